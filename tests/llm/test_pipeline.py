"""The pipeline against its stages by brute force, and the registry."""

from __future__ import annotations

import collections

import public_tokenizers
import sentencepiece

import corpus_pipeline
from tablewright.llm import quality, registry, secret_scan
from tests import oracle
from tests.conftest import SF
from tests.llm.test_operators import component_truth, leaks, quality_counts


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.quality_rules(spark, docs, SF)
    assert first.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in first.collect()]
    assert not any(quality_counts(t)[-1] for _, t in kept)

    second = corpus_pipeline.near_duplicates(spark, first, SF)
    truth = component_truth(kept)
    assert {r.doc_id for r in second.collect()} == {k for k, _, c in truth if k == c} and second.columns == docs.columns

    third = corpus_pipeline.decontamination(spark, second, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, _ in leaks([(r.doc_id, r.text) for r in second.collect()], items)}
    assert {r.doc_id for r in third.collect()} == {r.doc_id for r in second.collect()} - bad and third.columns == docs.columns

    fourth = corpus_pipeline.secrets(spark, third, SF)
    assert fourth.columns == docs.columns and fourth.schema == docs.schema
    assert secret_scan.secret_report(fourth).filter("spans != ''").count() == 0
    assert all(r.n_chars == len(r.text) for r in fourth.collect())

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = collections.Counter((r.doc_id, tuple(model.encode(r.text, add_eos=True))) for r in fourth.collect())
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, SF).collect()) == expected


def test_stages_judge_rows_by_their_own_texts(spark):
    """Null and shared ids, null, empty and repeated rows, odd columns: each stage against what its operator says of every row alone."""
    sample = spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en'").orderBy("doc_id").limit(60).collect()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(2).collect()]
    texts = list(dict.fromkeys(r.text for r in sample if not quality_counts(r.text)[-1]))
    texts += [None, "", "bad " * 40, "\u00e9 " + items[0] + " tail", texts[0], "x password=e3b3ed3cc8548923d6 " + texts[1]]
    rows = [(None if i % 3 == 0 else i % 5, t, "en", "s", i, f"c{i}") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` string").repartition(3)
    first = corpus_pipeline.quality_rules(spark, docs, SF)
    alone = docs.selectExpr("n_chars AS doc_id", "text", "lang")  # the same texts under ids of their own
    kept = {r.doc_id for r in quality.quality_report(alone).filter("kept").collect()}
    assert {r.n_chars for r in first.collect()} == kept and first.columns == docs.columns
    second = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    order = sorted(range(len(texts)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    groups = {i: c for i, _, c in component_truth([(i, t) for i, t in enumerate(texts)])}
    named = {min((i for i in order if groups[i] == c), key=lambda i: (rows[i][0] is None, rows[i][0] or 0)) for c in groups.values()}
    assert len(second) == len(named) and {groups[r.n_chars] for r in second} == set(groups.values())
    third = {r.n_chars for r in corpus_pipeline.decontamination(spark, docs, SF).collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert third == set(range(len(texts))) - {i for i, _ in leaks(list(enumerate(texts)), bench)} and len(third) < len(texts)
    fourth = {r["a.b"]: r.text for r in corpus_pipeline.secrets(spark, docs, SF).collect()}
    assert len(fourth) == len(texts) and "[SECRET]" in fourth[f"c{len(texts) - 1}"] and all(fourth[f"c{i}"] is None for i, t in enumerate(texts) if t is None)
    assert corpus_pipeline.token_ids(spark, docs, SF).count() == len(texts)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_registered_queries_equal_their_sql(spark):
    queries, sql = registry.queries(), registry.oracle_sql()
    assert {n.split("_")[0] for n in queries} == {*(f"op{n}" for n in range(1, 11)), "pipeline"} and sql.keys() <= queries.keys()
    for name, text in sql.items():
        assert oracle.given(queries[name](spark, SF)) == oracle.expected(SF, text), name
