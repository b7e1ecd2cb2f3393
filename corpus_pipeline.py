"""A training corpus in five stages: quality rules, near duplicates, benchmark leaks, secrets, token ids.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. The first three drop documents, the
fourth masks secrets inside texts, the last returns ids, token ids and decoded texts. Between stages the documents are
written as Parquet to the shared folder and read again, so a lost executor costs no earlier stage.

Defined results, for every stage: an empty table stays one; rows without an id, or with the id of another row, are judged each by
its own text, and none goes because another one does; extra columns are carried, whatever their names; repeated rows are alike to the
first stage, the third and the fourth, and the second keeps one of them. Null and empty texts go in the first stage, as they have too few words;
a stage that gets them by itself leaves them as they are, and the last gives them the end id alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, jaccard_join, quality, secret_scan, sp_codec
from tablewright.llm.common import ready, shared_dir
from tablewright.llm.registry import tokenizer
from tablewright.session import read_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or diverge from their languages go."""
    ready(spark)
    return quality.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    ready(spark)
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    ready(spark)
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars follows where it is there."""
    ready(spark)
    out = secret_scan.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests, ids and decoded text of every document that is left."""
    ready(spark)
    return sp_codec.encode_texts(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("SentencePiece encoding and decoding", token_ids),
]

#: SQL can't express the trained references of the first stage or the encoder of the last; tests hold both against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
