"""Quality rules by distribution divergence.

A document's character classes and its common words, as shares, are compared with references of the languages by the
Jensen-Shannon distance. The references are averages over all documents of a language in the corpus that pass the base
rules and have ``min_words``, and every language with one such document has a reference, however small its part of the table; a
document is held against the reference nearest to it, so a wrong language label does no harm. The references are a table of
their own, of which ``REFERENCE_ROWS`` at a time are on the driver and in the workers. Two
minimum lengths guard the comparison: below ``min_words`` no verdict is made, and the limits widen with the
sampling noise of short texts.

Without a language column no references are made and only the base rules decide.

Defined results: a null or empty text has no words and fails the base rules; a null language makes no reference of its
own; an empty table gives no rows; repeated rows stay, and rows without an id or with the same id are judged each by its
own text; further input columns, whatever their names, are carried by ``filter_quality`` and ignored by ``quality_report``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import digest_of, durable, mix, of, texts_of, window_hashes, without_rows, word_codes, word_hashes

# Frequent function words of English, German, French and Spanish, in lower case.
COMMON_WORDS = """
the of and to a in that is was for it with as be on by at this from are or an have not he had his but you they
der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach bei
de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec ou son
de la que el en y a los se del las un por con no una su para es al lo como más pero sus le ha me si
""".split()
WORDS = {w.encode(): i for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}

# The classes of ASCII characters; others than these and ASCII letters count as "other", and characters beyond ASCII as one class.
CLASSES = {"digit": "0123456789", "stop": ".,;:", "mark": "!?", "quote": "'\"-()", "blank": " \t", "line": "\n", "bar": "|", "symbol": "#*$%&<>=+_~^@/\\[]{}`"}
N_CLASSES = 12
#: References that documents are held against at a time; about 1.5 KB each.
REFERENCE_ROWS = 1_000


def _class_table() -> np.ndarray:
    table = np.full(256, 11, np.int64)
    table[ord("a") : ord("z") + 1] = 0
    table[ord("A") : ord("Z") + 1] = 1
    for k, chars in enumerate(CLASSES.values()):
        for c in chars:
            table[ord(c)] = 2 + k
    table[0xC0:] = 10  # the first byte of a longer character
    table[0x80:0xC0] = 12  # its other bytes, not counted
    return table


TABLE = _class_table()


def _features(texts: list[str]) -> list[list]:
    """Columns of base counts and of both histograms for some texts."""
    raw = [t.encode() for t in texts]
    words, counts = [], []
    for b in raw:
        own = b.split()  # bytes split at exactly the blanks \x20 and \x09-\x0D
        words += own
        counts.append(len(own))
    n = np.array(counts, np.int64)
    edges = np.concatenate([[0], np.cumsum(n)])
    codes, distinct = word_codes(words)
    hashes = word_hashes(codes, distinct)
    owner = np.repeat(np.arange(len(raw)), n)

    # Words in windows of eight that occur twice or more in their text.
    repeat = np.zeros(len(raw), np.int64)
    windows = window_hashes(hashes, 8)
    if len(windows):
        inside = owner[: len(windows)] == owner[7:]
        keys = np.where(inside, mix(windows ^ mix(owner[: len(windows)].astype(np.uint64) + np.uint64(1))), np.uint64(0))
        order = np.argsort(keys, kind="stable")
        same = np.zeros(len(keys), bool)
        equal = keys[order[1:]] == keys[order[:-1]]
        same[order[1:]] |= equal
        same[order[:-1]] |= equal
        same &= inside
        cover = np.zeros(len(codes) + 1, np.int64)
        np.add.at(cover, np.flatnonzero(same), 1)
        np.subtract.at(cover, np.flatnonzero(same) + 8, 1)
        covered = np.cumsum(cover[:-1]) > 0
        repeat = np.bincount(owner[covered], minlength=len(raw))

    place = np.fromiter((WORDS.get(w.lower().strip(b".,;:!?"), len(WORDS)) for w in distinct), np.int64, len(distinct))
    common = np.bincount(owner * (len(WORDS) + 1) + place[codes], minlength=len(raw) * (len(WORDS) + 1)) if len(codes) else np.zeros(len(raw) * (len(WORDS) + 1), np.int64)
    classes = [np.bincount(TABLE[np.frombuffer(b, np.uint8)], minlength=13)[:N_CLASSES].tolist() for b in raw]
    chars, symbols, lines = [], [], []
    for t, b in zip(texts, raw, strict=True):
        chars.append(len(t) - sum(map(t.count, " \t\n\v\f\r")))
        symbols.append(sum(map(t.count, "#*$%&|<>")))
        if "\n" in t:
            own = [x for x in b.split(b"\n") if x.strip()]
            lines.append(len(own) - len(set(own)))
        else:
            lines.append(0)
    return [n.tolist(), chars, symbols, lines, repeat.tolist(), classes, common.reshape(len(raw), -1).tolist()]


FEATURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<int>, common array<int>"


def measure(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """id, dig (of the text), lang, the base counts and both histograms of every document."""
    names = ["id", "dig", "lang", *[x.split()[0] for x in FEATURES.split(", ")]]
    kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in texts_of(batch, 3):
                own = [batch.column(i).slice(start, len(texts)) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, k) for x, k in zip(_features(texts), kinds, strict=True))], names)

    text, name = of(docs, text_col).cast("string"), of(docs, id_col).alias("id")
    lang = of(docs, lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    found = docs.select(name, digest_of(text).alias("dig"), lang.alias("lang"), text.alias("text"))
    return found.mapInArrow(run, f"id {found.schema['id'].dataType.simpleString()}, dig long, lang string, {FEATURES}")


def base_failed():
    """Too few words, or too many in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def references(measured: DataFrame, min_words: int) -> DataFrame:
    """Mean shares of classes and common words of every language with a sound document."""
    sound = measured.filter(~base_failed() & (F.col("n_words") >= min_words) & F.col("lang").isNotNull())
    total = F.aggregate("classes", F.lit(0), lambda a, x: a + x)
    means = [F.avg(F.col("classes")[i] / total).alias(f"c{i}") for i in range(N_CLASSES)]
    means += [F.avg(F.col("common")[i] / F.col("n_words")).alias(f"w{i}") for i in range(len(WORDS) + 1)]
    return durable(sound.groupBy("lang").agg(*means).orderBy("lang"))


def blocks(refs: DataFrame) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """The references, REFERENCE_ROWS at a time; collected at once only where they are counted to be few."""
    rows = iter(refs.collect()) if refs.count() <= REFERENCE_ROWS else refs.toLocalIterator()
    while block := list(islice(rows, REFERENCE_ROWS)):
        yield [(values[:N_CLASSES], values[N_CLASSES:]) for values in (np.array(row[1:], float) for row in block)]


def distances(histograms: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (base 2, 0 to 1) of rows of counts from a reference distribution."""
    sums = histograms.sum(1, keepdims=True)
    p = np.divide(histograms, sums, out=np.zeros(histograms.shape), where=sums > 0)
    q = np.broadcast_to(reference / max(reference.sum(), 1e-300), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.sqrt(np.clip((left + right) / 2, 0, 1))


def compare(state: DataFrame, refs: list[tuple[np.ndarray, np.ndarray]], last: bool, max_class: float, max_word: float, max_both: float) -> DataFrame:
    """``state`` with class_distance, word_distance and over of the nearest of ``refs`` where that is nearer; the ``last`` time without histograms."""
    names = [c for c in state.columns if not (last and c in ("classes", "common"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, column = batch.num_rows, lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023
            words = column("n_words").to_numpy(zero_copy_only=False).astype(float)
            grid = [np.array(column(x).flatten().to_numpy(zero_copy_only=False), float).reshape(n, -1) for x in ("classes", "common")]
            best = np.stack([column(x).to_numpy(zero_copy_only=False) for x in ("class_distance", "word_distance")])
            over = column("over").to_numpy(zero_copy_only=False).copy()
            for ref in refs:
                own = np.stack([distances(g, r) for g, r in zip(grid, ref, strict=True)])
                slack = 0.5 / np.sqrt(np.maximum(words, 1))
                excess = np.max([own[0] - max_class - slack, own[1] - max_word - 2 * slack, own.sum(0) - max_both - 3 * slack], axis=0)
                better = excess < over
                best[:, better], over[better] = own[:, better], excess[better]
            found = dict(zip(("class_distance", "word_distance", "over"), map(pa.array, (*best, over)), strict=True))
            yield pa.RecordBatch.from_arrays([found[x] if x in found else column(x) for x in names], names)

    return state.mapInArrow(run, state.select(*names).schema)


def judge(measured: DataFrame, refs: DataFrame, min_words: int, max_class: float, max_word: float, max_both: float) -> DataFrame:
    """Adds class_distance, word_distance (null below ``min_words``) and verdict.

    The limits, of each distance and of their sum, rise by a term that falls with the root of the length.
    """
    kept = ["id", "dig", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    state = measured.select(*kept, "classes", "common", *(F.lit(float("inf")).alias(x) for x in ("class_distance", "word_distance", "over")))
    every = blocks(refs)
    block, any_refs = next(every, []), False
    while block:
        any_refs, further = True, next(every, [])
        state = compare(state, block, not further, max_class, max_word, max_both)
        state, block = durable(state) if further else state, further
    guarded = (F.col("n_words") < min_words) | F.lit(not any_refs)
    shown = (F.when(~guarded, F.col(x)).alias(x) for x in ("class_distance", "word_distance"))
    return state.select(*kept, *shown, (guarded | (F.col("over") <= 0)).alias("verdict"))


def judged_rows(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    min_words: int = 50, max_class: float = 0.28, max_word: float = 0.33, max_both: float = 0.42,
) -> DataFrame:
    """id, dig, the base counts, base_failed, kept and both distances of every document."""
    measured = durable(measure(docs, id_col, text_col, lang_col))
    judged = judge(measured, references(measured, min_words), min_words, max_class, max_word, max_both)
    return judged.select(
        "id", "dig", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~base_failed() & F.col("verdict")).alias("kept"), "class_distance", "word_distance",
    )


def quality_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and both distances of every document."""
    return judged_rows(docs, **options).drop("dig").withColumnRenamed("id", "doc_id")


def filter_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are kept, with their columns as they are. A row goes by its own text, whatever rows share its id."""
    bad = judged_rows(docs, id_col=id_col, text_col=text_col, **options).filter(~F.col("kept"))
    return without_rows(docs, bad, id_col, text_col)
