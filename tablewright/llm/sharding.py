"""Sharding by sampled splitters.

Records are ordered by (hash of the text, hash of the id, a number of their own), so equal texts lie side by side. A size-weighted sample
of these keys gives quantile boundaries, and records are range-partitioned by them. Ranges that are overfull, or in which
the edge of a shard lies, are subdivided at a second sample drawn inside them; of all splitters those nearest to the
equal shares of the bytes become the shards' edges (law ``bytes``: sizes near equal). So an edge is a key, and a record's shard is
found by a search among ``shards - 1`` of them.

A group of equal texts that weighs at most ``whole_group`` of a shard is never cut, as splitters inside it are moved to its start; larger
ones are cut between two of their records, so one hot text cannot overfill a shard.

Slots number the records of a shard from 0: records fall into groups of about GROUP rows by the leading bits of the
text's hash, texts of more rows than that into several, and a record's slot is its place in its group behind all groups before.

The driver holds two samples of about SAMPLE keys, the bytes of as many ranges and the texts heavier than ``whole_group`` of a shard, of
which there are fewer than ``shards / whole_group``. None of these grows with the data.

Defined results: a null text weighs ``overhead`` bytes and has checksum 0 (that of no bytes); null texts form a group of their own; ids
of any type, null ones too, are records like others; repeated rows are separate records with slots of their own; an empty table
gives no rows; input columns beside id and text are ignored, whatever their names.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import durable, few, lookup, of

#: Keys that one sample holds, and rows that are numbered together.
SAMPLE, GROUP = 20_000, 100_000
LEAST = -(1 << 63)


def _keys(docs: DataFrame, id_col: str, text_col: str, overhead: int) -> DataFrame:
    text, name = of(docs, text_col).cast("string"), of(docs, id_col)
    return docs.select(
        name.alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(name).alias("k"), F.monotonically_increasing_id().alias("u"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long").alias("crc"),
    )


def _range_of(splitters: np.ndarray):
    """A vectorised search: how many of the sorted splitters (h, k, u) are not above a key."""
    hs, ks, us = splitters.T.copy()

    def inside(low: int, high: int, k: np.ndarray, u: np.ndarray) -> np.ndarray:
        first, last = np.searchsorted(ks[low:high], k, "left"), np.searchsorted(ks[low:high], k, "right")
        for a, b in {*zip(first[last > first].tolist(), last[last > first].tolist(), strict=True)}:
            own = (first == a) & (last == b)
            first[own] = a + np.searchsorted(us[low + a : low + b], u[own], "right")
        return low + first

    @F.pandas_udf("int")
    def search(h: pd.Series, k: pd.Series, u: pd.Series) -> pd.Series:
        h, k, u = (x.to_numpy(np.int64) for x in (h, k, u))
        out, high = np.searchsorted(hs, h, "left"), np.searchsorted(hs, h, "right")
        for a, b in {*zip(out[high > out].tolist(), high[high > out].tolist(), strict=True)}:  # the few texts that are splitters themselves
            own = (out == a) & (high == b)
            out[own] = inside(a, b, k[own], u[own])
        return pd.Series(out.astype(np.int32))

    return search


def _sampled(keys: DataFrame, total: float, mean: float, seed: int) -> np.ndarray:
    """About SAMPLE distinct keys, drawn with a chance in proportion to size plus mean size, sorted.

    The draw depends on text and id alone, but for rows that repeat both very often. Keys of texts that stay whole are those of their start.
    """
    chance = (F.col("size") + F.lit(mean)) * F.lit(SAMPLE / max(2.0 * total, 1.0))
    draw = (F.pmod(F.xxhash64("h", "k", F.when(F.col("repeats").isNotNull(), F.col("u")), F.lit(seed)), F.lit(1 << 40)) + F.lit(0.5)) / F.lit(float(1 << 40))
    own = [F.col("h"), *(F.when(F.col("heavy"), F.col(x)).otherwise(F.lit(LEAST)).alias(x) for x in ("k", "u"))]
    found = keys.filter(draw < chance).select(*own).toPandas().to_numpy(np.int64).reshape(-1, 3)
    return np.unique(found, axis=0)  # sorted by column


def _sizes(placed: DataFrame, count: int) -> np.ndarray:
    """Bytes of every one of ``count`` ranges."""
    out = np.zeros(count, np.int64)
    for x in placed.groupBy("part").agg(F.sum("size").alias("bytes")).collect():
        out[x.part] = x.bytes
    return out


def _edges(keys: DataFrame, shards: int, ranges: int, total: int, rows: int, seed: int) -> np.ndarray:
    """The keys at which a new shard begins, from the splitters of two samples."""
    drawn = _sampled(keys, total, total / rows, seed)
    splitters = np.unique(drawn[(np.arange(1, ranges) * len(drawn)) // ranges], axis=0) if len(drawn) else drawn
    placed = keys.withColumn("part", _range_of(splitters)("h", "k", "u"))
    sizes = _sizes(placed, len(splitters) + 1)
    ends = np.cumsum(sizes)
    wanted = np.arange(1, shards) * total / shards
    coarse = {*np.searchsorted(ends, wanted, "left").tolist(), *np.flatnonzero(sizes > 2 * total / ranges).tolist()}
    inner = placed.filter(F.col("part").isin(sorted(coarse)))
    weight = int(sum(sizes[p] for p in coarse))
    fine = _sampled(inner.drop("part"), weight, total / rows, seed + 1)
    finer, where = np.unique(np.concatenate([splitters, fine]), axis=0, return_inverse=True)
    where = where.reshape(-1)[: len(splitters)]
    again = inner.drop("part").withColumn("part", _range_of(finer)("h", "k", "u"))
    measured = _sizes(again, len(finer) + 1)
    for p, size in enumerate(sizes):  # ranges that were not subdivided are known
        if p not in coarse:
            measured[where[p - 1] + 1 if p else 0] = size
    before = np.cumsum(measured)[:-1]  # bytes in front of every splitter
    if not len(before):
        return finer
    right = np.minimum(np.searchsorted(before, wanted), len(before) - 1)
    left = np.maximum(right - 1, 0)
    return finer[np.where(np.abs(before[left] - wanted) <= np.abs(before[right] - wanted), left, right)]


def _marked(keys: DataFrame, limit: float) -> DataFrame:
    """``keys`` with heavy (the text may be cut), parts (groups of its rows, else null) and repeats (groups of rows that share text and id, else null)."""
    groups = lambda n: F.when(n > GROUP, F.ceil(n / GROUP))
    texts = keys.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).filter((F.col("n") > GROUP) | (F.col("bytes") > limit))
    texts = durable(texts.select("h", (F.col("bytes") > limit).alias("heavy"), groups(F.col("n")).alias("parts")))
    twins = lookup(keys.select("h", "k"), texts.filter("parts IS NOT NULL").select("h"), "h").groupBy("h", "k").agg(groups(F.count(F.lit(1))).alias("repeats"))
    twins = few(durable(twins.filter("repeats IS NOT NULL")))
    marked = lookup(keys, texts, "h", "left").join(twins, ["h", "k"], "left")
    return marked.withColumn("heavy", F.coalesce("heavy", F.lit(False)))


def _numbered(placed: DataFrame, rows: int) -> DataFrame:
    """Adds slot, the place of every row in its shard, by groups of bounded size."""
    bits = ceil(log2(rows / GROUP)) if rows > GROUP else 0
    leading = F.shiftright("h", 64 - bits) if bits else F.lit(0).cast("long")
    part = F.when(F.col("parts").isNotNull(), F.pmod(F.col("k"), F.col("parts"))).otherwise(F.lit(-1)).cast("long")
    twin = F.when(F.col("repeats").isNotNull(), F.pmod(F.xxhash64("u"), F.col("repeats"))).otherwise(F.lit(-1)).cast("long")
    group = ["shard", "leading", "text", "part", "twin"]
    own = F.when(F.col("parts").isNotNull(), F.col("h")).otherwise(F.lit(LEAST))
    grouped = placed.select("id", "h", "k", "u", "size", "crc", "shard", leading.alias("leading"), own.alias("text"), part.alias("part"), twin.alias("twin"))
    counts = grouped.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("shard").orderBy(*group[1:]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = few(durable(counts.withColumn("before", F.sum("n").over(order) - F.col("n")).drop("n")))  # one row for about GROUP records
    place = F.row_number().over(Window.partitionBy(*group).orderBy("h", "k", "u")) - 1
    return grouped.withColumn("place", place).join(before, group).withColumn("slot", (F.col("place") + F.col("before")).cast("long"))


def assign_shards(
    docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8,
    ranges_per_shard: int = 16, whole_group: float = 0.03, seed: int = 7,
) -> DataFrame:
    """One row per record: id, size, crc, shard (0 to shards-1) and slot (gapless from 0 in its shard). Only keys and sizes are shuffled, never texts."""
    keys = durable(_keys(docs, id_col, text_col, overhead))
    total, rows = keys.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not rows:
        return keys.select("id", "size", "crc", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    keys = durable(_marked(keys, whole_group * total / shards))
    edges = _edges(keys, shards, shards * ranges_per_shard, total, rows, seed)
    placed = keys.withColumn("shard", _range_of(edges)("h", "k", "u"))
    return _numbered(durable(placed), rows).select("id", "size", "crc", "shard", "slot")


def shard_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    out = assign_shards(docs, **options)
    return out.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
