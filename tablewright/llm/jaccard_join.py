"""N-gram Jaccard join by T-occurrence search.

Documents are sets of distinct word shingles; two link when their Jaccard similarity is at least 3/4, and the result is the
smallest id that links lead to. All links between different sets count, and none is lost:

1. Copies. Equal sets are one class, named by a digest of the set; everything after works on classes.
2. First filter. In the order of shingle hashes, two sets that link have at least min(l(a), l(b)) of their common shingles
   among the first n - ceil(3n/4) + l(n) of each, l(n) = ceil(3n/20) + 1 (or all common ones, where they are fewer). Only these
   prefixes are shuffled; a class stays when enough of its prefix occurs in another class. Shingles that
   several classes of one task share are counted there, so a passage that everybody has is one row per task.
3. Frequencies. For the classes that stay, shingles are counted, those of one class alone are dropped, and a class with
   fewer than ceil(3n/4) left cannot link. The rest are ordered rare first.
4. Groups. Under a few random orders, classes with the same first shingle meet in blocks of bounded size and are
   searched there; links found give provisional components. This step only saves work.
5. Search. Links can now matter only between different components. Prefixes of length k - ceil(3n/4) + 1 of the rare-first order
   (k shingles are left of n) name, for every class, the blocks of other components that can hold a partner, under the bounds
   for sizes and positions. The class of the smaller component is the query, the block's classes are the index.

Both searches are DivideSkip: to reach T common shingles with some class, the lists of the query's shingles are split into the
L longest and the others; the short lists are merged with their counts, classes with at least T - L are
candidates, and these alone are looked up in the long lists by binary search.

Defined results: a null or empty text, or one without words, has n_shingles 0 and is its own component; a text of fewer words
than ``width`` is one shingle; rows without an id belong to their class but never name it (their component is null if nothing
names it); repeated rows stay, and an id on several texts ties nothing together but is counted for each; an empty table gives no
rows; further input columns, whatever their names, are ignored by ``link_classes`` and carried by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import digest_of, durable, few, lookup, of, signed, texts_of, window_hashes, without_rows, word_codes, word_hashes
from tablewright.llm.components import components

#: Classes per block, and queries per block and task.
BLOCK, QUERIES = 96, 512


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    words, counts = [], []
    for text in texts:
        own = text.encode().lower().split()  # bytes fold A to Z alone and split at \\x20 and \\x09-\\x0D alone
        words += own
        counts.append(len(own))
    hashes = word_hashes(*word_codes(words))
    windows = window_hashes(hashes, width)
    out, at = [], 0
    for n in counts:
        if n >= width:
            out.append(np.unique(windows[at : at + n - width + 1]))
        else:
            out.append(window_hashes(hashes[at : at + n], n) if n else np.empty(0, np.uint64))
        at += n
    return out


def digest(own: np.ndarray) -> int:
    """64 bits that name a set; the top bit makes Spark's long."""
    return xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63)


def base_rows(docs: DataFrame, width: int) -> DataFrame:
    """id, own (digest of the text), n, dig (of the set) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in texts_of(batch):
                sets = shingle_sets(texts, width)
                columns = [*(batch.column(i).slice(start, len(texts)) for i in (0, 2)), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "own", "n", "dig"])

    made = docs.select("id", "text", digest_of(F.col("text")).alias("own"))
    return made.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, own long, n long, dig long")


def prefix_rows(docs: DataFrame, width: int) -> DataFrame:
    """t, dig, c: c = 0 a shingle of a prefix, -1 one that several classes of the task have, above 0 hits counted already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in texts_of(batch):
                own: dict[int, np.ndarray] = {}
                for s in shingle_sets(texts, width):
                    if n := len(s):
                        own[digest(s)] = s[: min(n, n - (3 * n + 3) // 4 + -(-3 * n // 20) + 1)]
                if not own:
                    continue
                sizes = [len(s) for s in own.values()]
                tokens = np.concatenate([*own.values()])
                digs = np.repeat(np.fromiter(own, np.int64, len(own)), sizes)
                order = np.argsort(tokens, kind="stable")
                tokens, digs = tokens[order], digs[order]
                first = np.concatenate([[True], tokens[1:] != tokens[:-1]])
                group = np.cumsum(first) - 1
                several = np.bincount(group)[group] > 1
                hit, times = np.unique(digs[several], return_counts=True)
                marks = np.where(several[first], -1, 0)
                kept = np.argsort(order[first])  # class by class again, as equal neighbours compress
                columns = [np.concatenate([signed(tokens[first][kept]), hit]), np.concatenate([digs[first][kept], hit]), np.concatenate([marks[kept], times])]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2].astype(np.int32))], ["t", "dig", "c"])

    return docs.mapInArrow(run, "t long, dig long, c int")


def hit_rows(rows: DataFrame) -> DataFrame:
    """dig, c: how many prefix shingles another class has too, in parts."""

    def count(t: np.ndarray, dig: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = c > 0
        t0, d0, m0 = t[~known], dig[~known], c[~known]
        if not len(t0):
            return dig[known], c[known]
        first = np.flatnonzero(np.concatenate([[True], t0[1:] != t0[:-1]]))
        group = np.repeat(np.arange(len(first)), np.diff([*first, len(t0)]))
        shared = (np.minimum.reduceat(m0, first) < 0) | (np.minimum.reduceat(d0, first) < np.maximum.reduceat(d0, first))
        found = d0[shared[group] & (m0 == 0)]
        return np.concatenate([dig[known], found]), np.concatenate([c[known], np.ones(len(found), np.int32)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            own = [x.to_numpy(zero_copy_only=False) for x in batch.columns]
            if rest is not None:
                own = [np.concatenate(x) for x in zip(rest, own, strict=True)]
            if not len(own[0]):
                continue
            edge = np.searchsorted(own[0], own[0][-1], "left")  # the last shingle may go on in the next batch
            rest = [x[edge:] for x in own]
            dig, c = count(*(x[:edge] for x in own))
            yield pa.RecordBatch.from_arrays([pa.array(dig), pa.array(c.astype(np.int32))], ["dig", "c"])
        if rest is not None:
            dig, c = count(*rest)
            yield pa.RecordBatch.from_arrays([pa.array(dig), pa.array(c.astype(np.int32))], ["dig", "c"])

    return rows.repartition("t").sortWithinPartitions("t").mapInArrow(run, "dig long, c int")


def set_rows(docs: DataFrame, width: int) -> DataFrame:
    """id, dig, n, toks of every document with a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in texts_of(batch):
                every = shingle_sets(texts, width)
                held = [i for i, s in enumerate(every) if len(s)]
                sets = [every[i] for i in held]
                columns = [pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([signed(s) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([start + i for i in held], pa.int64())), *columns], ["id", "dig", "n", "toks"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, dig long, n long, toks array<long>")


class Index:
    """Inverted lists of some sets."""

    def __init__(self, sizes: np.ndarray, sets: list[np.ndarray]):
        self.sizes = sizes
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]  # each list is sorted by its members

    def search(self, size: int, own: np.ndarray) -> np.ndarray:
        """Members with which a set of ``size`` shingles (``own`` are those that matter) links."""
        low, high = np.searchsorted(self.flat, own, "left"), np.searchsorted(self.flat, own, "right")
        length = high - low
        filled = length > 0
        low, high, length = low[filled], high[filled], length[filled]
        least = (3 * size + 3) // 4
        if len(low) < least:
            return np.empty(0, np.int64)
        # DivideSkip's number of long lists, from the longest list's length.
        long = min(least - 1, int(least / (0.02 * np.log2(length.max() + 1) + 1)), int((length > 4).sum()))
        order = np.argsort(length, kind="stable")
        short, longs = order[: len(order) - long], order[len(order) - long :]
        steps = length[short]
        places = np.repeat(low[short] - np.concatenate([[0], np.cumsum(steps)[:-1]]), steps) + np.arange(steps.sum())
        merged = np.sort(self.owner[places], kind="stable")  # the short lists merged
        first = np.flatnonzero(np.concatenate([[True], merged[1:] != merged[:-1]])) if len(merged) else np.empty(0, np.int64)
        members, counts = merged[first], np.diff([*first, len(merged)])
        enough = counts >= least - long
        members, counts = members[enough], counts[enough]
        for i in longs:
            if not len(members):
                break
            own_list = self.owner[low[i] : high[i]]
            at = np.searchsorted(own_list, members)
            counts = counts + (own_list[np.minimum(at, len(own_list) - 1)] == members)
        return members[7 * counts >= 3 * (size + self.sizes[members])]


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(kind, dig, n, toks) of every run of equal g in sorted batches with g, kind, dig, n, toks."""

    def joined(parts):
        kind, dig, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
        return kind, dig, n, [s for p in parts for s in p[3]]

    pending, key = [], None
    for batch in batches:
        g, kind, dig, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(g):
            continue
        lists = batch.column(4)
        flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy(zero_copy_only=False)
        offsets = offsets - offsets[0]
        edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for a, b in zip(edges, edges[1:], strict=False):
            if pending and g[a] != key:
                yield joined(pending)
                pending = []
            key = g[a]
            pending.append((kind[a:b], dig[a:b], n[a:b], [flat[offsets[i] : offsets[i + 1]].copy() for i in range(a, b)]))
    if pending:
        yield joined(pending)


def search_groups(rows: DataFrame) -> DataFrame:
    """a, b: links found within groups of equal g. Kind 0 is indexed, kind 1 asks; without kind 1 all ask.

    Links that join nothing new within the group are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, dig, n, sets in groups(batches):
            asked = np.flatnonzero(kind == 1)
            indexed = np.flatnonzero(kind == 0)
            if not len(indexed) or len(dig) < 2:
                continue
            index = Index(n[indexed], [sets[i] for i in indexed])
            root = list(range(len(dig)))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            links = []
            for i in asked if len(asked) else indexed:
                for j in indexed[index.search(int(n[i]), sets[i])]:
                    a, b = find(int(i)), find(int(j))
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        links.append((dig[i], dig[j]))
            if links:
                a, b = zip(*links, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select("g", "kind", "dig", "n", "toks").repartition("g").sortWithinPartitions("g", "kind").mapInArrow(run, "a long, b long")


def candidates(docs: DataFrame, base: DataFrame, width: int) -> DataFrame:
    """dig, n, toks (rare first, each in two classes at least) of all classes that can link."""
    hits = hit_rows(prefix_rows(docs, width)).groupBy("dig").agg(F.sum("c").alias("hits"))
    classes = base.filter("n > 0").groupBy("dig").agg(F.min("id").alias("rep"), F.first("n").alias("n"))
    need = F.least(F.ceil(F.col("n") * 0.1125) + 1, F.floor((3 * F.col("n") + 3) / 4))
    stay = durable(classes.join(hits, "dig").filter(F.col("hits") >= need).select("dig", "rep"))
    texts = docs.join(few(stay.select("rep").distinct()), docs["id"].eqNullSafe(F.col("rep")), "left_semi")
    made = set_rows(texts, width)
    own = stay.withColumnRenamed("dig", "own")
    sets = made.join(few(own), made["id"].eqNullSafe(own["rep"]) & (made["dig"] == own["own"]), "left_semi").drop("id")
    again = base.join(few(own), base["id"].eqNullSafe(own["rep"]) & (base["dig"] == own["own"]), "left_semi").groupBy("id", "dig").count().filter("count > 1")
    sets = durable(sets if again.isEmpty() else sets.dropDuplicates(["dig"]))
    each = sets.select("dig", F.explode("toks").alias("t"))
    often = each.groupBy("t").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    ranked = each.join(often, "t").groupBy("dig").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "t"))), lambda x: x["t"]).alias("toks"))
    return durable(ranked.join(sets.select("dig", "n"), "dig").filter(4 * F.size("toks") >= 3 * F.col("n")).select("dig", "n", "toks"))


def provisional(able: DataFrame, rounds: int) -> DataFrame:
    """Links found among classes with the same smallest shingle under random orders."""
    smallest = [F.struct(F.lit(r).alias("r"), F.array_min(F.transform("toks", _salted(r))).alias("key")) for r in range(rounds)]
    keyed = able.select("dig", F.explode(F.array(*smallest)).alias("k")).select("dig", "k.r", "k.key")
    crowded = keyed.groupBy("r", "key").agg(F.count(F.lit(1)).alias("size"))
    parts = crowded.filter(F.col("size") > 1).select("r", "key", F.ceil(F.col("size") / BLOCK).alias("parts"))
    placed = durable(keyed.join(few(parts), ["r", "key"]).select("dig", F.xxhash64("r", "key", F.pmod(F.xxhash64("dig", "r"), "parts")).alias("g")))
    return search_groups(able.join(placed, "dig").withColumn("kind", F.lit(0)))


def _salted(r: int):
    return lambda t: F.xxhash64(t, F.lit(r))


def linked_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, rounds: int = 2) -> DataFrame:
    """id, own (digest of the text), n, name and keep (structs of unnamed, id, own) of every document with shingles or without.

    ``name`` is the smallest id of the component, ``keep`` the id and text of its first document by id, those without one last.
    """
    plain = docs.select(of(docs, id_col).alias("id"), of(docs, text_col).cast("string").alias("text"))
    base = durable(base_rows(plain, width))
    able = candidates(plain, base, width)
    links = durable(provisional(able, rounds))
    labels = components(links)
    found = able.join(labels.withColumnRenamed("node", "dig"), "dig", "left").withColumn("comp", F.coalesce("component", "dig")).drop("component")

    # Blocks: at most about BLOCK classes of one component.
    sizes = found.groupBy("comp").agg(F.count(F.lit(1)).alias("csize")).filter("csize > 1")
    sizes = durable(sizes)
    mine = found.select("dig", "n", "comp", F.size("toks").alias("k"), F.slice("toks", 1, (F.size("toks") - F.floor((3 * F.col("n") + 3) / 4) + 1).cast("int")).alias("prefix"))
    mine = lookup(mine, sizes, "comp", "left").fillna(1, ["csize"])
    block = F.xxhash64("comp", F.pmod(F.xxhash64("dig"), F.ceil(F.col("csize") / BLOCK)))
    mine = durable(mine.withColumn("block", block))
    posts = mine.select("dig", "n", "k", "comp", "csize", "block", F.posexplode("prefix").alias("pos", "t"))
    held = posts.groupBy("t", "block").agg(
        F.first("comp").alias("bcomp"), F.first("csize").alias("bsize"), F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.max(F.col("k") - F.col("pos")).alias("rest")
    ).withColumnRenamed("block", "where")
    smaller = (F.col("csize") < F.col("bsize")) | ((F.col("csize") == F.col("bsize")) & (F.col("comp") < F.col("bcomp")))
    partner = F.greatest(F.col("n_low"), F.ceil(F.col("n") * 0.75))
    fits = (4 * F.col("n_high") >= 3 * F.col("n")) & (3 * F.col("n_low") <= 4 * F.col("n"))
    reach = 7 * F.least(F.col("k") - F.col("pos"), F.col("rest")) >= 3 * (F.col("n") + partner)
    asks = posts.join(held, "t").filter((F.col("comp") != F.col("bcomp")) & smaller & fits & reach).select("dig", "where").distinct()
    asks = durable(asks)
    crowd = durable(asks.groupBy("where").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("parts")))
    queries = lookup(asks, crowd, "where").select("dig", F.xxhash64("where", F.pmod(F.xxhash64("dig"), "parts")).alias("g"), F.lit(1).alias("kind"))
    members = lookup(mine.select("dig", F.col("block").alias("where")), crowd, "where").select("dig", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p"), "where")
    members = members.select("dig", F.xxhash64("where", "p").alias("g"), F.lit(0).alias("kind"))
    more = durable(search_groups(found.select("dig", "n", "toks").join(queries.unionByName(members), "dig")))

    # Components of components, and their names. A class of many links loads no task: classes are looked up once each.
    ends = found.select("dig", "comp").join(more.select(F.explode(F.array("a", "b")).alias("dig")).distinct(), "dig")
    ends = durable(ends)
    over = lookup(lookup(more, ends.toDF("a", "ca"), "a"), ends.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
    last = durable(components(over).toDF("comp", "top"))
    first = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "own"))
    names = base.filter("n > 0").groupBy("dig").agg(first.alias("rep"))
    final = lookup(found.select("dig", "comp"), last, "comp", "left").select("dig", F.coalesce("top", "comp").alias("comp"))
    able_reps = durable(names.join(few(durable(final)), "dig"))  # other classes are their own component
    lowest = durable(able_reps.groupBy("comp").agg(F.min("rep").alias("keep")))
    renamed = few(durable(lookup(able_reps, lowest, "comp").select("dig", "keep")))
    named = names.join(renamed, "dig", "left").select("dig", F.coalesce("keep", "rep").alias("keep"))
    named = durable(named)  # so that the last join has a shuffle of its own on either side, of which Spark splits hot texts
    return base.join(named, "dig", "left").select("id", "own", "n", F.when(F.col("n") > 0, F.col("keep")).alias("keep"))


def link_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    name = F.when(F.col("n") > 0, F.col("keep.id")).otherwise(F.col("id"))
    return linked_rows(docs, **options).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), name.alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Of every component the first document by id, with its columns as they are; those without an id come last.

    A row goes by its own id and text. Of rows that repeat both one stays; texts without shingles all stay.
    """
    linked = durable(linked_rows(docs, id_col=id_col, text_col=text_col, **options))
    other = F.col("keep").isNotNull() & ~(F.col("keep.id").eqNullSafe(F.col("id")) & (F.col("keep.own") == F.col("own")))
    out = without_rows(docs, linked.filter(other).select("id", F.col("own").alias("dig")), id_col, text_col)
    again = linked.filter("n > 0").groupBy("id", "own").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    again = durable(again.select(F.col("id").alias("again_id"), F.col("own").alias("again_own")))
    if again.isEmpty():
        return out
    same = of(out, id_col).eqNullSafe(again["again_id"]) & (digest_of(of(out, text_col)) == again["again_own"])
    one = out.join(few(again), same, "left_semi").dropDuplicates([id_col, text_col])
    return out.join(few(again), same, "left_anti").unionByName(one)
