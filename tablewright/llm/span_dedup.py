"""Substring dedup by sliding sentence spans.

A text is cut into sentences (at ``.``, ``!`` or ``?`` with a blank behind, and at line ends), and these into pieces at
places that the words around them choose: of every ``piece // 2`` consecutive gaps between words of a sentence the one with
the least hash is cut. So pieces have at most ``piece // 2`` words, and a passage is cut alike wherever it stands, alone, without
stops, or inside a longer sentence, but for that many words at either end; any ``2 * (piece // 2) + least_words`` words in a
row that two texts share (line ends included) have a run in common. From every sentence or piece, and up to every one, the run of the fewest
consecutive ones that are at least two and have ``least_words`` words is hashed. A run depends on its own words alone, so a
passage gives the same runs wherever it stands, and they cover all that the longer runs inside it would. Runs are joined
globally; of each the first place (smallest id, then position) stays, and in all others the sentences it covers are removed.

Runs are named by 64 bits of a hash, and not compared word by word.

Counts of a hash are combined before the shuffle, and only hashes that occur twice are joined back, so a passage that a
third of all texts share costs one row per task in the first shuffle; its second is a plain join that Spark
can split.

Defined results: a null or empty text has no sentences; an empty table gives no rows; rows without an id are never the first
place unless there is no other, and are reported under the null id; rows that share an id count each by its own text, as do rows
without one, and the first place of a run is one (id, start), or (text, start) without an id, so an exact repeat of a row keeps both; letters' case and
the kind of blanks don't matter; very long texts and many spans cost in proportion; further input columns, whatever their
names, are ignored by ``repeated_spans`` and carried by ``remove_repeats``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import digest_of, durable, mix, of, signed, texts_of, word_codes, word_hashes
from tablewright.llm.texts import replaced

SENTENCE = re.compile(r"(?:[^.!?\n]|[.!?]+(?=[^\s.!?]))*(?:[.!?]+(?=\s|$)|\n|$)")


def cut_places(size: np.ndarray, hashes: np.ndarray, window: int) -> np.ndarray:
    """Which words begin a unit: the first of every sentence, and those the words around them choose.

    ``size`` has the words of every sentence, ``hashes`` those of all words. Of every ``window`` consecutive gaps between
    words of a sentence the one with the least hash of the words beside it is cut, the last one where several are equal.
    """
    begins = np.zeros(len(hashes), bool)
    edges = np.concatenate([[0], np.cumsum(size)])
    begins[edges[:-1]] = True
    if len(hashes) <= window:
        return begins
    gaps = mix(hashes[:-1] + mix(hashes[1:] + np.uint64(1)))  # gap g stands before word g + 1
    owner = np.repeat(np.arange(len(size)), size)
    whole = np.flatnonzero(owner[:-window] == owner[window:])
    least = np.lib.stride_tricks.sliding_window_view(gaps, window)[whole, ::-1].argmin(1)
    begins[whole + window - least] = True
    return begins


def units(texts: list[str], piece: int) -> tuple:
    """Words and their hashes, and words, start, end and text of every sentence or piece of one; places are code points."""
    words, counts, begins, ends, owners, breaks, shifts = [], [], [], [], [], [], [0]
    for i, text in enumerate(texts):
        shift = shifts[-1]
        for m in SENTENCE.finditer(text):
            own = m[0]
            breaks.append(shift + m.start())
            if not own or own.isspace() or not (found := own.lower().encode().split()):
                continue
            words += found
            counts.append(len(found))
            begins.append(shift + m.start())
            ends.append(shift + m.end())
            owners.append(i)
        shifts.append(shift + len(text))
    if not counts:
        return words, np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(4))
    count, begin, end, owner = (np.array(x, np.int64) for x in (counts, begins, ends, owners))
    hashes = word_hashes(*word_codes(words))
    # Places of the words: a word begins behind a blank or where a sentence does.
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    filled = np.concatenate([[False], (points != 32) & ((points < 9) | (points > 13)), [False]])
    broken = np.zeros(len(points) + 1, bool)
    broken[breaks] = True
    opens = np.flatnonzero(filled[1:] & (~filled[:-1] | broken))
    closes = np.flatnonzero(filled[:-1] & (~filled[1:] | broken))
    edges = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(len(words)) + np.repeat(np.searchsorted(opens, begin) - edges[:-1], count)
    first = np.flatnonzero(cut_places(count, hashes, max(1, piece // 2)))
    size = np.diff(np.append(first, len(words)))
    of = np.searchsorted(edges, first, side="right") - 1
    cut = size < count[of]
    shift = np.array(shifts, np.int64)[owner[of]]
    start = np.where(cut, opens[place[first]], begin[of]) - shift
    stop = np.where(cut, closes[place[first + size - 1]], end[of]) - shift
    return words, hashes, size, start, stop, owner[of]


def sentences(text: str, piece: int) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, lower-case words) of every sentence or piece of one; places are code points."""
    words, _, size, start, end, _ = units([text], piece)
    edges = [0, *np.cumsum(size).tolist()]
    return [(s, e, words[a:b]) for s, e, a, b in zip(start.tolist(), end.tolist(), edges, edges[1:], strict=False)]


def runs(texts: list[str], least_words: int, piece: int) -> tuple[np.ndarray, ...]:
    """(text, start, end, hash) of every run of some texts."""
    _, hashes, size, begin, end, owner = units(texts, piece)
    if not len(size):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    edges = np.concatenate([[0], np.cumsum(size)])
    # A hash of a run of words from prefix sums of word hashes scrambled with their places: equal runs at different
    # places must agree, so each sentence is hashed on its own first and runs combine the sentences' hashes in order.
    local = np.arange(len(hashes)) - np.repeat(edges[:-1], size)
    sentence = np.add.reduceat(mix(hashes + mix(local.astype(np.uint64) + np.uint64(1))), edges[:-1])
    first, last = ends_of_runs(edges, owner, least_words)
    state, live = mix(sentence[first]), np.arange(len(first))
    step = 0
    while len(live):  # each round adds one more sentence to the runs that are still short
        step += 1
        live = live[first[live] + step <= last[live]]
        state[live] = mix(state[live] + mix(sentence[first[live] + step] + np.uint64(1)))
    return owner[first], begin[first], end[last], state


def ends_of_runs(edges: np.ndarray, owner: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of the shortest run from every sentence, and of the shortest one up to it, where its text has one."""
    n = len(owner)
    own = np.arange(n)
    last = np.maximum(np.searchsorted(edges, edges[:-1] + least_words) - 1, own + 1)
    onward = (last < n) & (owner[np.minimum(last, n - 1)] == owner)
    first = np.minimum(np.searchsorted(edges, edges[1:] - least_words, side="right") - 1, own - 1)
    back = (first >= 0) & (owner[np.maximum(first, 0)] == owner)
    back &= last[np.maximum(first, 0)] != own  # else it is the run from its first sentence
    return np.concatenate([own[onward], first[back]]), np.concatenate([last[onward], own[back]])


def span_rows(docs: DataFrame, least_words: int, piece: int) -> DataFrame:
    """id, dig, h, s, e for every run; ``docs`` has id, text and dig (of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in texts_of(batch):
                owner, begin, end, state = runs(texts, least_words, piece)
                own = pa.array(owner + start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(own), batch.column(2).take(own), pa.array(signed(state)), pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32))],
                    ["id", "dig", "h", "s", "e"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", "dig").mapInArrow(run, f"id {kind}, dig long, h long, s int, e int")


def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted places (start * 2^32 + end) of every row as disjoint stretches, in a column of the same name and kind."""
    for batch in batches:
        at = batch.schema.get_field_index("places")
        lists = batch.column(at)
        flat, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy(zero_copy_only=False)
        offsets = offsets - offsets[0]
        row = np.repeat(np.arange(len(lists)), np.diff(offsets))
        begin, end = flat >> 32, flat & 0xFFFFFFFF
        # Rows are laid one behind the other, each in a room of its own, so that one running maximum serves all.
        room = row * ((int(end.max()) if len(end) else 0) + 2)
        reach = np.maximum.accumulate(end + room)
        fresh = np.concatenate([[True], begin[1:] + room[1:] > reach[:-1]]) if len(flat) else np.empty(0, bool)
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(flat)) - 1
        joined = (begin[first] << 32) | (reach[last] - room[last])
        counts = np.bincount(row[first], minlength=len(lists)) if len(first) else np.zeros(len(lists), np.int64)
        made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(joined))
        yield pa.RecordBatch.from_arrays([made if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)


def removed_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = 25, piece: int = 25) -> DataFrame:
    """id, dig (of the text), spans (structs of s and e, disjoint and sorted) and first_docs of every text that loses something."""
    text = of(docs, text_col).cast("string")
    plain = docs.select(of(docs, id_col).alias("id"), text.alias("text"), digest_of(text).alias("dig"))
    rows = span_rows(plain, least_words, piece)
    text_of = F.when(F.col("id").isNull(), F.col("dig").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.lit(0))  # tells texts without an id apart
    place = F.struct(F.col("id").isNull().alias("unnamed"), "id", F.shiftleft(F.col("s").cast("long"), 32).bitwiseOR(text_of).alias("at"))
    twice = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
    twice = durable(twice.select("h", "first"))  # so that the join has a shuffle of its own on either side, of which Spark splits hot keys
    again = rows.join(twice, "h").filter(place != F.col("first"))
    held = F.shiftleft(F.col("s").cast("long"), 32).bitwiseOR(F.col("e").cast("long"))
    found = again.groupBy("id", "dig").agg(F.array_sort(F.collect_set(held)).alias("places"), F.array_sort(F.collect_set("first.id")).alias("first_docs"))
    found = found.mapInArrow(stretches, found.schema)
    spans = F.transform("places", lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("s"), x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("e")))
    return found.select("id", "dig", spans.alias("spans"), "first_docs")


def repeated_spans(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_removed (stretches), removed (their places as s:e, comma-joined) and first_docs (where they stand first).

    Only texts from which something is removed have a row.
    """
    shown = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["s"], x["e"])), ",")
    return removed_rows(docs, **options).select(F.col("id").alias("doc_id"), F.size("spans").cast("long").alias("n_removed"), shown.alias("removed"), "first_docs", "spans")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with repeated sentences cut out of their texts. A row loses what its own text holds, whatever rows share its id."""
    found = removed_rows(docs, id_col=id_col, text_col=text_col, **options).select(F.col("id").alias("found_id"), F.col("dig").alias("found_dig"), "spans")
    packed = docs.select(F.struct(*(of(docs, c).alias(c) for c in docs.columns)).alias("row"), of(docs, id_col).alias("row_id"), digest_of(of(docs, text_col)).alias("row_dig"))  # so that no name clashes
    joined = packed.join(found, F.col("row_id").eqNullSafe(F.col("found_id")) & (F.col("row_dig") == F.col("found_dig")), "left")
    clean = replaced(F.col("row")[text_col], F.col("spans"), lambda m, done: F.lit(""))
    return joined.select(*((clean if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns))
