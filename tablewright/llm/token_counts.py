"""Token counts by finite-state transducers.

Two deterministic machines are compiled from a byte-level BPE tokenizer file:

* a splitter over character classes that marks where the pre-tokens of a text begin. A text is cut into equal chunks;
  every chunk gets its state map (exit state for every entry state), all chunks at once, the maps compose
  through a parallel prefix scan, and the entry states so found let all chunks mark their boundaries together.
* a counter over the bytes of a pre-token. The encoding of a prefix ends in one token, and which token ends a longer prefix depends on
  the last tokens at the few places where a token may still begin. A state is just that: these places, by their distance from
  the end, each with its last token and the number of tokens since. So prefixes that go on alike share a state, states are finitely
  many, and a transition carries the number of tokens that the longer prefix has more (or less); their sum along a pre-token is
  its count. States and transitions are made when first reached, and dropped together at a bound. A pre-token of several
  chunks is counted chunk by chunk: every chunk gets its map (exit state and count for the entry states that come up when the text before
  it is read from the start state), and the maps compose through the same scan; where the entry state is another one after
  all, the chunk is read again from it.

Defined results: a null text counts as empty (0 tokens); an empty table gives no rows; ids that are null stay null; rows that
repeat stay; very long texts and pre-tokens cost in proportion; further input columns, whatever their names, are ignored. A special string in a text counts as one token, as the tokenizer's default has it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from tablewright.llm.bpe import PairTest
from tablewright.llm.common import of, texts_of

#: Characters per chunk of the prefix scan, and those after which entry states are compared; transitions of the counter that a
#: worker keeps, characters that are read ahead of a chunk for its entry state, and pre-tokens that a worker keeps.
CHUNK, SYNC, KEPT_ARCS, AHEAD, KEPT_WORDS = 512, 24, 300_000, 64, 300_000

# Character classes of the splitter.
LETTER, NUMBER, OTHER, BLANK, SPACE, QUOTE, L_STMD, L_R, L_V, L_L, L_E, FINAL = range(12)
# Its states: what has been read of the present pre-token.
(START, IN_LETTER, IN_NUMBER, IN_OTHER, ONE_BLANK, ONE_SPACE, AT_QUOTE, Q_DONE, Q_R, Q_V, Q_L, BLANKS, SPACES) = range(13)
STATES = 13


@cache
def char_classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for found in regex.finditer(pattern, every):
            a, b = ord(found[0][0]), ord(found[0][-1])
            table[a : b + 1] = kind
    table[0xD800:0xE000] = OTHER
    table[ord(" ")], table[ord("'")] = BLANK, QUOTE
    for char, kind in {"s": L_STMD, "t": L_STMD, "m": L_STMD, "d": L_STMD, "r": L_R, "v": L_V, "l": L_L, "e": L_E}.items():
        table[ord(char)] = kind
    return table


def family(kind: int) -> int:
    """Letters are one family for all but the endings after a quote."""
    return LETTER if kind in (L_STMD, L_R, L_V, L_L, L_E) else OTHER if kind == QUOTE else kind


@cache
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, where a pre-token starts) for [class, state].

    Starts: 0 none, 1 at this character, 2 at the character before it, 3 at both. The pattern is that of byte-level
    BPE: the endings 's 't 're 've 'm 'll 'd; letters, numbers or others with at most one blank in front; white space,
    whose last character stays apart when something else follows.
    """
    into = {LETTER: IN_LETTER, NUMBER: IN_NUMBER, OTHER: IN_OTHER}
    step = np.zeros((12, STATES), np.uint8)
    mark = np.zeros((12, STATES), np.uint8)
    for kind in range(12):
        own = family(kind)
        for state in range(STATES):
            # What a pre-token that begins here leads to.
            go = {BLANK: ONE_BLANK, SPACE: ONE_SPACE, QUOTE: AT_QUOTE}.get(kind, into.get(own, START))
            at = 1
            if state in (IN_LETTER, IN_NUMBER, IN_OTHER) and into.get(own) == state:
                go, at = state, 0
            elif state == ONE_BLANK and own in into:
                go, at = into[own], 0
            elif state in (ONE_BLANK, ONE_SPACE, BLANKS, SPACES) and kind in (BLANK, SPACE):
                go, at = (BLANKS if kind == BLANK else SPACES), 0
            elif state == BLANKS and own in into:  # the last blank of the run begins the next pre-token
                go, at = into[own], 2
            elif state == SPACES and own in into:  # the last white space of the run is a pre-token
                at = 3
            elif state in (Q_R, Q_V, Q_L):  # the letter after the quote is an ending's or begins a word
                if kind == (L_L if state == Q_L else L_E):
                    go, at = Q_DONE, 0
                elif own == LETTER:
                    go, at = IN_LETTER, 2
                else:
                    at = 3
            elif state == AT_QUOTE and kind == L_STMD:
                go, at = Q_DONE, 0
            elif state == AT_QUOTE and kind in (L_R, L_V, L_L):
                go, at = {L_R: Q_R, L_V: Q_V, L_L: Q_L}[kind], 0
            elif state == AT_QUOTE and own == OTHER:
                go, at = IN_OTHER, 0
            step[kind, state], mark[kind, state] = go, at
    return step, mark


def scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps [n, STATES] under composition, in log n vectorised steps."""
    maps, gap = maps.copy(), 1
    while gap < len(maps):
        maps[gap:] = np.take_along_axis(maps[gap:], maps[:-gap].astype(np.intp), 1)
        gap *= 2
    return maps


def starts_of(kinds: np.ndarray) -> np.ndarray:
    """Positions where pre-tokens of one long run of classes begin; FINAL separates texts."""
    step, mark = splitter()
    n = len(kinds)
    rows = n // CHUNK + 1  # at least one FINAL stands behind the last text
    grid = np.full(rows * CHUNK, FINAL, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T).astype(np.intp) * STATES
    table = step.ravel().astype(np.intp)
    # State maps of all chunks; once all entry states of a chunk have met, one of them stands for all.
    maps = np.tile(np.arange(STATES), (rows, 1))
    for line in grid[:SYNC]:
        maps = np.take(table, line[:, None] + maps)
    apart = np.flatnonzero((maps != maps[:, :1]).any(1))
    met, wide = maps[:, 0].copy(), maps[apart]
    for line in grid[SYNC:]:
        met = np.take(table, line + met)
        wide = np.take(table, line[apart, None] + wide)
    maps[:] = met[:, None]
    maps[apart] = wide
    states = np.zeros(rows, np.intp)
    states[1:] = scan(maps)[:-1, START]
    marks = np.empty((CHUNK, rows), np.uint8)
    flat = mark.ravel()
    for i, line in enumerate(grid):
        key = line + states
        marks[i], states = np.take(flat, key), np.take(table, key)
    marks = marks.T.ravel()
    begins = (marks[:n] & 1).astype(bool)
    begins[np.flatnonzero(marks[: n + 1] & 2) - 1] = True
    return begins


class Counter:
    """The transducer that counts the tokens of a pre-token."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        ranks = {pair: i for i, pair in enumerate(merges)}
        self.apart = PairTest(lambda a, b: ranks.get((a, b)))
        self.tokens = {t for t in vocab if len(t) > 1 and self.apart.encode(t) == [t]}  # a token that no merges reach never occurs
        self.begins = {t[:n] for t in self.tokens for n in range(1, len(t))}
        self.reset()

    def reset(self) -> None:
        #: By state: its places, longest first, as (what follows the place, last token before it, tokens from it to the end); and
        #: its transitions by character: (next state, change of the count). State 0 is that of no character.
        self.places: list[tuple] = [(("", "", 0),)]
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]
        self.known = {self.places[0]: 0}
        self.made = 0

    def arc(self, state: int, c: str) -> tuple[int, int]:
        """Makes the transition of a state by a character."""
        places = self.places[state]
        token, gain = c, 1  # the character stands alone
        for follows, last, count in places:  # the longest token that ends here and can follow what stands before it
            longer = follows + c
            if longer in self.tokens and (not last or self.apart(last, longer)):
                token, gain = longer, 1 - count
                break
        own = [(follows + c, last, count + gain) for follows, last, count in places if follows + c in self.begins]
        key = (*own, ("", token, 0))
        to = self.known.get(key)
        if to is None:
            to = self.known[key] = len(self.places)
            self.places.append(key)
            self.arcs.append({})
        self.made += 1
        out = self.arcs[state][c] = (to, gain)
        return out

    def run(self, state: int, text: str) -> tuple[int, int]:
        """Exit state and count of a text read from a state."""
        arcs, total = self.arcs, 0
        for c in text:
            found = arcs[state].get(c) or self.arc(state, c)
            state = found[0]
            total += found[1]
        return state, total

    def count(self, word: str) -> int:
        """Tokens of a pre-token (in the byte alphabet)."""
        if self.made > KEPT_ARCS:
            self.reset()
        if len(word) <= 2 * CHUNK:
            return self.run(0, word)[1]
        chunks = [word[i : i + CHUNK] for i in range(0, len(word), CHUNK)]
        maps: list[dict[int, tuple[int, int]]] = []
        for i, chunk in enumerate(chunks):
            entry = self.run(0, word[max(0, i * CHUNK - AHEAD) : i * CHUNK])[0]
            maps.append({entry: self.run(entry, chunk)})
        return self.composed(maps, chunks)[1]

    def composed(self, maps: list[dict[int, tuple[int, int]]], chunks: list[str]) -> tuple[int, int]:
        """The map of all chunks from state 0, by pairs of neighbours; an entry that is missing is read."""
        runs = [[chunk] for chunk in chunks]
        while len(maps) > 1:
            joined, texts = [], []
            for i in range(0, len(maps) - 1, 2):
                out = {}
                for entry, (middle, n) in maps[i].items():
                    if middle not in maps[i + 1]:
                        maps[i + 1][middle] = self.run(middle, "".join(runs[i + 1]))
                    exit_, more = maps[i + 1][middle]
                    out[entry] = (exit_, n + more)
                joined.append(out)
                texts.append(runs[i] + runs[i + 1])
            if len(maps) % 2:
                joined.append(maps[-1])
                texts.append(runs[-1])
            maps, runs = joined, texts
        return maps[0][0]


class Machine:
    """Both transducers of a tokenizer file."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only byte-level BPE without prefix blanks and normalizer can be compiled")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = [b for b in range(256) if b not in set(plain)]
        alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.alphabet = "".join(alphabet[b] for b in range(256))
        self.counter = Counter(model["vocab"], merges)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))).split if self.special else None
        self.words: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = self.counter.count(word.encode().decode("latin-1").translate(self.alphabet))
        if len(word) <= 64:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = n
        return n

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of every text."""
        out = [0] * len(texts)
        parts, owner = [], []
        for i, text in enumerate(texts):
            pieces = [text]
            if self.cut and any(s in text for s in self.special):
                pieces = self.cut(text)
                out[i] += len(pieces) - 1
            for piece in pieces:
                if piece:
                    parts.append(piece)
                    owner.append(i)
        if not parts:
            return out
        joined = "\0".join(parts)  # the place of the separator is given the class FINAL
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = char_classes()[points]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(lengths + 1) - 1
        kinds[ends[:-1]] = FINAL
        begins = starts_of(kinds)
        begins[ends[:-1]] = True
        places = np.flatnonzero(begins)
        bounds = [*places.tolist(), len(joined)]
        known, slow = self.words.get, self.word
        each = np.empty(len(places), np.int64)
        each[:] = [n if (n := known(w)) is not None else slow(w) for w in map(joined.__getitem__, map(slice, bounds, bounds[1:]))]
        each[np.searchsorted(places, ends[:-1])] = 0  # the separators
        totals = np.add.reduceat(each, np.searchsorted(places, np.concatenate([[0], ends[:-1] + 1])))
        for i, n in zip(owner, totals.tolist(), strict=True):
            out[i] += n
        return out


_machines: dict[str, Machine] = {}


def machine(file: str) -> Machine:
    """The worker's machine for a tokenizer file, compiled once."""
    if file not in _machines:
        _machines[file] = Machine(file)
    return _machines[file]


def count_tokens(docs: DataFrame, tokenizer_file: str, *, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = machine(tokenizer_file)
        for batch in batches:
            for start, texts in texts_of(batch):
                counts = pa.array(tool.counts(texts), pa.int64())
                sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(texts)), sizes, counts, pa.compute.greater(counts, limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    plain = docs.select(of(docs, id_col).alias("doc_id"), of(docs, text_col).cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
