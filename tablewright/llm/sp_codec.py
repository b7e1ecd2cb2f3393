"""Encoding and decoding with a sentencepiece BPE model by a merge-type prefix table.

Pieces hold the word mark only in front, or are made of marks alone, so no merge crosses from a letter to a mark and
a text falls into words that are encoded on their own. Each distinct word is encoded once per worker while it
stays in a bounded table; a word without blanks may be a whole text and is still encoded in linear steps.

Defined results: a null text counts as empty and gives the end id alone; an empty table gives no rows; ids that are null stay
null; rows that repeat stay; further input columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tablewright.llm.bpe import PrefixTable
from tablewright.llm.common import of, texts_of

MARK = "▁"
#: Words that a worker keeps with their ids, and the longest of them.
KEPT_WORDS, KEPT_LENGTH = 300_000, 64

_codecs: dict[str, Codec] = {}


class Codec:
    """A model file's encoder and decoder."""

    def __init__(self, model_file: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        model = self.model
        pieces = {}
        for i in range(model.vocab_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                pieces[model.id_to_piece(i)] = i
        if bad := [p for p in pieces if MARK in p[1:] and p.strip(MARK)]:
            raise ValueError(f"pieces cross words: {bad[:5]}")
        scores = {p: (-model.get_score(i), i) for p, i in pieces.items()}
        self.pieces = pieces
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.unknown, self.end = model.unk_id(), model.eos_id()
        self.table = PrefixTable(list(pieces), lambda a, b: scores.get(a + b))
        self.shown = [str(i) for i in range(model.vocab_size())]
        self.words: dict[str, tuple[int, ...]] = {}
        self.split = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall

    def _ids(self, word: str) -> tuple[int, ...]:
        out = []
        for token in self.table.encode(word):
            known = self.pieces.get(token)
            if known is not None:
                out.append(known)
            else:
                for b in token.encode():
                    out.append(self.bytes[b])
        return tuple(out)

    def word(self, word: str) -> tuple[int, ...]:
        ids = self._ids(word)
        if len(word) <= KEPT_LENGTH:
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def normal(self, text: str) -> str:
        """The text as the model sees it: blanks as marks and one in front."""
        return self.model.normalize(text) if text else ""

    def encode(self, text: str) -> tuple[str, list[int]]:
        """Decimal ids joined by blanks, and the ids, with the end id."""
        ids, known, slow = [], self.words.get, self.word
        for word in self.split(self.normal(text)):
            ids += known(word) or slow(word)
        ids.append(self.end)
        return " ".join(map(self.shown.__getitem__, ids)), ids

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def codec(model_file: str) -> Codec:
    """The worker's codec for a file, compiled once."""
    if model_file not in _codecs:
        _codecs[model_file] = Codec(model_file)
    return _codecs[model_file]


def encode_texts(docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """One row per document: its id, n_tokens, digests of ids and decoded text; with ``full`` also ids and decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(model_file)
        for batch in batches:
            for start, texts in texts_of(batch):
                rows = []
                for text in texts:
                    shown, ids = tool.encode(text)
                    decoded = tool.decode(ids)
                    row = [len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()]
                    rows.append([*row, ids, decoded] if full else row)
                columns = [batch.column(0).slice(start, len(texts)), *map(pa.array, zip(*rows, strict=True))]
                if full:
                    columns[4] = columns[4].cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * full]
    plain = docs.select(of(docs, id_col).alias("doc_id"), of(docs, text_col).cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * full
    return plain.mapInArrow(run, schema)
