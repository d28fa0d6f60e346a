"""Byte-level BPE by dynamic programming over prefixes (problem 8).

The encoding of a text is the concatenation of the encodings of its pieces. For each prefix of a piece
there is exactly one token that can end its encoding: among the tokens that are suffixes of the prefix
(found by an automaton with suffix links) it is the one that is compatible with the last token of the
prefix before it. Storing that token for every prefix, the ids follow by stepping back from the end, in
time linear in the piece, however long it is.

Two neighbours are compatible if no merge would have crossed the boundary between them. That is tested by
undoing their merges from the latest on and asking at each state whether the two parts at the boundary
have a merge of their own that comes before the next recorded one.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Folder of the public vocabularies.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern that splits text before merging.
PATTERN = r"'(?:[sdmt]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct short pieces whose ids a worker remembers, and the longest of them.
REMEMBERED, SHORT = 200_000, 48

_ENCODERS: dict[int, Encoder] = {}


class Encoder:
    """Tables of one vocabulary; tokens[i] are the bytes of id i, its rank."""

    def __init__(self, tokens: list[bytes]):
        self.split = regex.compile(PATTERN).findall
        self.left, self.right = list(range(len(tokens))), list(range(len(tokens)))
        self.merged: dict[int, int] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        self.automaton = ahocorasick.Automaton()
        self.lengths = [len(t) for t in tokens]
        words = {t.decode("latin-1"): i for i, t in enumerate(tokens)}
        self.words = words
        for i, token in enumerate(tokens):
            if len(token) > 1:
                self._record(i, token.decode("latin-1"))
        for word, i in words.items():
            self.automaton.add_word(word, i)
        self.automaton.make_automaton()

    def _record(self, i: int, word: str) -> None:
        """The merge that makes token i: the parts left when all merges before it are done."""
        words, parts = self.words, list(word)
        while len(parts) > 2:
            ranks = [words.get(parts[k] + parts[k + 1], i) for k in range(len(parts) - 1)]
            rank = min(ranks)
            if rank >= i:
                return  # no merge leads to it
            k = ranks.index(rank)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        self.left[i], self.right[i] = words[parts[0]], words[parts[1]]
        self.merged[self.left[i] << 32 | self.right[i]] = i

    def compatible(self, a: int, b: int) -> bool:
        """Whether encoding both tokens' bytes together keeps them apart."""
        left, right, merged = self.left, self.right, self.merged
        until = 1 << 40
        while True:
            if merged.get(a << 32 | b, until) < until:
                return False
            # Undo the later of the two; equal merges happen from the left on, so then the right one is later.
            if a > b:
                until, a = a, right[a]
                if a == until:
                    return True
            else:
                until = b + 1
                if left[b] == b:
                    # b is a byte; a isn't later, so both are bytes or a is a byte of less rank.
                    return True
                b = left[b]

    def piece(self, text: str) -> tuple[int, ...] | array:
        """Ids of one piece."""
        data = text.encode("utf-8", "replace").decode("latin-1")
        whole = self.words.get(data)
        if whole is not None:  # the longest suffix of the last prefix is the piece itself
            return (whole,)
        lengths, compatible = self.lengths, self.compatible
        last = [-1] * (len(data) + 1)
        done = 0
        # The automaton gives each end's tokens from the longest to the shortest.
        for end, token in self.automaton.iter(data):
            if end < done:
                continue
            before = end + 1 - lengths[token]
            if before == 0 or compatible(last[before], token):
                last[end + 1] = token
                done = end + 1
        ids = array("i")
        at = len(data)
        while at:
            ids.append(last[at])
            at -= lengths[last[at]]
        ids.reverse()
        return tuple(ids) if len(text) <= SHORT else ids

    def ids(self, text: str | None, out: array) -> None:
        """Append the ids of a text; null and empty ones have none."""
        if not text:
            return
        known, extend = self.known, out.extend
        for piece in self.split(text):
            found = known.get(piece)
            if found is None:
                found = self.piece(piece)
                if len(piece) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = found
            extend(found)


def vocabulary(path: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> list[bytes]:
    """Bytes of each id."""
    ranked = [line.split() for line in Path(path, name).read_bytes().splitlines() if line]
    tokens = [b""] * len(ranked)
    for word, rank in ranked:
        tokens[int(rank)] = base64.b64decode(word)
    return tokens


def _encoder(tokens: list[bytes]) -> Encoder:
    """The tables of a vocabulary, made once in a worker."""
    key = hash(tuple(tokens))
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(tokens)
    return _ENCODERS[key]


def encode(docs: DataFrame, tokens: list[bytes], ids: bool = True, rows: int = 512) -> DataFrame:
    """doc_id and ids (array of int), or doc_id and n_tokens, of documents with doc_id and text.

    Special tokens are ordinary text. Null and empty texts have no ids. Rows pass one to one without a
    shuffle, also repeated ones; other columns are left out. The vocabulary (fixed, about 1 MB) is
    broadcast, so executors need no file of it; rows bounds what is in memory at once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())) if ids else T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                flat, ends = array("i"), array("i", [0])
                for text in batch.column(1):
                    encoder.ids(text.as_py(), flat)
                    ends.append(len(flat))
                if ids:
                    column = pa.ListArray.from_arrays(pa.array(memoryview(ends), pa.int32()), pa.array(memoryview(flat), pa.int32()))
                else:
                    column = pa.array([b - a for a, b in zip(ends, ends[1:], strict=False)], pa.int64())
                yield pa.record_batch([batch.column(0).cast(pa.int64()), column], names=out.names)

    return docs.select("doc_id", "text").mapInArrow(run, out)


def token_counts(spark: SparkSession, docs: DataFrame, path: str = TOKENIZERS) -> DataFrame:
    return encode(docs, vocabulary(path), ids=False)
