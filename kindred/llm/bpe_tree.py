"""Byte-level BPE as a monoid: halves are encoded on their own and joined.

A sequence of tokens is the encoding of its bytes exactly if every two neighbours are the encoding
of theirs. So a join re-encodes a window around the seam and is done as soon as the window's first
and last token stand the pair test with the tokens outside; otherwise the window grows. Decoding is
concatenation up the same tree. Texts are first split by the vocabulary's pattern: matches never
share a token, so their join is plain concatenation.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A match of up to so many bytes is one call of the merges; longer ones are halved and joined.
LEAF_BYTES = 8
# Chunks kept in each of two generations.
CACHE_CHUNKS = 150_000
BATCH_DOCS = 256
# Ids decoded at once, unless one text has more.
DECODE_IDS = 1 << 22

# White space as the pattern means it: the Unicode property, which Python's \s differs from.
_GAP = r"\t-\r \x85\xa0  -     　"
# Words with one space before, and runs of white space, cut where the vocabulary's pattern cuts too.
_CHUNK = re.compile(rf" ?[^{_GAP}]+|[{_GAP}]+(?![^{_GAP}])|[{_GAP}]+")


class TreeBpe:
    """Encoder and decoder by a rank file and a split pattern."""

    def __init__(self, path: str, pattern: str, leaf_bytes: int = LEAF_BYTES) -> None:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.leaf_bytes = leaf_bytes
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf = merges._encode_single_piece  # the merges of one short run of bytes
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.stable = lru_cache(1 << 16)(self._stable)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.flat = pa.array(self.tokens, pa.large_binary())

    def _stable(self, left: int, right: int) -> bool:
        return self.leaf(self.tokens[left] + self.tokens[right]) == [left, right]

    def bytes_of(self, ids: list[int]) -> bytes:
        """Concatenation up the tree."""
        if len(ids) <= 4096:
            return b"".join(map(self.tokens.__getitem__, ids))
        half = len(ids) // 2
        return self.bytes_of(ids[:half]) + self.bytes_of(ids[half:])

    def piece(self, data: bytes) -> list[int]:
        """The tokens of one match of the pattern."""
        if len(data) <= self.leaf_bytes:
            return self.leaf(data)
        half = len(data) // 2
        return self.join(self.piece(data[:half]), self.piece(data[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours from theirs."""
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.leaf(self.bytes_of(left[-i:]) + self.bytes_of(right[:j]))
            left_holds = i == len(left) or self.stable(left[-i - 1], window[0])
            right_holds = j == len(right) or self.stable(window[-1], right[j])
            if left_holds and right_holds:
                return left[:-i] + window + right[j:]
            i, j = i if left_holds else 2 * i, j if right_holds else 2 * j

    def chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for match in self.pattern.findall(chunk):
            ids += self.piece(match.encode())
        return np.asarray(ids, "<i4").tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; a chunk is kept as long as it is met again before a generation is full."""
        chunks = _CHUNK.findall(text)
        if len(self.young) > CACHE_CHUNKS:
            self.old, self.young = self.young, {}
        kept, old = self.young, self.old
        for chunk in set(chunks).difference(kept):
            kept[chunk] = old[chunk] if chunk in old else self.chunk(chunk)
        return np.frombuffer(b"".join(map(kept.__getitem__, chunks)), "<i4")

    def decode(self, ids: pa.ListArray) -> Iterator[tuple[int, pa.Array]]:
        """``(rows, bytes of each)`` for runs of lists: the leaves of the decoding tree, concatenated in one take."""
        lengths = ids.value_lengths().fill_null(0).to_numpy()
        ends = np.cumsum(lengths)
        start = 0
        while start < len(ids):
            before = ends[start] - lengths[start]
            stop = max(start + 1, int(np.searchsorted(ends, before + DECODE_IDS, side="right")))
            taken = self.flat.take(ids.slice(start, stop - start).flatten())
            places = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
            cuts = places[np.concatenate([[0], ends[start:stop] - before])]
            offsets = pa.py_buffer((cuts - cuts[0]).astype("<i4").tobytes())
            data = taken.buffers()[2]
            data = data.slice(int(cuts[0]), int(cuts[-1] - cuts[0])) if data is not None else pa.py_buffer(b"")
            yield stop - start, pa.Array.from_buffers(pa.binary(), stop - start, [None, offsets, data])
            start = stop


_CODECS: dict[tuple[str, str], TreeBpe] = {}


def codec(path: str, pattern: str) -> TreeBpe:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = TreeBpe(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row of ``docs`` (``doc_id``, ``text``).

    A null or empty text has no ids. Rows with equal or null ``doc_id`` are rows of their own;
    other columns are ignored; no rows give no rows. Special tokens are ordinary text.
    """
    target = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(at, BATCH_DOCS)
                ids = [bpe.encode(text) if text else np.empty(0, "<i4") for text in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<i4")
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], schema=target)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded`` (binary) of ``encoded``; null ids decode to nothing."""
    target = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            start = 0
            for rows, data in bpe.decode(batch.column(1)):
                part = batch.slice(start, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(target.field(1).type), data], schema=target)
                start += rows

    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
