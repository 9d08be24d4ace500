"""Vector bin packing of tokenised examples into training sequences.

Every example is a vector (tokens, one segment, loss-bearing tokens). An open sequence takes the
waiting example whose vector has the largest dot product with the room that is left, as long as
one fits under all limits at once; when none fits, an example is cut so that the sequence ends
full. The work is local to a partition: a bounded pool of examples waits, so that nothing is
shuffled, memory is bounded, and a lost task is simply run again with the same result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


END_ID = 1
SEQUENCE_BITS = 36
POOL = 1024
BATCH_DOCS = 256
CACHE_WORDS = 500_000

PIECES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, "
    "sequence_id long, offset long"
)

# A run of Latin letters that ends its word but for marks, those marks, or a whole word. None of
# the cuts changes a token: the vocabulary's pattern cuts there too, and apostrophes stay inside.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"
_PLAIN = re.compile(rf"[{_LETTERS}]+")
_PART = re.compile(rf"[{_LETTERS}]+(?=[{_MARKS}]*(?:[ \t\n\r]|\Z))|[{_MARKS}]+(?=[ \t\n\r]|\Z)|[^ \t\n\r]+")


class WordTokens(dict):
    """Little-endian ids of a text by a vocabulary file, with the parts of words kept."""

    def __init__(self, path: str) -> None:
        super().__init__()
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        # For lower-case Latin letters the normaliser changes nothing and the pattern cuts nowhere: only the merge is left,
        # of characters that stand for bytes. A byte without a character of its own has the next one of the alphabet.
        self.merge = self.tokenizer.model.tokenize
        alphabet = sorted(map(ord, ByteLevel.alphabet()))
        spare = iter(a for a in alphabet if a > 255)
        self.byte_chars = {b: b if b in alphabet else next(spare) for b in range(256)}
        self.old: dict[str, bytes] = {}

    def fill(self, parts: set[str]) -> None:
        """Ids of all ``parts``; a part is kept as long as it comes again before a generation is full."""
        if len(self) > CACHE_WORDS // 2:
            self.old = dict(self)
            self.clear()
        missing = []
        for p in parts.difference(self):
            if p in self.old:
                self[p] = self.old[p]
            else:
                missing.append(p)
        lowered = list({p.lower() if p.isalpha() and len(p.lower()) == len(p) else p for p in missing})
        ids = {}
        for word in lowered:
            if _PLAIN.fullmatch(word) and word.islower():
                seen = word if word.isascii() else word.encode().decode("latin-1").translate(self.byte_chars)
                found = [t.id for t in self.merge(seen)]
                ids[word] = struct.pack(f"<{len(found)}I", *found)
        lowered = [w for w in lowered if w not in ids]
        for at in range(0, len(lowered), 4096):
            words = lowered[at : at + 4096]
            # One call for all of them: each word is split and merged on its own, as if it were the text.
            encoded = self.tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)
            data, lengths = np.asarray(encoded.ids, "<u4").tobytes(), np.bincount(np.asarray(encoded.word_ids, np.int64), minlength=len(words))
            ends = np.cumsum(4 * lengths)
            ids.update(zip(words, (data[e - 4 * n : e] for e, n in zip(ends.tolist(), lengths.tolist())), strict=True))
        for p in missing:
            self[p] = ids[p] if p in ids else ids[p.lower()]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        split = [_PART.findall(t) if t else [] for t in texts]
        self.fill(set().union(*split))
        for parts in split:
            yield b"".join(map(self.__getitem__, parts))


_TOKENS: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    if path not in _TOKENS:
        _TOKENS[path] = WordTokens(path)
    return _TOKENS[path]


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold. A sequence is padded to ``tokens`` unless its length is a power of two."""

    tokens: int = 2048
    segments: int = 1024
    loss: int = 2048


@dataclass
class Example:
    doc_id: int | None
    ids: bytes
    prompt: int  # leading tokens without loss
    total: int


@dataclass
class Packer:
    """Packs the stream of examples of one partition."""

    limits: Limits
    first_sequence: int
    pool: list[tuple[Example, int, int]] = field(default_factory=list)  # example, start, end
    made: int = 0
    rows: list[tuple] = field(default_factory=list)

    def add(self, example: Example) -> None:
        """Whole sequences leave at once; the rest waits in the pool."""
        start, full = 0, self.limits.tokens
        while example.total - start >= full and loss_of(example, start, start + full) <= self.limits.loss:
            self._close([(example, start, start + full)])
            start += full
        if start < example.total:
            self.pool.append((example, start, example.total))
        if len(self.pool) >= POOL:
            self._pack(keep=POOL // 4)

    def finish(self) -> None:
        self._pack(keep=0)

    def _close(self, pieces: list[tuple[Example, int, int]]) -> None:
        offset = 0
        for example, start, end in pieces:
            self.rows.append(
                (example.doc_id, start, end - start, example.ids[4 * start : 4 * end], example.total,
                 loss_of(example, start, end), self.first_sequence + self.made, offset)
            )
            offset += end - start
        self.made += 1

    def _pack(self, keep: int) -> None:
        pool, most = self.pool, self.limits
        cap = np.array([most.tokens, most.segments, most.loss], float)
        size = np.array([[e - s, 1, loss_of(x, s, e)] for x, s, e in pool], float).reshape(-1, 3)
        alive = np.ones(len(pool), bool)
        left = len(pool)
        while left > keep:
            room, pieces = cap.copy(), []
            while left and room[0] > 0 and room[1] >= 1:
                fits = alive & (size <= room).all(axis=1)
                if fits.any():
                    score = np.where(fits, (size / cap) @ (room / cap), -1.0)
                    pick = int(score.argmax())
                    example, start, end = pool[pick]
                    alive[pick] = False
                    left -= 1
                else:
                    pick, cut = self._cut(pool, size, alive, room)
                    if pick is None:
                        break
                    example, start, rest = pool[pick]
                    end = start + cut
                    pool[pick] = (example, end, rest)
                    size[pick] = [rest - end, 1, loss_of(example, end, rest)]
                pieces.append((example, start, end))
                room -= [end - start, 1, loss_of(example, start, end)]
            if not left and room[0] > 0:
                self._close_by_powers(pieces)
            else:
                self._close(pieces)
        self.pool = [p for p, a in zip(pool, alive, strict=True) if a]

    @staticmethod
    def _cut(pool: list, size: np.ndarray, alive: np.ndarray, room: np.ndarray) -> tuple[int | None, int]:
        """The shortest waiting example and how much of it fills the room that is left."""
        pick = int(np.where(alive, size[:, 0], np.inf).argmin())
        example, start, end = pool[pick]
        cut = int(min(room[0], end - start))
        bare = max(0, example.prompt - start)
        cut = int(min(cut, bare + room[2]))
        return (pick, cut) if cut > 0 else (None, 0)

    def _close_by_powers(self, pieces: list[tuple[Example, int, int]]) -> None:
        """The last, unfilled sequence of a partition: parts of power-of-two length need no padding."""
        total = sum(e - s for _, s, e in pieces)
        while total:
            part = want = 1 << (total.bit_length() - 1)
            taken = []
            while want:
                example, start, end = pieces.pop(0)
                cut = min(want, end - start)
                taken.append((example, start, start + cut))
                if start + cut < end:
                    pieces.insert(0, (example, start + cut, end))
                want -= cut
            self._close(taken)
            total -= part


def loss_of(example: Example, start: int, end: int) -> int:
    return max(0, end - max(start, example.prompt))


def pack(
    examples: DataFrame,
    tokenizer_path: str,
    limits: Limits = Limits(),
    prompt: str | None = None,
) -> DataFrame:
    """Pieces of ``examples`` (``doc_id``, ``text``) placed in sequences, with their ids.

    ``prompt`` names a text column whose tokens come before those of ``text`` and bear no loss.
    An example ends with id 1. Pieces of an example follow each other without gap or overlap.
    A null or empty text is an example of that one id. Rows with equal or null ``doc_id`` are
    examples of their own. Other columns are ignored; no rows give no rows. ``ids`` holds the
    piece's ids as unsigned little-endian 32-bit integers.
    """
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(PIECES))
    before = F.col(prompt) if prompt else F.lit(None).cast("string")
    rows = examples.select(F.col("doc_id").cast("long").alias("doc_id"), before.alias("prompt"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer_path)
        packer = Packer(limits, TaskContext.get().partitionId() << SEQUENCE_BITS)
        end = np.array([END_ID], "<u4").tobytes()

        def taken() -> pa.RecordBatch:
            columns = zip(*packer.rows, strict=True)
            arrays = [pa.array(c, t.type) for c, t in zip(columns, target, strict=True)]
            packer.rows = []
            return pa.RecordBatch.from_arrays(arrays, schema=target)

        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                ids, heads, texts = (c.to_pylist() for c in batch.slice(at, BATCH_DOCS).columns)
                head_ids = tokens.encode(heads) if prompt else [b""] * len(ids)
                for doc, head, body in zip(ids, list(head_ids), tokens.encode(texts), strict=True):
                    whole = head + body + end
                    packer.add(Example(doc, whole, len(head) // 4, len(whole) // 4))
                if packer.rows:
                    yield taken()
        packer.finish()
        if packer.rows:
            yield taken()

    return rows.mapInArrow(run, PIECES)
