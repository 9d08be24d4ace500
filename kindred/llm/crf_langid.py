"""Language of every word, and of a text, by a linear-chain conditional random field.

A word's features are its beginnings and ends, its character n-grams, itself, and the languages
whose learned lexicon has it. Learned transitions join the words of a chain, so that text which
switches languages is labelled piece by piece; forward-backward gives each word's probabilities,
and a text has the language with the largest mean probability over all its words. Chains are runs
of at most ``Fit.chain`` words: all chains of a batch advance together, one matrix step per word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import one_text_per_id, texts_of

LONGEST = 40
UNKNOWN = "und"
BATCH_DOCS = 256
CACHE_WORDS = 400_000
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Fit:
    """At most ``per_lang`` labelled rows of each language, those with the smallest hash of their id
    and at most ``most_chars`` characters, are used to fit; every row is labelled wholly."""

    per_lang: int = 150
    most_chars: int = 6_000
    buckets: int = 1 << 15
    lexicon_least: int = 5
    chain: int = 32
    epochs: int = 3
    batch: int = 128
    rate: float = 0.1
    decay: float = 1e-6
    switch: float = 0.3
    seed: int = 3


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, as far as Python's word characters without digits go.

    A run of more than ``LONGEST`` letters, as in text without spaces, is cut into pieces of so many.
    """
    found = [w for w in _WORD.findall(text.lower()) if w[0].isalpha() or any(map(str.isalpha, w))] if text else []
    if max(map(len, found), default=0) <= LONGEST:
        return found
    pieces = [w[i : i + LONGEST] for w in found for i in range(0, len(w), LONGEST)]
    return [w for w in pieces if any(map(str.isalpha, w))]


def marks(word: str) -> list[bytes]:
    """Affixes, n-grams and the word itself."""
    w = word.encode()
    edged = f"^{word}$"
    out = [b"w" + w]
    out += [f"p{word[:n]}".encode() for n in (1, 2, 3)] + [f"s{word[-n:]}".encode() for n in (1, 2, 3)]
    out += [edged[i : i + n].encode() for n in (2, 3) for i in range(len(edged) - n + 1)]
    return out


class Field:
    """Weights of a linear-chain field over ``langs``."""

    def __init__(self, langs: list[str], fit: Fit) -> None:
        self.langs, self.fit = langs, fit
        n = len(langs)
        self.weights = np.zeros((fit.buckets + n, n))
        self.moves = np.zeros((n, n))
        self.lexicon: dict[str, int] = {}

    def feature_rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all words in a row, and where each word's begin."""
        flat, starts = [], []
        for word in words:
            starts.append(len(flat))
            flat += [crc32(m) % self.fit.buckets for m in marks(word)]
            if word in self.lexicon:
                flat.append(self.fit.buckets + self.lexicon[word])
        return np.array(flat, int), np.array(starts, int)

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.langs)))
        flat, starts = self.feature_rows(words)
        return np.add.reduceat(self.weights[flat], starts)

    def marginals(self, scores: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward over chains (chain, place, lang): word probabilities and expected moves.

        Places that are not ``real`` only follow real ones and have no say.
        """
        step = np.exp(self.moves - self.moves.max())
        e = np.exp(scores - scores.max(axis=2, keepdims=True))
        e[~real] = 1.0
        length = e.shape[1]
        forward, backward = np.empty_like(e), np.ones_like(e)
        forward[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, length):
            f = (forward[:, t - 1] @ step) * e[:, t]
            forward[:, t] = f / f.sum(axis=1, keepdims=True)
        for t in range(length - 2, -1, -1):
            b = (backward[:, t + 1] * e[:, t + 1]) @ step.T
            b = np.where(real[:, t + 1, None], b, 1.0)
            backward[:, t] = b / b.sum(axis=1, keepdims=True)
        word = forward * backward
        word /= word.sum(axis=2, keepdims=True)
        return word, (forward, backward, e, step)

    def train(self, texts: list[list[str]], labels: list[int]) -> None:
        """Adagrad on the log-likelihood of chains, some of which are spliced from two languages."""
        rng, fit, n = np.random.default_rng(self.fit.seed), self.fit, len(self.langs)
        seen = [Counter() for _ in range(n)]
        for words, y in zip(texts, labels, strict=True):
            seen[y].update(words)
        total = Counter()
        for c in seen:
            total.update(c)
        for word, count in total.items():
            if count >= fit.lexicon_least:
                best = max(range(n), key=lambda y: seen[y][word])
                if seen[best][word] >= 0.9 * count:
                    self.lexicon[word] = best
        vocabulary = sorted(total)
        number = {w: i for i, w in enumerate(vocabulary)}
        flat, starts = self.feature_rows(vocabulary)
        ends = np.append(starts[1:], len(flat))
        chains = []
        for words, y in zip(texts, labels, strict=True):
            ids = np.array([number[w] for w in words], int)
            chains += [(ids[i : i + fit.chain], np.full(len(ids[i : i + fit.chain]), y)) for i in range(0, len(ids), fit.chain)]
        history, moves_history = np.full_like(self.weights, 1e-4), np.full_like(self.moves, 1e-4)
        for _ in range(fit.epochs):
            order = rng.permutation(len(chains))
            for at in range(0, len(order), fit.batch):
                part = [self.spliced(chains, int(i), rng) for i in order[at : at + fit.batch]]
                ids = np.full((len(part), fit.chain), -1)
                truth = np.zeros((len(part), fit.chain), int)
                for r, (w, y) in enumerate(part):
                    ids[r, : len(w)], truth[r, : len(w)] = w, y
                real = ids >= 0
                words, place = np.unique(ids[real], return_inverse=True)
                spans = [flat[starts[w] : ends[w]] for w in words]
                own = np.concatenate(spans)
                sizes = np.array([len(s) for s in spans])
                emitted = np.add.reduceat(self.weights[own], np.cumsum(sizes) - sizes)
                scores = np.zeros((*ids.shape, n))
                scores[real] = emitted[place]
                p, (f, b, e, step) = self.marginals(scores, real)
                gap = -p
                np.put_along_axis(gap, truth[..., None], np.take_along_axis(gap, truth[..., None], 2) + 1, 2)
                by_word = np.zeros((len(words), n))
                np.add.at(by_word, place, gap[real])
                spread = np.repeat(by_word, sizes, axis=0)
                g = np.stack([np.bincount(own, spread[:, y], len(self.weights)) for y in range(n)], axis=1) / len(part)
                pair = real[:, 1:] & real[:, :-1]
                joint = f[:, :-1, :, None] * step * (e * b)[:, 1:, None, :]
                joint /= joint.sum(axis=(2, 3), keepdims=True)
                observed = np.zeros((n, n))
                np.add.at(observed, (truth[:, :-1][pair], truth[:, 1:][pair]), 1)
                m = (observed - joint[pair].sum(axis=0)) / len(part)
                g -= fit.decay * self.weights
                history += g * g
                moves_history += m * m
                self.weights += fit.rate * g / np.sqrt(history)
                self.moves += fit.rate * m / np.sqrt(moves_history)

    def spliced(self, chains: list, i: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        words, labels = chains[i]
        if rng.random() >= self.fit.switch or len(words) < 4:
            return words, labels
        other, theirs = chains[int(rng.integers(len(chains)))]
        cut = int(rng.integers(1, len(words)))
        tail = len(words) - cut
        return np.concatenate([words[:cut], other[:tail]]), np.concatenate([labels[:cut], theirs[:tail]])


class Labeller:
    """A field at work: words' scores are kept, chains of many texts advance together."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(field.langs)))

    def probabilities(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Per text an array (word, language)."""
        n, size = len(self.field.langs), self.field.fit.chain
        if len(self.number) > CACHE_WORDS:
            self.number, self.scores = {}, np.zeros((0, n))
        new = sorted(set().union(*texts).difference(self.number))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        if new:
            self.scores = np.concatenate([self.scores, self.field.emissions(new)])
        out, held, width = [], [], 0
        for words in texts:
            held.append(words)
            width += len(words)
            if width > 50_000:
                out += self._together(held, n, size)
                held, width = [], 0
        return out + self._together(held, n, size)

    def _together(self, texts: list[list[str]], n: int, size: int) -> list[np.ndarray]:
        counts = [len(t) for t in texts]
        rows = [-(-c // size) for c in counts]
        ids = np.full(sum(rows) * size, -1)
        at, spans = 0, []
        for words, c, r in zip(texts, counts, rows, strict=True):
            ids[at : at + c] = np.fromiter(map(self.number.__getitem__, words), int, c)
            spans.append((at, at + c))
            at += r * size
        if not at:
            return [np.zeros((0, n)) for _ in texts]
        real = (ids >= 0).reshape(-1, size)
        scores = np.zeros((len(ids), n))
        scores[ids >= 0] = self.scores[ids[ids >= 0]]
        p, _ = self.field.marginals(scores.reshape(-1, size, n), real)
        p = p.reshape(-1, n)
        return [p[a:b] for a, b in spans]

    def texts(self, texts: list[str | None]) -> list[tuple[str, float, np.ndarray]]:
        """Language, its mean probability, and word probabilities of each text."""
        words = [words_of(t) for t in texts]
        if not self.field.langs:
            return [(UNKNOWN, 0.0, np.zeros((len(w), 0))) for w in words]
        out = []
        for p in self.probabilities(words):
            mean = p.mean(axis=0) if len(p) else None
            best = int(mean.argmax()) if mean is not None else -1
            out.append((self.field.langs[best], min(1.0, float(mean[best])), p) if len(p) else (UNKNOWN, 0.0, p))
        return out


def fit_field(docs: DataFrame, fit: Fit = Fit()) -> Field:
    """A field from the rows of ``docs`` (``doc_id``, ``text``, ``lang``) with a language.

    Every word of a row counts as of the row's language. Of equal ids one text per language takes part
    (``one_text_per_id``), so the sample is bounded however often an id repeats. Without usable rows the
    field has no language.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (F.length("text") <= fit.most_chars))
    order = Window.partitionBy("lang").orderBy("pick", "doc_id")
    ids = one_text_per_id(known, "lang").withColumn("pick", F.xxhash64("doc_id", F.lit(fit.seed)))
    chosen = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= fit.per_lang).select("doc_id", "lang", "mark")
    # Bounded by the limit above per language.
    sample = texts_of(known, chosen, "lang").collect()
    sample = sorted(sample, key=lambda r: (str(r["doc_id"]), r["lang"], r["text"]))
    rows = [(words_of(r["text"]), r["lang"]) for r in sample]
    rows = [(w, y) for w, y in rows if w]
    field = Field(sorted({y for _, y in rows}), fit)
    if rows:
        field.train([w for w, _ in rows], [field.langs.index(y) for _, y in rows])
    return field


def label(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` of every row, over the whole text.

    ``spans`` lists runs of words with one most probable language: first word, number of words,
    language. A null text, or one without a letter, is ``und`` with score 0 and no spans. Rows with
    equal or null ids are rows of their own; other columns are ignored; no rows give no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(field)  # a few megabytes
    span = pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("lang", pa.string())])
    target = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("spans", pa.list_(span))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shipped.value)
        langs = labeller.field.langs
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(at, BATCH_DOCS)
                found = labeller.texts(part.column(1).to_pylist())
                spans = []
                for _, _, p in found:
                    best = p.argmax(axis=1) if p.size else np.zeros(0, int)
                    starts = np.flatnonzero(np.diff(best, prepend=-1))
                    sizes = np.diff(np.append(starts, len(best)))
                    spans.append([{"first_word": int(a), "n_words": int(n), "lang": langs[best[a]]} for a, n in zip(starts, sizes, strict=True)])
                columns = [part.column(0), pa.array([x[0] for x in found]), pa.array([x[1] for x in found]), pa.array(spans, target.field(3).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=target)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, spans array<struct<first_word: int, n_words: int, lang: string>>"
    )


def keep_known(docs: DataFrame, field: Field, least: float) -> DataFrame:
    """The rows of ``docs`` whose language is known with a score of ``least`` or more, columns as they are.

    Rows without a text, or with one that has no letter, go; repeated rows and null ids stay as often
    as they come; no rows give no rows. Only the text passes to Python, and only the decision back.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(field)

    def decide(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        labeller = Labeller(shipped.value)
        for batch in texts:
            known: list[bool] = []
            for at in range(0, len(batch), BATCH_DOCS):
                found = labeller.texts(batch.slice(at, BATCH_DOCS).to_pylist())
                known += [x[0] != UNKNOWN and x[1] >= least for x in found]
            yield pa.array(known, pa.bool_())

    decide.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.where(F.arrow_udf(decide, "boolean")("text"))
