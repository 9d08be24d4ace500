"""Toxicity from confirmed toxic examples and unlabelled text alone.

Classifiers are trained with the non-negative positive-unlabelled risk: unlabelled text stands for
the negatives after the share that the class prior says is positive has been taken off, and that
difference may not become negative. Features are the words of a text and their beginnings, as far as
they are clearly more frequent in toxic than in unlabelled text; a text counts by its strongest one,
because one insult in a long text is enough. A model is a short weighted lexicon, and a whole text
is scored with one look-up per distinct word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import one_text_per_id, texts_of
from kindred.session import broadcast_if_fits

BEGINNINGS = (4, 5)
_WORD = re.compile(r"[^\W\d_]+")
_ID_BYTES = 32


@dataclass(frozen=True)
class Fit:
    """Bounds of the sample and parameters of training.

    At most ``positives`` toxic and ``unlabelled`` other rows, those with the smallest hash of
    their id, of at most ``most_chars`` characters, are used to fit; every row is scored.
    """

    positives: int = 1000
    unlabelled: int = 4000
    most_chars: int = 50_000
    least_texts: int = 4  # toxic ones that have a feature
    least_odds: float = 1.0
    epochs: int = 20
    rate: float = 0.02
    models: int = 3
    seed: int = 7


def features(text: str | None) -> set[str]:
    """Lower-cased words, and the beginnings of longer ones marked by a trailing star."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return words | {w[:n] + "*" for n in BEGINNINGS for w in words if len(w) > n}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Texts:
    """Rows of feature numbers, each with feature 0, whose weight is always zero."""

    def __init__(self, rows: list[set[str]], number: dict[str, int]) -> None:
        kept = [np.array([0, *sorted(number[f] for f in row if f in number)]) for row in rows]
        self.sizes = np.array([len(r) for r in kept])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.concatenate(kept)

    def strongest(self, which: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The feature of largest weight of each of the rows ``which``."""
        parts = [self.flat[self.starts[i] : self.starts[i] + self.sizes[i]] for i in which]
        return np.array([p[w[p].argmax()] for p in parts])


def cautious_odds(k_toxic: np.ndarray, n_toxic: int, k_other: np.ndarray, n_other: int, prior: float) -> np.ndarray:
    """log P(f | toxic) / P(f | clean) from counts, each taken a standard error or two to the safe side.

    The clean rate is what is left of the unlabelled rate without the prior's share of the toxic one.
    """
    toxic = (k_toxic - np.sqrt(k_toxic)) / n_toxic
    other = (k_other + 2 * np.sqrt(k_other) + 1) / n_other
    return np.log(np.maximum(toxic, 1e-9) / np.maximum((other - prior * toxic) / (1 - prior), 0.5 / n_other))


def train(toxic: list[set[str]], unlabelled: list[set[str]], prior: float, fit: Fit) -> list[tuple[dict[str, float], float]]:
    """One ``(weights, bias)`` per model; without toxic examples the prior alone."""
    bias = float(np.log(prior / (1 - prior)))
    if not toxic or not unlabelled:
        return [({}, bias)]
    in_toxic, in_other = Counter(), Counter()
    for row in toxic:
        in_toxic.update(row)
    for row in unlabelled:
        in_other.update(row)
    names = sorted(f for f, n in in_toxic.items() if n >= fit.least_texts)
    counts = np.array([[in_toxic[f], in_other[f]] for f in names], float).reshape(-1, 2)
    odds = cautious_odds(counts[:, 0], len(toxic), counts[:, 1], len(unlabelled), prior)
    lexicon = [(f, o) for f, o in zip(names, odds, strict=True) if o > fit.least_odds]
    number = {f: i + 1 for i, (f, _) in enumerate(lexicon)}
    start = np.array([0.0, *[o for _, o in lexicon]])
    p, u = Texts(toxic, number), Texts(unlabelled, number)
    models = []
    for m in range(fit.models):
        w, b = nonnegative_risk(p, u, start, bias, prior, fit, np.random.default_rng(fit.seed + m))
        models.append(({f: float(w[i]) for f, i in number.items() if w[i] > 0}, b))
    return models


def nonnegative_risk(
    p: Texts, u: Texts, start: np.ndarray, bias: float, prior: float, fit: Fit, rng: np.random.Generator
) -> tuple[np.ndarray, float]:
    """Minimise prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]), l the logistic loss, by Adam.

    f is the bias plus the weight of the text's strongest feature.
    """
    w = np.append(start, bias)  # the bias is the last
    mean, square, step, batches = np.zeros_like(w), np.zeros_like(w), 0, 8
    for _ in range(fit.epochs):
        pos, oth = rng.permutation(len(p.sizes)), rng.permutation(len(u.sizes))
        for part_p, part_u in zip(np.array_split(pos, batches), np.array_split(oth, batches), strict=True):
            if not len(part_p) or not len(part_u):
                continue
            fp, fu = p.strongest(part_p, w), u.strongest(part_u, w)
            zp, zu = w[fp] + w[-1], w[fu] + w[-1]
            as_negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            neg_u, neg_p = sigmoid(zu) / len(zu), -prior * sigmoid(zp) / len(zp)
            if as_negative < 0:  # the estimate has been overfitted: step back from it
                gp, gu = -neg_p, -neg_u
            else:
                gp, gu = neg_p - prior * sigmoid(-zp) / len(zp), neg_u
            g = np.bincount(fp, gp, len(w)) + np.bincount(fu, gu, len(w))
            g[-1] = gp.sum() + gu.sum()
            g[0] = 0
            step += 1
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g * g
            w -= fit.rate * mean / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
            w[:-1] = np.maximum(w[:-1], 0)
    return w[:-1], float(w[-1])


def class_prior(labels: DataFrame) -> float:
    """The share of toxic among the labelled rows (``label`` 0 or 1), between 0.1 % and 50 %."""
    share = labels.agg(F.avg(F.col("label").cast("double")).alias("share")).first()["share"]
    return min(0.5, max(0.001, share or 0.001))


def fit_models(docs: DataFrame, toxic_ids: DataFrame, prior: float, fit: Fit = Fit()) -> list[tuple[dict[str, float], float]]:
    """Models from the rows of ``docs`` (``doc_id``, ``text``) and the ids confirmed as toxic.

    Toxic rows may be among the unlabelled ones: that is what the prior corrects. Of several texts of
    an id one takes part (``one_text_per_id``).
    """
    rows = docs.select("doc_id", "text").where(F.length("text") <= fit.most_chars)
    ids = one_text_per_id(rows.where(F.col("doc_id").isNotNull())).withColumn("pick", F.xxhash64(F.col("doc_id"), F.lit(fit.seed)))
    other = ids.orderBy("pick", "doc_id").limit(fit.unlabelled)
    confirmed = toxic_ids.select("doc_id").distinct()
    positive = ids.join(broadcast_if_fits(confirmed, _ID_BYTES), "doc_id", "left_semi").orderBy("pick", "doc_id").limit(fit.positives)
    chosen = positive.withColumn("toxic", F.lit(True)).unionByName(other.withColumn("toxic", F.lit(False))).drop("pick")
    # Bounded by the two limits above.
    sample = texts_of(rows, chosen, "toxic").collect()
    sample = sorted(sample, key=lambda r: (r["doc_id"], r["toxic"], r["text"]))
    return train([features(r["text"]) for r in sample if r["toxic"]], [features(r["text"]) for r in sample if not r["toxic"]], prior, fit)


def score(docs: DataFrame, models: list[tuple[dict[str, float], float]]) -> DataFrame:
    """``doc_id, score`` of every row: the mean of the models' probabilities over the whole text.

    A null or empty text has no words and gets the bias alone. Rows with equal or null ids are
    rows of their own; other columns are ignored; no rows give no rows.
    """
    names = sorted(set().union(*[w for w, _ in models]))
    table = {f: np.array([w.get(f, 0.0) for w, _ in models]) for f in names}
    bias = np.array([b for _, b in models])
    shipped = docs.sparkSession.sparkContext.broadcast((table, bias))  # a lexicon of bounded size
    target = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, start = shipped.value
        for batch in batches:
            scores = []
            for text in batch.column(1):
                known = weights.keys() & features(text.as_py())
                strongest = np.max([weights[f] for f in known], axis=0) if known else 0.0
                scores.append(float(sigmoid(start + strongest).mean()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], schema=target)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
