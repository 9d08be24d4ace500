"""Quality of a text by a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Learned filters over byte
embeddings run along each chunk and are max-pooled; a hidden layer turns a chunk into a vector, and
the mean and the maximum of these over all chunks give one probability. For scoring, embedding and
filter are folded into one table per filter position, so that a convolution is a sum of look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import one_text_per_id, texts_of
from kindred.session import broadcast_if_fits

CHUNK, HOP = 256, 224
SLICE = 64


@dataclass(frozen=True)
class Fit:
    """At most ``per_class`` labelled rows of each label, those with the smallest hash of their id
    and at most ``most_chars`` characters, are used to fit; every row is scored wholly."""

    per_class: int = 700
    most_chars: int = 6_000
    width: int = 7
    embedding: int = 8
    filters: int = 24
    hidden: int = 16
    epochs: int = 14
    batch: int = 32
    rate: float = 0.004
    seed: int = 5


def chunks_of(text: str | None) -> np.ndarray:
    """The text's bytes as rows of CHUNK bytes that overlap by CHUNK - HOP; zeros fill up the last."""
    data = np.frombuffer(text.encode(), np.uint8) if text else np.zeros(0, np.uint8)
    n = max(1, -(-(len(data) - (CHUNK - HOP)) // HOP))
    padded = np.zeros((n - 1) * HOP + CHUNK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::HOP]


class Network:
    """Weights, the forward pass, and training by back-propagation."""

    def __init__(self, fit: Fit) -> None:
        rng = np.random.default_rng(fit.seed)
        self.fit = fit

        def start(*shape: int, fan: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(fan)).astype(np.float32)

        self.w = {
            "embed": start(256, fit.embedding, fan=1),
            "filter": start(fit.width, fit.embedding, fit.filters, fan=fit.width * fit.embedding),
            "filter_bias": np.zeros(fit.filters, np.float32),
            "hidden": start(fit.filters, fit.hidden, fan=fit.filters),
            "hidden_bias": np.zeros(fit.hidden, np.float32),
            "out": start(2 * fit.hidden, fan=2 * fit.hidden),
            "out_bias": np.zeros(1, np.float32),
        }
        self.fold()

    def fold(self) -> None:
        self.tables = [self.w["embed"] @ f for f in self.w["filter"]]

    def pooled(self, chunks: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter in each chunk and, for training, its place."""
        span = CHUNK - self.fit.width + 1
        best = np.empty((len(chunks), self.fit.filters), np.float32)
        place = np.empty(best.shape, np.int64) if where else None
        for at in range(0, len(chunks), SLICE):
            part = chunks[at : at + SLICE]
            response = self.tables[0][part[:, :span]]
            for o in range(1, self.fit.width):
                response += self.tables[o][part[:, o : o + span]]
            if where:
                place[at : at + SLICE] = response.argmax(axis=1)
            best[at : at + SLICE] = response.max(axis=1)
        return best + self.w["filter_bias"], place

    def forward(self, pooled: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Document logits; ``starts`` has the first chunk of each document."""
        c = np.maximum(pooled, 0)
        h = np.maximum(c @ self.w["hidden"] + self.w["hidden_bias"], 0)
        n = np.diff(np.append(starts, len(h)))
        mean = np.add.reduceat(h, starts) / n[:, None]
        most = np.maximum.reduceat(h, starts)
        z = np.concatenate([mean, most], axis=1) @ self.w["out"] + self.w["out_bias"]
        return {"c": c, "h": h, "n": n, "mean": mean, "most": most, "z": z}

    def probability(self, chunks: list[np.ndarray]) -> np.ndarray:
        sizes = [len(c) for c in chunks]
        starts = np.cumsum([0, *sizes[:-1]])
        pooled = np.concatenate([self.pooled(c)[0] for c in chunks])
        z = self.forward(pooled, starts)["z"].astype(float)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def gradients(self, chunks: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        pooled, place = self.pooled(chunks, where=True)
        f = self.forward(pooled, starts)
        p = 1 / (1 + np.exp(-np.clip(f["z"], -40, 40)))
        dz = ((p - y) * weight / weight.sum()).astype(np.float32)
        owner = np.repeat(np.arange(len(starts)), f["n"])
        half = self.fit.hidden
        both = np.concatenate([f["mean"], f["most"]], axis=1)
        top = (f["h"] == f["most"][owner]).astype(np.float32)
        top /= np.add.reduceat(top, starts)[owner]
        dh = dz[owner, None] * (self.w["out"][:half] / f["n"][owner, None] + self.w["out"][half:] * top)
        dh = dh * (f["h"] > 0)
        dc = (dh @ self.w["hidden"].T) * (pooled > 0)
        offsets = np.arange(self.fit.width)
        seen = chunks[np.arange(len(chunks))[:, None, None], place[:, :, None] + offsets]  # chunk, filter, offset
        spread = np.zeros_like(self.w["filter"])
        to_embed = np.zeros_like(self.w["embed"])
        for o in offsets:
            e = self.w["embed"][seen[:, :, o]]
            spread[o] = np.einsum("cf,cfd->df", dc, e)
            back = dc[:, :, None] * self.w["filter"][o].T[None]
            flat, code = back.reshape(-1, self.fit.embedding), seen[:, :, o].ravel()
            for d in range(self.fit.embedding):
                to_embed[:, d] += np.bincount(code, flat[:, d], 256).astype(np.float32)
        return {
            "embed": to_embed, "filter": spread, "filter_bias": dc.sum(axis=0), "hidden": f["c"].T @ dh,
            "hidden_bias": dh.sum(axis=0), "out": both.T @ dz, "out_bias": dz.sum(keepdims=True),
        }

    def train(self, texts: list[str], labels: np.ndarray, weights: np.ndarray) -> None:
        rng = np.random.default_rng(self.fit.seed + 1)
        docs = [chunks_of(t) for t in texts]
        mean, square = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        step = 0
        for epoch in range(self.fit.epochs):
            order = rng.permutation(len(docs))
            rate = self.fit.rate * (1 - epoch / self.fit.epochs)
            for at in range(0, len(order), self.fit.batch):
                pick = order[at : at + self.fit.batch]
                starts = np.cumsum([0, *[len(docs[i]) for i in pick[:-1]]])
                g = self.gradients(np.concatenate([docs[i] for i in pick]), starts, labels[pick], weights[pick])
                step += 1
                for k in self.w:
                    mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                    square[k] = 0.999 * square[k] + 0.001 * g[k] ** 2
                    self.w[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-7)
                self.fold()


def fit_network(docs: DataFrame, labels: DataFrame, fit: Fit = Fit()) -> Network:
    """A network from ``docs`` (``doc_id``, ``text``) and ``labels`` (``doc_id``, ``label`` 0 or 1).

    Classes are weighted by their share of all labels, so that one half is even odds. Of several
    labels of an id the smallest counts, of several texts one (``one_text_per_id``). With fewer than two classes the score is that share.
    """
    known = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"))
    shares = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    pick = F.xxhash64(F.col("doc_id"), F.lit(fit.seed))
    short = docs.select("doc_id", "text").where(F.length("text") <= fit.most_chars)
    ids = one_text_per_id(short).join(broadcast_if_fits(known, 32), "doc_id").withColumn("pick", pick)
    parts = [ids.where(F.col("label") == y).orderBy("pick", "doc_id").limit(fit.per_class) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).select("doc_id", "mark", "label")
    # Bounded by the limits above.
    sample = sorted(texts_of(short, chosen, "label").collect(), key=lambda r: (r["doc_id"], r["text"]))
    network = Network(fit)
    y = np.array([r["label"] for r in sample], np.float32)
    if len(set(y.tolist())) < 2:
        share = (shares.get(1, 0) + 1) / (sum(shares.values()) + 2)
        network.w["out"][:] = 0
        network.w["out_bias"][:] = np.log(share / (1 - share))
        return network
    weight = np.where(y == 1, shares[1] / y.sum(), shares[0] / (1 - y).sum()).astype(np.float32)
    network.train([r["text"] for r in sample], y, weight / weight.mean())
    return network


def score(docs: DataFrame, network: Network) -> DataFrame:
    """``doc_id, score`` of every row, over the whole text.

    A null or empty text is one chunk of zeros. Rows with equal or null ids are rows of their own;
    other columns are ignored; no rows give no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(network)  # tens of kilobytes
    target = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            scores = [float(model.probability([chunks_of(t.as_py())])[0]) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], schema=target)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
