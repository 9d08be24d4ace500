"""Exact top-k inner-product search with two cover trees per block of queries and data.

Queries and data are dealt into blocks of bounded size by a hash; every pair of blocks is a cell,
and a cell is one small group. In a cell both sides get a cover tree, and pairs of nodes are
visited best first: for query node (c, r) and data node (d, s) no inner product can exceed
<c,d> + r|d| + s|c| + r s, so a pair is left out once that is below the worst k-th score that the
node's queries already have. Results of the cells meet in one ranking per query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import map_groups
from kindred.session import cut_lineage

DATA_ROWS = 8192
QUERY_ROWS = 2048
LEAF = 64
FANOUT = 16
EXACT = 2.0**53
LOWEST = np.iinfo(np.int64).min + 1  # its negative is a long too


@dataclass
class Node:
    """A ball around one of its points; children cover its points, their centres lie apart."""

    center: np.ndarray
    norm: float
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(points: np.ndarray, rows: np.ndarray, center: int) -> Node:
    """The tree over ``points[rows]`` around row ``center``.

    Children are centred by farthest-point traversal starting at the parent's centre (nesting):
    centres are pairwise at least as far apart (separation) as any point is from its nearest
    centre (covering).
    """
    own = points[rows]
    away = np.sqrt(((own - points[center]) ** 2).sum(axis=1))
    node = Node(points[center], float(np.sqrt(points[center] @ points[center])), float(away.max()), rows)
    if len(rows) <= LEAF or node.radius == 0:
        return node
    centers, nearest, owner = [center], away, np.zeros(len(rows), int)
    while len(centers) < FANOUT and nearest.max() > 0:
        far = int(nearest.argmax())
        away = np.sqrt(((own - own[far]) ** 2).sum(axis=1))
        owner[away < nearest] = len(centers)
        nearest = np.minimum(nearest, away)
        centers.append(int(rows[far]))
    node.children = [
        cover_tree(points, rows[owner == i], c) for i, c in enumerate(centers) if (owner == i).any()
    ]
    return node


class DualSearch:
    """The k best data rows of every query of a cell, ties to the smaller id."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> None:
        self.k, self.query_ids, self.ids = k, query_ids, ids
        self.queries, self.data = queries, data
        wide = max(np.abs(queries.astype(float)).max(initial=0), np.abs(data.astype(float)).max(initial=0))
        exact = wide * wide * queries.shape[1] < EXACT
        self.left, self.right = (queries.astype(float), data.astype(float)) if exact else (queries, data)
        self.scores = np.full((len(queries), k), -np.inf if exact else LOWEST)
        if not exact:
            self.scores = self.scores.astype(np.int64)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.pairs = 0
        points, places = queries.astype(float), data.astype(float)
        self.slack = 1e-9 * max(1.0, wide * wide * queries.shape[1])
        roots = cover_tree(points, np.arange(len(points)), 0), cover_tree(places, np.arange(len(places)), 0)
        self.visit(*roots)

    def bound(self, q: Node, d: Node) -> float:
        return float(q.center @ d.center) + q.radius * d.norm + d.radius * q.norm + q.radius * d.radius + self.slack

    def visit(self, q: Node, d: Node) -> None:
        if self.bound(q, d) < self.scores[q.rows, -1].min():
            return
        if not q.children and not d.children:
            self.compare(q.rows, d.rows)
        elif d.children and (not q.children or d.radius >= q.radius):
            for child in sorted(d.children, key=lambda c: -self.bound(q, c)):
                self.visit(q, child)
        else:
            for child in q.children:
                self.visit(child, d)

    def compare(self, q: np.ndarray, d: np.ndarray) -> None:
        self.pairs += len(q) * len(d)
        score = self.left[q] @ self.right[d].T
        ids = np.broadcast_to(self.ids[d], score.shape)
        worst = LOWEST if score.dtype.kind == "i" else -np.inf
        own = ids == self.query_ids[q][:, None]
        score = np.where(own, worst, score)
        better = (score >= self.scores[q, -1][:, None]) & ~own
        some = better.any(axis=1)
        if not some.any():
            return
        q, score, ids = q[some], score[some], np.where(own[some], np.iinfo(np.int64).max, ids[some])
        all_scores = np.concatenate([self.scores[q], score], axis=1)
        all_ids = np.concatenate([self.found[q], ids], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=-1)[:, : self.k]
        self.scores[q] = np.take_along_axis(all_scores, order, axis=1)
        self.found[q] = np.take_along_axis(all_ids, order, axis=1)


def integer_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """``vec_id, v, width``: floor(scale * x) of each component.

    A null vector, one that holds null or a non-finite number, an empty one and a null id take no
    part. Rows that repeat an id count once, with the smallest vector.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.forall("x", lambda c: F.coalesce(F.abs(c) < F.lit(math.inf), F.lit(False)))  # false for NaN too
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
        .where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & usable & ~F.exists("x", F.isnan))
        .groupBy("vec_id")
        .agg(F.min(F.transform("x", lambda c: F.floor(c * scale))).alias("v"))
        .withColumn("width", F.size("v"))
    )


def search(vectors: DataFrame, every: int, k: int, scale: float = 256.0) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best rows for every row whose id ``every`` divides.

    Vectors of different width are never compared. A query with fewer than ``k`` candidates has as
    many rows as it has candidates. No rows give no rows. Scores have to fit a long.
    """
    whole = cut_lineage(integer_vectors(vectors, scale))
    is_query = F.col("vec_id") % every == 0
    sizes = whole.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    data_blocks = max(1, math.ceil(sizes["n"] / DATA_ROWS))
    query_blocks = max(1, math.ceil(sizes["q"] / QUERY_ROWS))

    def block(n: int, seed: int) -> F.Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n)).cast("int")

    def each(n: int) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    data = whole.select("width", each(query_blocks).alias("q"), block(data_blocks, 1).alias("d"), "vec_id", "v", F.lit(False).alias("asks"))
    asked = whole.where(is_query).select(
        "width", block(query_blocks, 2).alias("q"), each(data_blocks).alias("d"), "vec_id", "v", F.lit(True).alias("asks")
    )

    def cell(group: pa.Table) -> dict[str, list] | None:
        asks = group.column("asks").to_numpy()
        ids = group.column("vec_id").to_numpy()
        flat = group.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        v = flat.reshape(len(ids), -1)
        if asks.all() or not asks.any():
            return None
        order = np.argsort(ids[~asks], kind="stable")
        found = DualSearch(v[asks], ids[asks], v[~asks][order], ids[~asks][order], k)
        real = found.found != np.iinfo(np.int64).max
        return {
            "query_id": np.repeat(found.query_ids, real.sum(axis=1)),
            "vec_id": found.found[real],
            "score": found.scores[real].astype(np.int64),
        }

    found = map_groups(data.unionByName(asked), ["width", "q", "d"], cell, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
