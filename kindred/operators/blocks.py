"""Exact search in a catalogue of any size.

Items are assigned to cells around a bounded number of pivots.  The angle of a user to a
pivot and the cell's radius bound every score inside the cell from both sides, so a user
visits only the cells that can still hold one of their best ``n`` items.  Users and items
then meet in an equi-join on ``(cell, user block, item block)``; blocks have a target size,
so a cell that holds a third of the catalogue is simply many blocks.  Each block keeps
each user's local best before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.vectors import dot, vector_sum
from kindred.operators.profiles import taken_items
from kindred.operators.selection import (
    SCORE_DIGITS,
    ListSpec,
    greedy_picks,
    local_kmeans,
)
from kindred.session import cut_lineage

BLOCK_ROWS = 2048
MAX_CELLS = 1024
# Slack on angle bounds: rounding must never make a bound cut a true candidate.
SLACK = 1e-9


@dataclass
class Cells:
    """Directory of the cells, at most ``MAX_CELLS`` rows."""

    pivots: np.ndarray
    count: np.ndarray
    radius: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray

    def bounds(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest inner product of ``vector`` with any item of each cell."""
        size = float(np.linalg.norm(vector))
        if size == 0:
            zero = np.zeros(len(self.pivots))
            return zero, zero
        angle = np.arccos(np.clip(self.pivots @ (vector / size), -1.0, 1.0))
        high = size * np.cos(np.clip(angle - self.radius - SLACK, 0.0, np.pi))
        low = size * np.cos(np.clip(angle + self.radius + SLACK, 0.0, np.pi))
        high = np.where(high >= 0, high * self.longest, high * self.shortest)
        low = np.where(low >= 0, low * self.shortest, low * self.longest)
        return low - SLACK, high + SLACK

    def score_bounds(self, spec: ListSpec, user: np.ndarray, picks: np.ndarray):
        """Bounds of the greedy score of any item of each cell, given the picks so far."""
        low, high = self.bounds(user)
        if not spec.searches_all or not len(picks):
            return low, high
        if spec.penalty == "mean":
            return self.bounds(spec.rel * user - spec.div * picks.mean(axis=0))
        near = [self.bounds(p) for p in picks]
        near_low = np.max([lo for lo, _ in near], axis=0)
        near_high = np.max([hi for _, hi in near], axis=0)
        return spec.rel * low - spec.div * near_high, spec.rel * high - spec.div * near_low

    def visits(self, low: np.ndarray, high: np.ndarray, need: int | None) -> np.ndarray:
        """Cells that can hold one of the ``need`` best items."""
        live = self.count > 0
        if need is None or need >= int(self.count.sum()):
            return np.flatnonzero(live)
        order = np.argsort(-low, kind="stable")
        enough = int(np.searchsorted(np.cumsum(self.count[order]), need))
        return np.flatnonzero(live & (high >= low[order][enough]))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)


def matrix_of(column) -> np.ndarray:
    values = list(column)
    return np.array([np.asarray(v, dtype=np.float64) for v in values]) if values else np.zeros((0, 0))


def build_cells(
    items: DataFrame, block_rows: int = BLOCK_ROWS, max_cells: int = MAX_CELLS, seed: int = 42
) -> tuple[DataFrame, Cells]:
    """``items`` with ``cell``, ``angle`` and ``size``, and the directory of the cells.

    The pivots are up to ``max_cells`` items in hash order: a bounded read to the driver.
    """
    n = items.count()
    wanted = max(1, min(max_cells, -(-n // block_rows)))
    rows = items.orderBy(F.xxhash64("item_id", F.lit(seed)), "item_id").limit(wanted)
    pivots = unit_rows(matrix_of(r["embedding"] for r in rows.select("embedding").collect()))
    shipped = items.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            matrix = flat.reshape(batch.num_rows, -1)
            close = unit_rows(matrix) @ centre.T
            cell = close.argmax(axis=1)
            angle = np.arccos(np.clip(close[np.arange(len(cell)), cell], -1.0, 1.0))
            out = batch.append_column("cell", pa.array(cell.astype(np.int32)))
            out = out.append_column("angle", pa.array(angle))
            yield out.append_column("size", pa.array(np.linalg.norm(matrix, axis=1)))

    slim = [c for c in ("item_id", "code", "section", "cluster", "group_id") if c in items.columns]
    source = items.select(*slim, "embedding")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields)
    assigned = cut_lineage(
        source.mapInArrow(assign, f"{fields}, cell int, angle double, size double")
    )
    stats = (
        assigned.groupBy("cell")
        .agg(
            F.count("*").alias("n"), F.max("angle").alias("radius"),
            F.min("size").alias("low"), F.max("size").alias("high"),
        )
        .collect()
    )
    cells = Cells(pivots, *(np.zeros(len(pivots)) for _ in range(4)))
    for row in stats:
        c = row["cell"]
        cells.count[c], cells.radius[c] = row["n"], row["radius"]
        cells.shortest[c], cells.longest[c] = row["low"], row["high"]
    return assigned, cells


def by_cell(counts: Sequence[float], block_rows: int) -> F.Column:
    """How many blocks each cell has, as a lookup expression on ``cell``."""
    blocks = [max(1, -(-int(n) // block_rows)) for n in counts]
    return F.element_at(F.array(*[F.lit(b) for b in blocks]), F.col("cell") + 1)


def scan(
    state: DataFrame,
    taken: DataFrame | None,
    items: DataFrame,
    cells: Cells,
    spec: ListSpec,
    keep: int | None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(user_id, item_id, sim, score)``: each user's ``keep`` best items by current score.

    Lists of visits are long and small on disk: merge joins keep them from being broadcast.
    ``state`` has ``user_id, vec, picks, n_skip``; ``taken`` lists the ``(user_id, item_id)``
    that must not come back.  ``keep=None`` returns every item that passes the threshold.
    """
    spark = state.sparkSession
    directory = spark.sparkContext.broadcast(cells)
    width = cells.pivots.shape[1]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell_dir = directory.value
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                user = np.asarray(row.vec, dtype=np.float64)
                picks = matrix_of(row.picks).reshape(-1, width)
                low, high = cell_dir.score_bounds(spec, user, picks)
                need = None if keep is None or spec.dedupe else keep + int(row.n_skip)
                if spec.threshold is not None:
                    sim_low, _ = cell_dir.bounds(user)
                    seen = np.flatnonzero((sim_low <= spec.threshold) & (cell_dir.count > 0))
                else:
                    seen = cell_dir.visits(low, high, need)
                out.append((row.user_id, seen.astype(np.int32)))
            yield pd.DataFrame(out, columns=["user_id", "seen"])

    visits = state.select("user_id", "vec", "picks", "n_skip").mapInPandas(
        route, "user_id bigint, seen array<int>"
    )
    visits = cut_lineage(visits.select("user_id", F.explode("seen").alias("cell")))
    load = np.zeros(len(cells.count))
    for row in visits.groupBy("cell").count().collect():
        load[row["cell"]] = row["count"]
    item_blocks = by_cell(cells.count, block_rows)
    user_blocks = by_cell(load, block_rows)

    placed = items.withColumn("iblock", F.pmod(F.xxhash64("item_id"), item_blocks).cast("int"))
    users = (
        visits.withColumn("ublock", F.pmod(F.xxhash64("user_id"), user_blocks).cast("int"))
        .withColumn("iblock", F.explode(F.sequence(F.lit(0), item_blocks - 1)))
        .join(state.select("user_id", "vec", "picks").hint("merge"), "user_id")
    )
    if taken is not None:
        skipped = (
            taken.select("user_id", "item_id")
            .join(placed.select("item_id", "cell", "iblock").hint("merge"), "item_id")
            .groupBy("user_id", "cell", "iblock")
            .agg(F.collect_list("item_id").alias("skip"))
        )
        users = users.join(skipped.hint("merge"), ["user_id", "cell", "iblock"], "left")
    else:
        users = users.withColumn("skip", F.lit(None).cast("array<bigint>"))
    spread = placed.withColumn("ublock", F.explode(F.sequence(F.lit(0), user_blocks - 1)))
    columns = ["cell", "ublock", "iblock", "item_id", "embedding"]
    columns += [c for c in ("group_id",) if c in items.columns]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"user_id": [], "item_id": [], "sim": [], "score": []})
        if not len(left) or not len(right):
            return empty
        right = right.sort_values("item_id")
        ids = right["item_id"].to_numpy()
        vectors = matrix_of(right["embedding"])
        sims_all = np.round(matrix_of(left["vec"]) @ vectors.T, SCORE_DIGITS)
        group = right["group_id"].to_numpy() if "group_id" in right else ids
        out = []
        for at, row in enumerate(left.itertuples(index=False)):
            sims = sims_all[at]
            score = sims
            picks = matrix_of(row.picks).reshape(-1, width)
            if spec.searches_all and len(picks):
                near = vectors @ picks.T
                near = near.max(axis=1) if spec.penalty == "max" else near.mean(axis=1)
                score = np.round(spec.rel * sims - spec.div * near, SCORE_DIGITS)
            usable = np.ones(len(ids), dtype=bool)
            if row.skip is not None:
                usable &= ~np.isin(ids, np.asarray(row.skip))
            if spec.threshold is not None:
                usable &= sims <= spec.threshold
            where = np.flatnonzero(usable)
            where = where[np.argsort(-score[where], kind="stable")]
            if spec.dedupe:
                _, first = np.unique(group[where], return_index=True)
                where = where[np.sort(first)]
            if keep is not None:
                where = where[:keep]
            out.append((np.full(len(where), row.user_id), ids[where], sims[where], score[where]))
        if not out:
            return empty
        user, item, sim, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"user_id": user, "item_id": item, "sim": sim, "score": score})

    keys = ["cell", "ublock", "iblock"]
    found = (
        users.groupBy(*keys)
        .cogroup(spread.select(*columns).groupBy(*keys))
        .applyInPandas(meet, "user_id bigint, item_id bigint, sim double, score double")
    )
    if spec.dedupe and "group_id" in items.columns:
        best = Window.partitionBy("user_id", "group_id").orderBy(F.desc("score"), "item_id")
        found = (
            found.join(items.select("item_id", "group_id"), "item_id")
            .withColumn("rn", F.row_number().over(best))
            .where("rn = 1")
            .drop("rn", "group_id")
        )
    if keep is None:
        return found
    order = Window.partitionBy("user_id").orderBy(F.desc("score"), "item_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def skip_counts(profiles: DataFrame, taken: DataFrame) -> DataFrame:
    """Profiles with the number of taken items and an empty list of picks."""
    counted = taken.groupBy("user_id").agg(F.count("*").alias("n_skip"))
    return profiles.join(counted, "user_id", "left").select(
        "user_id", "vec",
        F.array().cast("array<array<double>>").alias("picks"),
        F.coalesce("n_skip", F.lit(0)).alias("n_skip"),
    )


def lists_by_cut(state, taken, items, cells, spec, n_clusters, seed, block_rows) -> DataFrame:
    """Lists whose candidates are one similarity cut (or everything under a threshold).

    A list that dedupes without a pool has its ``k`` best groups straight from the scan; with a
    pool the cut comes first, as for any list.
    """
    whole = spec.cut is None and spec.dedupe
    before = taken if spec.drops_first else None
    plain = state if before is not None else state.withColumn("n_skip", F.lit(0))
    found = scan(plain, before, items, cells, replace(spec, dedupe=whole), spec.k if whole else spec.cut, block_rows)
    if spec.taken == "after" and not spec.drops_first:
        found = found.join(taken.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    if spec.dedupe and not whole and "group_id" in items.columns:
        first = Window.partitionBy("user_id", "group_id").orderBy(F.desc("sim"), "item_id")
        found = found.join(items.select("item_id", "group_id"), "item_id")
        found = found.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "group_id")
    names = items.select("item_id", "code", "section", *(["cluster"] if "cluster" in items.columns else []))
    if "cluster" not in names.columns:
        names = names.withColumn("cluster", F.lit(None).cast("bigint"))
    names = names.withColumn("cluster", F.col("cluster").cast("bigint"))
    if not spec.greedy:
        order = Window.partitionBy("user_id").orderBy(F.desc("sim"), "item_id")
        ranked = found.withColumn("pos", F.row_number().over(order))
        if spec.k is not None:
            ranked = ranked.where(F.col("pos") <= spec.k)
        return ranked.join(names, "item_id").select(
            "user_id", F.lit(spec.method).alias("method"), "pos", "item_id", "code", "section",
            "sim", "cluster", F.col("sim").alias("score"),
        )
    has_cluster = "cluster" in items.columns
    vectors = items.select("item_id", "embedding", *(["cluster"] if has_cluster else []))

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["sim", "item_id"], ascending=[False, True])
        matrix = matrix_of(group["embedding"])
        labels = None
        if spec.cov:
            labels = group["cluster"].to_numpy() if has_cluster else local_kmeans(
                matrix, n_clusters, seed
            )
        picks, scores = greedy_picks(spec, matrix, group["sim"].to_numpy(), labels)
        chosen = group.iloc[picks]
        return pd.DataFrame(
            {
                "user_id": chosen["user_id"].to_numpy(),
                "pos": np.arange(1, len(picks) + 1, dtype=np.int32),
                "item_id": chosen["item_id"].to_numpy(),
                "sim": chosen["sim"].to_numpy(),
                "label": (labels[picks] if labels is not None else np.full(len(picks), -1)),
                "score": scores,
            }
        )

    # A user's group is at most ``pool`` rows: vectors join after the cut, never before.
    picked = (
        found.select("user_id", "item_id", "sim")
        .join(vectors, "item_id")
        .groupBy("user_id")
        .applyInPandas(
            pick, "user_id bigint, pos int, item_id bigint, sim double, label bigint, score double"
        )
    )
    return picked.join(names, "item_id").select(
        "user_id", F.lit(spec.method).alias("method"), "pos", "item_id", "code", "section", "sim",
        F.coalesce("cluster", "label").alias("cluster"), "score",
    )


def extender(spec: ListSpec, pool: int, width: int, longest: float, opening: bool):
    """The step of one round for one user: state and pool in, proven picks out."""

    def extend(mine: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(group):
            return pd.DataFrame(columns=["user_id", "pos", "item_id", "sim", "score", "finished"])
        me = mine.iloc[0]
        user = np.asarray(me["vec"], dtype=np.float64)
        picked = matrix_of(me["picks"]).reshape(-1, width)
        group = group.sort_values("item_id")
        everything = len(group) < (1 if opening else pool)
        edge = -np.inf if everything else float(group["now"].min())
        started = spec.rel * user - (spec.div * picked.mean(axis=0) if len(picked) else 0)

        def outside(new: int, on_list: int, vectors_sum) -> float:
            if new == 0 or everything:
                return -np.inf
            if opening:
                return np.inf
            if spec.penalty == "max":
                return edge
            shift = spec.rel * user - spec.div * vectors_sum / on_list - started
            return edge + longest * float(np.linalg.norm(shift)) + SLACK

        room = spec.k - len(picked)
        picks, scores = greedy_picks(
            spec, matrix_of(group["embedding"]), group["sim"].to_numpy(), None, picked,
            outside, room,
        )
        chosen = group.iloc[picks]
        over = len(picks) >= room or (everything and len(picks) == len(group))
        return pd.DataFrame(
            {
                "user_id": chosen["user_id"].to_numpy(),
                "pos": np.arange(len(picked) + 1, len(picked) + len(picks) + 1, dtype=np.int32),
                "item_id": chosen["item_id"].to_numpy(),
                "sim": chosen["sim"].to_numpy(),
                "score": scores,
                "finished": over,
            }
        )

    return extend


def lists_by_rounds(state, taken, items, cells, spec, pool, block_rows) -> DataFrame:
    """MMR and Max-Sum over the whole catalogue, exactly, with bounded groups.

    A round scans for each user's ``pool`` best items by their current score and picks
    from them while the best one provably beats everything outside: under MMR a score can
    only fall as the list grows, and under Max-Sum it moves by no more than the shift of
    the query ``rel * user - div * mean(picked)``.  The first pick of a round is always
    proven, so the number of rounds is at most ``k``; users who are done drop out.
    """
    width = cells.pivots.shape[1]
    total = int(cells.count.sum())
    longest = float(cells.longest.max()) if total else 1.0
    if spec.taken == "keep":  # only what a round has picked is passed over
        state, taken = state.withColumn("n_skip", F.lit(0)), taken.where("false")
    state = cut_lineage(state.withColumn("n_picked", F.lit(0)))
    taken = cut_lineage(taken.select("user_id", "item_id"))
    done: list[DataFrame] = []
    schema = "user_id bigint, pos int, item_id bigint, sim double, score double, finished boolean"
    for turn in range(spec.k):
        keep = 1 if turn == 0 else pool
        found = scan(state, taken, items, cells, spec, keep, block_rows)
        pool_rows = found.select("user_id", "item_id", "sim", F.col("score").alias("now")).join(
            items.select("item_id", "embedding"), "item_id"
        )
        extend = extender(spec, pool, width, longest, opening=turn == 0)
        fresh = cut_lineage(
            state.groupBy("user_id").cogroup(pool_rows.groupBy("user_id")).applyInPandas(extend, schema)
        )
        done.append(fresh.drop("finished"))
        added = (
            fresh.join(items.select("item_id", "embedding"), "item_id")
            .groupBy("user_id")
            .agg(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("pos", "embedding"))),
                    lambda s: s["embedding"],
                ).alias("new_picks"),
                F.count("*").alias("n_new"),
                F.bool_or("finished").alias("finished"),
            )
        )
        state = cut_lineage(
            state.join(added, "user_id")
            .where(~F.col("finished"))
            .select(
                "user_id", "vec", F.concat("picks", "new_picks").alias("picks"),
                (F.col("n_skip") + F.col("n_new")).alias("n_skip"),
                (F.col("n_picked") + F.col("n_new")).alias("n_picked"),
            )
        )
        if state.isEmpty():
            break
        taken = cut_lineage(taken.unionByName(fresh.select("user_id", "item_id")))
    picked = done[0]
    for part in done[1:]:
        picked = picked.unionByName(part)
    cluster = F.col("cluster").cast("bigint") if "cluster" in items.columns else F.lit(None).cast("bigint")
    return picked.join(items, "item_id").select(
        "user_id", F.lit(spec.method).alias("method"), "pos", "item_id", "code", "section", "sim",
        cluster.alias("cluster"), "score",
    )


def recommend_blocked(
    history: DataFrame,
    profiles: DataFrame,
    items: DataFrame,
    specs: Sequence[ListSpec],
    n_clusters: int = 10,
    seed: int = 42,
    block_rows: int = BLOCK_ROWS,
    max_cells: int = MAX_CELLS,
    pool: int = 1000,
) -> DataFrame:
    """The lists of ``specs`` when the catalogue is not known to be small."""
    assigned, cells = build_cells(items, block_rows, max_cells, seed)
    taken = cut_lineage(taken_items(history, assigned))
    state = cut_lineage(skip_counts(profiles, taken))
    out = None
    for spec in specs:
        if spec.searches_all:
            part = lists_by_rounds(state, taken, assigned, cells, spec, pool, block_rows)
        else:
            part = lists_by_cut(state, taken, assigned, cells, spec, n_clusters, seed, block_rows)
        out = part if out is None else out.unionByName(part)
    return out


def score_summary_blocked(profiles: DataFrame, items: DataFrame) -> DataFrame:
    """``n, mean, low, high`` of each user's scores without forming the pairs.

    The mean is the product with the mean item; the extremes are one-item searches for
    the profile and for its negative.
    """
    assigned, cells = build_cells(items)
    whole = assigned.agg(vector_sum(F.col("embedding")).alias("total"), F.count("*").alias("n")).first()
    mean = F.array(*[F.lit(float(x) / whole["n"]) for x in whole["total"]])
    none = F.array().cast("array<array<double>>")
    one = ListSpec("one", k=1)

    def extreme(sign: int, name: str) -> DataFrame:
        state = profiles.select(
            "user_id", F.transform("vec", lambda x: x * F.lit(float(sign))).alias("vec"),
            none.alias("picks"), F.lit(0).alias("n_skip"),
        )
        found = scan(state, None, assigned, cells, one, 1)
        return found.select("user_id", (F.col("sim") * sign).alias(name))

    return (
        profiles.select("user_id", F.lit(whole["n"]).alias("n"), dot(F.col("vec"), mean).alias("mean_sim"))
        .join(extreme(-1, "low_sim"), "user_id")
        .join(extreme(1, "high_sim"), "user_id")
    )
