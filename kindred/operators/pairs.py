"""Similar pairs of dense vectors, their blend with text similarity, and histograms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators import blocks, products, search
from kindred.operators.selection import SCORE_DIGITS
from kindred.session import cut_lineage, spread

PAIRS = "id_a bigint, id_b bigint, sim double"
TILE_ROWS, TILE_COLUMNS = 64, 4096


def dense_pairs(items: DataFrame, at_least: float, limit: int = search.SHIPPED_BYTES) -> DataFrame:
    """All ``(id_a < id_b, sim)`` with a cosine of ``at_least``; only hits are emitted."""
    ready = search.unit_items(items)
    catalogue = search.small_catalogue(ready, limit)

    def hits(ids: np.ndarray, vectors: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column("item_id").to_numpy()
            renamed = pa.RecordBatch.from_arrays([batch.column("embedding")], ["vec"])
            for row, sims in search.score_chunks(renamed, vectors):
                at = np.flatnonzero((sims >= at_least) & (ids > mine[row]))
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), mine[row])), pa.array(ids[at]), pa.array(sims[at])],
                        names=["id_a", "id_b", "sim"],
                    )

    rows = ready.select("item_id", "embedding")
    if catalogue is not None:
        shipped = ready.sparkSession.sparkContext.broadcast((catalogue.item_id, catalogue.vectors))
        return spread(rows, "item_id").mapInArrow(lambda batches: hits(*shipped.value, batches), PAIRS)
    if search.is_dealt(ready, limit):
        return search.deal(
            items, rows, "item_id", lambda cat, batches: hits(cat.item_id, search.unit_matrix(cat), batches), PAIRS
        )
    assigned, cells = blocks.build_cells(ready)
    return near_pairs(assigned, cells, at_least)


def near_pairs(
    assigned: DataFrame, cells: blocks.Cells, at_least: float, block_rows: int = blocks.BLOCK_ROWS
) -> DataFrame:
    """The same pairs by cells: an item visits the cells that can hold a near item."""
    directory = assigned.sparkSession.sparkContext.broadcast(cells)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = directory.value
        for batch in batches:
            seen = []
            for vec in batch["embedding"]:
                _, high = known.bounds(np.asarray(vec, dtype=np.float64))
                seen.append(np.flatnonzero((high >= at_least) & (known.count > 0)).astype(np.int32))
            yield pd.DataFrame({"item_id": batch["item_id"], "seen": seen})

    visits = assigned.select("item_id", "embedding").mapInPandas(
        route, "item_id bigint, seen array<int>"
    )
    visits = cut_lineage(visits.select("item_id", F.explode("seen").alias("cell")))
    load = np.zeros(len(cells.count))
    for row in visits.groupBy("cell").count().collect():
        load[row["cell"]] = row["count"]
    item_blocks = blocks.by_cell(cells.count, block_rows)
    visit_blocks = blocks.by_cell(load, block_rows)
    left = (
        visits.withColumn("ublock", F.pmod(F.xxhash64("item_id"), visit_blocks).cast("int"))
        .withColumn("iblock", F.explode(F.sequence(F.lit(0), item_blocks - 1)))
        .join(assigned.select("item_id", "embedding").hint("merge"), "item_id")
    )
    right = (
        assigned.select("item_id", "embedding", "cell")
        .withColumn("iblock", F.pmod(F.xxhash64("item_id"), item_blocks).cast("int"))
        .withColumn("ublock", F.explode(F.sequence(F.lit(0), visit_blocks - 1)))
    )

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id_a": [], "id_b": [], "sim": []})
        sims = np.round(
            blocks.matrix_of(a["embedding"]) @ blocks.matrix_of(b["embedding"]).T, SCORE_DIGITS
        )
        id_a, id_b = a["item_id"].to_numpy(), b["item_id"].to_numpy()
        i, j = np.nonzero((sims >= at_least) & (id_a[:, None] < id_b[None, :]))
        return pd.DataFrame({"id_a": id_a[i], "id_b": id_b[j], "sim": sims[i, j]})

    keys = ["cell", "ublock", "iblock"]
    # Both sides come from one table: fresh names for the columns of one of them.
    right = right.toDF(*right.columns)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, PAIRS)


def hybrid_pairs(
    weights: DataFrame, items: DataFrame, at_least: float, alpha: float = 0.65, kinds: DataFrame | None = None
) -> DataFrame:
    """``(id_a, id_b, tfidf, dense, hybrid)`` with ``alpha*dense + (1-alpha)*tfidf >= at_least``.

    Both products of a pair are formed where two blocks of items meet (see ``products``); only pairs
    that reach ``at_least`` leave a task. An item without weights has text similarity 0. With ``kinds(item_id, kind)``
    only items that share a kind meet, once for each, and pairs have it.
    """
    ready = search.unit_items(items).select(F.col("item_id").cast("long").alias("id"), F.col("embedding").alias("vec"))
    rows = ready.join(products.by_document(weights), "id", "left").select(
        "id", F.coalesce("nos", F.array().cast("array<bigint>")).alias("nos"),
        F.coalesce("ws", F.array().cast("array<double>")).alias("ws"), "vec",
    )
    if kinds is not None:
        rows = rows.join(kinds.select(F.col("item_id").cast("long").alias("id"), F.col("kind").cast("string").alias("kind")), "id")
    found = products.block_pairs(rows, at_least, alpha)
    hybrid = F.lit(alpha) * F.col("dense") + F.lit(1 - alpha) * F.col("text")
    return found.select("id_a", "id_b", F.col("text").alias("tfidf"), "dense", hybrid.alias("hybrid"), *[c for c in found.columns if c == "kind"])


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """``(bin, low, high, n)`` of equal width between the least and the greatest value."""
    edge = df.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, high = edge["low"], edge["high"]
    if low is None:
        low = high = 0.0
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(at.cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
        .select(
            "bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"),
            (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"), "n",
        )
    )


def pair_histogram(items: DataFrame, bins: int = 50, limit: int = search.SHIPPED_BYTES) -> DataFrame:
    """Histogram over [-1, 1] of the cosines of all ordered pairs, an item with itself included.

    Each block of items is reduced to ``bins`` counts where its products are formed; no pair
    leaves a task.  A catalogue that no task holds meets itself block by block; two different blocks
    meet once and count for both orders.
    """
    ready = search.unit_items(items).select("item_id", "embedding")

    def count(sims: np.ndarray) -> np.ndarray:
        at = np.round(sims, SCORE_DIGITS, out=sims)
        at += 1
        at /= 2
        at *= bins
        np.clip(at, 0, bins - 1, out=at)  # what is not negative is cut to whole bins as by floor
        return np.bincount(at.astype(np.int32).ravel(), minlength=bins)

    catalogue = search.small_catalogue(
        items.select("item_id", "code", "section", "embedding"), limit
    )

    def reduce(ids: np.ndarray, vectors: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs with a later item count for both orders; pairs are formed a cache-sized tile at a time."""
        total = np.zeros(bins, dtype=np.int64)
        ordered = ids.dtype.kind != "f"  # no null among them
        for batch in batches:
            mine = search.list_matrix(batch.column("embedding"))
            names = batch.column("item_id").to_numpy(zero_copy_only=False)
            order = np.argsort(names, kind="stable")
            for rows in np.array_split(order, -(-len(order) // TILE_ROWS)) if len(order) else ():
                low, high = names[rows[0]], names[rows[-1]]
                first, later = (int(np.searchsorted(ids, low)), int(np.searchsorted(ids, high, "right"))) if ordered else (0, 0)
                for start in range(first, later, TILE_COLUMNS):
                    to = min(start + TILE_COLUMNS, later)
                    sims = mine[rows] @ vectors[start:to].T
                    after, same = names[rows][:, None] < ids[start:to], names[rows][:, None] == ids[start:to]
                    total += 2 * count(sims[after]) + count(sims[same])
                for start in range(later, len(vectors), TILE_COLUMNS):
                    total += (2 if ordered else 1) * count(mine[rows] @ vectors[start : start + TILE_COLUMNS].T)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(bins, dtype=np.int32)), pa.array(total)], names=["bin", "n"]
        )

    if catalogue is not None:
        vectors = blocks.unit_rows(catalogue.vectors)
        shipped = ready.sparkSession.sparkContext.broadcast((catalogue.item_id, vectors))
        parts = spread(ready, "item_id").mapInArrow(lambda batches: reduce(*shipped.value, batches), "bin int, n bigint")
    elif search.is_dealt(items, limit):
        parts = search.deal(
            items, ready, "item_id", lambda cat, batches: reduce(cat.item_id, search.unit_matrix(cat), batches), "bin int, n bigint"
        )
    else:
        n_blocks = max(1, -(-ready.count() // blocks.BLOCK_ROWS))
        mine = ready.withColumn("a", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).cast("int"))
        rows = mine.withColumn("b", F.explode(F.sequence("a", F.lit(n_blocks - 1))))
        columns = mine.toDF("item_id", "embedding", "b").withColumn("a", F.explode(F.sequence(F.lit(0), "b")))

        def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
            if not len(x) or not len(y):
                return pd.DataFrame({"bin": [], "n": []})
            found = count(blocks.matrix_of(x["embedding"]) @ blocks.matrix_of(y["embedding"]).T)
            orders = 1 if x["a"].iat[0] == x["b"].iat[0] else 2
            return pd.DataFrame({"bin": np.arange(bins, dtype=np.int32), "n": orders * found})

        parts = rows.groupBy("a", "b").cogroup(columns.groupBy("a", "b")).applyInPandas(
            meet, "bin int, n bigint"
        )
    return parts.groupBy("bin").agg(F.sum("n").alias("n")).where(F.col("n") > 0)
