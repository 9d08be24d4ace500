"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``(v, root)`` for every vertex of ``links`` (``a``, ``b``); ``root`` is its component's smallest vertex.

    Each round is written, so a lost executor replays one round. Minima combine map-side; a star's
    centre with many neighbours is one row on one side of a join, the other side may be split.
    Nulls and self-links are ignored; no links give no rows.
    """
    edges = (
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where((F.col("u") != F.col("v")) & F.col("u").isNotNull() & F.col("v").isNotNull())
        .distinct()
    )
    edges, seen = cut_lineage(edges), None
    while True:
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        edges = cut_lineage(small_star(large_star(edges)))
    return edges.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(
        edges.select("v", F.col("v").alias("root")).distinct()
    )


def large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of every vertex move to the smallest vertex that it sees."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where(F.col("u") != F.col("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of every vertex, and itself, move to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).where(F.col("u") != F.col("v")).distinct()
