"""Running values over ordered rows that survive a hot key.

A plain window sorts all rows of a key in one task.  These operators take a ``chunk``
column that rises with the order (a day, ``row div 1000``, …).  Rows are sorted per
``(key, chunk)`` only; one small row per chunk carries what passes from chunk to chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.session import cut_lineage, spread_width


def _order(order: list[str]) -> Column:
    return F.struct(*order)


def fill_down(
    df: DataFrame, keys: list[str], order: list[str], chunk: str, value: str, name: str
) -> DataFrame:
    """``name``: the last non-null ``value`` up to and including each row of the key."""
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*keys, chunk).agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), _order(order))).alias("_end")
    )
    carried = ends.select(*keys, chunk, F.last("_end", ignorenulls=True).over(before).alias("_in"))
    return (
        df.withColumn(name, F.last(value, ignorenulls=True).over(inside))
        .join(carried, [*keys, chunk])
        .withColumn(name, F.coalesce(name, "_in"))
        .drop("_in")
    )


def before_chunks(sizes: DataFrame, keys: list[str], chunk: str, size: str, name: str) -> DataFrame:
    """``(keys, chunk, name)``: the sum of ``size`` over the key's earlier chunks (all earlier chunks, without keys).

    Two levels: chunks are dealt to ranges and summed inside each range; then one total per range
    and key passes on, so that a key's chunks never meet in one task, however many they are.
    """
    ranged = sizes.select(*keys, chunk, size).repartitionByRange(spread_width(sizes), *keys, chunk)
    ranged = cut_lineage(ranged.withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(size).over(inside), F.lit(0))
    totals = ranged.groupBy("_range", *keys).agg(F.sum(size).alias("_total"))
    if not keys:
        # One number per range: as many as there are shuffle partitions.
        found = {r["_range"]: r["_total"] for r in totals.collect()}
        offsets = [0]
        for i in range(max(found, default=0)):
            offsets.append(offsets[-1] + found.get(i, 0))
        carried = F.get(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col("_range"))
        return ranged.select(chunk, (own + carried).alias(name))
    across = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_range", *keys, F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_carried"))
    summed = ranged.withColumn("_own", own).join(carried, ["_range", *keys])
    return summed.select(*keys, chunk, (F.col("_own") + F.col("_carried")).alias(name))


def number_rows(df: DataFrame, keys: list[str], order: list[str], chunk: str, name: str) -> DataFrame:
    """``name``: the row's 1-based position in its key (in the table, without keys)."""
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    sizes = df.groupBy(*keys, chunk).agg(F.count("*").alias("_n"))
    offsets = before_chunks(sizes, keys, chunk, "_n", "_before")
    return (
        df.withColumn(name, F.row_number().over(inside))
        .join(offsets, [*keys, chunk])
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_before")
    )


def next_row(
    df: DataFrame, keys: list[str], order: list[str], chunk: str, columns: list[str], prefix: str
) -> DataFrame:
    """``prefix + column`` of the following row of the key."""
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    across = Window.partitionBy(*keys).orderBy(chunk)
    row = F.struct(*columns)
    heads = df.groupBy(*keys, chunk).agg(F.min_by(row, _order(order)).alias("_head"))
    following = heads.select(*keys, chunk, F.lead("_head").over(across).alias("_across"))
    return (
        df.withColumn("_next", F.lead(row).over(inside))
        .join(following, [*keys, chunk])
        .withColumn("_next", F.coalesce("_next", "_across"))
        .select(*df.columns, *[F.col(f"_next.{c}").alias(f"{prefix}{c}") for c in columns])
    )


WEEKS = [str(n) for n in range(1, 17)]


def week_pairs(df: DataFrame, key: str, order: str, chunk: str, name: str = "name", value: str = "value") -> DataFrame:
    """``(key, name, topic, value)``: a numbered row and the row behind it become one week.

    A row named 1 to 16 whose next row's name is no number gives that week with the name as its
    topic and the value as its form; both rows go.  All other rows stay, without a topic.
    """
    rows = df.select(key, order, chunk, name, value)
    paired = next_row(rows, [key], [order], chunk, [order, name, value], "_next_").where(
        F.col(name).isin(WEEKS) & (F.col(f"_next_{name}") != "") & ~F.col(f"_next_{name}").rlike(r"^\d+$")
    )
    weeks = paired.select(
        key, F.concat(name, F.lit("주차")).alias("name"), F.col(f"_next_{name}").alias("topic"),
        F.coalesce(f"_next_{value}", F.lit("")).alias("value"),
    )
    used = paired.select(key, F.explode(F.array(order, f"_next_{order}")).alias(order))
    rest = rows.join(used, [key, order], "left_anti")
    return weeks.unionByName(rest.select(key, F.col(name).alias("name"), F.lit(None).cast("string").alias("topic"), F.col(value).alias("value")))


def rows_before_marker(df: DataFrame, keys: list[str], order: str, marker: Column) -> DataFrame:
    """Rows of each key before its first marker row; all rows where there is none."""
    first = df.where(marker).groupBy(*keys).agg(F.min(order).alias("_marker"))
    kept = F.col("_marker").isNull() | (F.col(order) < F.col("_marker"))
    return df.join(first, keys, "left").where(kept).drop("_marker")


def rows_after_marker(
    df: DataFrame, keys: list[str], order: str, marker: Column, n: int = 3
) -> DataFrame:
    """The ``n`` rows behind each key's first marker, with their ``offset`` 1 to ``n``."""
    first = df.where(marker).groupBy(*keys).agg(F.min(order).alias("_marker"))
    after = df.join(first, keys).where(F.col(order) > F.col("_marker")).drop("_marker")
    ranked = after.withColumn("offset", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    return ranked.where(F.col("offset") <= n)


def collision_suffix(
    df: DataFrame, name: str, order: list[str], chunk: str, out: str = "unique_name"
) -> DataFrame:
    """Repeated names get ``-1``, ``-2``, … from the second one on."""
    numbered = number_rows(df, [name], order, chunk, "_nth")
    suffix = F.when(F.col("_nth") > 1, F.concat(F.lit("-"), (F.col("_nth") - 1).cast("string")))
    return numbered.withColumn(out, F.concat(F.col(name), F.coalesce(suffix, F.lit("")))).drop("_nth")
