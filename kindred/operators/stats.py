"""Profiles of tables and numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

ACCURACY = 50_000
# Up to so many values all of them are counted.
FEW = 20 * ACCURACY


def null_profile(df: DataFrame) -> DataFrame:
    """``(column, dtype, n_rows, n_null)`` of every column in one pass."""
    counts = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)]
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"), F.lit(t).alias("dtype"),
            F.col("_rows").alias("n_rows"), F.col(f"_{i}").alias("n_null"),
        )
        for i, (c, t) in enumerate(df.dtypes)
    ]
    return counts.select(F.inline(F.array(*rows)))


def exact_quantiles(df: DataFrame, column: str, probs: list[float]) -> DataFrame:
    """``(prob, value)`` with linear interpolation, in two scans and without one task seeing all values."""
    return quantiles_and(df, column, probs, [])[0]


def quantiles_and(df: DataFrame, column: str, probs: list[float], more: list[Column]) -> tuple[DataFrame, Row]:
    """``exact_quantiles`` and one row of ``more`` aggregates, which the first scan computes as well.

    The first scan's rank sketch brackets all wanted ranks at once. The second scan counts, for every
    bracket, the rows below it in one group and those inside by value; only the latter are ordered.
    """
    x = F.col(column).cast("double")
    values = df.select(x.alias("x")).where("x is not null")
    # The sketch's rank errs by 1 / ACCURACY; both neighbours of a rank must lie inside.
    gap = 3.0 / ACCURACY
    wanted = [p for q in probs for p in (max(q - gap, 0.0), min(q + gap, 1.0))]
    first = df.agg(
        F.count(x).alias("_n"), F.min(x).alias("_low"), F.max(x).alias("_high"),
        F.percentile_approx(x, wanted, ACCURACY).alias("_edges"), *more,
    ).first()
    n = first["_n"]
    if not n:
        return df.sparkSession.createDataFrame([(p, None) for p in probs], "prob double, value double"), first
    brackets = []
    for i, p in enumerate(probs):
        # A bracket of few rows could miss a neighbour; then all values are few enough to count.
        low = first["_low"] if p <= gap or n <= FEW else first["_edges"][2 * i]
        high = first["_high"] if p + gap >= 1 or n <= FEW else first["_edges"][2 * i + 1]
        brackets.append((low, high))
    below, inside = F.lit(None).cast("double"), F.col("x")
    tagged = F.array(
        *[
            F.when(F.col("x") <= hi, F.struct(F.lit(i).alias("i"), F.when(F.col("x") >= lo, inside).otherwise(below).alias("x")))
            for i, (lo, hi) in enumerate(brackets)
        ]
    )
    counted = values.select(F.inline(F.array_compact(tagged))).groupBy("i", "x").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("i").orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("last", F.sum("n").over(upto) - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    at = [p * (n - 1) for p in probs]

    def of_bracket(numbers: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in numbers]), F.col("i") + 1)

    def value_at(ranks: list[int]) -> Column:
        rank = of_bracket(ranks)
        return F.max(F.when((F.col("first") <= rank) & (F.col("last") >= rank), F.col("x")))

    ends = ranked.groupBy("i").agg(
        value_at([int(r) for r in at]).alias("a"), value_at([min(int(r) + 1, n - 1) for r in at]).alias("b")
    )
    share = of_bracket([r - int(r) for r in at])
    value = F.col("a") + (F.col("b") - F.col("a")) * share
    return ends.select(of_bracket([float(p) for p in probs]).alias("prob"), value.alias("value")), first


def describe_numeric(df: DataFrame, column: str) -> DataFrame:
    """One row: count, mean, std, min, quartiles and max."""
    x = F.col(column).cast("double")
    quartiles, base = quantiles_and(
        df, column, [0.25, 0.5, 0.75], [F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")]
    )
    q = {r["prob"]: r["value"] for r in quartiles.collect()}
    row = (column, base["_n"], base["mean"], base["std"], base["_low"], q[0.25], q[0.5], q[0.75], base["_high"])
    schema = "column string, n long, mean double, std double, low double, q1 double, median double, q3 double, high double"
    return df.sparkSession.createDataFrame([row], schema)


def boxplot_stats(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, whiskers inside 1.5 interquartile ranges, and the number of outliers."""
    quartile = {r["prob"]: r["value"] for r in exact_quantiles(df, column, [0.25, 0.5, 0.75]).collect()}
    q1, q3 = quartile[0.25], quartile[0.75]
    x = F.col(column).cast("double")
    low, high = F.lit(q1) - 1.5 * F.lit(q3 - q1), F.lit(q3) + 1.5 * F.lit(q3 - q1)
    inside = (x >= low) & (x <= high)
    return df.agg(
        F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    ).select(
        F.lit(column).alias("column"), "whisker_low", F.lit(q1).alias("q1"),
        F.lit(quartile[0.5]).alias("median"), F.lit(q3).alias("q3"), "whisker_high", "n_outliers",
    )
