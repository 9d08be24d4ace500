"""User profiles: the mean of the taken items' vectors, at unit length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.vectors import as_double, l2_normalise, vector_sum


def code_sums(items: DataFrame, dedupe_by_code: bool = False) -> DataFrame:
    """One row per code: sum of its section vectors and how many there are.

    Summing before the join with the history means that join moves one row per
    (user, code), whatever the number of sections behind a code.
    """
    vectors = items.where(F.col("code").isNotNull()).select(
        "code", "item_id", as_double(F.col("embedding")).alias("v")
    )
    if dedupe_by_code:
        return vectors.groupBy("code").agg(
            F.min_by("v", "item_id").alias("total"), F.lit(1).cast("bigint").alias("n")
        )
    return vectors.groupBy("code").agg(vector_sum(F.col("v")).alias("total"), F.count("*").alias("n"))


def user_profiles(
    history: DataFrame,
    items: DataFrame,
    dedupe_by_code: bool = False,
) -> DataFrame:
    """``(user_id, vec, n_items)`` for every user with at least one matching code."""
    taken = history.select("user_id", "code").distinct()
    joined = taken.join(code_sums(items, dedupe_by_code), "code")
    grouped = joined.groupBy("user_id").agg(
        vector_sum(F.col("total")).alias("total"), F.sum("n").alias("n_items")
    )
    mean = F.transform("total", lambda x: x / F.col("n_items"))
    return grouped.select("user_id", l2_normalise(mean).alias("vec"), "n_items")


def matched_codes(history: DataFrame, items: DataFrame) -> DataFrame:
    """``(user_id, codes)``: a user's distinct codes that name an item.

    A list is as long as the catalogue at most: for catalogues found small.
    """
    known = items.select("code").where(F.col("code").isNotNull()).distinct()
    return (
        history.select("user_id", "code")
        .join(known, "code", "left_semi")
        .groupBy("user_id")
        .agg(F.collect_set("code").alias("codes"))
    )


def taken_items(history: DataFrame, items: DataFrame) -> DataFrame:
    """Every section of every code a user took: ``(user_id, item_id, code, section)``."""
    taken = history.select("user_id", "code").distinct()
    return taken.join(items.select("item_id", "code", "section"), "code").select(
        "user_id", "item_id", "code", "section"
    )


def unmatched_history(history: DataFrame, items: DataFrame) -> DataFrame:
    """History rows whose code names no item, e.g. codes with a section suffix."""
    return history.select("user_id", "code").distinct().join(items, "code", "left_anti")
