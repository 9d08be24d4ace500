"""Relational steps around recommendation lists: dedupe, prefix, names, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def drop_taken(recs: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of ``recs`` whose code the user does not have."""
    return recs.join(history.select("user_id", "code").distinct(), ["user_id", "code"], "left_anti")


def keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per key.  ``min_by`` combines map-side, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys and c != order]
    return df.groupBy(*keys).agg(
        F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in rest]
    )


def first_pos_last_value(recs: DataFrame) -> DataFrame:
    """Per user and code the first position and the last section (a dict built in order)."""
    return recs.groupBy("user_id", "code").agg(
        F.min("pos").alias("first_pos"), F.max_by("section", "pos").alias("section")
    )


def prefix_deduped(recs: DataFrame, prefix: str, n: int) -> DataFrame:
    """First ``n`` codes of each list that start with ``prefix``, one row per code."""
    once = first_pos_last_value(recs.where(F.coalesce(F.startswith("code", F.lit(prefix)), F.lit(False))))
    order = Window.partitionBy("user_id").orderBy("first_pos")
    return once.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n)


def first_names(items: DataFrame, names: DataFrame) -> DataFrame:
    """One name per code: that of its first item with a name."""
    return (
        items.select("item_id", "code")
        .join(names.select("item_id", "name"), "item_id")
        .groupBy("code")
        .agg(F.min_by("name", "item_id").alias("name"))
    )


def look_up_names(recs: DataFrame, named: DataFrame, default: str) -> DataFrame:
    """Left join on the code with a default text where no name is known."""
    return recs.join(named, "code", "left").withColumn("name", F.coalesce("name", F.lit(default)))


def with_text_groups(items: DataFrame, names: DataFrame) -> DataFrame:
    """``group_id``: the first item with the same text.  Items without text form one group."""
    known = names.select("item_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("known"))
    keyed = items.join(known, "item_id", "left").withColumn(
        "text_key", F.coalesce("known", F.sha2(F.lit(""), 256))
    )
    groups = keyed.groupBy("text_key").agg(F.min("item_id").alias("group_id"))
    return keyed.join(groups, "text_key").drop("text_key", "known")


def shuffled(key: str, seed: int) -> F.Column:
    """A repeatable random order of keys."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Up to ``n`` rows per group, the same ones on every run."""
    order = Window.partitionBy(group).orderBy(shuffled(key, seed), key)
    return df.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).drop("rn")


def sample_cap(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in hash order, or all rows when there are fewer."""
    return df.orderBy(shuffled(key, seed), key).limit(n)
