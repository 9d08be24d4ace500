"""What is still to do: unseen texts, pending keys, progress, and token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import blank_tokens


def text_key(column: str = "text") -> Column:
    """A fixed-size join key, so that whole texts never travel as keys."""
    return F.sha2(F.col(column), 256)


def unseen_texts(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``fresh`` whose text is not stored; copies inside ``fresh`` stay."""
    known = stored.select(text_key().alias("text_key")).distinct()
    return fresh.withColumn("text_key", text_key()).join(known, "text_key", "left_anti").drop("text_key")


def first_of_text(batch: DataFrame, order: str) -> DataFrame:
    """Each text of a batch once, with the least ``order`` value."""
    return (
        batch.groupBy(text_key().alias("text_key"))
        .agg(F.min(order).alias(order), F.first("text").alias("text"))
        .select(order, "text")
    )


def pending_keys(wanted: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Wanted keys that are not done.  Failures of the last run, if any, go first and alone."""
    left = wanted.select(key).distinct().join(done.select(key), key, "left_anti")
    before = failed.select(key).distinct().join(done.select(key), key, "left_anti")
    return left if failed.isEmpty() else before


def progress_counts(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """``(total, n_done, n_left)`` in one join and one aggregate."""
    marks = wanted.select(key).distinct().join(
        done.select(key).distinct().withColumn("hit", F.lit(1)), key, "left"
    )
    return marks.agg(
        F.count("*").alias("total"),
        F.count("hit").alias("n_done"),
        F.count_if(F.col("hit").isNull()).alias("n_left"),
    )


def token_budget(
    docs: DataFrame, key: str, text: Column, limit: int, tokenizer=blank_tokens
) -> DataFrame:
    """Tokens per text against a limit, how many are cut, and the part that is kept."""
    n = F.size("toks").cast("bigint")
    return docs.select(key, tokenizer(text).alias("toks")).select(
        key, n.alias("n_tokens"), (n > limit).alias("over"),
        F.greatest(n - limit, F.lit(0).cast("bigint")).alias("n_cut"),
        F.array_join(F.slice("toks", 1, limit), " ").alias("kept"),
    )
