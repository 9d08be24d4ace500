"""New texts arrive as a stream; unseen ones are embedded and stored once.

The store is laid out by batch and by the first ``PREFIX_HEX`` digits of the text's key, so a batch opens only
the files whose keys can be its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.functions.encoders import Encoder, embed_batches
from kindred.operators.ingest import text_key
from kindred.session import broadcast_if_fits

PREFIX_HEX = 2
STORE = "text_key string, doc_id bigint, text string, embedding array<float>, batch bigint, bucket int"


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The stored texts; an empty table before the first batch."""
    try:
        return spark.read.schema(STORE).parquet(store)
    except AnalysisException:
        return spark.createDataFrame([], STORE)


def bucket_of(key: Column) -> Column:
    """The part of the store that a key lies in, of 16 ** ``PREFIX_HEX``."""
    return F.conv(F.left(key, F.lit(PREFIX_HEX)), 16, 10).cast("int")


def stored_keys(fresh: DataFrame, store: str, batch_id: int) -> DataFrame:
    """``text_key`` of other batches in the buckets of ``fresh`` (``text_key``, ``bucket``); files of other buckets stay closed."""
    asked = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most 16 ** PREFIX_HEX
    stored = read_store(fresh.sparkSession, store)
    return stored.where(F.col("bucket").isin(asked) & (F.col("batch") != batch_id)).select("text_key")


def append_unseen(
    stream: DataFrame,
    store: str,
    checkpoint: str,
    make_encoder: Callable[[], Encoder] | None = None,
) -> StreamingQuery:
    """Start the query; ``stream`` has ``doc_id, text``.

    A batch writes its own folder and overwrites it when it is replayed, and compares
    itself only with the other folders.  So a batch that fails half-way is stored once.
    """

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        fresh = (
            batch.withColumn("text_key", text_key())
            .groupBy("text_key")
            .agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
            .withColumn("bucket", bucket_of(F.col("text_key")))
        ).persist()
        try:
            # Only stored keys that this batch asks for take part in the anti join.
            asked = broadcast_if_fits(fresh.select("text_key"), row_bytes=96)
            known = stored_keys(fresh, store, batch_id).join(asked, "text_key", "left_semi")
            unseen = fresh.join(known, "text_key", "left_anti")
            embedded = embed_batches(unseen, F.col("text"), make_encoder)
            dealt = embedded.repartition("bucket")  # a file for each bucket of a batch
            dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={batch_id}")
        finally:
            fresh.unpersist()

    return (
        stream.writeStream.foreachBatch(store_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
