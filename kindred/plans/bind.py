"""How the driver's tables play items, histories and names, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.vectors import as_double

PREFIXES = ["GEB", "GED", "EEC", "ACE"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def code_of(n: F.Column) -> F.Column:
    prefix = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (n % 4 + 1).cast("int"))
    return F.concat(prefix, F.format_string("%04d", n.cast("bigint")))


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Five sections per code; ``cluster`` is the table's own label."""
    n = F.floor(F.col("vec_id") / 5)
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        code_of(n).alias("code"),
        F.format_string("%03d", F.col("vec_id") % 5 + 1).alias("section"),
        "embedding",
        F.col("label").cast("bigint").alias("cluster"),
    )


def purchases(spark: SparkSession, sf: str) -> DataFrame:
    """Every purchase: ``(event_id, user_id, code)``, duplicates kept."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return (
        table(spark, sf, "events")
        .where(F.col("event_type") == "purchase")
        .select("event_id", "user_id", code_of(k).alias("code"))
    )


def history(spark: SparkSession, sf: str) -> DataFrame:
    return purchases(spark, sf).select("user_id", "code").distinct()


def names(spark: SparkSession, sf: str) -> DataFrame:
    """An item's name is the first line of its document, its text the whole document."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"),
        F.substring_index("text", "\n", 1).alias("name"),
        "text",
    )


def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return items(spark, sf).withColumn("embedding", as_double(F.col("embedding")))


ITEMS = """
items AS (
  SELECT vec_id AS item_id,
         (['GEB','GED','EEC','ACE'])[CAST((vec_id // 5) % 4 + 1 AS INT)] || printf('%04d', vec_id // 5) AS code,
         printf('%03d', vec_id % 5 + 1) AS section,
         embedding::DOUBLE[] AS embedding, CAST(label AS BIGINT) AS cluster
  FROM embeddings)"""

PURCHASES = """
purchases AS (
  SELECT event_id, user_id,
         (['GEB','GED','EEC','ACE'])[CAST(k % 4 + 1 AS INT)] || printf('%04d', k) AS code
  FROM (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
        FROM events WHERE event_type = 'purchase'))"""

HISTORY = PURCHASES + """,
history AS (SELECT DISTINCT user_id, code FROM purchases)"""

NAMES = r"""
names AS (
  SELECT doc_id AS item_id, split_part(text, chr(10), 1) AS name, text FROM documents)"""


def profiles_sql(taken: str = "SELECT h.user_id, i.embedding FROM history h JOIN items i USING (code)") -> str:
    return f"""
profile_dims AS (
  SELECT user_id, i, avg(v) AS m
  FROM (SELECT user_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM ({taken}))
  GROUP BY user_id, i),
profile_raw AS (SELECT user_id, list(m ORDER BY i) AS vec FROM profile_dims GROUP BY user_id),
profiles AS (
  SELECT user_id, CASE WHEN n > 0 THEN list_transform(vec, lambda x: x / n) ELSE vec END AS vec
  FROM (SELECT user_id, vec, sqrt(list_inner_product(vec, vec)) AS n FROM profile_raw))"""


UNIT_ITEMS = """
unit_items AS (
  SELECT item_id, code, section, cluster,
         list_transform(embedding, lambda x: x / sqrt(list_inner_product(embedding, embedding))) AS embedding
  FROM items)"""

SCORES = """
scores AS (
  SELECT p.user_id, i.item_id, i.code, i.section, i.cluster, list_inner_product(p.vec, i.embedding) AS sim
  FROM profiles p, unit_items i)"""

TAKEN = """
taken AS (SELECT DISTINCT user_id, code FROM history)"""

BASE = f"{ITEMS},{HISTORY},{profiles_sql()},{UNIT_ITEMS},{SCORES},{TAKEN}"
