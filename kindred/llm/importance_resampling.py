"""Resampling of a corpus towards a target text by hashed n-gram weights.

Every feature falls into one of a fixed number of buckets. A bucket's gain says how much more common
it is in the target than in the corpus; all gains are one array, and a document's weight is the sum
of the array's values over its features. Gumbel noise from the document's id turns the draw without
replacement into a search for the highest scores: scores are written once, and counting jobs over
them narrow the cutoff, first of the score, then of the ids tied at it. Only drawn rows are ordered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import ascii_lower, let
from kindred.session import cut_lineage, spread_width

# After lower-casing, words are runs of a-z, 0-9 and everything beyond ASCII.
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_HASH_RANGE = 4294967296.0
_LAST = (1 << 63) - 1
# Borders that one counting job tests.
_BORDERS = 64


@dataclass(frozen=True)
class Resampling:
    """Parameters: features are runs of 1 to ``longest`` words; ``percent`` of the long enough documents are drawn."""

    longest: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: int = 2024


def words_of(text: Column) -> Column:
    found = F.split(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), _NO_WORD)
    return F.filter(found, lambda w: w != "")


def feature_buckets(words: Column, plan: Resampling) -> Column:
    """The bucket of every run of words, repeats included."""

    def bucket(feature: Column) -> Column:
        return F.pmod(F.crc32(feature.cast("binary")), F.lit(plan.buckets)).cast("int")

    if plan.longest == 1:
        return F.transform(words, bucket)
    return let(words, lambda found: _runs(found, bucket, plan.longest))


def _runs(words: Column, bucket: Callable[[Column], Column], longest: int) -> Column:
    def runs(n: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - n + 1)
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(words, i, n), " ")))

    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words)))
    return F.when(F.size(words) > 0, F.flatten(F.transform(lengths, runs))).otherwise(F.array().cast("array<int>"))


def bucket_counts(texts: DataFrame, plan: Resampling) -> list[int]:
    """Features of each bucket over all rows; at most ``plan.buckets`` rows reach the driver."""
    counts = [0] * plan.buckets
    found = texts.select(F.explode(feature_buckets(words_of(F.col("text")), plan)).alias("bucket")).groupBy("bucket").count()
    for row in found.collect():
        counts[row["bucket"]] = row["count"]
    return counts


def long_array(values: list[int]) -> Column:
    """One constant array, parsed once by the optimizer."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def gains(docs: DataFrame, target: DataFrame, plan: Resampling) -> list[int]:
    """floor(1000 * ln) of each bucket's smoothed share in ``target`` over that in ``docs``."""
    spark = docs.sparkSession
    own, aim = bucket_counts(docs, plan), bucket_counts(target, plan)
    total, aimed = sum(own), sum(aim)
    s, t = (F.get(long_array(x), F.col("id").cast("int")).cast("double") for x in (own, aim))
    ratio = (t + 1) * F.lit(float(total + plan.buckets)) / ((s + 1) * F.lit(float(aimed + plan.buckets)))
    rows = spark.range(plan.buckets).select("id", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).collect()
    return [r["gain"] for r in sorted(rows)]


def scored(docs: DataFrame, gain: list[int], plan: Resampling) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, row`` of every row; ``row`` is unique once written."""
    array = long_array(gain)
    # The noise of a null id is that of the empty id.
    digest = F.sha2(F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / _HASH_RANGE))).cast("long")
    words = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    cut = words.select("doc_id", F.size("words").cast("long").alias("n_words"), feature_buckets(F.col("words"), plan).alias("at"))
    weighed = cut.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_features"),
        F.aggregate("at", F.lit(0).cast("long"), lambda total, b: total + F.get(array, b)).alias("weight"),
    )
    return weighed.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())


def smallest(rows: DataFrame, keys: list[str], wanted: int) -> Column | None:
    """A condition that exactly ``wanted`` rows meet: those first in the order of the integer columns ``keys``.

    Together the keys must tell all rows apart. For each key counting jobs over all rows narrow the
    interval of the cutoff, by a factor of the tested borders each; only rows tied at it go on to
    the next key. None where no row is wanted.
    """
    if wanted <= 0:
        return None
    tied, left, cuts = rows, wanted, []
    for key in keys:
        column = F.col(key)
        low, high = tied.agg(F.min(key), F.max(key)).first()
        before, upto = 0, None
        while low < high or upto is None:
            borders = sorted({low + (high - low) * i // _BORDERS for i in range(_BORDERS + 1)})
            counts = tied.agg(*[F.count_if(column <= b).alias(f"b{i}") for i, b in enumerate(borders)]).first()
            at = next(i for i, n in enumerate(counts) if n >= left)
            upto, high = counts[at], borders[at]
            if at:
                before, low = counts[at - 1], borders[at - 1] + 1
            else:
                low = high
        cuts.append((key, high))
        left -= before
        if upto - before == left:
            break
        tied = tied.where(column == high)
    met = F.col(cuts[-1][0]) <= cuts[-1][1]
    for key, value in reversed(cuts[:-1]):
        met = (F.col(key) < value) | ((F.col(key) == value) & met)
    return met


def in_order(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``name``: 1, 2, 3, … in the order of ``keys``, by ranges of them; no task sees more than its range."""
    ranged = rows.repartitionByRange(spread_width(rows), *keys).sortWithinPartitions(*keys)
    placed = cut_lineage(ranged.withColumn("place", F.monotonically_increasing_id()))
    part, own = F.shiftright("place", 33).cast("int"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for i in range(max(sizes, default=0) + 1):
        offsets.append(total)
        total += sizes.get(i, 0)
    return placed.withColumn(name, F.get(long_array(offsets), part) + own + 1).drop("place")


def resample(docs: DataFrame, target: DataFrame, plan: Resampling = Resampling()) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every row of ``docs`` (``doc_id``, ``text``); undrawn: null rank.

    ``target`` has ``text``. A null text has no words; without features the weight is 0. Ties go to
    the smaller id, null ids come last; rows that tie in that too (repeated ids) go by their number
    of features, then in no stated order, being equal in every column. An empty ``target`` or no
    rows are allowed; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = cut_lineage(scored(docs, gains(docs, target.select("text"), plan), plan))
    keyed = table.withColumns(
        {
            "down": -F.col("score"), "no_id": F.col("doc_id").isNull().cast("long"),
            "id": F.coalesce("doc_id", F.lit(_LAST)), "long_enough": F.col("n_words") >= plan.least_words,
        }
    )
    keys = ["down", "no_id", "id", "n_features", "row"]
    able = keyed.where("long_enough")
    first = smallest(able, keys, plan.percent * able.count() // 100)
    columns = ["doc_id", "n_features", "weight", "score"]
    if first is None:
        return table.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = in_order(able.where(first), keys, "rank").select(*columns, "rank")
    rest = keyed.where(~(F.col("long_enough") & first)).select(*columns, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)
