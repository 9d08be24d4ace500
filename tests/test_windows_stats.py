"""Running values and quantiles on a table where one key holds most rows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kindred.operators import ingest, stats, windows


def rows(spark):
    return spark.range(500).select(
        F.when(F.col("id") % 5 == 0, F.col("id") % 7).otherwise(0).alias("key"),
        F.col("id").alias("pos"),
        F.when(F.col("id") % 11 == 3, F.col("id")).alias("mark"),
        F.floor(F.col("id") / 16).alias("chunk"),
    )


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


def test_against_plain_windows(spark):
    df = rows(spark)
    w = Window.partitionBy("key").orderBy("pos")
    filled = windows.fill_down(df, ["key"], ["pos"], "chunk", "mark", "v").select("key", "pos", "v")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    assert same(filled, df.select("key", "pos", F.last("mark", ignorenulls=True).over(upto)))
    numbered = windows.number_rows(df, ["key"], ["pos"], "chunk", "v").select("key", "pos", "v")
    assert same(numbered, df.select("key", "pos", F.row_number().over(w)))
    following = windows.next_row(df, ["key"], ["pos"], "chunk", ["pos"], "next_").select("key", "pos", "next_pos")
    assert same(following, df.select("key", "pos", F.lead("pos").over(w)))


def test_markers(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate("kkMhvdx")] + [("b", 0, "k")], "file string, row int, v string")
    before = windows.rows_before_marker(df, ["file"], "row", F.col("v") == "M").collect()
    assert {(r["file"], r["row"]) for r in before} == {("a", 0), ("a", 1), ("b", 0)}
    after = windows.rows_after_marker(df, ["file"], "row", F.col("v") == "M", 3).collect()
    assert {(r["offset"], r["v"]) for r in after} == {(1, "h"), (2, "v"), (3, "d")}


def test_collision_suffix(spark):
    df = spark.createDataFrame([("K", 0, 0), ("K", 1, 0), ("K", 2, 1), ("L", 3, 1)], "name string, pos int, chunk int")
    got = windows.collision_suffix(df, "name", ["pos"], "chunk").orderBy("pos").collect()
    assert [r["unique_name"] for r in got] == ["K", "K-1", "K-2", "L"]


def test_exact_quantiles(spark):
    values = [1.0] * 400 + [float(i) for i in range(600)] + [1e6]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["prob"]: r["value"] for r in stats.exact_quantiles(df, "x", probs).collect()}
    assert np.allclose([got[p] for p in probs], np.quantile(values, probs))


def test_pending(spark):
    def keys(*v):
        return spark.createDataFrame([(x,) for x in v], "k string")

    def left(failed):
        found = ingest.pending_keys(keys("a", "b", "c"), keys("a"), failed, "k").collect()
        return {r["k"] for r in found}

    assert left(keys()) == {"b", "c"}
    assert left(keys("c", "a")) == {"c"}


def test_week_pairs(spark):
    names = ["과목", "1", "소개", "2", "3", "실습", "17", "끝", "4"]
    rows = [(1, i, i // 4, n, f"v{i}") for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "k int, i int, c int, name string, value string")
    got = {(r["name"], r["topic"], r["value"]) for r in windows.week_pairs(df, "k", "i", "c").collect()}
    assert got == {
        ("1주차", "소개", "v2"), ("3주차", "실습", "v5"), ("과목", None, "v0"), ("2", None, "v3"),
        ("17", None, "v6"), ("끝", None, "v7"), ("4", None, "v8"),
    }


def test_many_chunks_never_meet(spark):
    """A hundred thousand chunks of one name, and of the whole table: no window without keys, right numbers."""
    df = spark.range(200_000).select(
        (F.col("id") * 7919 % 200_000).alias("x"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("name")
    ).withColumn("chunk", F.floor(F.col("x") / 2))
    numbered = windows.number_rows(df, [], ["x"], "chunk", "n")
    assert "SinglePartition" not in numbered._jdf.queryExecution().toString()
    assert numbered.where("n <> x + 1").isEmpty() and numbered.count() == 200_000
    by_name = windows.number_rows(df, ["name"], ["x"], "chunk", "n")
    want = by_name.withColumn("want", F.row_number().over(Window.partitionBy("name").orderBy("x")))
    assert want.where("n <> want").isEmpty() and want.count() == 200_000


@pytest.mark.parametrize("few", [stats.FEW, 100])
def test_quantiles_in_two_scans(spark, monkeypatch, few):
    monkeypatch.setattr(stats, "FEW", few)
    rng = np.random.default_rng(8)
    for values in (rng.normal(size=150_000), rng.integers(0, 9, 120_000).astype(float), np.array([3.0]), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
        probs = [0.0, 0.25, 0.5, 0.9, 1.0]
        made = stats.exact_quantiles(df, "v", probs)
        assert made._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
        got = {r["prob"]: r["value"] for r in made.collect()}
        assert all(abs(got[p] - np.quantile(values, p)) < 1e-9 for p in probs)
