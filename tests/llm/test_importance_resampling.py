import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from kindred.llm.importance_resampling import Resampling, in_order, resample, smallest

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, plan):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    runs = [" ".join(words[i : i + n]) for n in range(1, plan.longest + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % plan.buckets for r in runs]


def by_hand(rows, target, plan):
    own, aim = [0] * plan.buckets, [0] * plan.buckets
    for _, text in rows:
        for b in features(text, plan)[1]:
            own[b] += 1
    for text in target:
        for b in features(text, plan)[1]:
            aim[b] += 1
    size, aimed = sum(own) + plan.buckets, sum(aim) + plan.buckets
    gain = [math.floor(1000 * math.log((t + 1) * size / ((s + 1) * aimed))) for s, t in zip(own, aim)]
    found = []
    for i, text in rows:
        n, at = features(text, plan)
        h = int(hashlib.sha256(f"{plan.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in at)
        found.append((i, n, len(at), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((-r[4], r[0] is None, r[0] or 0, r[2]) for r in found if r[1] >= plan.least_words)
    drawn = able[: plan.percent * len(able) // 100]
    out = []
    for i, n, m, weight, score in found:
        key = (-score, i is None, i or 0, m)
        rank = None
        if n >= plan.least_words and key in drawn:
            rank = drawn.index(key) + 1
            drawn[rank - 1] = None
        out.append((i, m, weight, score, rank))
    return out


def order(row):
    return tuple((x is None, x or 0) for x in row)


def result(df, target, plan):
    return sorted((tuple(r) for r in resample(df, target, plan).collect()), key=order)


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([("w1 w2 w3 W3 é", 1), (None, 2), ("", 3)], "text string, score int")


PLANS = [Resampling(), Resampling(longest=2, buckets=97, percent=33, least_words=3, seed=5), Resampling(percent=100, least_words=0)]


@pytest.mark.parametrize("plan", PLANS)
def test_equals_by_hand(spark, target, plan):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(60)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    texts = [r.text for r in target.collect()]
    assert result(df, target, plan) == sorted(by_hand(rows, texts, plan), key=order)


@pytest.mark.parametrize("plan", PLANS)
def test_awkward(spark, awkward_docs, no_docs, target, plan):
    rows = [(r.doc_id, r.text) for r in awkward_docs.collect()]
    texts = [r.text for r in target.collect()]
    assert result(awkward_docs, target, plan) == sorted(by_hand(rows, texts, plan), key=order)
    assert resample(no_docs, target, plan).count() == 0
    assert result(awkward_docs, target.limit(0), plan) == sorted(by_hand(rows, [], plan), key=order)


def test_hot_copies(spark, target):
    """A third of all rows is one row: each copy is drawn or not on its own, and ranks have no gap."""
    text = " ".join(f"w{i % 5}" for i in range(40))
    rows = [(7, text)] * 400 + [(i, text + f" x{i}") for i in range(100, 900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    plan = Resampling(percent=60)
    got = result(df, target, plan)
    assert got == sorted(by_hand(rows, [r.text for r in target.collect()], plan), key=order)
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 721))


def test_smallest_reads_ties_only_to_the_end(spark):
    rows = [(i % 3, i % 7 - (1 << 62) * (i % 2), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    for wanted in (1, 333, 334, 500, 999, 1000):
        met = df.where(smallest(df, ["a", "b", "c"], wanted))
        assert sorted(tuple(r) for r in met.collect()) == sorted(rows)[:wanted]
    assert smallest(df, ["a", "b", "c"], 0) is None


def test_ranks_by_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"))
    ranked = in_order(df, ["x"], "rank")
    assert sorted((r.x, r["rank"]) for r in ranked.collect()) == [(i, i + 1) for i in range(5000)]
