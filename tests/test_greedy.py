"""Lists against a direct reading of the formulas, one user and one round at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import profiles, search, selection


def catalogue(n=60, width=8, seed=1):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, width)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[7] = vectors[3]  # an exact copy: ties
    return [(i, f"C{i // 3:02d}", f"{i % 3 + 1:03d}", [float(x) for x in vectors[i]], i % 4) for i in range(n)]


SCHEMA = "item_id bigint, code string, section string, embedding array<float>, cluster bigint"
HISTORY = [(1, "C00"), (1, "C05"), (1, "C00"), (2, "C01"), (2, "nope"), (3, "nope"), (4, "C01-001"), (4, "C19")]


def by_hand(rows, codes, spec):
    vectors = np.array([r[3] for r in rows], dtype=np.float64)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    raw = np.array([r[3] for r in rows], dtype=np.float64)
    mine = [i for i, r in enumerate(rows) if r[1] in codes]
    if not mine:
        return []
    profile = raw[mine].mean(axis=0)
    profile /= np.linalg.norm(profile)
    sims = [round(float(v @ profile), 12) for v in vectors]
    order = sorted(range(len(rows)), key=lambda i: (-sims[i], i))
    if spec.taken == "before":
        order = [i for i in order if i not in mine]
    if spec.pool is not None:
        order = order[: spec.pool]
    if spec.taken == "after":
        order = [i for i in order if i not in mine]
    if not spec.greedy:
        return order[: spec.k]
    scan = sorted(order) if spec.searches_all else order
    picked, k = [], min(spec.k, len(order))
    share = {}
    step = 1.0 / (k if spec.step_by_length else spec.k)
    while len(picked) < k:
        best, best_score = None, -1e18
        for j in scan:
            if j in picked:
                continue
            near = [float(vectors[j] @ vectors[s]) for s in picked]
            penalty = 0.0 if not near else (max(near) if spec.penalty == "max" else sum(near) / len(near))
            score = spec.rel * sims[j] - spec.div * penalty + spec.cov * (1 - share.get(rows[j][4], 0.0))
            if round(score, 10) > round(best_score, 10):
                best, best_score = j, score
        picked.append(best)
        share[rows[best][4]] = share.get(rows[best][4], 0.0) + step
    return picked


SPECS = [
    selection.topk(10), selection.mmr(12, 0.5), selection.maxsum(12, 0.3), selection.xquad(12, 30, 0.6),
    selection.final(25, 40), selection.final_untaken(25, 40), selection.cut_then_filter(5, 20),
    selection.mmr(500, 0.7), selection.final(500, 1000), selection.final_untaken(500, 1000),
]


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: f"{s.method}-{s.k}")
def test_lists(spark, spec):
    rows = catalogue()
    items = spark.createDataFrame(rows, SCHEMA)
    history = spark.createDataFrame(HISTORY, "user_id bigint, code string")
    got = search.recommend(history, items, spec).orderBy("user_id", "pos").collect()
    users = {u for u, _ in HISTORY}
    for user in users:
        mine = [r for r in got if r["user_id"] == user]
        assert [r["pos"] for r in mine] == list(range(1, len(mine) + 1))
        codes = {c for u, c in HISTORY if u == user}
        assert [r["item_id"] for r in mine] == by_hand(rows, codes, spec), user


def test_unmatched_history(spark):
    items = spark.createDataFrame(catalogue(), SCHEMA)
    history = spark.createDataFrame(HISTORY, "user_id bigint, code string")
    left = profiles.unmatched_history(history, items).collect()
    assert {(r["user_id"], r["code"]) for r in left} == {(2, "nope"), (3, "nope"), (4, "C01-001")}


def test_fitted_clusters(spark):
    """Without a cluster column each user's candidates are clustered; picks stay in the pool."""
    items = spark.createDataFrame(catalogue(), SCHEMA).drop("cluster")
    history = spark.createDataFrame(HISTORY, "user_id bigint, code string")
    got = search.recommend(history, items, selection.final(20, 30), n_clusters=5)
    counts = got.groupBy("user_id").agg(
        F.count("*").alias("n"), F.countDistinct("item_id").alias("d"), F.countDistinct("cluster").alias("c")
    ).collect()
    assert {r["user_id"] for r in counts} == {1, 2, 4}
    assert all(r["n"] == r["d"] == 20 and r["c"] == 5 for r in counts)


def test_score_summary_blocked(spark):
    items = spark.createDataFrame(catalogue(), SCHEMA)
    history = spark.createDataFrame(HISTORY, "user_id bigint, code string")
    mine = profiles.user_profiles(history, items)
    cols = ["user_id", "n", *[F.round(c, 9).alias(c) for c in ("mean_sim", "low_sim", "high_sim")]]
    small = sorted(tuple(r) for r in search.score_summary(mine, items).select(*cols).collect())
    large = sorted(tuple(r) for r in search.score_summary(mine, items, limit=0).select(*cols).collect())
    assert small and small == large


@pytest.mark.parametrize("make", [selection.mmr, selection.maxsum])
def test_proven_rounds_pick_what_the_whole_scan_picks(make):
    """Small pools, many ties: the rounds look at few candidates and still pick the same; an undefined score ends."""
    rng = np.random.default_rng(2)
    for n in (1, 7, 60, 150):
        vectors = np.round(rng.normal(size=(n, 3)), 1) + 0.01
        vectors[n // 3 : n // 2] = vectors[0]
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        sims = np.round(vectors @ vectors[0], 12)
        found = np.flatnonzero(rng.random(n) < 0.8)
        spec = make(25, 0.4)
        picks, _ = selection.greedy_picks(spec, vectors[found], sims[found], None)
        for pool in (1, 3, 40):
            got, scores = selection.greedy_everywhere(spec, vectors[0], vectors, sims, found, pool)
            assert got.tolist() == found[picks].tolist() and len(scores) == len(got)
        assert len(selection.greedy_everywhere(spec, vectors[0], vectors, np.full(n, np.nan), found, 3)[0]) <= len(found)
