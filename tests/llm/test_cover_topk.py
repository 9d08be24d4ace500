import math
import random

import numpy as np

from kindred.llm import cover_topk
from kindred.llm.cover_topk import search

SCHEMA = "vec_id long, embedding array<double>, score string, rank string"


def by_hand(rows, every, k, scale=256):
    usable = {}
    for vec_id, v in rows:
        if vec_id is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(scale * x) for x in v]
        usable[vec_id] = min(usable.get(vec_id, whole), whole)
    out = []
    for q in usable:
        if q % every:
            continue
        found = [(-sum(map(lambda a, b: a * b, usable[q], v)), i) for i, v in usable.items() if i != q and len(v) == len(usable[q])]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def run(spark, rows, every, k):
    df = spark.createDataFrame([(i, v, "c", "c") for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in search(df, every, k).collect())


def test_awkward_vectors(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(120)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(200, 215)]  # ties
    rows += [(0, rows[0][1]), (3, [0.1, 0.2, 0.3, 0.4])]  # repeated ids
    rows += [(1000, None), (1001, []), (1010, [None, 1.0, 1.0, 1.0]), (1020, [math.nan] * 4), (1030, [math.inf] * 4)]
    rows += [(None, [1.0] * 4), (2000, [1.0, 2.0]), (2001, [1.0, -2.0]), (3000, [1.0] * 7), (-10, [0.3] * 4)]
    rows += [(4000, [1e10, 1.0, 0.0, 0.0]), (4001, [1e3, -1.0, 3.0, 0.0])]  # too wide for exact doubles
    assert run(spark, rows, 10, 5) == by_hand(rows, 10, 5)


def test_few_candidates_and_none(spark):
    assert run(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])], 2, 5) == [(0, 1, 1, 0)]
    assert run(spark, [(0, [1.0])], 2, 5) == []
    assert run(spark, [], 2, 5) == []


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(cover_topk, "DATA_ROWS", 100)
    monkeypatch.setattr(cover_topk, "QUERY_ROWS", 30)
    rng = random.Random(2)
    rows = [(i, [rng.gauss(i % 5, 0.2) for _ in range(6)]) for i in range(900)]
    assert run(spark, rows, 7, 3) == by_hand(rows, 7, 3)


def test_pruning_leaves_out_pairs():
    """On clustered data the two trees visit far fewer pairs than there are, with the same result."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 8)) * 100
    data = np.floor(centers[rng.integers(20, size=4000)] + rng.normal(size=(4000, 8)))
    queries = data[:100]
    found = cover_topk.DualSearch(queries, np.arange(100), data, np.arange(4000), 5)
    scores = queries @ data.T
    scores[np.arange(100), np.arange(100)] = -np.inf
    order = np.lexsort((np.broadcast_to(np.arange(4000), scores.shape), -scores), axis=-1)[:, :5]
    assert (found.found == order).all()
    assert found.pairs < 0.4 * 100 * 4000
