"""Lists of a group of users by one pass in single precision are those of all scores in double precision."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.operators import compare, scan, search, selection
from kindred.plans.bind import history, items


def catalogue(n=9000, width=12, seed=3, kind=np.float32):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, width)).astype(kind)
    vectors[n // 3 : n // 3 + 40] = vectors[0]  # exact copies: ties
    vectors[n // 2 : n // 2 + 60] = vectors[1] * (1 + 1e-7 * rng.normal(size=(60, width)))  # closer than single precision tells
    vectors[17] = 0
    ids = np.arange(n)
    return search.Catalogue(
        item_id=ids, code=np.array([f"C{i // 5}" if i % 11 else None for i in ids], dtype=object),
        section=np.array([f"{i % 5}" for i in ids], dtype=object), vectors=vectors, cluster=ids % 7, group=ids // 3,
    )


def users(n, seed=4):
    rng = np.random.default_rng(seed)
    codes = [[f"C{c}" for c in rng.choice(1800, rng.integers(1, 9), replace=False)] for _ in range(n)]
    codes[0] = ["C0"]
    codes[1] = [f"C{c}" for c in range(1700)]  # took nearly everything
    return pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(codes)], names=["user_id", "codes"])


SPECS = [
    selection.topk(30), selection.mmr(12, 0.5), selection.maxsum(12, 0.5), selection.xquad(30, 300, 0.6),
    selection.final(60, 200), selection.final_untaken(60, 200), selection.cut_then_filter(10, 100), selection.baseline(10),
    selection.threshold(0.1), selection.ListSpec("search", k=900, taken="keep"),
    selection.ListSpec("kept", k=5, taken="keep", rel=0.5, div=0.5, penalty="max"),
]


@pytest.mark.parametrize("metric", ["cosine", "ip"])
def test_a_group_gives_the_lists_of_whole_scores(monkeypatch, metric):
    def made():
        serve = search.server(SPECS, metric)
        rows = pa.Table.from_batches(list(serve(catalogue(), iter([users(13)])))).to_pylist()
        rows.sort(key=lambda r: (r["user_id"], r["method"], r["pos"]))
        keys = [(r["user_id"], r["method"], r["pos"], r["item_id"], r["code"], r["section"], r["cluster"]) for r in rows]
        return keys, np.array([(r["sim"], r["score"]) for r in rows])

    called = []
    nearest = scan.Stock.nearest
    monkeypatch.setattr(scan.Stock, "nearest", lambda self, *a: called.append(found := nearest(self, *a)) or found)
    keys, values = made()
    assert any(x is not None for found in called for x in found)
    called.clear()
    monkeypatch.setattr(scan, "LEAST", 10**9)
    whole_keys, whole_values = made()
    assert not called
    assert keys == whole_keys and {k[1] for k in keys} == {s.method for s in SPECS}
    assert np.allclose(values, whole_values, rtol=0, atol=1e-11)


def test_a_cut_that_was_too_high_is_lowered():
    """All of the few near items are in the sample, so it promises more of them than there are."""
    rng = np.random.default_rng(1)
    raw = rng.normal(size=(20_000, 8))
    raw[scan.Stock(raw, True).sample[:300]] = user = np.ones(8) / np.sqrt(8)
    stock = scan.Stock(raw, True)
    (at, sims), = stock.nearest(user[None, :], np.array([1000]))
    whole = stock.similarities(user[None, :])[0]
    assert set(selection.best_first(whole, 1000)) <= set(at.tolist()) and np.allclose(sims, whole[at], rtol=0, atol=1e-11)


def test_counted_lists(monkeypatch):
    """The number of different (code, section) of threshold lists, and of any other list, without their items."""
    specs = [selection.threshold(0.3), selection.threshold(-0.2), selection.topk(30)]
    specs[1] = selection.ListSpec("low", k=None, threshold=-0.2)
    cat = catalogue()
    cat.section[:] = "1"  # five items of a code share a key
    rows = pa.Table.from_batches(list(search.server(specs)(cat, iter([users(13)])))).to_pylist()
    wanted = {}
    for r in rows:
        wanted.setdefault((r["user_id"], r["method"]), set()).add((r["code"], r["section"]))
    for least in (scan.LEAST, 10**9):
        monkeypatch.setattr(scan, "LEAST", least)
        counted = ("threshold", "low", "topk")
        got = pa.Table.from_batches(list(search.server(specs, counted=counted)(cat, iter([users(13)])))).to_pylist()
        assert len(got) == len(wanted) and {(r["user_id"], r["method"]): r["n_keys"] for r in got} == {k: len(v) for k, v in wanted.items()}


def test_counted_lists_compare_as_lists(spark, sf):
    """By the tasks' numbers and by cells as by rows; copies of items and codes without a value included."""
    past, stock = history(spark, sf), items(spark, sf).withColumn("section", F.when(F.col("item_id") % 3 > 0, F.col("section")))
    specs = [selection.topk(5), selection.threshold(0.1), selection.mmr(3), selection.maxsum(3), selection.xquad(5, 20)]
    rows = [
        sorted(map(tuple, compare.compare_sets(search.recommend(past, stock, specs, limit=limit, counted=counted)).collect()))
        for limit, counted in ((search.SHIPPED_BYTES, ()), (search.SHIPPED_BYTES, ["threshold"]), (1, ["threshold"]), (0, ["threshold"]))
    ]
    assert rows[0] and all(r == rows[0] for r in rows[1:])


def test_undefined_vectors_are_scored_whole():
    cat = catalogue()
    cat.vectors[5] = np.nan
    stock = scan.Stock(cat.vectors, True)
    assert not stock.can(np.ones((1, 12)))
    made = list(search.server([selection.topk(3)])(cat, iter([users(3)])))
    assert sum(b.num_rows for b in made)


def test_long_greedy_lists_by_one_product_matrix(monkeypatch):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(200, 6))
    vectors[50:60] = vectors[3]
    sims, labels = np.round(vectors @ vectors[0], 12), rng.integers(0, 4, 200)
    picks = selection.greedy_picks(selection.final(150, 200), vectors, sims, labels)
    monkeypatch.setattr(selection, "GRAM_ROWS", 0)
    assert picks[0] == selection.greedy_picks(selection.final(150, 200), vectors, sims, labels)[0]
