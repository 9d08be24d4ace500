"""The search for large catalogues gives the lists of the search for small ones."""

import pytest

from kindred.operators import blocks, search, selection
from kindred.operators.lists import with_text_groups
from kindred.operators.profiles import user_profiles
from kindred.plans.bind import history, items, names


def both(spark, sf, specs, dedupe=False, pool=64):
    stock = items(spark, sf)
    if dedupe:
        stock = with_text_groups(stock, names(spark, sf))
    past = history(spark, sf)
    small = search.recommend(past, stock, specs)
    large = blocks.recommend_blocked(
        past, user_profiles(past, stock), search.unit_items(stock), specs,
        block_rows=90, max_cells=6, pool=pool,
    )
    cols = ["method", "user_id", "pos", "item_id", "code", "section", "sim", "cluster"]

    def rows(df):
        return sorted(tuple(r) for r in df.selectExpr(*cols[:6], "round(sim, 9)", "cluster").collect())

    return rows(small), rows(large)


def test_cut_lists(spark, sf):
    specs = [
        selection.topk(7), selection.threshold(-0.2), selection.xquad(10, 60),
        selection.final(20, 80), selection.final_untaken(20, 80), selection.cut_then_filter(5, 40),
    ]
    small, large = both(spark, sf, specs)
    assert {r[0] for r in small} == {s.method for s in specs} and small == large


def test_distinct_texts(spark, sf):
    small, large = both(spark, sf, [selection.baseline(10)], dedupe=True)
    assert small and small == large


@pytest.mark.parametrize("spec", [selection.mmr(5), selection.maxsum(5)], ids=lambda s: s.method)
def test_whole_catalogue_greedy(spark, sf, spec):
    small, large = both(spark, sf, [spec], pool=64)
    assert small and small == large


def test_dealt_catalogue_gives_the_same_lists(spark, sf):
    """A catalogue beyond the driver's limit reaches the tasks by a shuffle, floats and all."""
    specs = [selection.topk(7), selection.mmr(5), selection.maxsum(5), selection.xquad(10, 60), selection.final(20, 80)]
    past, stock = history(spark, sf), items(spark, sf).where("item_id < 400")
    columns = ["method", "user_id", "pos", "item_id", "code", "section", "cluster", "round(sim, 9)", "round(score, 9)"]
    shipped, dealt = (
        sorted(tuple(r) for r in search.recommend(past, stock, specs, limit=limit).selectExpr(*columns).collect())
        for limit in (search.SHIPPED_BYTES, 1)
    )
    assert {r[0] for r in shipped} == {s.method for s in specs} and shipped == dealt
    mine = user_profiles(past, stock)
    columns = ["user_id", "n", "round(mean_sim, 9)", "round(low_sim, 9)", "round(high_sim, 9)"]
    shipped, dealt = (
        sorted(tuple(r) for r in search.score_summary(mine, stock, limit).selectExpr(*columns).collect())
        for limit in (search.SHIPPED_BYTES, 1)
    )
    assert shipped and shipped == dealt


def test_a_large_catalogue_does_not_pass_through_the_driver(spark, sf, monkeypatch):
    """Between the driver's limit and that of a task nothing is collected and no cells are built."""
    stock = items(spark, sf)
    monkeypatch.setattr(blocks, "build_cells", None)
    monkeypatch.setattr(search, "as_catalogue", None)
    plan = search.recommend(history(spark, sf), stock, selection.topk(7), limit=1)
    assert plan.columns[:2] == ["user_id", "method"]


def custom(taken, pool, dedupe, cov, k):
    greedy = {"rel": 0.6, "cov": cov} if cov else {}
    name = f"{taken}-{pool}-{dedupe}-{cov}-{k}"
    return selection.ListSpec(name, k=k, pool=pool, taken=taken, dedupe=dedupe, **greedy)


def test_every_combination_means_the_same(spark, sf):
    """taken x pool x dedupe x coverage x length, some items without a code, some texts shared."""
    from itertools import product

    from pyspark.sql import functions as F

    stock = items(spark, sf).withColumn("code", F.when(F.col("item_id") % 7 != 3, F.col("code")))
    stock = stock.withColumn("group_id", F.floor(F.col("item_id") / 2))
    specs = [
        custom(taken, pool, dedupe, cov, k)
        for taken, pool, dedupe, cov, k in product(
            ("keep", "before", "after"), (None, 40), (False, True), (0.0, 0.4), (12, None)
        )
        if not (cov and pool is None) and not (pool is None and k is None)
    ]
    specs += [selection.ListSpec(f"all-{t}", k=4, taken=t, rel=0.5, div=0.5, penalty=p) for t in ("keep", "after") for p in ("max", "mean")]
    past = history(spark, sf).where("user_id % 9 = 0")
    small = search.recommend(past, stock, specs)
    large = blocks.recommend_blocked(
        past, user_profiles(past, stock), search.unit_items(stock), specs, block_rows=90, max_cells=6, pool=64
    )
    cols = ["method", "user_id", "pos", "item_id", "code", "section", "cluster"]

    def rows(df):
        return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)

    a, b = rows(small), rows(large)
    assert {r[0] for r in a} == {s.method for s in specs}
    assert any(r[4] is None for r in a)
    assert a == b


@pytest.mark.parametrize("bad", [{"cov": 0.4}, {"div": 0.5, "k": None}, {"div": 0.5, "dedupe": True}, {"taken": "never"}])
def test_lists_that_would_depend_on_size_are_refused(bad):
    with pytest.raises(ValueError):
        selection.ListSpec("x", **bad)
