import random

import numpy as np
import pytest

from kindred.llm import partition_jaccard as pj
from kindred.llm.minhash_paths import shingles
from kindred.llm.partition_jaccard import Allocation, Join, allocate, segment_costs, sets_of, similar
from tests.llm.test_minhash_paths import shingle_set

MERGING = dict(key_cost=0.0, pair_cost=1.0)


def near_rows(seed, groups=14, copies=12):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([2, 5, 9, 12, 20, 33, 60, 200, 600]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            words += [f"y{rng.randrange(10**6)}" for _ in range(rng.choice([0, 0, 1, len(words) // 12]))]
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    return rows


def expected(rows, join):
    sets = [(i, shingle_set(t, join.words)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= join.percent * len(sets[a][1] | sets[b][1]):
                root[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        least[find(n)] = min(least.get(find(n), i), i)
    return sorted((i, len(s), least[find(n)]) for n, (i, s) in enumerate(sets))


def result(df, join=Join()):
    return sorted(tuple(r) for r in similar(df, join).collect())


@pytest.mark.parametrize("join", [Join(), Join(**MERGING, block_sets=4), Join(percent=80, costed_segments=2, block_shingles=300)])
def test_equals_all_pairs(spark, join):
    rows = near_rows(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df, join) == expected(rows, join)


def test_frequent_line_in_short_texts(spark):
    """One line in every text: no key is given up, and merged segments are chosen where they are cheaper."""
    rng = random.Random(9)
    line = "one line that all the short texts of this corpus have in common ok"
    rows = [(i, f"{line} a{rng.randrange(40)} b{rng.randrange(3)} c{rng.randrange(3)}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for join in (Join(), Join(**MERGING)):
        assert result(df, join) == expected(rows, join)
    every = sets_of(df, Join()).where("vid is not null")
    assert any(allocate(segment_costs(every, Join(**MERGING)), Join(**MERGING)).merges(b) for b in range(20))


@pytest.mark.parametrize("merged", [False, True])
def test_no_similar_pair_is_without_a_common_key(merged):
    """Sets at the very threshold, in one band and in two, share a key for any allocation."""
    rng, join = np.random.default_rng(4), Join()
    for _ in range(1500):
        n = int(rng.choice([9, 10, 12, 17, 18, 27, 40, 57, 90, 140, 200, 290, 300, 700]))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        larger = int(rng.integers(len(a), join.largest_partner(len(a)) + 1))
        most = join.differing(len(a), larger)
        out = (most - (larger - len(a))) // 2
        new = rng.integers(0, 1 << 63, larger - len(a) + out, dtype=np.uint64)
        b = np.unique(np.concatenate([rng.permutation(a)[out:], new]))
        allocation = Allocation({k: [(int(j), merged and bool(rng.integers(2))) for j in rng.permutation(join.segments(k) // 2)]
                                 for k in range(40) if join.segments(k) <= join.costed_segments})

        def keys(h, allocation=allocation):
            whole, deleted = [], pj.deletion_keys(h, join, allocation)
            for band, needed in join.bands_of(len(h)):
                values, at = pj.segment_keys(h, band, join)
                tokens = np.bincount(at.astype(np.int64), minlength=len(values))
                if len(values) > join.costed_segments:
                    whole.append(pj.prefix_keys(values, tokens, band, needed))
                else:
                    whole += exact(values, tokens >= pj._STRONG, band, needed, allocation)
            flat = lambda parts: set(np.concatenate(parts).tolist()) if parts else set()
            return flat(whole), flat(deleted)

        def exact(values, strong, band, needed, allocation):
            pairs, every = pj.chosen(allocation.bands[band], needed, strong)
            out = []
            for j, both in pairs:
                if both:
                    out.append(pj.tagged(values[2 * j : 2 * j + 1] ^ values[2 * j + 1 : 2 * j + 2], band, j, 1))
                else:
                    places = np.array([i for i in (2 * j, 2 * j + 1) if every or strong[i]], np.int64)
                    out.append(pj.tagged(values[places], band, places, 0))
            return out

        (wa, da), (wb, db) = keys(a), keys(b)
        assert wa & wb or wa & db or da & wb
        differing = len(np.setxor1d(a, b))
        assert differing <= most
        assert np.bitwise_count((pj.parity(a) ^ pj.parity(b)).view(np.uint64)).sum() <= differing


def test_bands_hold_every_size():
    for join in (Join(), Join(percent=80), Join(percent=50, band_ratio=1.2)):
        for n in range(1, 3000):
            low, high = join.band_sizes(join.band(n))
            assert low <= n <= high
            filed = dict(join.bands_of(n))
            assert all(join.segments(b) >= needed for b, needed in filed.items())
            smaller = [m for m in range(max(1, n // 2), n) if join.largest_partner(m) >= n]
            assert all(join.band(m) in filed for m in smaller)


def test_documents(spark, docs):
    assert result(docs) == expected([(r.doc_id, r.text) for r in docs.collect()], Join())


def test_awkward(spark, awkward_docs, no_docs):
    got = similar(awkward_docs).collect()
    texts = awkward_docs.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in got) == sorted(
        (r.doc_id is None, r.doc_id or 0, len(shingle_set(r.text, 3))) for r in texts
    )
    by_id = {r.doc_id: r for r in got}
    assert by_id[12].component_id == 11 and by_id[0].component_id == 0 and by_id[0].n_shingles == 0
    assert by_id[None].component_id is None
    assert similar(no_docs).count() == 0


def test_hot_rows(spark):
    """One id and text as a third of all rows, a null id with an equal text, and copies of one text."""
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(7, text)] * 300 + [(None, text)] * 5 + [(i, text.upper() if i % 2 else text + " more") for i in range(100, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in similar(df).collect()) == sorted(
        (i is None, i or 0, 7) for i, _ in rows
    )


def test_shingles_of_three():
    assert len(shingles("a b c d", 3)) == 2 and len(shingles("a b", 3)) == 1
