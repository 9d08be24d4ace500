import random
import re

import pytest

from kindred.llm.components import components
from kindred.llm.minhash_paths import Join, keep_one, near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k=5):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def by_hand(rows, percent=85):
    sets = [(i, shingle_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and 100 * both >= percent * len(sets[a][1] | sets[b][1]):
                parent[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(sets):
        least[find(n)] = min(least.get(find(n), i), i)
    return sorted((i, len(s), least[find(n)], least[find(n)] == i) for n, (i, s) in enumerate(sets))


def near_rows(seed, groups=12, copies=14):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([3, 20, 60, 200]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 8])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    return rows


def result(df, join=Join()):
    return sorted(tuple(r) for r in near_duplicates(df, join).collect())


@pytest.mark.parametrize("join", [Join(), Join(small=6, block_sets=4, levels=2), Join(percent=80, small=10, block_shingles=300)])
def test_equals_all_pairs(spark, join):
    rows = near_rows(1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df, join) == by_hand(rows, join.percent)


def test_documents(spark, docs):
    assert result(docs) == by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward(spark, awkward_docs, no_docs):
    got = near_duplicates(awkward_docs).collect()
    texts = awkward_docs.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles) for r in got) == sorted(
        (r.doc_id is None, r.doc_id or 0, len(shingle_set(r.text))) for r in texts
    )
    by_id = {r.doc_id: r for r in got}
    assert by_id[12].component_id == 11 and not by_id[12].kept
    assert by_id[0].kept and by_id[1].kept and by_id[0].n_shingles == 0
    assert by_id[None].component_id is None and by_id[None].kept
    assert near_duplicates(no_docs).count() == 0
    kept = keep_one(awkward_docs)
    assert kept.dtypes == awkward_docs.dtypes and kept.count() == len(texts) - 1


def test_one_row_of_each_component(spark):
    """Null ids, repeated rows, and an id that stands for two texts: one row per component, no other text is lost."""
    a, b, c, d, e, f, g = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcdefg")
    rows = [
        (3, a, "x"), (5, a, "x"), (5, b, "x"),  # id 5: a copy of 3, and a text of its own
        (None, c, "x"), (None, c, "y"), (None, c, "y"), (None, c + " more", "x"),  # null ids only
        (None, d, "x"), (8, d + " more", "x"),  # a null id near another document
        (9, e, "x"), (9, e, "x"), (9, e, "y"), (10, e.upper(), "x"),  # repeated rows
        (None, f, "x"), (11, g, "x"), (12, "", "x"), (None, None, "x"), (None, None, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)

    def texts(kept):
        return sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)

    both = [(3, a), (5, b), (8, d + " more"), (9, e), (None, f), (11, g), (12, ""), (None, None), (None, None)]
    one, more = texts(keep_one(df, repeats=False)), texts(keep_one(df))
    null_c = [r for r in one if r[1] and r[1].startswith(c)]
    assert len(null_c) == 1 and null_c[0][0] is None
    assert one == sorted([*both, *null_c], key=str)
    assert more == sorted([*both, *null_c, (9, e), (9, e)], key=str)
    kept = keep_one(df, repeats=False)
    assert kept.dtypes == df.dtypes and sorted(map(str, kept.collect())) == sorted(map(str, keep_one(df.repartition(2), repeats=False).collect()))


def test_awkward_rows_once(spark, awkward_docs, no_docs):
    assert keep_one(awkward_docs, repeats=False).dtypes == awkward_docs.dtypes
    assert keep_one(awkward_docs, repeats=False).count() == awkward_docs.count() - 2  # a copy, and a row that is there twice
    assert keep_one(no_docs, repeats=False).count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, rng.randrange(101, 160)) for _ in range(50)] + [(7, 7), (None, 1), (300, 301)]
    got = {r.v: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[300] == got[301] == 300
    assert {got[b] for a, b in links if a == 100} == {100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
