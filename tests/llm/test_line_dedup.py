import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.llm.line_dedup import (
    COUNTED,
    Near,
    _count_gap,
    dedupe,
    keep_lines,
    with_counts,
    with_keys,
    within,
)

GAPS = " \t\n\x0b\f\r"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, line, n):
    chars = list(line)
    for _ in range(n):
        at = rng.randrange(len(chars))
        kind = rng.choice("ids")
        if kind == "i":
            chars.insert(at, rng.choice("abcé🙂"))
        elif kind == "d":
            del chars[at]
        else:
            chars[at] = rng.choice("abcé🙂")
    return "".join(chars)


def pairs(seed, n=400):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = "".join(rng.choice("abcdeé ") for _ in range(rng.choice([4, 9, 33, 70, 200])))
        out.append((a, edited(rng, a, rng.randrange(0, 5))) if rng.random() < 0.5 else (edited(rng, a, rng.randrange(0, 5)), a))
    return out + [("abc", "cab"), ("aaaa", "aaa"), ("x", "y"), ("", "ab"), ("ab", "")]


@pytest.mark.parametrize("edits", [0, 1, 2, 4])
def test_banded_distance(spark, edits):
    rows = [p for p in pairs(edits) if p[0] and p[1]]
    df = spark.createDataFrame(rows, "a string, b string")
    for r in df.select("a", "b", within(F.col("a"), F.col("b"), edits).alias("near")).collect():
        assert r.near == (distance(r.a, r.b) <= edits), (r.a, r.b)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_a_near_line_shares_a_key(spark, edits):
    near = Near(edits=edits)
    rows = [p for p in pairs(10 + edits, 1500) if min(map(len, p)) > 2 * edits and distance(*p) <= edits]
    rows = [sorted(p, key=len) for p in rows]
    df = spark.createDataFrame(rows, "short string, long string")

    def keyed(column, keep):
        sized = df.select("short", "long", F.col(column).alias("line"), F.length(column).alias("n"))
        return with_keys(sized, near, "short", "long").withColumnRenamed("keys", keep)

    own = keyed("short", "own").withColumn("own", F.slice("own", 1, edits + 1))
    probes = keyed("long", "probes").withColumn("probes", F.array_compact("probes"))
    both = own.join(probes, ["short", "long"])
    missing = both.where(~F.arrays_overlap("own", "probes"))
    assert both.count() >= len(rows)
    assert len(rows) > 300 and missing.count() == 0


def by_hand(rows, near):
    """rows: (doc_id, text) with different ids."""
    seen, out = [], {}
    for doc_id, text in sorted(rows):
        equal, close, kept = [], [], []
        for at, raw in enumerate((text or "").split("\n") if text is not None else []):
            line = raw.strip(GAPS)
            if line and any(line == s for s in seen):
                equal.append(at)
            elif line and any(
                min(len(line), len(s)) >= near.least_chars and abs(len(s) - len(line)) <= near.edits and distance(line, s) <= near.edits
                for s in seen
            ):
                close.append(at)
            else:
                kept.append(raw)
            if line:
                seen.append(line)
        out[doc_id] = (equal, close, "\n".join(kept) if text is not None else None)
    return out


def lines_corpus(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice([8, 31, 40, 90]))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = [edited(rng, x, rng.choice([0, 0, 1, 2, 3])) + rng.choice(["", " ", "\t"]) for x in rng.choices(base, k=rng.randrange(5))]
        rows.append((i, "\n".join(lines)))
    return rows + [(100, None), (101, ""), (102, "\n\n \n"), (103, "z" * 2_000), (104, "z" * 2_001 + "\n" + "z" * 1_997)]


def test_equals_brute_force(spark):
    near = Near(edits=2, least_chars=30)
    rows = lines_corpus(1)
    df = spark.createDataFrame([(i, t, "c", "c") for i, t in rows], "doc_id long, text string, id string, near string").repartition(4)
    got = {r.doc_id: (list(r.line_equal), list(r.line_near), r.line_text) for r in dedupe(df, near).collect()}
    want = by_hand(rows, near)
    # A line that equals an earlier one and is near another counts as equal there, as equal here.
    assert {k: (v[2]) for k, v in got.items()} == {k: v[2] for k, v in want.items()}
    assert sum(len(v[0]) for v in got.values()) == sum(len(v[0]) for v in want.values())


def test_awkward(spark, awkward_docs, no_docs):
    got = dedupe(awkward_docs).collect()
    assert len(got) == awkward_docs.count()
    kept = keep_lines(awkward_docs)
    assert kept.dtypes == awkward_docs.dtypes
    texts = [r.text for r in kept.collect()]
    assert texts.count("same line here") == 1 and None in texts and "" in texts
    assert dedupe(no_docs).count() == 0 and keep_lines(no_docs).count() == 0


def test_counts_bound_edits(spark):
    """Counts differ by no more than two per edit, and are those of a plain count, twelve letters in lines of any length."""
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        a = "".join(rng.choice(COUNTED + " qxé🙂") for _ in range(rng.choice([30, 99, 100, 101, 330])))
        rows.append((a, edited(rng, a, 2)))
    both = spark.createDataFrame(rows, "a string, b string")
    for side in "ab":
        sized = both.withColumn("line", F.col(side)).withColumn("n", F.length(side))
        both = with_counts(sized).drop("line", "n").withColumnRenamed("counts", f"of_{side}")
    for r in both.withColumn("gap", _count_gap(F.col("of_a"), F.col("of_b"))).collect():
        assert r["gap"] <= 4
        assert [(r["of_a"] >> 5 * i) & 31 for i in range(len(COUNTED))] == [r["a"].count(c) % 32 for c in COUNTED]
