import hashlib
import random
import zlib

import numpy as np
import pytest

from kindred.llm.prefix_trie import PerfectHash, Trie, end_digests, trie

SCHEMA = "conv_id long, turn long, role string, text string"
SMALL = Trie(unit_turns=12, shard_turns=20, chunk_turns=3, joined_ids=2)
WHOLE = Trie(unit_turns=10**9)


def by_hand(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(x, key=lambda t: t[:2])] for c, x in turns.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = said.get(c - int(np.fmod(c, 100)), [])[:h] + own[h:]
    members = {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), []).append(c)
    kids = {p: 0 for p in members}
    leaves, saved = dict(kids), dict(kids)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += kids[p] == 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df, plan):
    return sorted((tuple(r) for r in trie(df, plan).collect()), key=str)


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 450), n):
        for t in range(rng.choice([1, 2, 5, 7, 11])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "bé", "🙂 c"])))
    return rows


@pytest.mark.parametrize("plan", [Trie(), SMALL, WHOLE])
def test_equals_by_hand(spark, plan):
    rows = conversations(2, 220)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(df, plan) == by_hand(rows)


def test_hot_conversation_and_first_turn(spark):
    """One conversation with a third of all rows, one first turn in all others, and copies of a conversation."""
    rows = [(77_777, t, "user", f"t{t}") for t in range(400)]
    rows += [(c, t, "user", "hello" if t == 0 else f"{c % 7} {t}") for c in range(0, 12000, 100) for t in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    assert result(df, Trie(unit_turns=30, shard_turns=64, chunk_turns=16, joined_ids=4)) == by_hand(rows)


def test_awkward(spark):
    rows = [
        (1, None, "user", "null turn first"), (1, 0, None, None), (1, 5, "", ""), (None, 0, "user", "no conversation"),
        (100, 0, "user", "x" * 100_000), (101, 3, "user", "b"), (101, 3, "user", "b"), (7, 0, "user", "only"), (207, 0, "a", "b"),
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", depth string, c int")
    assert result(df, Trie()) == by_hand(rows) == result(df, SMALL)
    assert trie(df.limit(0)).count() == 0
    assert trie(df.where("conv_id is null")).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 30_000):
        keys = np.unique(rng.integers(0, 1 << 63, (n, 2), dtype=np.uint64), axis=0)
        table = PerfectHash(keys)
        assert sorted(table.slots(keys)) == list(range(len(keys)))
        assert (table.slots(rng.integers(0, 1 << 63, (50, 2), dtype=np.uint64)) == -1).all()


def test_ends_in_pieces(spark):
    rows = [(c % 3, -(c % 3), c * 7 % 5003) for c in range(5003)]
    df = spark.createDataFrame(rows, "d1 long, d2 long, c long").repartition(7)
    want = {}
    for d, _, c in rows:
        want.setdefault(d, []).append(c)
    got = {r.d1: r.ends_sha256 for r in end_digests(df, Trie(joined_ids=10)).collect()}
    assert got == {d: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest() for d, x in want.items()}
