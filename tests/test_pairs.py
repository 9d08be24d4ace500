"""Threshold joins against all pairs, with a group of copies and a hot term."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import blocks, impact, pairs, products, search, tfidf, two_stage


def corpus(n=90, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(n):
        if i % 3 == 0:
            texts.append("hot alpha beta gamma delta " + ("tail" if i % 2 else "other"))
        else:
            texts.append("hot " + " ".join(rng.choices(words, weights=range(1, 41), k=rng.randint(2, 14))))
    return texts


def reference(texts, min_df=2, max_df=0.85):
    docs = []
    for text in texts:
        toks = text.split()
        grams = toks + [f"{a} {b}" for a, b in zip(toks, toks[1:], strict=False)]
        docs.append({g: grams.count(g) for g in set(grams)})
    n = len(docs)
    df = {}
    for d in docs:
        for g in d:
            df[g] = df.get(g, 0) + 1
    out = []
    for d in docs:
        w = {
            g: (1 + math.log(c)) * (math.log((1 + n) / (1 + df[g])) + 1)
            for g, c in d.items()
            if min_df <= df[g] <= max_df * n
        }
        size = math.sqrt(sum(x * x for x in w.values()))
        out.append({g: x / size for g, x in w.items()} if size else {})
    return out


def product(a, b):
    return sum(x * b[g] for g, x in a.items() if g in b)


@pytest.mark.parametrize("at_least", [0.05, 0.3, 0.7, 0.999])
def test_similar_pairs(spark, at_least):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    reps = tfidf.one_per_text(docs)
    weights = tfidf.tfidf(docs).join(reps.select("doc_id"), "doc_id", "left_semi")
    found = {(r["doc_a"], r["doc_b"]): r["sim"] for r in tfidf.similar_pairs(weights, at_least).collect()}
    vectors = reference(texts)
    keep = sorted({texts.index(t) for t in texts})
    wanted = {}
    for i, a in enumerate(keep):
        for b in keep[i + 1 :]:
            sim = product(vectors[a], vectors[b])
            if sim >= at_least:
                wanted[(a, b)] = sim
    assert found.keys() == wanted.keys()
    assert all(abs(found[p] - wanted[p]) < 1e-9 for p in wanted)
    copies = {r["doc_id"]: r["n_copies"] for r in reps.collect()}
    assert sum(copies.values()) == len(texts) and max(copies.values()) >= len(texts) // 6


def test_topn_by_blocks_of_any_size(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    asked = spark.createDataFrame([(0, texts[1]), (1, texts[0] + " w1 w2")], "query_id bigint, text string")

    def rows(layout):
        found = two_stage.tfidf_topn(docs, asked, 7, layout)
        return sorted((r["query_id"], r["pos"], r["doc_id"], round(r["sim"], 9)) for r in found.collect())

    small = rows(impact.Layout(block_docs=5, group_terms=3))
    assert small == rows(impact.Layout()) and len(small) == 14


def test_most_postings_are_not_read(spark):
    """Frequent terms with little weight: their lists stay closed, and the lists are as exact as a full scan's."""
    rng = np.random.default_rng(6)
    rows = []
    for d in range(3000):
        common = {int(t): 0.02 + 0.01 * rng.random() for t in rng.choice(60, 40, replace=False)}
        rare = {int(t): 0.3 + 0.6 * rng.random() for t in 100 + (rng.random(2) ** 2 * 300).astype(int)}
        rows += [(d, t, w) for t, w in {**common, **rare}.items()]
    postings = spark.createDataFrame(rows, "doc_id bigint, no bigint, w double")
    asked = [(q, int(t), 0.1) for q in range(20) for t in range(60)] + [(q, 100 + q * 3 + i, 0.5) for q in range(20) for i in range(4)]
    queries = impact.queries_of(spark.createDataFrame(asked, "query_id bigint, no bigint, q1 double"))
    layout = impact.Layout(block_docs=1000)
    got = impact.search(impact.build(postings, layout), queries, 10, layout)
    weights = {}
    for d, t, w in rows:
        weights.setdefault(t, []).append((d, w))
    for q in range(20):
        sums = {}
        for _, t, x in [a for a in asked if a[0] == q]:
            for d, w in weights.get(t, []):
                sums[d] = sums.get(d, 0.0) + x * w
        best = sorted(((-round(s, 9), d) for d, s in sums.items()))[:10]
        mine = sorted((-round(r["sim"], 9), r["doc_id"]) for r in got.where(f"query_id = {q}").collect())[:10]
        assert mine == best
    read = got.groupBy("query_id").agg(F.sum_distinct("postings").alias("n")).agg(F.avg("n")).first()[0]
    assert read < 0.25 * len(rows)


def test_dense_pairs_and_histogram(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(120, 6))
    vectors[:40] = vectors[0] + rng.normal(scale=0.05, size=(40, 6))
    rows = [(i, "c", "001", [float(x) for x in v]) for i, v in enumerate(vectors)]
    items = spark.createDataFrame(rows, "item_id bigint, code string, section string, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sims = unit @ unit.T
    wanted = {(i, j) for i in range(120) for j in range(i + 1, 120) if sims[i, j] >= 0.8}
    small = {(r["id_a"], r["id_b"]) for r in pairs.dense_pairs(items, 0.8).collect()}
    assigned, cells = blocks.build_cells(search.unit_items(items), block_rows=10, max_cells=8)
    large = [(r["id_a"], r["id_b"]) for r in pairs.near_pairs(assigned, cells, 0.8, block_rows=10).collect()]
    assert small == wanted and set(large) == wanted and len(large) == len(wanted)
    counts = [{r["bin"]: r["n"] for r in pairs.pair_histogram(items, 20, limit).collect()} for limit in (1 << 26, 0)]
    assert counts[0] == counts[1] and sum(counts[0].values()) == 120 * 120


def test_pair_histogram_of_many_blocks(spark, monkeypatch):
    """Blocks that meet once count for both orders."""
    rng = np.random.default_rng(6)
    rows = [(i, "c", "001", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(90, 5)))]
    items = spark.createDataFrame(rows, "item_id bigint, code string, section string, embedding array<double>")
    whole = {r["bin"]: r["n"] for r in pairs.pair_histogram(items, 20).collect()}
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 16)
    assert {r["bin"]: r["n"] for r in pairs.pair_histogram(items, 20, 0).collect()} == whole
    assert sum(whole.values()) == 90 * 90


def test_dealt_pairs_and_histogram(spark, monkeypatch):
    """A catalogue beyond the driver's limit needs no cells and no list of visits."""
    rng = np.random.default_rng(6)
    rows = [(i, "c", "001", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(90, 5)).astype(np.float32))]
    items = spark.createDataFrame(rows, "item_id bigint, code string, section string, embedding array<float>")
    wanted = sorted(tuple(r) for r in pairs.dense_pairs(items, 0.6).selectExpr("id_a", "id_b", "round(sim, 9)").collect())
    bins = sorted(tuple(r) for r in pairs.pair_histogram(items, 20).collect())
    monkeypatch.setattr(blocks, "build_cells", None)
    monkeypatch.setattr(blocks, "BLOCK_ROWS", None)
    dealt = sorted(tuple(r) for r in pairs.dense_pairs(items, 0.6, limit=1).selectExpr("id_a", "id_b", "round(sim, 9)").collect())
    assert wanted and dealt == wanted
    assert sorted(tuple(r) for r in pairs.pair_histogram(items, 20, limit=1).collect()) == bins


def test_profile_topn_equals_refitting(spark):
    """The corrected fit of every user equals a fit on that user's own corpus."""
    texts = corpus(40, seed=9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    taken = {1: [0, 3, 5], 2: list(range(0, 36, 2)), 3: [39], 4: list(range(38))}  # the last took 95 %
    pairs_taken = [(u, d) for u, ds in taken.items() for d in ds]
    frame = spark.createDataFrame(pairs_taken, "user_id bigint, doc_id bigint")
    got = two_stage.profile_topn(docs, frame, 15).collect()
    small = two_stage.profile_topn(docs, frame, 15, layout=impact.Layout(block_docs=6, group_terms=100)).collect()
    assert sorted(map(str, small)) == sorted(map(str, got))
    for user, mine in taken.items():
        rest = [d for d in range(len(texts)) if d not in mine]
        vectors = reference([texts[d] for d in rest] + [" ".join(texts[d] for d in mine)])
        scored = [(round(product(vectors[-1], vectors[i]), 9), d) for i, d in enumerate(rest)]
        wanted = sorted((s, d) for s, d in scored if s > 0)
        wanted = sorted(wanted, key=lambda p: (-p[0], p[1]))[:15]
        found = sorted((r["pos"], round(r["sim"], 9), r["doc_id"]) for r in got if r["query_id"] == user)
        assert [(s, d) for _, s, d in found] == wanted


def test_histogram_numeric(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    bins = {r["bin"]: r["n"] for r in pairs.histogram(df, "x", 10).collect()}
    assert bins == {i: 100 for i in range(10)}


def test_a_candidate_without_a_vector_stays(spark):
    found = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10)], "query_id bigint, doc_id bigint")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, vec array<double>")
    known = spark.createDataFrame([(10, [0.6, 0.8]), (12, [-1.0, 0.0])], "doc_id bigint, vec array<double>")
    got = two_stage.rerank_dense(found, asked, known, 3)
    assert sorted((r["query_id"], r["pos"], r["doc_id"], r["sim"]) for r in got.collect()) == [
        (1, 1, 10, 0.6), (1, 2, 11, 0.0), (1, 3, 12, -1.0), (2, 1, 10, 0.0),
    ]


def test_hybrid_of_all_documents(spark, sf, tmp_path):
    """Documents without a row in the embeddings table have their pairs, text-only ones included."""
    from kindred.plans import QUERIES

    texts = ["apple pear plum cherry"] * 2 + ["stone iron copper zinc"] * 2 + ["river"]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/embeddings.parquet").limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("hybrid_similarity_all", "pair_self_join_all"):
        found = {(r.id_a, r.id_b): r.hybrid for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert found[0, 1] == found[2, 3] == 1.0


@pytest.mark.parametrize("block_docs", [7, 1000])
def test_blocks_meet_once_without_joining_pairs(spark, block_docs):
    """Rows of one id, rows without an id or postings, terms both frequent and rare, vectors on both sides."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        nos = np.sort(rng.choice(40, rng.integers(0, 9), replace=False) ** 3)
        nos = np.concatenate([[-1], nos]) if i % 2 else nos
        vec = rng.normal(size=4)
        rows.append((None if i == 50 else i // 2 * 2, [int(x) for x in nos], [float(x) for x in rng.random(len(nos))], [float(x) for x in vec / np.linalg.norm(vec)]))
    df = spark.createDataFrame(rows, "id bigint, nos array<bigint>, ws array<double>, vec array<double>").repartition(3)
    wanted = []
    for i, (a, na, wa, va) in enumerate(rows):
        for b, nb, wb, vb in rows[i + 1 :]:
            text = sum(x * dict(zip(nb, wb, strict=True)).get(n, 0.0) for n, x in zip(na, wa, strict=True))
            dense = float(np.dot(va, vb))
            if None not in (a, b) and a != b and 0.6 * dense + 0.4 * text >= 0.4:
                wanted.append((min(a, b), max(a, b), round(text, 9), round(dense, 9)))
    made = products.block_pairs(df, 0.4, 0.6, block_docs)
    assert sorted((r.id_a, r.id_b, round(r.text, 9), round(r.dense, 9)) for r in made.collect()) == sorted(wanted)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


@pytest.mark.parametrize("room", [0, 3, 25, 10_000])
def test_frequent_terms_are_broadcast_and_the_others_joined(spark, room):
    """Every limit gives the same counts; below all terms the frequent ones still stay where they are."""
    docs = spark.createDataFrame(list(enumerate(corpus())), "doc_id bigint, text string")
    counts = tfidf.term_counts(docs)
    known = tfidf.prune(tfidf.document_frequency(counts), 90)
    made = tfidf.with_frequency(counts, known, room * tfidf.TERM_BYTES)
    wanted = counts.join(known.select("term", "df"), "term")
    rows = [sorted(tuple(r) for r in d.select("doc_id", "term", "tf", "df").collect()) for d in (made, wanted)]
    assert rows[0] == rows[1] and len(rows[0]) > 300
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert ("LeftAnti" in plan) == (room == 25)


def test_only_candidates_are_encoded(spark):
    """The cut is a semi join below the aggregate that makes the vectors."""
    found = spark.createDataFrame([(1, 2), (1, 3)], "query_id bigint, doc_id bigint")
    tokens = spark.createDataFrame([(i, f"t{i % 3}") for i in range(50)], "doc_id bigint, token string")
    vectors = tokens.groupBy("doc_id").agg(F.array(F.count("token").cast("double")).alias("vec"))
    asked = spark.createDataFrame([(1, [2.0])], "query_id bigint, vec array<double>")
    made = two_stage.rerank_dense(found, asked, vectors, 5)
    assert sorted((r.doc_id, r.sim, r.pos) for r in made.collect()) == [(2, 2.0, 1), (3, 2.0, 2)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("LeftSemi")


@pytest.mark.parametrize("block_bytes", [200, 1 << 26])
def test_joined_texts_are_not_shuffled_per_user(spark, block_bytes, capsys):
    """Every text of a user in document order, repeated rows and nulls as before; blocks of any size agree."""
    texts = [(i, f"t{i} é" if i % 7 else None) for i in range(40)] + [(3, "again"), (3, "t3 é"), (None, "lost")]
    taken = [(u, d) for u in range(30) for d in range(40) if (u * 7 + d * 3) % 5 == 0]
    taken += [(None, 3), (None, 1), (2, 3), (2, 3), (50, 7), (51, 99)]
    made = two_stage.user_text(
        spark.createDataFrame(taken, "user_id long, doc_id long"), spark.createDataFrame(texts, "doc_id long, text string"), block_bytes
    )
    want = {}
    for user in {u for u, _ in taken}:
        rows = sorted([(d, t or "", t) for u, d in taken if u == user for e, t in texts if e == d], key=lambda r: r[:2])
        if rows:
            want[user] = " ".join(t for *_, t in rows if t is not None)
    assert want[50] == "" and 51 not in want
    got = made.collect()
    assert {r["user_id"]: r["text"] for r in got} == want and len(got) == len(want)
    made.explain()
    assert "collect_list(struct" not in capsys.readouterr().out


def test_blocks_are_built_from_flat_arrays():
    """Documents of several batches as one block, without an object per posting."""
    import tracemalloc

    import pyarrow as pa

    kind = pa.schema([
        ("doc_id", pa.int64()), ("nos", pa.list_(pa.int64())), ("ws", pa.list_(pa.float64())), ("sums", pa.list_(pa.float64())),
        ("edge", pa.list_(pa.struct([(c, pa.float64()) for c in ("df", "s0", "s1", "s2")]))),
    ])
    edges = [None, [], [{"df": 3.0, "s0": 1.0, "s1": 2.0, "s2": 4.0}]]
    docs = [{"doc_id": 10 * i, "nos": [i, 7, 3], "ws": [0.1 * i, 0.7, 0.3], "sums": [1.0 * i, 2.0, 3.0], "edge": edges[i % 3]} for i in range(9)]
    batches = [pa.RecordBatch.from_pylist(docs[a:b], kind) for a, b in ((0, 4), (4, 9))]
    runs = [impact.Run.of(b) for b in batches]
    names = impact._BLOCK.names
    block = impact.Block(dict(zip(names, impact.block_rows(impact.Run.joined([runs[0].part(1, 4), runs[1].part(0, 5)]), 5))))
    assert block.docs.tolist() == [10 * i for i in range(1, 9)] and block.edge_doc.tolist() == [1, 4, 7]
    assert block.terms[block.at].tolist() == [t for i in range(1, 9) for t in (i, 7, 3)]
    assert np.allclose(block.w, [w for i in range(1, 9) for w in (0.1 * i, 0.7, 0.3)]) and block.edge_sums.tolist() == [[1, 2, 4]] * 3
    many = pa.RecordBatch.from_pylist([{"doc_id": i, "nos": list(range(500)), "ws": [0.5] * 500, "sums": [], "edge": None} for i in range(400)], kind)
    tracemalloc.start()
    impact.block_rows(impact.Run.of(many).part(0, 400), 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * 200_000


@pytest.mark.parametrize("block_docs", [7, 1000])
def test_rows_of_one_kind_meet_apart(spark, block_docs, monkeypatch):
    """As a join of all pairs by kind: a kind that shares its hash, ids of several kinds, twice of one, or of none."""
    monkeypatch.setattr(products, "KINDS", 2)
    rng = np.random.default_rng(6)
    kinds = [rng.choice(["en", "de", "fr", ""], rng.integers(0, 3)).tolist() for _ in range(50)]
    held = [([int(x) for x in rng.choice(9, 4, replace=False)], [float(x) for x in rng.random(4)]) for _ in range(50)]
    rows = [(i, *held[i], k) for i in range(50) for k in [*kinds[i], None]]
    df = spark.createDataFrame(rows, "id bigint, nos array<bigint>, ws array<double>, kind string")
    plain = products.block_pairs(df.where("kind is null").drop("kind"), 0.3, block_docs=block_docs)
    of = df.where("kind is not null").select("id", "kind")
    joined = plain.join(of.toDF("id_a", "kind"), "id_a").join(of.toDF("id_b", "kind"), ["id_b", "kind"])
    columns = ["id_a", "id_b", "kind", "round(text, 9)"]
    got = products.block_pairs(df, 0.3, block_docs=block_docs)
    assert sorted(map(tuple, got.selectExpr(*columns).collect())) == sorted(map(tuple, joined.selectExpr(*columns).collect())) != []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_terms_are_numbered_where_frequencies_are_joined(spark):
    docs = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma delta{i // 2}") for i in range(12)], "doc_id long, text string")
    made = tfidf.tfidf(docs, numbers=True)
    assert products.numbered(made) is made
    assert made.groupBy("term").agg(F.countDistinct("no").alias("n")).where("n <> 1").isEmpty()
    assert made.select("term").distinct().count() == made.select("no").distinct().count() > 3
