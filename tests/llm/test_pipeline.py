"""Every stage against a brute-force version, on the rows that the stage before it kept."""

import importlib.util
import pathlib
import re

import __spark_entry__ as entry
import corpus_pipeline as pipeline

HERE = pathlib.Path(__file__).parent


def helper(name):
    spec = importlib.util.spec_from_file_location(f"llm_{name}", HERE / f"{name}.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_stages(spark, sf, tmp_path):
    quality, lines, near = helper("test_host_quality"), helper("test_line_dedup"), helper("test_minhash_paths")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [sorted(docs.collect())]
    assert [name for name, _ in pipeline.STAGES] == ["language_id", "quality_rules", "line_dedup", "minhash_near_dedup", "packing"]
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
            seen.append(sorted(docs.collect()))
    raw, spoken, good, cut, once = seen

    dropped = [r for r in raw if r not in spoken]
    assert set(spoken) <= set(raw) and len(dropped) <= 0.05 * len(raw)
    assert not any(re.search(r"[^\W\d_]", r.text or "") is None for r in spoken)

    def passes(r):
        n, _, _, _, repeats = quality.by_hand(r.text)
        return n >= 50 and 100 * repeats <= 50 * n

    assert set(good) <= {r for r in spoken if passes(r)}
    assert len(good) >= 0.9 * sum(map(passes, spoken))

    want = lines.by_hand([(r.doc_id, r.text) for r in good], lines.Near())
    left = {i: text for i, (_, _, text) in want.items() if text.strip(" \t\n\x0b\f\r") or not (want[i][0] or want[i][1])}
    assert {r.doc_id: r.text for r in cut} == left

    groups = near.by_hand([(r.doc_id, r.text) for r in cut], percent=80)
    assert sorted(r.doc_id for r in once) == [i for i, _, _, kept in groups if kept]

    pieces = docs.collect()
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
        assert p.length * 4 == len(p.ids)
    assert total == {p.doc_id: p.doc_tokens for p in pieces} and total.keys() == {r.doc_id for r in once}


def test_registered(spark, sf):
    assert entry.queries()["pipeline"] is pipeline.run
    names = [q for q in entry.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 11))
    assert pipeline.run(spark, sf).count() > 0


def test_no_documents(spark, no_docs):
    docs = no_docs
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
