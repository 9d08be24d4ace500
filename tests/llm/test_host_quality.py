import re
from collections import Counter

from kindred.llm.host_quality import Rules, judge, keep

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts(awkward_docs, docs, no_docs):
    for df in (awkward_docs.withColumn("host", awkward_docs.source), docs.withColumn("host", docs.source)):
        got = judge(df).collect()
        cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        assert sorted(tuple(r[c] for c in cols) for r in got) == sorted(by_hand(r.text) for r in df.collect())
        for r in got:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert judge(no_docs.withColumnRenamed("source", "host")).count() == 0


def docs_of(spark, counts):
    good, loud = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}#" for i in range(60))
    rows = [(i, loud if i < bad else good, host) for host, bad, n in counts for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, host string")


def test_small_hosts_are_shrunk(spark):
    """One bad document does not condemn a host; forty of fifty do; clean documents always stay."""
    counts = [("bad", 40, 50), ("one", 1, 1), (None, 0, 30)] + [(f"h{i}", 1, 20) for i in range(30)]
    docs = docs_of(spark, counts)
    rows = judge(docs).collect()
    assert {r.host for r in rows if r.strict} == {"bad"}
    assert sum(not r.kept for r in rows) == 40
    kept = keep(docs, "host")
    assert kept.columns == docs.columns and kept.count() == len(rows) - 40


def test_repeated_lines_make_a_host_strict(spark):
    """Duplicate lines count against lines: a host that fails only this rule loses those documents."""
    lines = [" ".join(f"w{i}x{j}" for j in range(20)) for i in range(4)]
    good, again = "\n".join(lines), "\nmore\n".join([*lines, " \t", ""])  # 4 of 9 lines are the fifth one again
    counts = [("bad", 40, 50), ("one", 1, 1), (None, 0, 30)] + [(f"h{i}", 1, 20) for i in range(30)]
    rows = [(i, again if i < bad else good, host) for host, bad, n in counts for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string")
    got = judge(docs).collect()
    assert {(r.n_lines, r.n_dup_lines, r.fails_lines) for r in got} == {(4, 0, False), (9, 4, True)}
    assert {r.host for r in got if r.strict} == {"bad"}
    assert sum(r.base_failed for r in got) == 0 and sum(not r.kept for r in got) == 40
    assert keep(docs, "host").count() == len(rows) - 40


def test_keep_leaves_columns_alone(awkward_docs, no_docs):
    kept = keep(awkward_docs, "source", Rules(least_words=1))
    assert kept.dtypes == awkward_docs.dtypes
    want = sorted(str(r) for r in awkward_docs.collect() if (m := by_hand(r.text))[0] and 100 * m[4] <= 50 * m[0])
    assert sorted(str(r) for r in kept.collect()) == want
    assert keep(no_docs, "source").count() == 0


def test_a_host_that_fails_by_lines_alone(spark, tmp_path):
    """The registered query and its SQL agree where a host goes strict, and only for its repeated lines."""
    import duckdb

    from kindred.llm.queries import ORACLES, QUERIES

    def text(i, repeated):
        lines = [" ".join(f"w{i}x{j}y{k}" for k in range(12)) for j in range(6)]
        return "\n".join(lines + ([f"menu of page {i % 2}"] * 6 if repeated else []))

    rows = [(i, text(i, i % 10), "en", "bad", 0) for i in range(60)] + [(100 + i, text(i, False), "en", f"good{i % 5}", 0) for i in range(200)]
    rows += [(900, None, None, None, 0), (901, text(901, True), "en", "good1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.base_failed, r.kept, r.n_dup_lines) for r in QUERIES["op3_quality_rules"](spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.sql(f"SELECT doc_id, base_failed, kept, n_dup_lines FROM ({ORACLES['op3_quality_rules']})").fetchall()
    assert got == sorted(want)
    kept = {r[0] for r in got if r[2]}
    assert kept == {i for i in range(60) if i % 10 == 0} | set(range(100, 300)) | {901}
