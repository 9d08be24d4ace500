import itertools

import numpy as np

from kindred.llm.crf_langid import UNKNOWN, Field, Fit, Labeller, fit_field, keep_known, label
from kindred.llm.queries import QUERIES

WORDS = {"en": "the of and house water thing with morning".split(), "de": "der und das haus wasser ding mit schön".split()}


def corpus(spark, extra=()):
    rows = []
    for i in range(80):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(WORDS[lang][(i + j * 3) % 8] for j in range(10 + i % 30)), lang))
    return spark.createDataFrame(rows + list(extra), "doc_id long, text string, lang string")


def test_forward_backward_equals_all_paths():
    rng = np.random.default_rng(0)
    field = Field(["a", "b", "c"], Fit())
    field.moves = rng.normal(size=(3, 3))
    scores = rng.normal(size=(1, 4, 3))
    want, total = np.zeros((4, 3)), 0.0
    for path in itertools.product(range(3), repeat=4):
        w = np.exp(sum(scores[0, t, y] for t, y in enumerate(path)) + sum(field.moves[a, b] for a, b in itertools.pairwise(path)))
        total += w
        for t, y in enumerate(path):
            want[t, y] += w
    got, _ = field.marginals(scores, np.ones((1, 4), bool))
    assert np.allclose(got[0], want / total)
    padded = np.concatenate([scores, rng.normal(size=(1, 3, 3))], axis=1)
    got, _ = field.marginals(padded, np.array([[True] * 4 + [False] * 3]))
    assert np.allclose(got[0, :4], want / total)


def test_labels_words_of_mixed_text(spark):
    field = fit_field(corpus(spark))
    mixed = "the house with water and thing der haus mit wasser und ding"
    (lang, score, p), = Labeller(field).texts([mixed])
    assert [field.langs[i] for i in p.argmax(axis=1)] == ["en"] * 6 + ["de"] * 6
    df = spark.createDataFrame([(1, mixed)], "doc_id long, text string")
    spans = [tuple(s) for s in label(df, field).first().spans]
    assert spans == [(0, 6, "en"), (6, 6, "de")]


def test_awkward(spark, awkward_docs, no_docs):
    field = fit_field(corpus(spark, [(None, "no id", "en"), (1, None, "en"), (2, "", "fr"), (3, "x", None), (3, "der und", "de")]))
    assert field.langs == ["de", "en"]
    got = label(awkward_docs, field).collect()
    texts = awkward_docs.collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.lang_pred in ("de", "en", UNKNOWN) and 0 <= r.score <= 1
    letters = sum(any(map(str.isalpha, t.text or "")) for t in texts)
    assert sum(r.lang_pred != UNKNOWN for r in got) == letters
    assert label(no_docs, field).count() == 0
    kept = keep_known(awkward_docs, field, 0.0)
    assert kept.dtypes == awkward_docs.dtypes and kept.count() == letters
    nothing = fit_field(no_docs)
    assert {r.lang_pred for r in label(awkward_docs, nothing).collect()} == {UNKNOWN}


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op5_language_id"](spark, sf).collect() if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.98 * len(rows)
    assert sum(r.score >= 0.5 for r in rows) >= 0.98 * len(rows)


def test_keep_known_and_long_runs(spark, docs, awkward_docs, no_docs):
    """Awkward rows pass the filter whole or not at all; a run without spaces gives features from end to end."""
    from kindred.llm.crf_langid import fit_field, keep_known, words_of

    field = fit_field(docs)
    kept = keep_known(awkward_docs, field, 0.0)
    assert kept.dtypes == awkward_docs.dtypes
    rows = awkward_docs.collect()
    assert kept.count() == sum(any(c.isalpha() for c in r.text or "") for r in rows)
    assert keep_known(no_docs, field, 0.5).count() == 0
    assert "".join(words_of("ab" * 100)) == "ab" * 100 and max(map(len, words_of("ab" * 100))) == 40
