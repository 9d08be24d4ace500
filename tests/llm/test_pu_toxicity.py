import random

from kindred.llm.pu_toxicity import Fit, class_prior, fit_models, score
from kindred.llm.queries import QUERIES

CLEAN = [f"word{a}{b}" for a in "abcdefgh" for b in "klmnop"]
BAD = ["vilefoo", "vilebar", "grottle"]


def corpus(spark, n=600):
    rng = random.Random(4)
    rows = []
    for i in range(n):
        words = rng.choices(CLEAN, k=rng.randint(20, 200))
        if i % 5 == 0:
            words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words)))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_finds_unseen_toxic_text(spark):
    docs = corpus(spark, 1500)
    toxic = docs.where("doc_id % 5 = 0")
    models = fit_models(docs.where("doc_id < 1300"), toxic.where("doc_id < 600").select("doc_id"), prior=0.2)
    got = {r.doc_id: r.score for r in score(docs.where("doc_id >= 1300"), models).collect()}
    assert len(got) == 200 and all(0 <= s <= 1 for s in got.values())
    assert all((s >= 0.3) == (i % 5 == 0) for i, s in got.items())


def test_awkward(spark, awkward_docs, no_docs):
    models = fit_models(corpus(spark, 100), spark.createDataFrame([(0,), (5,), (None,)], "doc_id long"), 0.1, Fit(epochs=3))
    got = score(awkward_docs, models).collect()
    assert len(got) == awkward_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert score(no_docs, models).count() == 0
    nothing = fit_models(no_docs, no_docs.select("doc_id"), 0.1)
    assert [round(r.score, 6) for r in score(awkward_docs.limit(2), nothing).collect()] == [0.1, 0.1]


def test_prior(spark):
    labels = spark.createDataFrame([(1,), (0,), (0,), (None,)], "label int")
    assert abs(class_prior(labels) - 1 / 3) < 1e-9
    assert class_prior(labels.where("false")) == 0.001


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op8_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    hit = sum(r.predicted == truth[r.doc_id] == 1 for r in rows)
    # In this table one toxic text in fifteen holds no toxic word, and some stems are ordinary syllables.
    assert hit >= 0.8 * sum(truth[r.doc_id] for r in rows)
    assert hit >= 0.9 * sum(r.predicted for r in rows)
