import numpy as np

from kindred.llm.byte_cnn import CHUNK, HOP, Fit, Network, chunks_of, fit_network, score
from kindred.llm.queries import QUERIES


def test_chunks_cover_the_text():
    for n in (0, 1, CHUNK, CHUNK + 1, HOP, 5 * HOP + 32, 10_001):
        text = "".join(chr(33 + i % 90) for i in range(n))
        chunks = chunks_of(text)
        back = b"".join(c[:HOP].tobytes() for c in chunks[:-1]) + chunks[-1].tobytes()
        assert back.rstrip(b"\0") == text.encode()


def test_tables_equal_the_convolution():
    fit = Fit(filters=5)
    network = Network(fit)
    chunk = chunks_of("Some bytes to look at, ÄÖÜ. " * 8)[:1]
    embedded = network.w["embed"][chunk[0]]
    by_hand = [
        max(float((embedded[p : p + fit.width] * network.w["filter"][:, :, f]).sum()) for p in range(CHUNK - fit.width + 1))
        for f in range(5)
    ]
    assert np.allclose(network.pooled(chunk)[0][0], by_hand, atol=1e-4)


def test_gradients():
    network = Network(Fit(filters=6, hidden=4))
    chunks = np.concatenate([chunks_of("good text " * 60), chunks_of("bad### text " * 30)])
    starts, y, weight = np.array([0, len(chunks_of("good text " * 60))]), np.array([1.0, 0.0]), np.ones(2)

    def loss():
        network.fold()
        z = network.forward(network.pooled(chunks)[0], starts)["z"].astype(float)
        return float((np.logaddexp(0, z) - y * z).mean())

    g = network.gradients(chunks, starts, y, weight)
    for name, at in (("out", (1,)), ("hidden", (2, 1)), ("filter_bias", (3,)), ("filter", (2, 3, 1)), ("embed", (ord("t"), 2))):
        old, step = float(network.w[name][at]), 2e-3
        network.w[name][at] = old + step
        up = loss()
        network.w[name][at] = old - step
        down = loss()
        network.w[name][at] = old
        assert abs((up - down) / (2 * step) - g[name][at]) < 0.02 + 0.1 * abs(g[name][at]), name


def test_awkward(spark, awkward_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(14)] + [(None, 1), (2, None), (3, 7)], "doc_id long, label int")
    network = fit_network(awkward_docs, labels, Fit(epochs=1))
    got = score(awkward_docs, network).collect()
    assert len(got) == awkward_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert score(no_docs, network).count() == 0
    one_class = fit_network(awkward_docs, labels.where("label = 1"), Fit(epochs=1))
    assert {round(r.score, 3) for r in score(awkward_docs, one_class).collect()} == {0.889}
    assert fit_network(no_docs, labels.where("false")) is not None


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op6_quality_classifier"](spark, sf).collect() if r.held_out and r.doc_id in truth]
    good = [r for r in rows if truth[r.doc_id]]
    bad = [r for r in rows if not truth[r.doc_id]]
    assert sum(r.predicted for r in good) >= 0.97 * len(good)
    assert sum(1 - r.predicted for r in bad) >= 0.75 * len(bad)
    order = sorted((r.score, truth[r.doc_id]) for r in rows)
    ranks = sum(i for i, (_, y) in enumerate(order) if y) - len(good) * (len(good) - 1) / 2
    assert ranks / (len(good) * len(bad)) >= 0.93
