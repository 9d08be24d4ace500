import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions.encoders import embed_batches
from kindred.operators import cluster
from kindred.plans.bind import items, names
from kindred.sources import files
from kindred.streaming.unseen import append_unseen, bucket_of, read_store, stored_keys


def test_a_batch_opens_only_its_own_part_of_the_store(spark, tmp_path):
    source, store, marks = (str(tmp_path / n) for n in ("in", "store", "marks"))
    for start in (0, 2000):
        spark.range(start, start + 2000).selectExpr("id AS doc_id", "concat('text ', id) AS text").write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id bigint, text string").parquet(source)
        append_unseen(stream, store, marks).awaitTermination()
    assert read_store(spark, store).count() == 4000
    key = F.sha2(F.col("text"), 256)
    fresh = spark.createDataFrame([("text 7",), ("never seen",)], "text string").select(key.alias("text_key"))
    fresh = fresh.withColumn("bucket", bucket_of(F.col("text_key")))
    known = stored_keys(fresh, store, batch_id=9)
    filters = known._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters
    everything = read_store(spark, store).inputFiles()
    assert len(everything) > 400
    assert known.select(F.input_file_name()).distinct().count() <= 4  # two buckets, two batches
    assert fresh.join(known, "text_key").count() == 1


def test_json_folder(spark, tmp_path):
    for name, body in {"b.json": '{\n "a": 1\n}', "a.json": '{"a": {"b": [1]}}', "c.json": '{"a": '}.items():
        (tmp_path / name).write_text(body)
    good, bad = files.split_bad_docs(files.scan_json_docs(spark, str(tmp_path)))
    assert {r["file"] for r in good.collect()} == {"a.json", "b.json"}
    assert [r["file"] for r in bad.collect()] == ["c.json"]
    for _ in range(2):
        files.write_error_log(bad, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", 'say "hi", ok', "line\nbreak"), ("2", None, "강의")]
    df = spark.createDataFrame(rows, "`a.id` string, b string, c string")
    files.write_csv_table(df, str(tmp_path / "t"))
    read = files.scan_csv_strings(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, read.collect())) == [(a, b or "", c) for a, b, c in rows]
    with pytest.raises(ValueError):
        files.scan_url_list(spark, str(tmp_path / "t"))


def test_stream_stores_each_text_once(spark, tmp_path):
    source, store, marks = (str(tmp_path / n) for n in ("in", "store", "marks"))
    schema = "doc_id bigint, text string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        append_unseen(stream, store, marks).awaitTermination()

    arrive([(1, "a b"), (2, "c"), (3, "a b")])
    arrive([(4, "c"), (5, "d e f"), (6, "")])
    stored = read_store(spark, store)
    assert sorted(r["text"] for r in stored.collect()) == ["", "a b", "c", "d e f"]
    sizes = {r["text"]: float(np.linalg.norm(r["embedding"])) for r in stored.collect()}
    assert sizes[""] == 0 and abs(sizes["d e f"] - 1) < 1e-6


def test_encoder_hook(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(50)], "i int, t string")

    def factory():
        return lambda texts: np.array([[len(t), len(texts)] for t in texts], dtype=float)

    got = embed_batches(df, F.col("t"), factory, batch=7).collect()
    assert all(r["embedding"][0] == r["i"] and r["embedding"][1] <= 7 for r in got)


def test_kmeans_and_projection(spark, sf):
    stock = items(spark, sf)
    model = cluster.fit_kmeans(stock, 6, 42, n_init=2)
    got = cluster.assign_clusters(stock, model).select("item_id", "embedding", "cluster").collect()
    points = np.array([r["embedding"] for r in got])
    centres = np.array(model.clusterCenters())
    nearest = ((points[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == np.array([r["cluster"] for r in got])).all()
    pca = cluster.fit_pca(stock, 3)
    axes = pca.stages[1].pc.toArray()
    assert np.allclose(axes.T @ axes, np.eye(3), atol=1e-9)
    placed = cluster.project(stock.select("item_id", "embedding"), pca, names=("a", "b", "c"))
    rows = np.array([[r["a"], r["b"], r["c"]] for r in placed.collect()])
    assert np.allclose(rows.mean(axis=0), 0, atol=1e-6)
    view, _ = cluster.cluster_view(stock, names(spark, sf), k=5, per_cluster=12)
    assert max(r["count"] for r in view.groupBy("cluster").count().collect()) <= 12


def test_topics(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    topics = cluster.lda_topics(docs, k=3, n_terms=5).collect()
    assert len(topics) == 15 and all(0 < r["weight"] < 1 and r["term"] for r in topics)


def test_record_per_section(spark, tmp_path):
    """The last record of a section stays, odd names survive, and a code has one file."""
    rows = [(i, f"A {i % 3}/x", str(i % 2), '{"n":"%d","in":{"q":"\\"}"}}' % i) for i in range(60)] + [(99, None, "1", "{}")]
    df = spark.createDataFrame(rows, "doc_id long, code string, section string, record string").repartition(7)
    files.write_record_per_section(df, f"{tmp_path}/out", "doc_id")
    got = {r["key"]: r["record"] for r in files.read_record_per_section(spark, f"{tmp_path}/out").collect()}
    assert got == {f"{c}-{s}": rec for _, c, s, rec in rows[:60]}
    assert all(len([f for f in d.iterdir() if f.name.startswith("part-")]) == 1 for d in (tmp_path / "out").iterdir() if d.is_dir())


def test_section_documents_lie_in_few_folders(spark, tmp_path):
    """However many codes there are, folders and files stay bounded, and a code lies in one of them."""
    df = spark.range(2000).selectExpr("id AS doc_id", "CONCAT('C', id DIV 2) AS code", "CAST(id % 2 AS string) AS section", "'{}' AS record")
    files.write_record_per_section(df, f"{tmp_path}/out", "doc_id")
    parts = list((tmp_path / "out").glob("*/part-*"))
    assert len(parts) <= 256
    held = [{line.split('"code":"')[1].split('"')[0] for line in p.read_text().splitlines()} for p in parts]
    assert sum(map(len, held)) == len(set().union(*held)) == 1000
    got = files.read_record_per_section(spark, f"{tmp_path}/out").collect()
    assert {(r["code"], r["key"], r["record"]) for r in got} == {(f"C{i // 2}", f"C{i // 2}-{i % 2}", "{}") for i in range(2000)}
