from pyspark.sql import functions as F

from kindred.llm import crf_langid
from kindred.llm.common import one_text_per_id, texts_of


def test_an_id_in_a_third_of_the_rows_is_one_row_of_the_sample(spark):
    hot = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 3).alias("text"))
    rest = spark.range(4000).select((F.col("id") + 10).alias("doc_id"), F.lit("other words").alias("text"))
    rows = hot.unionByName(rest).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("fr"))
    chosen = one_text_per_id(rows, "lang").where("doc_id < 20")
    got = texts_of(rows, chosen, "lang").collect()
    assert sorted((r.doc_id, r.lang) for r in got) == [(i, "en" if i % 2 else "fr") for i in (7, *range(10, 20))]
    assert {r.text for r in got if r.doc_id == 7} <= {"text 0", "text 1", "text 2"}


def test_columns_that_only_the_choice_has(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    chosen = one_text_per_id(rows).withColumn("toxic", F.explode(F.array(F.lit(True), F.lit(False))))
    got = sorted((r.doc_id, r.toxic, r.text or "") for r in texts_of(rows, chosen, "toxic").collect())
    assert got == [(1, False, "a"), (1, True, "a"), (2, False, ""), (2, True, "")]


def test_language_fit_with_a_repeated_id(spark):
    rows = [(1, f"alpha beta gamma {i % 2}", "en") for i in range(300)] + [(i, "uno dos tres quatro", "es") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = crf_langid.fit_field(docs)
    assert field.langs == ["en", "es"]
