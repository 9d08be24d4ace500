import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import encoders
from kindred.functions import text as tx


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


@pytest.mark.parametrize(
    ("fn", "cases"),
    [
        (tx.clean_id, {"1.0": "001", "7": "007", "12.0": "12", "ABC1": "ABC1", "": "", None: "", "0012": "12", "1.2.3": "1.2.3", ".5": "000"}),
        (tx.section_zfill, {"1.0": "001", None: "", "1234": "1234", "x": ""}),
        (tx.week_label, {"3": "3주차", "3주": "3주차", "3주차": "3주차", "20250901주차": None, "비고": None, "주차": None, "16주차": "16주차"}),
        (tx.parse_credit, {"3": 3.0, "3학점": 3.0, "": 0.0, "x": 0.0, "2.5 점": 2.5, None: 0.0}),
        (tx.clean_text, {"The 강의 Data-Base 2 분석!": "the data base 분석", "": "", "é à ç": ""}),
        (tx.label_preview, {"a b c": "a b", " one ": "one", "": ""}),
        (tx.sanitize_filename, {'a/b:c*?"<>|\\d ': "a_b_c_______d"}),
        (lambda c: tx.url_query_param(c, "haksu_no", "CurrCode"), {"http://a/b?haksu_no=AC%2F1&x=1": "AC/1", "http://a/b?CurrCode=Z9": "Z9", "http://a/b?haksu_no=&CurrCode=Z": "Z", "http://a": ""}),
        (lambda c: tx.named_number(c, "중간"), {"중간고사 : 30 %": 30, "기말 40": None}),
        (lambda c: tx.default_if_blank(c, "웹강의"), {"": "웹강의", None: "웹강의", "월1": "월1"}),
        (tx.classify_header, {"강의주제": "강의주제", "학습 목표": "강의내용", "비고": "시험및과제", "기타": "기타"}),
    ],
)
def test_cases(spark, fn, cases):
    assert apply(spark, fn, list(cases)) == list(cases.values())


def test_code_section_credit(spark):
    df = spark.createDataFrame([("ABC2201-001 학점:3.0",), ("ABC2201 001",)], "v string")
    parts = tx.parse_code_section_credit(F.col("v"))
    rows = [tuple(r) for r in df.select(*[c.alias(n) for n, c in parts.items()]).collect()]
    assert rows == [("ABC2201", "001", 3.0, None), (None, None, None, "ABC2201 001")]


def test_weighted_text(spark):
    df = spark.createDataFrame([("data base", "goal one", "")], "a string, b string, c string")
    text = tx.weighted_text({"교과목명": F.col("a"), "강의목표": F.col("b"), "강의개요": F.col("c")})
    assert df.select(text).first()[0] == "data base data base data base  goal one"


def test_item_key(spark):
    df = spark.createDataFrame([("A1", "002", 5), ("A1", "", 5), (None, "1", 5)], "c string, s string, i int")
    keys = [r[0] for r in df.select(tx.build_item_key(F.col("c"), F.col("s"), F.col("i"))).collect()]
    assert keys == ["A1-002", "A1", "course-005"]


def test_hashed_vectors_shuffle_a_row_per_text(spark):
    """Equal to the encoder; rows of one key count together, null and empty lists are zero, and no word is a row."""
    texts = [(1, "a b c a"), (2, "kind red a"), (2, "b"), (3, ""), (4, None)]
    df = spark.createDataFrame(texts, "id bigint, text string")
    made = encoders.hashed_vectors(df, "id", F.filter(F.split("text", " "), lambda t: t != ""))
    joined = {1: "a b c a", 2: "kind red a b", 3: "", 4: ""}
    wanted = encoders.hashing_encoder()()([*joined.values()])
    found = {r.id: np.array(r.vec, np.float32) for r in made.collect()}
    assert sorted(found) == sorted(joined)
    for i, vec in zip(joined, wanted, strict=True):
        assert np.array_equal(found[i], vec.astype(np.float32))
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
