import json

import pytest
from pyspark.sql import functions as F

from kindred.operators import frames, nested, pages

CASES = [
    ({"g": "one"}, {"g": "one"}),
    ({"g.a": "x", "g.b": "y"}, {"g": {"a": "x", "b": "y"}}),
    ({"g": "", "g.a": "x"}, {"g": {"a": "x"}}),
    ({"g": "sum", "g.a": "x", "g.b": "y"}, {"g": {"a": "x", "b": "y"}}),
    ({"e": "", "e.mid": "30 %", "e.fin": "40 %"}, {"e": {"mid": "30 %", "fin": "40 %"}}),
    ({"g": '["A","B"]'}, {"g": '["A","B"]'}),
    ({"__filename": "X", "g.a": "OK"}, {"g": {"a": "OK"}}),
    ({"g": "only", "g.a": ""}, {"g": "only"}),
    ({"g": 'quote " and \\ [x]'}, {"g": 'quote " and \\ [x]'}),
    ({"g": None, "h.a.b": ""}, {}),
]


@pytest.mark.parametrize(("flat", "expected"), CASES)
def test_unflatten(spark, flat, expected):
    schema = ", ".join(f"`{c}` string" for c in flat)
    df = spark.createDataFrame([tuple(flat.values())], schema)
    assert json.loads(frames.unflatten(df).first()["record"]) == expected


def test_names():
    assert frames.normalised_name("전공능력 및\n 핵심역량") == "전공능력및핵심역량"
    assert frames.normalised_name("Office Hour\n(상담시간)") == "OfficeHour(상담시간)"
    assert frames.translated_name("주차별강의진행계획서.03주차.강의주제") == "weekly_plan.week3.topic"
    assert frames.translated_name("강의목표.목표4") == "objective.목표4"
    assert frames.translated_name("New Col!") == "new_col"


def test_reorder(spark):
    names = ["z", "주차별강의진행계획서.2주차.강의주제", "__filename", "주차별강의진행계획서.1주차.시험및과제",
             "주차별강의진행계획서.1주차.강의주제", "평가기준.계", "학수번호", "교과목명"]
    df = spark.createDataFrame([tuple("abcdefgh")], ", ".join(f"`{c}` string" for c in names))
    assert frames.reorder(df).columns == [
        "교과목명", "학수번호", "평가기준.계", "주차별강의진행계획서.1주차.강의주제",
        "주차별강의진행계획서.1주차.시험및과제", "주차별강의진행계획서.2주차.강의주제", "__filename", "z",
    ]


def test_key_paths(spark):
    docs = spark.createDataFrame(
        [(1, '{"a": {"b": null}, "c": [{"d": 1}, {"e": [{"f": 2}]}]}'), (2, '{"a": 1}'), (3, "broken")],
        "id int, json string",
    )
    paths = nested.key_paths(docs, "id", "json")
    got = {(r["id"], r["path"]) for r in paths.collect()}
    assert got == {(1, p) for p in ("a", "a.b", "c", "c[].d", "c[].e", "c[].e[].f")} | {(2, "a")}
    missing = {(r["id"], r["path"]) for r in nested.missing_keys(docs, paths, "id").collect()}
    assert (2, "a.b") in missing and (3, "a") in missing and (1, "a") not in missing


def test_zip_rows(spark):
    df = spark.createDataFrame([(1, ["mid", "", "fin"], ["30", "40", "50"])], "id int, h array<string>, v array<string>")
    rows = nested.zip_rows(df, "id", F.col("h"), F.col("v")).collect()
    assert {r["name"]: r["value"] for r in rows} == {"mid": "30", "fin": "40"}


def test_grading(spark):
    df = spark.createDataFrame([([("중간 고사", "30 %"), ("기말고사", "20 %"), ("기말고사 2", "25 %")],)], "rows array<struct<name:string,value:string>>")
    found = {r["part"]: r["value"] for r in df.select(F.inline(nested.grading_fill(F.col("rows")))).collect()}
    assert found["중간고사"] == "30 %" and found["기말고사"] == "25 %" and found["계"] == "100 %"


HTML = """<html><table><tr><td>교과목명</td><td>자료 &amp; 구조</td></tr><tr><th><b>학점</b></th><td></td></tr></table>
<table><tr><th>주차</th><th>주제</th><th>과제</th></tr><tr><td>1주</td><td>a</td><td>b</td></tr>
<tr><td>20250901주차</td><td>x</td><td>y</td></tr><tr><td>2</td><td>c</td></tr></table>
<script>var txtPyeongga1='30'; txtPyeongga2 = '70'</script></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, HTML)], "id int, html string")
    cells = pages.page_cells(F.col("html"))
    row = df.select(
        pages.after_label(cells, ["없음", "교과목명"]), pages.after_label(cells, ["학점", "교과목명"]),
        pages.script_numbers(F.col("html")),
    ).first()
    assert tuple(row) == ("자료 & 구조", "", [30, 70])
    plan = pages.weekly_plan(pages.table_rows(df, "id"), "id").collect()
    assert {(r["week"], r["field"], r["value"]) for r in plan} == {
        ("1주차", "강의주제", "a"), ("1주차", "시험및과제", "b"), ("2주차", "강의주제", "c"), ("2주차", "시험및과제", ""),
    }


NESTED = """<p>a&nbsp;b &middot; &copy; &#8364;&#x41;</p><table><tr><td>강의개요<td>one<br>two <table><tr><td>in&eacute;</td></tr></table> three
<tr><td>next</table><!-- no --><style>p{}</style>"""


def test_nested_tables_line_breaks_and_references(spark):
    df = spark.createDataFrame([(1, NESTED), (2, None), (3, "")], "id int, html string")
    rows = {(r.id, r.table_no, r.row_no): r.cells for r in pages.table_rows(df, "id").collect()}
    assert rows == {
        (1, 0, 0): ["강의개요", "one\ntwo\niné\nthree"], (1, 0, 1): ["next"], (1, 1, 0): ["iné"],
    }
    text = {r.id: r.t for r in df.select("id", pages.visible_text(F.col("html")).alias("t")).collect()}
    assert text == {1: "a b · © €A 강의개요 one two iné three next", 2: "", 3: ""}
    found = df.select("id", pages.after_label(pages.page_cells(F.col("html")), ["강의개요"]).alias("v"))
    assert {r.id: r.v for r in found.collect()} == {1: "one\ntwo\niné\nthree", 2: "", 3: ""}


def test_key_paths_in_one_pass(spark):
    texts = ['{"a": {"b": [{"c": 1}, {"d": null}, [2, {"e": 3}]]}}', "[1, 2]", "{broken", None, '{"a": 1, "a": 2}', '{"x": "' + "y" * 100_000 + '"}']
    deep = '{"k": ' * 50 + "1" + "}" * 50
    rows = list(enumerate([*texts, deep]))
    docs = spark.createDataFrame(rows, "doc_id long, json string")
    paths = nested.key_paths(docs, "doc_id", "json")
    found = {}
    for r in paths.collect():
        found.setdefault(r["doc_id"], set()).add(r["path"])
    assert found[0] == {"a", "a.b", "a.b[].c", "a.b[].d", "a.b[][].e"} and found[5] == {"x"} and len(found[6]) == 50
    assert set(found) == {0, 5, 6}
    every = set().union(*found.values())
    want = {(i, p) for i, _ in rows for p in every - found.get(i, set())}
    for size in (2, 1000):
        assert {(r["doc_id"], r["path"]) for r in nested.missing_keys(docs, paths, "doc_id", size).collect()} == want


def test_select_fields(spark):
    df = spark.sql("SELECT 1 AS id, 'n' AS `교과목명`, 3.0D AS `학점`, named_struct('a', 'x', 'b', named_struct('c', cast(null AS string), 'd', 'y')) AS `강의목표`, named_struct('a', cast(null AS string)) AS `강의개요`")
    got = frames.select_fields(df, "id", frames.COMPARED_FIELDS).first()
    assert got.asDict() == {"id": 1, "교과목명": "n", "강의목표": "x y", "강의개요": None}


def test_weekly_plan_reads_each_page_once(spark):
    """One parse and one meeting of a page's rows; a second copy of a page and a page without a key change nothing."""
    page = "<table><tr><th>주차</th><th>강의주제</th></tr><tr><td>1</td><td>a{}</td></tr></table><table><tr><td>x</td></tr></table>"
    df = spark.createDataFrame([(1, page.format(1)), (1, page.format(1)), (2, page.format(2)), (None, page.format(3))], "id bigint, html string")
    plan = pages.weekly_plan(pages.table_rows(df, "id"), "id")
    assert sorted(tuple(r) for r in plan.collect()) == [(1, "1주차", "강의주제", "a1"), (2, "1주차", "강의주제", "a2")]
    text = plan._jdf.queryExecution().executedPlan().toString()
    text = text.split("== Initial Plan ==")[-1]
    assert text.count("ArrowEvalPython") == 1 and "Join" not in text and text.count("Exchange") == 1
