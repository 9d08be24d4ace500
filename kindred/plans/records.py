"""Scalars, frames, nested data, pages and running values over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions import text as tx
from kindred.operators import frames, ingest, nested, pages, stats, windows
from kindred.plans.bind import ITEMS, code_of, items, table
from kindred.plans.registry import query

# ---- syllabus records derived from documents ----------------------------------------

CODE = "(['GEB','GED','EEC','ACE'])[CAST((doc_id // 5) % 4 + 1 AS INT)] || printf('%04d', doc_id // 5)"

# The same record as columns, for the SQL side.
SYLLABI_SQL = f"""
lines AS (SELECT doc_id, text, source, lang, n_chars, string_split(text, chr(10)) AS l FROM documents),
syllabi AS (
  SELECT doc_id, l[1] AS name, {CODE} AS code, printf('%03d', doc_id % 5 + 1) AS section,
         CAST(doc_id % 4 AS DOUBLE) AS credit, l[2] AS goal1, l[3] AS goal2, source AS skill, lang AS hours,
         CASE WHEN doc_id % 3 <> 0 THEN (n_chars % 50) || ' %' END AS midterm,
         CASE WHEN doc_id % 2 = 0 THEN (n_chars % 40) || ' %' END AS final,
         l[4] AS topic1, l[5] AS content1, l[6] AS topic2, l[7] AS task2,
         CASE WHEN doc_id % 5 = 0 THEN source END AS book
  FROM lines)"""


def syllabi(spark: SparkSession, sf: str) -> DataFrame:
    """One nested record per document, with the key names raw records have."""
    lines = F.split("text", "\n")

    def line(i: int):
        return F.get(lines, F.lit(i))

    doc = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id",
        line(0).alias("교과목명"),
        code_of(F.floor(doc / 5)).alias("학수번호"),
        F.format_string("%03d", doc % 5 + 1).alias("분 반"),
        (doc % 4).cast("double").alias("학점"),
        F.struct(line(1).alias("목표1"), line(2).alias("목표2")).alias("강의목표"),
        F.col("source").alias("전공능력 및\n핵심역량"),
        F.col("lang").alias("Office Hour\n(상담시간)"),
        F.struct(
            F.when(doc % 3 != 0, F.concat((F.col("n_chars") % 50).cast("string"), F.lit(" %"))).alias("중간고사"),
            F.when(doc % 2 == 0, F.concat((F.col("n_chars") % 40).cast("string"), F.lit(" %"))).alias("기말고사"),
        ).alias("평가기준"),
        F.struct(
            F.struct(line(3).alias("강의주제"), line(4).alias("강의내용")).alias("1주차"),
            F.struct(line(5).alias("강의주제"), line(6).alias("시험및과제")).alias("2주차"),
        ).alias("주차별 강의진행계획서"),
        F.when(doc % 5 == 0, F.array(F.struct(F.col("source").alias("제목")))).alias("교재"),
    )


def undotted(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(".", "__") for c in df.columns])


def flat_syllabi(spark: SparkSession, sf: str) -> DataFrame:
    return frames.rename_merged(
        frames.flatten(syllabi(spark, sf).drop("교재")), frames.normalised_name
    )


FLAT = """doc_id, name AS "교과목명", code AS "학수번호", section AS "분반", credit AS "학점",
  goal1 AS "강의목표__목표1", goal2 AS "강의목표__목표2", skill AS "{skill}", hours AS "{hours}",
  midterm AS "평가기준__중간고사", final AS "평가기준__기말고사",
  topic1 AS "주차별강의진행계획서__1주차__강의주제", content1 AS "주차별강의진행계획서__1주차__강의내용",
  topic2 AS "주차별강의진행계획서__2주차__강의주제", task2 AS "주차별강의진행계획서__2주차__시험및과제" """


@query(
    "flatten_json",
    f"""WITH {SYLLABI_SQL} SELECT {FLAT.format(skill="전공능력및핵심역량", hours="OfficeHour(상담시간)")} FROM syllabi""",
)
def _flatten_json(spark: SparkSession, sf: str) -> DataFrame:
    return undotted(frames.flatten(syllabi(spark, sf).drop("교재")))


@query(
    "add_missing_columns",
    f"""WITH {SYLLABI_SQL} SELECT doc_id, name AS "교과목명", code AS "학수번호",
  CAST(NULL AS VARCHAR) AS "담당교수명", CAST(NULL AS VARCHAR) AS "강의개요", CAST(NULL AS VARCHAR) AS "수업방법"
FROM syllabi""",
)
def _add_missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    full = frames.add_missing(frames.flatten(syllabi(spark, sf).drop("교재")))
    return full.select("doc_id", "교과목명", "학수번호", "담당교수명", "강의개요", "수업방법")


@query(
    "rename_columns_normalised",
    f"""WITH {SYLLABI_SQL} SELECT doc_id, coalesce(skill, book) AS "전공능력및핵심역량", hours AS "OfficeHour(상담시간)"
FROM syllabi""",
)
def _rename_columns_normalised(spark: SparkSession, sf: str) -> DataFrame:
    raw = syllabi(spark, sf)
    wide = raw.select(
        "doc_id", "전공능력 및\n핵심역량", F.get("교재", F.lit(0))["제목"].alias("전공능력 및\n 핵심역량"),
        "Office Hour\n(상담시간)",
    )
    return frames.rename_merged(wide, frames.normalised_name)


ENGLISH_FLAT = """doc_id, name AS course_name, code AS course_code, section AS class_number, credit,
  goal1 AS objective__goal1, goal2 AS objective__goal2, skill AS core_competency, hours AS office_hour,
  midterm AS evaluation__midterm, final AS evaluation__final,
  topic1 AS weekly_plan__week1__topic, content1 AS weekly_plan__week1__content,
  topic2 AS weekly_plan__week2__topic, task2 AS weekly_plan__week2__exam_or_task"""


@query("rename_columns_translated", f"WITH {SYLLABI_SQL} SELECT {ENGLISH_FLAT} FROM syllabi")
def _rename_columns_translated(spark: SparkSession, sf: str) -> DataFrame:
    return undotted(frames.rename_merged(flat_syllabi(spark, sf), frames.translated_name))


@query(
    "drop_columns_matching",
    f"""WITH {SYLLABI_SQL} SELECT doc_id, name AS "교과목명", code AS "학수번호", section AS "분반", credit AS "학점",
  goal1 AS "강의목표__목표1", goal2 AS "강의목표__목표2", skill AS "전공능력및핵심역량", hours AS "OfficeHour(상담시간)",
  midterm AS "평가기준__중간고사", final AS "평가기준__기말고사" FROM syllabi""",
)
def _drop_columns_matching(spark: SparkSession, sf: str) -> DataFrame:
    return undotted(frames.drop_matching(flat_syllabi(spark, sf), contains="주차별강의진행계획서"))


@query(
    "reorder_columns",
    f"""WITH {SYLLABI_SQL} SELECT doc_id, '교과목명|학수번호|분반|학점|강의목표.목표1|강의목표.목표2|전공능력및핵심역량|'
  || 'OfficeHour(상담시간)|평가기준.중간고사|평가기준.기말고사|주차별강의진행계획서.1주차.강의주제|'
  || '주차별강의진행계획서.1주차.강의내용|주차별강의진행계획서.2주차.강의주제|주차별강의진행계획서.2주차.시험및과제|doc_id'
  AS header, name AS first_value FROM syllabi""",
)
def _reorder_columns(spark: SparkSession, sf: str) -> DataFrame:
    ordered = frames.reorder(flat_syllabi(spark, sf))
    return ordered.select(
        "doc_id", F.lit("|".join(ordered.columns)).alias("header"),
        frames.at(ordered.columns[0]).alias("first_value"),
    )


@query(
    "unflatten_columns",
    f"""WITH {SYLLABI_SQL} SELECT doc_id, nullif(name, '') AS name, nullif(goal1, '') AS goal1, nullif(goal2, '') AS goal2,
  nullif(midterm, '') AS midterm, nullif(topic1, '') AS topic1, nullif(task2, '') AS task2,
  goal1 IS NULL OR goal1 = '' AS no_goal1 FROM syllabi""",
)
def _unflatten_columns(spark: SparkSession, sf: str) -> DataFrame:
    english = frames.rename_merged(flat_syllabi(spark, sf), frames.translated_name)
    records = frames.unflatten(english, keep=["doc_id"])

    def part(path: str):
        return F.get_json_object("record", path)

    return records.select(
        "doc_id", part("$.course_name").alias("name"), part("$.objective.goal1").alias("goal1"),
        part("$.objective.goal2").alias("goal2"), part("$.evaluation.midterm").alias("midterm"),
        part("$.weekly_plan.week1.topic").alias("topic1"),
        part("$.weekly_plan.week2.exam_or_task").alias("task2"),
        part("$.objective.goal1").isNull().alias("no_goal1"),
    )


# ---- key paths ----------------------------------------------------------------------

PATHS = {
    "doc_id": "TRUE", "교과목명": "name IS NOT NULL", "학수번호": "TRUE", "분 반": "TRUE", "학점": "TRUE",
    "강의목표": "TRUE", "강의목표.목표1": "goal1 IS NOT NULL", "강의목표.목표2": "goal2 IS NOT NULL",
    "전공능력 및' || chr(10) || '핵심역량": "skill IS NOT NULL",
    "Office Hour' || chr(10) || '(상담시간)": "hours IS NOT NULL",
    "평가기준": "TRUE", "평가기준.중간고사": "midterm IS NOT NULL", "평가기준.기말고사": "final IS NOT NULL",
    "주차별 강의진행계획서": "TRUE", "주차별 강의진행계획서.1주차": "TRUE", "주차별 강의진행계획서.2주차": "TRUE",
    "주차별 강의진행계획서.1주차.강의주제": "topic1 IS NOT NULL",
    "주차별 강의진행계획서.1주차.강의내용": "content1 IS NOT NULL",
    "주차별 강의진행계획서.2주차.강의주제": "topic2 IS NOT NULL",
    "주차별 강의진행계획서.2주차.시험및과제": "task2 IS NOT NULL",
    "교재": "book IS NOT NULL", "교재[].제목": "book IS NOT NULL",
}
PATHS_SQL = f"""{SYLLABI_SQL},
paths AS ({" UNION ALL ".join(f"SELECT doc_id, '{p}' AS path FROM syllabi WHERE {c}" for p, c in PATHS.items())})"""


def json_syllabi(spark: SparkSession, sf: str) -> DataFrame:
    raw = syllabi(spark, sf)
    return raw.select("doc_id", F.to_json(F.struct(*[frames.at(c) for c in raw.columns])).alias("json"))


@query("extract_key_paths", f"WITH {PATHS_SQL} SELECT doc_id, path FROM paths")
def _extract_key_paths(spark: SparkSession, sf: str) -> DataFrame:
    return nested.key_paths(json_syllabi(spark, sf), "doc_id", "json")


@query("key_presence_count", f"WITH {PATHS_SQL} SELECT path, count(*) AS n_docs FROM paths GROUP BY path")
def _key_presence_count(spark: SparkSession, sf: str) -> DataFrame:
    return nested.presence(nested.key_paths(json_syllabi(spark, sf), "doc_id", "json"), "doc_id")


@query("distinct_key_union", f"WITH {PATHS_SQL} SELECT DISTINCT path FROM paths")
def _distinct_key_union(spark: SparkSession, sf: str) -> DataFrame:
    return nested.key_paths(json_syllabi(spark, sf), "doc_id", "json").select("path").distinct()


@query(
    "missing_keys_per_doc",
    f"""WITH {PATHS_SQL}, everything AS (SELECT DISTINCT path FROM paths)
SELECT d.doc_id, e.path FROM documents d CROSS JOIN everything e
ANTI JOIN paths p ON p.doc_id = d.doc_id AND p.path = e.path""",
)
def _missing_keys_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    docs = json_syllabi(spark, sf)
    return nested.missing_keys(docs, nested.key_paths(docs, "doc_id", "json"), "doc_id")


@query(
    "flatten_week_plan",
    """SELECT doc_id, array_to_string(list_filter([source, lang, CASE WHEN doc_id % 2 = 0 THEN CAST(n_chars AS VARCHAR) END],
  lambda x: x IS NOT NULL), ' ') AS plan FROM documents""",
)
def _flatten_week_plan(spark: SparkSession, sf: str) -> DataFrame:
    chars = F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("string"))
    plan = F.create_map(
        F.lit("1주차"), F.create_map(F.lit("강의주제"), F.col("source"), F.lit("강의내용"), F.col("lang")),
        F.lit("2주차"), F.create_map(F.lit("강의주제"), chars),
    )
    return table(spark, sf, "documents").select("doc_id", nested.flatten_weeks(plan).alias("plan"))


@query(
    "select_fields",
    f"""WITH {SYLLABI_SQL} SELECT doc_id, name AS "교과목명", lpad(CAST(credit AS VARCHAR), 5, ' ') AS "학점" FROM syllabi""",
)
def _select_fields(spark: SparkSession, sf: str) -> DataFrame:
    wanted = {"교과목명", "학점"}
    raw = syllabi(spark, sf)
    kept = [frames.at(c).cast("string").alias(c) for c in raw.columns if c in wanted]
    return raw.select("doc_id", *kept).withColumn("학점", F.lpad("학점", 5, " "))


@query(
    "select_fields_embedded",
    f"""WITH {SYLLABI_SQL}
SELECT doc_id, name AS "교과목명",
  CASE WHEN goal1 IS NOT NULL OR goal2 IS NOT NULL THEN concat_ws(' ', goal1, goal2) END AS "강의목표",
  skill AS "전공능력 및\n핵심역량",
  CASE WHEN coalesce(topic1, content1, topic2, task2) IS NOT NULL THEN concat_ws(' ', topic1, content1, topic2, task2) END
    AS "주차별 강의진행계획서"
FROM syllabi""",
)
def _select_fields_embedded(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of the embedded text that a record has, goals and weekly plan flattened."""
    return frames.select_fields(syllabi(spark, sf), "doc_id", frames.EMBEDDED_FIELDS)


# ---- grids --------------------------------------------------------------------------

CELLS_SQL = r"""
cells AS (
  SELECT conv_id AS file, turn AS row, CAST(i - 1 AS INT) AS col, value
  FROM (SELECT conv_id, turn, unnest(w) AS value, generate_subscripts(w, 1) AS i
        FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations))),
kept AS (SELECT file, row, col, trim(value) AS value,
                row_number() OVER (PARTITION BY file, row ORDER BY col) AS nth FROM cells WHERE trim(value) <> '')"""


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as sheets: a file per conversation, a row per turn, a cell per word."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("file"), F.col("turn").alias("row"),
        F.posexplode(F.split("text", " ")).alias("col", "value"),
    )


@query(
    "grid_nonblank_cells",
    f"""WITH {CELLS_SQL} SELECT file, row, string_agg(value, '|' ORDER BY col) AS cells FROM kept GROUP BY file, row""",
)
def _grid_nonblank_cells(spark: SparkSession, sf: str) -> DataFrame:
    made = nested.row_values(cells(spark, sf), ["file", "row"])
    return made.withColumn("cells", F.array_join("cells", "|"))


@query(
    "pair_adjacent_cells",
    f"""WITH {CELLS_SQL},
pairs AS (SELECT a.file, a.row, a.nth, a.value AS name, b.value FROM kept a JOIN kept b
          ON a.file = b.file AND a.row = b.row AND b.nth = a.nth + 1 WHERE a.nth % 2 = 1)
SELECT file, name, value FROM (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY row DESC, nth DESC) AS rn
  FROM pairs) WHERE rn = 1""",
)
def _pair_adjacent_cells(spark: SparkSession, sf: str) -> DataFrame:
    return nested.adjacent_pairs(cells(spark, sf))


@query(
    "zip_header_values",
    """WITH sides AS (
  SELECT a.conv_id, list_filter(string_split(a.text, ' '), lambda t: t <> '') AS h,
         list_filter(string_split(b.text, ' '), lambda t: t <> '') AS v
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1),
cells AS (SELECT conv_id, unnest(range(1, least(len(h), len(v)) + 1)) AS i, h, v FROM sides)
SELECT conv_id, name, max_by(value, i) AS value FROM (SELECT conv_id, i, h[i] AS name, v[i] AS value FROM cells)
GROUP BY conv_id, name""",
)
def _zip_header_values(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.split("text", " ").alias("w"))
    head = turns.where("turn = 0").select("conv_id", F.col("w").alias("h"))
    body = turns.where("turn = 1").select("conv_id", F.col("w").alias("v"))
    return nested.zip_rows(head.join(body, "conv_id"), "conv_id", F.col("h"), F.col("v"))


PARTS_SQL = ", ".join(f"('{k}', '{v}')" for k, v in tx.GRADING_DEFAULTS.items())


@query(
    "grading_map_fill",
    f"""WITH found AS (
  SELECT doc_id, n, name, value FROM (
    SELECT doc_id, 1 AS n, '중간 고사' AS name, (n_chars % 50) || ' %' AS value FROM documents WHERE doc_id % 3 <> 0
    UNION ALL SELECT doc_id, 2, '기말고사(필기)', (n_chars % 40) || ' %' FROM documents
    UNION ALL SELECT doc_id, 3, '기말고사', (n_chars % 30) || ' %' FROM documents WHERE doc_id % 2 = 0)),
parts AS (SELECT * FROM (VALUES {PARTS_SQL}) AS t(part, value))
SELECT d.doc_id, p.part, coalesce(max_by(f.value, f.n), p.value) AS value
FROM documents d CROSS JOIN parts p
LEFT JOIN found f ON f.doc_id = d.doc_id AND contains(replace(f.name, ' ', ''), p.part)
GROUP BY d.doc_id, p.part, p.value""",
)
def _grading_map_fill(spark: SparkSession, sf: str) -> DataFrame:
    def share(of: int):
        return F.concat((F.col("n_chars") % of).cast("string"), F.lit(" %"))

    def row(name: str, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    rows = F.filter(
        F.array(
            F.when(F.col("doc_id") % 3 != 0, row("중간 고사", share(50))),
            row("기말고사(필기)", share(40)),
            F.when(F.col("doc_id") % 2 == 0, row("기말고사", share(30))),
        ),
        lambda r: r.isNotNull(),
    )
    return table(spark, sf, "documents").select("doc_id", F.inline(nested.grading_fill(rows)))


# ---- pages --------------------------------------------------------------------------


def syllabus_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A syllabus page per document: a label table and a weekly table."""

    def safe(c):
        return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    doc = F.col("doc_id").cast("string")
    html = F.concat(
        F.lit("<html><table><tr><th>교과목명</th><td>"), safe(F.col("source")),
        F.lit("</td><th>담당 교수</th><td> "), safe(F.col("lang")),
        F.lit("</td></tr><tr><th>강의개요</th><td><b>"), safe(F.col("text")),
        F.lit("</b></td></tr></table><table border=1><tr><th>주차</th><th>강의주제</th><th>학습내용</th></tr><tr><td>"),
        doc, F.lit("</td><td>t"), doc, F.lit("</td><td>c"), doc,
        F.lit("</td></tr><tr><td>2주</td><td>"), safe(F.col("source")),
        F.lit("</td></tr><tr><td>보강계획</td><td>x</td></tr></table></html>"),
    )
    return table(spark, sf, "documents").select("doc_id", html.alias("html"))


@query(
    "page_label_next_cell",
    """SELECT doc_id, trim(source) AS name, lang AS professor, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS overview,
  '' AS book FROM documents""",
)
def _page_label_next_cell(spark: SparkSession, sf: str) -> DataFrame:
    read = syllabus_pages(spark, sf).select("doc_id", pages.page_cells(F.col("html")).alias("cells"))
    cell = F.col("cells")
    return read.select(
        "doc_id", pages.after_label(cell, ["과목이름", "교과목명", "과목명"]).alias("name"),
        pages.after_label(cell, ["담당교수", "교수명", "담당 교수"]).alias("professor"),
        pages.after_label(cell, ["강의개요", "교과목개요"]).alias("overview"),
        pages.after_label(cell, ["주교재없음"]).alias("book"),
    )


@query(
    "page_weekly_plan",
    r"""WITH w AS (
  SELECT doc_id, doc_id || '주차' AS week, 't' || doc_id AS topic, 'c' || doc_id AS content FROM documents
  WHERE doc_id <> 2
  UNION ALL SELECT doc_id, '2주차', trim(regexp_replace(source, '\s+', ' ', 'g')), '' FROM documents)
SELECT doc_id, week, '강의주제' AS field, topic AS value FROM w
UNION ALL SELECT doc_id, week, '강의내용', content FROM w""",
)
def _page_weekly_plan(spark: SparkSession, sf: str) -> DataFrame:
    return pages.weekly_plan(pages.table_rows(syllabus_pages(spark, sf), "doc_id"), "doc_id")


CLEAN_HTML = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace({html}, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&middot;', chr(183)), '&copy;', chr(169)), '&lt;', '<'), '&gt;', '>'), '&#39;', ''''), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query("page_text", f"SELECT page_id, {CLEAN_HTML.format(html='html')} AS text FROM pages")
def _page_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", pages.visible_text(F.col("html")).alias("text"))


@query(
    "page_table_rows",
    rf"""WITH lists AS (
  SELECT page_id, unnest(b) AS body, generate_subscripts(b, 1) - 1 AS table_no
  FROM (SELECT page_id, regexp_extract_all(html, '(?is)<(?:ul)(?:\s[^>]*)?>(.*?)</(?:ul)>', 1) AS b FROM pages)),
rows AS (
  SELECT page_id, table_no, unnest(b) AS line, generate_subscripts(b, 1) - 1 AS row_no
  FROM (SELECT page_id, table_no, regexp_extract_all(body, '(?is)<(?:li)(?:\s[^>]*)?>(.*?)</(?:li)>', 1) AS b FROM lists))
SELECT page_id, CAST(table_no AS INT) AS table_no, CAST(row_no AS INT) AS row_no,
  array_to_string(list_transform(regexp_extract_all(line, '(?is)<(?:a)(?:\s[^>]*)?>(.*?)</(?:a)>', 1),
    lambda c: {CLEAN_HTML.format(html="c")}), '|') AS cells FROM rows""",
)
def _page_table_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = pages.table_rows(table(spark, sf, "pages"), "page_id", table="ul", row="li", cell=["a"])
    return rows.withColumn("cells", F.array_join("cells", "|"))


@query(
    "extract_all_numbers",
    r"""SELECT page_id, CAST(generate_subscripts(n, 1) - 1 AS INT) AS nth, CAST(unnest(n) AS BIGINT) AS value
FROM (SELECT page_id, regexp_extract_all(html, 'track\((\d+)\)', 1) AS n FROM pages)""",
)
def _extract_all_numbers(spark: SparkSession, sf: str) -> DataFrame:
    numbers = pages.script_numbers(F.col("html"), r"track\((\d+)\)")
    return table(spark, sf, "pages").select("page_id", F.posexplode(numbers).alias("nth", "value"))


# ---- scalars ------------------------------------------------------------------------


@query(
    "section_zfill",
    """SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber <> 7 THEN printf('%03d', CAST(trunc(l_quantity) AS BIGINT)) END, '') AS section,
  printf('%03d', CAST(trunc(l_extendedprice) AS BIGINT)) AS long FROM lineitem""",
)
def _section_zfill(spark: SparkSession, sf: str) -> DataFrame:
    quantity = F.when(F.col("l_linenumber") != 7, F.col("l_quantity"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", tx.section_zfill(quantity).alias("section"),
        tx.section_zfill(F.col("l_extendedprice")).alias("long"),
    )


@query(
    "clean_id",
    """WITH raw AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_retailprice AS VARCHAR)
  WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN p_size || '.0' ELSE CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END END AS raw
  FROM part)
SELECT p_partkey, CASE WHEN raw = '' THEN '' WHEN TRY_CAST(raw AS DOUBLE) IS NULL THEN raw
  WHEN length(raw) <= 3 THEN printf('%03d', CAST(floor(CAST(raw AS DOUBLE)) AS BIGINT))
  ELSE CAST(CAST(floor(CAST(raw AS DOUBLE)) AS BIGINT) AS VARCHAR) END AS id FROM raw""",
)
def _clean_id(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 4
    raw = (
        F.when(kind == 0, F.col("p_retailprice").cast("string"))
        .when(kind == 1, size)
        .when(kind == 2, F.concat(size, F.lit(".0")))
        .otherwise(F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""))
    )
    return table(spark, sf, "part").select("p_partkey", tx.clean_id(raw).alias("id"))


@query(
    "parse_code_section_credit",
    f"""WITH {ITEMS} SELECT item_id, CASE WHEN item_id % 3 < 2 THEN code END AS code,
  CASE WHEN item_id % 3 < 2 THEN section END AS section, CASE WHEN item_id % 3 < 2 THEN CAST(cluster AS DOUBLE) END AS credit,
  CASE WHEN item_id % 3 = 2 THEN code || ' ' || section END AS raw FROM items""",
)
def _parse_code_section_credit(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("item_id") % 3
    credit = F.col("cluster").cast("string")
    line = (
        F.when(kind == 0, F.concat("code", F.lit("-"), "section", F.lit(" 학점:"), credit, F.lit(".0")))
        .when(kind == 1, F.concat("code", F.lit("-"), "section", F.lit("학점 "), credit))
        .otherwise(F.concat("code", F.lit(" "), "section"))
    )
    line = F.replace(line, F.lit("학점 "), F.lit("학점"))
    read = items(spark, sf).select("item_id", line.alias("line"))
    parts = tx.parse_code_section_credit(F.col("line"))
    return read.select("item_id", *[c.alias(n) for n, c in parts.items()])


@query(
    "sanitize_filename",
    r"""SELECT page_id, trim(regexp_replace(url, '[\\/:*?"<>|]', '_', 'g')) AS file,
  trim(regexp_replace(url, '[^A-Za-z0-9가-힣 _-]', '', 'g')) AS sheet FROM pages""",
)
def _sanitize_filename(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", tx.sanitize_filename(url).alias("file"), tx.sanitize_sheet_name(url).alias("sheet")
    )


@query(
    "build_item_key",
    f"""WITH {ITEMS} SELECT item_id, CASE item_id % 3 WHEN 0 THEN code || '-' || section WHEN 1 THEN code
  ELSE 'course-' || printf('%03d', item_id) END AS key FROM items""",
)
def _build_item_key(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("item_id") % 3
    code = F.when(kind < 2, F.col("code"))
    section = F.when(kind == 0, F.col("section")).otherwise(" ")
    return items(spark, sf).select(
        "item_id", tx.build_item_key(code, section, F.col("item_id")).alias("key")
    )


@query(
    "url_query_param",
    """SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]ref=([^&#]+)', 1), ''),
  nullif(regexp_extract(url, '[?&]utm_source=([^&#]+)', 1), ''), 'none') AS origin FROM pages""",
)
def _url_query_param(spark: SparkSession, sf: str) -> DataFrame:
    origin = tx.url_query_param(F.col("url"), "ref", "utm_source", default="none")
    return table(spark, sf, "pages").select("page_id", origin.alias("origin"))


@query(
    "parse_credit",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN CAST(p_size AS DOUBLE)
  WHEN 2 THEN 0.0 ELSE CAST(p_size AS DOUBLE) + 0.5 END AS credit FROM part""",
)
def _parse_credit(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 4
    raw = (
        F.when(kind == 0, size)
        .when(kind == 1, F.concat(size, F.lit("학점")))
        .when(kind == 2, "x")
        .otherwise(F.concat(F.lit("약 "), size, F.lit(".5 점")))
    )
    return table(spark, sf, "part").select("p_partkey", tx.parse_credit(raw).alias("credit"))


@query(
    "week_label_normalise",
    """SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE turn || '주차' END AS week
FROM conversations""",
)
def _week_label_normalise(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn").cast("string")
    kind = (F.col("conv_id") + F.col("turn")) % 5
    raw = (
        F.when(kind == 0, t)
        .when(kind == 1, F.concat(t, F.lit("주")))
        .when(kind == 2, F.concat(t, F.lit("주차")))
        .when(kind == 3, F.concat(F.lit("2025090"), t, F.lit("주차")))
        .otherwise("비고")
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.week_label(raw).alias("week"))


@query(
    "classify_header",
    """SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN '강의주제' WHEN 1 THEN '강의방식' WHEN 2 THEN '강의내용'
  WHEN 3 THEN '시험및과제' WHEN 4 THEN '시험및과제' ELSE '기타 ' || role END AS field FROM conversations""",
)
def _classify_header(spark: SparkSession, sf: str) -> DataFrame:
    heads = F.array(*[F.lit(h) for h in ("주제", "수업 방식", "학습 목표", "중간 시험", "비고란", "기타")])
    header = F.concat(F.element_at(heads, (F.col("turn") % 6 + 1).cast("int")), F.lit(" "), F.col("role"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.classify_header(header).alias("field")
    )


@query(
    "default_if_blank",
    "SELECT doc_id, CASE WHEN lang = 'en' THEN '웹강의' ELSE source END AS timetable FROM documents",
)
def _default_if_blank(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("lang") != "en", F.col("source")).otherwise("")
    default = tx.FIELD_DEFAULTS["강의시간표"]
    return table(spark, sf, "documents").select(
        "doc_id", tx.default_if_blank(raw, default).alias("timetable")
    )


@query(
    "extract_named_numbers",
    """SELECT doc_id, CAST(n_chars % 50 AS INT) AS "중간", CAST(n_chars % 40 AS INT) AS "기말",
  CAST(NULL AS INT) AS "출석" FROM documents""",
)
def _extract_named_numbers(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_chars")
    line = F.concat(
        F.lit("평가: 중간고사 ("), (n % 50).cast("string"), F.lit("%) 기말 : "), (n % 40).cast("string"),
        F.lit("% 출석 없음"),
    )
    return table(spark, sf, "documents").select(
        "doc_id", *[tx.named_number(line, k).alias(k) for k in ("중간", "기말", "출석")]
    )


@query("trim_cast_key", "SELECT c_custkey, CAST(c_nationkey AS VARCHAR) AS nation, c_name AS name FROM customer")
def _trim_cast_key(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))
    return table(spark, sf, "customer").select(
        "c_custkey", tx.trim_cast_key(F.col("c_nationkey")).alias("nation"),
        tx.trim_cast_key(padded).alias("name"),
    )


# ---- filters ------------------------------------------------------------------------


@query(
    "filter_not_null",
    "SELECT event_id, user_id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL",
)
def _filter_not_null(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "events").select(
        "event_id", "user_id", F.get_json_object("props", "$.k").alias("k")
    )
    return keyed.where(F.col("k").isNotNull()).drop("k")


@query(
    "filter_any_null",
    """SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)
WHERE l.quality IS NULL OR l.toxic IS NULL OR d.source IS NULL""",
)
def _filter_any_null(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    test = F.col("quality").isNull() | F.col("toxic").isNull() | F.col("source").isNull()
    return joined.where(test).select("doc_id", "quality", "toxic")


@query(
    "filter_prefix",
    f"WITH {ITEMS} SELECT item_id, code FROM items WHERE starts_with(code, 'GE') AND item_id % 11 <> 0",
)
def _filter_prefix(spark: SparkSession, sf: str) -> DataFrame:
    holed = items(spark, sf).select("item_id", F.when(F.col("item_id") % 11 != 0, F.col("code")).alias("code"))
    return holed.where(F.coalesce(F.startswith("code", F.lit("GE")), F.lit(False)))


@query(
    "filter_not_equal",
    "SELECT p_partkey, p_type FROM part WHERE p_type IS DISTINCT FROM 'ECONOMY'",
)
def _filter_not_equal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").where(~F.col("p_type").eqNullSafe("ECONOMY")).select("p_partkey", "p_type")


@query(
    "filter_range",
    "SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount < 0.05 AND l_tax < 0.02",
)
def _filter_range(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .where((F.col("l_discount") < 0.05) & (F.col("l_tax") < 0.02))
        .select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    )


# ---- joins and aggregates -----------------------------------------------------------


@query(
    "anti_pending_keys",
    """SELECT DISTINCT doc_id FROM (SELECT doc_id FROM labels WHERE toxic = 1) f
ANTI JOIN (SELECT doc_id FROM documents WHERE lang = 'en') d USING (doc_id)""",
)
def _anti_pending_keys(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return ingest.pending_keys(docs, docs.where("lang = 'en'"), labels.where("toxic = 1"), "doc_id")


@query(
    "progress_counts",
    """SELECT count(*) AS total, count(l.doc_id) AS n_done, count(*) FILTER (l.doc_id IS NULL) AS n_left
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""",
)
def _progress_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.progress_counts(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query(
    "join_index_integrity",
    f"""WITH {ITEMS} SELECT count(i.item_id) AS n_vectors, count(d.doc_id) AS n_documents,
  count(*) FILTER (i.item_id IS NOT NULL AND d.doc_id IS NOT NULL) AS n_matched,
  count(*) FILTER (d.doc_id IS NULL) AS n_vector_only, count(*) FILTER (i.item_id IS NULL) AS n_document_only
FROM items i FULL OUTER JOIN documents d ON d.doc_id = i.item_id""",
)
def _join_index_integrity(spark: SparkSession, sf: str) -> DataFrame:
    vectors = items(spark, sf).select(F.col("item_id").alias("v"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("d"))
    v, d = F.col("v"), F.col("d")
    return vectors.join(docs, v == d, "full_outer").agg(
        F.count("v").alias("n_vectors"), F.count("d").alias("n_documents"),
        F.count_if(v.isNotNull() & d.isNotNull()).alias("n_matched"),
        F.count_if(d.isNull()).alias("n_vector_only"), F.count_if(v.isNull()).alias("n_document_only"),
    )


NULL_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(*) AS n_rows, count(*) - count({c}) AS n_null FROM j"
    for c, t in [("doc_id", "bigint"), ("lang", "string"), ("quality", "int"), ("toxic", "int")]
)


@query(
    "column_null_profile",
    f"WITH j AS (SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)) {NULL_PROFILE}",
)
def _column_null_profile(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return stats.null_profile(docs.join(table(spark, sf, "labels"), "doc_id", "left"))


@query(
    "describe_numeric",
    """SELECT 'o_totalprice' AS "column", count(x) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std,
  min(x) AS low, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.5), 4) AS median,
  round(quantile_cont(x, 0.75), 4) AS q3, max(x) AS high FROM (SELECT o_totalprice AS x FROM orders)""",
)
def _describe_numeric(spark: SparkSession, sf: str) -> DataFrame:
    made = stats.describe_numeric(table(spark, sf, "orders"), "o_totalprice")
    return made.select(
        "column", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "low",
        *[F.round(c, 4).alias(c) for c in ("q1", "median", "q3")], "high",
    )


@query(
    "boxplot_stats",
    """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
  quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT 'l_extendedprice' AS "column", min(x) FILTER (x BETWEEN lo AND hi) AS whisker_low, round(any_value(q1), 4) AS q1,
  round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3, max(x) FILTER (x BETWEEN lo AND hi) AS whisker_high,
  count(*) FILTER (x < lo OR x > hi) AS n_outliers FROM (SELECT l_extendedprice AS x FROM lineitem), f""",
)
def _boxplot_stats(spark: SparkSession, sf: str) -> DataFrame:
    made = stats.boxplot_stats(table(spark, sf, "lineitem"), "l_extendedprice")
    for c in ("q1", "median", "q3"):
        made = made.withColumn(c, F.round(c, 4))
    return made


@query(
    "longest_per_group",
    """SELECT source, doc_id, length(text) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rn FROM documents) WHERE rn = 1""",
)
def _longest_per_group(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        "source", "doc_id", F.length("text").cast("bigint").alias("n")
    )
    best = F.max_by(F.struct("doc_id", "n"), F.struct(F.col("n"), -F.col("doc_id")))
    return docs.groupBy("source").agg(best.alias("b")).select("source", "b.doc_id", "b.n")


# ---- running values -----------------------------------------------------------------

def day_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the day as the chunk that keeps one user's rows apart."""
    return table(spark, sf, "events").withColumn("day", F.date_trunc("day", F.col("ts")))


@query(
    "ffill_group_marker",
    """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS marker FROM events""",
)
def _ffill_group_marker(spark: SparkSession, sf: str) -> DataFrame:
    rows = day_events(spark, sf).select(
        "event_id", "user_id", "ts", "day",
        F.when(F.col("event_type") == "signup", F.col("event_id")).alias("own"),
    )
    filled = windows.fill_down(rows, ["user_id"], ["ts", "event_id"], "day", "own", "marker")
    return filled.select("event_id", "user_id", "marker")


@query(
    "rows_before_sentinel",
    """WITH m AS (SELECT user_id, min(event_id) AS first FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT event_id, user_id, event_type FROM events LEFT JOIN m USING (user_id) WHERE first IS NULL OR event_id < first""",
)
def _rows_before_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return windows.rows_before_marker(rows, ["user_id"], "event_id", F.col("event_type") == "error")


@query(
    "rows_at_offset_from_sentinel",
    """WITH m AS (SELECT user_id, min(event_id) AS first FROM events WHERE event_type = 'error' GROUP BY user_id)
SELECT event_id, user_id, event_type, CAST(rn AS INT) AS "offset" FROM (
  SELECT e.*, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events e JOIN m USING (user_id)
  WHERE event_id > first) WHERE rn <= 3""",
)
def _rows_at_offset_from_sentinel(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return windows.rows_after_marker(rows, ["user_id"], "event_id", F.col("event_type") == "error", 3)


@query(
    "next_key_pairing",
    """SELECT event_id, user_id, event_type AS kind, lead(event_type) OVER w AS next_kind, lead(event_id) OVER w AS next_id
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def _next_key_pairing(spark: SparkSession, sf: str) -> DataFrame:
    rows = day_events(spark, sf).select(
        "event_id", "user_id", "ts", "day", F.col("event_type").alias("kind"), F.col("event_id").alias("id")
    )
    paired = windows.next_row(rows, ["user_id"], ["ts", "event_id"], "day", ["kind", "id"], "next_")
    return paired.select("event_id", "user_id", "kind", "next_kind", "next_id")


@query(
    "week_pairs",
    """WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 3 <> 2 THEN CAST(turn + 1 AS VARCHAR) ELSE role || turn END AS name,
             CAST(length(text) AS VARCHAR) AS value FROM conversations),
n AS (SELECT *, lead(name) OVER w AS next_name, lead(value) OVER w AS next_value, lead(turn) OVER w AS next_turn
      FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT * FROM n WHERE try_cast(name AS INT) BETWEEN 1 AND 16 AND try_cast(next_name AS INT) IS NULL AND next_name <> '')
SELECT conv_id, name || '주차' AS name, next_name AS topic, next_value AS value FROM p
UNION ALL SELECT conv_id, name, NULL, value FROM r
ANTI JOIN (SELECT conv_id, turn FROM p UNION ALL SELECT conv_id, next_turn FROM p) u
  ON u.conv_id = r.conv_id AND u.turn = r.turn""",
)
def _week_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as the rows of a record: two of three named by a number, the third by its role."""
    turn = F.col("turn")
    named = F.when(turn % 3 != 2, (turn + 1).cast("string")).otherwise(F.concat("role", turn.cast("string")))
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.floor(turn / 1000).alias("chunk"), named.alias("name"),
        F.length("text").cast("string").alias("value"),
    )
    return windows.week_pairs(rows, "conv_id", "turn", "chunk")


@query(
    "collision_suffix",
    """SELECT doc_id, source || CASE WHEN rn > 1 THEN '-' || (rn - 1) ELSE '' END AS unique_name FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)""",
)
def _collision_suffix(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        "doc_id", "source", F.floor(F.col("doc_id") / 256).alias("chunk")
    )
    return windows.collision_suffix(docs, "source", ["doc_id"], "chunk").select("doc_id", "unique_name")


@query("assign_row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders")
def _assign_row_index(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.floor(F.col("o_orderkey") / 4096).alias("chunk")
    )
    numbered = windows.number_rows(rows, [], ["o_orderkey"], "chunk", "nth")
    return numbered.select("o_orderkey", (F.col("nth") - 1).cast("bigint").alias("idx"))
