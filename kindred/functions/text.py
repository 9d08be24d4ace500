"""Column functions on text and identifiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about a course's subject.
EDU_STOPWORDS = [
    "강의", "수업", "평가", "과제", "출석", "시험", "퀴즈", "토론", "프로젝트", "보고서", "학습", "이해",
    "목표", "개요", "참고", "교재", "부교재", "오피스아워", "공지",
    "상대평가", "절대평가", "성적", "점수", "배점", "기준", "기타", "계", "변경될수", "있음", "안내", "실습",
    "진행", "방식", "자료", "교수", "담당", "담당교원",
]

# How often a field is repeated in the weighted text.
FIELD_WEIGHTS = {"교과목명": 3.0, "강의목표": 1.0, "강의개요": 1.0}

# Defaults of blank fields.
FIELD_DEFAULTS = {
    "강의시간표": "웹강의",
    "강좌평가방법": "상대평가",
    "수업 방법": "강의식",
    "Office Hour\n(상담시간)": "사전 예약으로 상담시간 조정",
    "e-learning\n중간고사유형": "기타",
}

# Grading parts and their defaults.
GRADING_DEFAULTS = {
    "중간고사": "0 %", "기말고사": "0 %", "출석": "0 %", "과제": "0 %", "퀴즈": "0 %", "토론": "0 %",
    "기타": "0 %", "계": "100 %",
}

# Words in a weekly-plan header and the field they mean, first match wins.
WEEK_HEADERS = [
    (("주제",), "강의주제"),
    (("방식",), "강의방식"),
    (("내용", "학습"), "강의내용"),
    (("과제", "시험", "비고"), "시험및과제"),
]


def tokens(text: Column, stopwords: Sequence[str] = EDU_STOPWORDS) -> Column:
    """Lower-case Hangul/ASCII tokens of two or more characters, stop words removed."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[가-힣a-z0-9]{2,}"), 0)
    return F.filter(words, lambda t: ~t.isin(list(stopwords))) if stopwords else words


def clean_text(text: Column, stopwords: Sequence[str] = EDU_STOPWORDS) -> Column:
    return F.array_join(tokens(text, stopwords), " ")


def weighted_text(fields: Mapping[str, Column], weights: Mapping[str, float] | None = None) -> Column:
    """Cleaned fields joined by blanks, each repeated by its rounded weight."""
    weights = FIELD_WEIGHTS if weights is None else weights
    parts = []
    for name, column in fields.items():
        cleaned = clean_text(column)
        times = int(round(weights.get(name, 1.0)))
        parts.append(F.when(cleaned != "", F.repeat(F.concat(F.lit(" "), cleaned), times)))
    return F.trim(F.concat_ws(" ", *parts))


def concat_fields(*columns: Column | str) -> Column:
    return F.concat_ws(" ", *columns)


def zfill3(whole: Column) -> Column:
    """A whole number with at least three digits; longer ones are not cut."""
    return F.when(whole.isNotNull(), F.format_string("%03d", whole))


def section_zfill(section: Column) -> Column:
    """A number or its text to at least three digits; null gives an empty text."""
    return F.coalesce(zfill3(section.try_cast("double").try_cast("bigint")), F.lit(""))


def clean_id(value: Column) -> Column:
    """Numbers lose their decimals; only texts of up to three characters are padded."""
    s = F.trim(value)
    number = s.rlike(r"^(\d+\.?\d*|\.\d+)$")
    whole = F.regexp_extract(s, r"^(\d*)", 1)
    bare = F.coalesce(F.nullif(F.regexp_replace(whole, r"^0+", ""), F.lit("")), F.lit("0"))
    padded = F.when(F.length(bare) >= 3, bare).otherwise(F.lpad(bare, 3, "0"))
    return F.when(s.isNull() | (s == ""), "").when(
        number, F.when(F.length(s) <= 3, padded).otherwise(bare)
    ).otherwise(s)


CODE_SECTION_CREDIT = r"^([A-Za-z]+\d+)-(\d+)\s*학점[:：]?([\d.]+)"


def parse_code_section_credit(text: Column) -> dict[str, Column]:
    """``BNF2201-001 학점:3.0`` to code, section and credit; otherwise the raw text is kept."""
    hit = text.rlike(CODE_SECTION_CREDIT)
    part = [F.when(hit, F.regexp_extract(text, CODE_SECTION_CREDIT, i)) for i in (1, 2, 3)]
    return {
        "code": part[0],
        "section": part[1],
        "credit": part[2].try_cast("double"),
        "raw": F.when(~hit, text),
    }


def sanitize_filename(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r'[\\/:*?"<>|]', "_"))


def sanitize_sheet_name(name: Column) -> Column:
    """Only letters, digits, blanks, ``_`` and ``-`` stay."""
    return F.trim(F.regexp_replace(name, r"[^A-Za-z0-9가-힣 _-]", ""))


def build_item_key(code: Column, section: Column, index: Column) -> Column:
    """``code-section``, the code alone, or ``course-<index>`` when there is no code."""
    c, s = F.trim(F.coalesce(code, F.lit(""))), F.trim(F.coalesce(section, F.lit("")))
    return F.when((c != "") & (s != ""), F.concat_ws("-", c, s)).when(c != "", c).otherwise(
        F.concat(F.lit("course-"), zfill3(index.cast("bigint")))
    )


def url_query_param(url: Column, *names: str, default: str = "") -> Column:
    """First non-empty of the named query parameters."""
    raw = [F.nullif(F.regexp_extract(url, rf"[?&]{n}=([^&#]+)", 1), F.lit("")) for n in names]
    return F.coalesce(*[F.coalesce(F.try_url_decode(r), r) for r in raw], F.lit(default))


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_credit(text: Column) -> Column:
    """The number the text is, else the first number in it, else 0."""
    whole = F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
    first = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+(\.\d+)?)", 1)
    return F.coalesce(whole, first.try_cast("double"), F.lit(0.0))


# A number, alone or as a week; with the long ending the whole is shorter than a date.
WEEK_LABEL = r"^(?=\d+주?$|.{1,9}$)(\d+)\s*(?:주차?)?$"


def week_label(text: Column) -> Column:
    """``3``, ``3주`` and ``3주차`` to ``3주차``; dates and other labels to null."""
    return F.concat(F.nullif(F.regexp_extract(F.trim(text), WEEK_LABEL, 1), F.lit("")), F.lit("주차"))


def classify_header(header: Column, rules: Sequence[tuple[Sequence[str], str]] = WEEK_HEADERS) -> Column:
    """Canonical field of a header by the words it contains; unknown headers stay."""
    out = None
    for words, field in rules:
        test = F.lit(False)
        for word in words:
            test = test | F.contains(header, F.lit(word))
        out = F.when(test, field) if out is None else out.when(test, field)
    return out.otherwise(header)


def default_if_blank(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def named_number(text: Column, name: str) -> Column:
    """The first integer after a name, e.g. ``중간 … 30``."""
    return F.regexp_extract(text, rf"{name}[^0-9]*([0-9]+)", 1).try_cast("int")


def label_preview(text: Column, words: int = 2) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda t: t != ""), 1, words), " ")


def blank_tokens(text: Column) -> Column:
    """Default tokenizer of the budget audit: pieces between whitespace."""
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def trim_cast_key(value: Column) -> Column:
    return F.trim(value.cast("string"))
