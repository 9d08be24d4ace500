"""Text, labelled cells and tables of web pages: one parse per page, in Arrow batches."""

from __future__ import annotations

from collections.abc import Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.text import classify_header, week_label
from kindred.session import spread_width

PAGE = {
    "text": "string",
    "cells": "array<struct<is_td: boolean, label: string, text: string>>",
    "rows": "array<struct<table_no: int, row_no: int, cells: array<string>>>",
}
HIDDEN = {"script", "style", "template"}


class Page(HTMLParser):
    """Visible text, cells and table rows of one page.

    A cell holds all text inside it, nested tables included; a row belongs to the nearest table
    around it. Cells and rows without an end tag end where the next one of their table begins.
    The parser decodes every named and numeric character reference.
    """

    def __init__(self, table: str, row: str, cell: Sequence[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.table, self.row, self.cell = table, row, set(cell)
        self.hidden, self.pieces, self.cells = 0, [], []
        self.tables = [{"no": -1, "rows": 0, "row": None, "open": None}]  # open ones, innermost last; first the page
        self.closed: list[tuple[int, int, list[str]]] = []
        self.n_tables = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == self.table:
            self.tables.append({"no": self.n_tables, "rows": 0, "row": None, "open": None})
            self.n_tables += 1
        elif tag == self.row:
            self._end_row()
            self.tables[-1]["row"] = []
        elif tag in self.cell:
            self._end_cell()
            cell = {"is_td": tag != "th", "nodes": []}
            self.cells.append(cell)
            self.tables[-1]["open"] = cell
            if self.tables[-1]["row"] is not None:
                self.tables[-1]["row"].append(cell)

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.cell:
            self._end_cell()
        elif tag == self.row:
            self._end_row()
        elif tag == self.table and len(self.tables) > 1:
            self._end_row()
            self.tables.pop()

    def _end_cell(self) -> None:
        self.tables[-1]["open"] = None

    def _end_row(self) -> None:
        self._end_cell()
        table = self.tables[-1]
        if table["row"] is not None:
            if table["no"] >= 0:
                self.closed.append((table["no"], table["rows"], table["row"]))
            table["rows"], table["row"] = table["rows"] + 1, None

    def handle_data(self, data: str) -> None:
        if self.hidden:
            return
        self.pieces.append(data)
        plain = data.strip()
        if plain:
            for table in self.tables:
                if table["open"] is not None:
                    table["open"]["nodes"].append(plain)

    def read(self, html: str) -> dict:
        self.feed(html)
        self.close()
        while len(self.tables) > 1:
            self._end_row()
            self.tables.pop()
        text = {id(c): "\n".join(c["nodes"]) for c in self.cells}
        return {
            "text": " ".join(" ".join(self.pieces).split()),
            "cells": [{"is_td": c["is_td"], "label": "".join(c["nodes"]), "text": text[id(c)]} for c in self.cells],
            "rows": [
                {"table_no": t, "row_no": r, "cells": [text[id(c)] for c in row]} for t, r, row in sorted(self.closed, key=lambda x: x[:2])
            ],
        }


def read_page(html: Column, table: str = "table", row: str = "tr", cell: Sequence[str] = ("td", "th"), parts: Sequence[str] = tuple(PAGE)) -> Column:
    """A page as ``struct<text, cells, rows>``, or those of its ``parts`` that are asked for; a null page has none.

    Text nodes of a cell are stripped and joined by line breaks; the page's text is squeezed.
    """

    names = list(parts)

    @F.pandas_udf(", ".join(f"{name} {PAGE[name]}" for name in names))
    def parse(series: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([Page(table, row, cell).read(h or "") for h in series], columns=names)

    return parse(html)


def visible_text(html: Column) -> Column:
    """Text outside tags, scripts, styles and comments, whitespace squeezed."""
    return read_page(html, parts=["text"])["text"]


def page_cells(html: Column) -> Column:
    """Every table cell of a page in order: ``array<struct<is_td, label, text>>``."""
    return read_page(html, parts=["cells"])["cells"]


def after_label(cells: Column, labels: Sequence[str]) -> Column:
    """Text of the ``td`` behind the first cell that contains a label, labels in order."""

    def behind(label: str) -> Column:
        hits = F.transform(cells, lambda c, i: F.when(F.contains(c["label"], F.lit(label)), i))
        behind_it = F.slice(cells, F.array_min(hits) + 2, F.size(cells))
        return F.get(F.filter(behind_it, lambda c: c["is_td"]), F.lit(0))["text"]

    return F.coalesce(*[behind(label) for label in labels], F.lit(""))


def table_rows(
    pages: DataFrame, key: str, html: str = "html",
    table: str = "table", row: str = "tr", cell: Sequence[str] = ("td", "th"),
) -> DataFrame:
    """``(key, table_no, row_no, cells)`` of every row of every table of a page."""
    rows = F.explode(read_page(F.col(html), table, row, cell, ["rows"])["rows"])
    return pages.select(key, rows.alias("r")).select(key, "r.table_no", "r.row_no", "r.cells")


def weekly_plan(rows: DataFrame, key: str) -> DataFrame:
    """``(key, week, field, value)`` from the longest table that speaks of weeks.

    Headers become canonical fields; rows without a valid week label are dropped. The rows are read once and
    meet by page once; rows without a key belong to no page.
    """
    week_word = F.exists("cells", lambda c: F.contains(c, F.lit("주차")))
    known = rows.where(F.col(key).isNotNull()).repartition(spread_width(rows), key)
    tables = known.groupBy(key, "table_no").agg(
        F.bool_or(week_word).alias("weekly"), F.count("*").alias("n_rows"),
        F.collect_list(F.struct("row_no", "cells")).alias("lines"),
    )
    chosen = tables.groupBy(key).agg(
        F.max_by("lines", F.struct("weekly", "n_rows", -F.col("table_no"))).alias("lines")
    )
    headers = F.filter("lines", lambda r: r["row_no"] == 0)
    body = chosen.withColumn("headers", F.explode(headers)).withColumn("r", F.explode("lines")).where("r.row_no > 0")
    labelled = body.select(
        key, "r.row_no", week_label(F.try_element_at("r.cells", F.lit(1))).alias("week"), "r.cells",
        F.col("headers.cells").alias("headers"),
    ).where(F.col("week").isNotNull())
    cells = labelled.select(key, "row_no", "week", "cells", F.posexplode("headers").alias("i", "header"))
    fields = cells.where("i > 0").select(
        key, "row_no", "week", "i", classify_header(F.col("header")).alias("field"),
        F.coalesce(F.get("cells", F.col("i")), F.lit("")).alias("value"),
    )
    return fields.groupBy(key, "week", "field").agg(
        F.max_by("value", F.struct("row_no", "i")).alias("value")
    )


def script_numbers(html: Column, pattern: str = r"txtPyeongga\d+\s*=\s*'(\d+)'") -> Column:
    """Integers a script assigns, in order."""
    return F.transform(F.regexp_extract_all(html, F.lit(pattern), 1), lambda x: x.try_cast("bigint"))
