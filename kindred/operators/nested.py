"""JSON key paths, weekly plans, cell grids and grading maps."""

from __future__ import annotations

import math
from json import loads as json_loads

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.text import GRADING_DEFAULTS
from kindred.session import cut_lineage


def paths_of(text: str | None) -> set[str]:
    """The path of every key in one JSON document; none where it is not valid or a key comes twice in an object."""

    def pairs(found: list[tuple]) -> dict:
        if len({k for k, _ in found}) < len(found):
            raise ValueError("a key comes twice")
        return dict(found)

    def refuse(name: str) -> None:
        raise ValueError(name)

    try:
        waiting = [("", json_loads(text, object_pairs_hook=pairs, parse_constant=refuse))] if text is not None else []
    except (ValueError, RecursionError):
        return set()
    paths = set()
    while waiting:
        prefix, value = waiting.pop()
        if isinstance(value, dict):
            for k, inner in value.items():
                path = f"{prefix}.{k}" if prefix else k
                paths.add(path)
                waiting.append((path, inner))
        elif isinstance(value, list):
            waiting += [(f"{prefix}[]", inner) for inner in value]
    return paths


def key_paths(docs: DataFrame, key: str, json: str) -> DataFrame:
    """``(key, path)`` of every key in each JSON document, ``[]`` marking list items.

    One pass over the documents, whatever their depth. Keys whose value is null count as present; a
    document that is no valid JSON has none.
    """

    @F.udf(returnType="array<string>", useArrow=True)
    def opened(text):
        return sorted(paths_of(text))

    return docs.select(key, F.explode(opened(F.col(json).cast("string"))).alias("path")).distinct()


def presence(paths: DataFrame, key: str) -> DataFrame:
    """In how many documents each path occurs."""
    return paths.select(key, "path").distinct().groupBy("path").agg(F.count("*").alias("n_docs"))


def missing_keys(docs: DataFrame, paths: DataFrame, key: str, chunk_paths: int = 1000) -> DataFrame:
    """``(key, path)`` of paths other documents have and this one lacks.

    All paths are dealt to chunks of bounded size by a hash; a document meets each chunk once, and
    its own paths of that chunk are taken off. Nothing is collected, however many paths there are.
    """
    paths = cut_lineage(paths.select(key, "path"))
    every = cut_lineage(paths.select("path").distinct())
    chunks = max(1, math.ceil(every.count() / chunk_paths))
    chunk = F.pmod(F.xxhash64("path"), F.lit(chunks)).cast("int").alias("chunk")
    whole = every.groupBy(chunk).agg(F.collect_list("path").alias("whole"))
    mine = paths.groupBy(key, chunk).agg(F.collect_set("path").alias("mine"))
    met = docs.select(key, F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")).join(whole, "chunk")
    lacking = F.array_except("whole", F.coalesce("mine", F.array().cast("array<string>")))
    return met.join(mine, [key, "chunk"], "left").select(key, F.explode(lacking).alias("path"))


def flatten_weeks(plan: Column) -> Column:
    """``map<week, map<field, text>>`` to one text, week by week."""
    return F.array_join(F.flatten(F.transform(F.map_values(plan), F.map_values)), " ")


def zip_rows(rows: DataFrame, key: str, header: Column, values: Column) -> DataFrame:
    """``(key, name, value)``: blanks dropped on both sides, the shorter side wins.

    A name that comes twice keeps its last value.
    """
    trimmed = [F.filter(c, lambda x: x.isNotNull() & (x != "")) for c in (header, values)]
    sides = rows.select(key, trimmed[0].alias("h"), trimmed[1].alias("v"))
    n = F.least(F.size("h"), F.size("v"))
    cells = sides.select(
        key, F.posexplode(F.arrays_zip(F.slice("h", 1, n).alias("h"), F.slice("v", 1, n).alias("v")))
    )
    return cells.groupBy(key, F.col("col.h").alias("name")).agg(F.max_by("col.v", "pos").alias("value"))


def nonblank_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells with text, trimmed, numbered from 1 within ``by`` (a row of a sheet)."""
    kept = cells.withColumn("value", F.trim("value")).where(F.col("value") != "")
    return kept.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("col")))


def row_values(cells: DataFrame, by: list[str]) -> DataFrame:
    """The non-blank cells of each row as one ordered list."""
    kept = nonblank_cells(cells, by)
    ordered = F.array_sort(F.collect_list(F.struct("col", "value")))
    return kept.groupBy(*by).agg(F.transform(ordered, lambda s: s["value"]).alias("cells"))


def adjacent_pairs(cells: DataFrame, file: str = "file") -> DataFrame:
    """Cells 1 and 2, 3 and 4, … of each row as ``(file, name, value)``; the last write wins."""
    numbered = nonblank_cells(cells, [file, "row"])
    pair = F.floor((F.col("nth") - 1) / 2).cast("int")
    left = (F.col("nth") % 2) == 1
    paired = numbered.groupBy(file, "row", pair.alias("pair")).agg(
        F.max(F.when(left, F.col("value"))).alias("name"),
        F.max(F.when(~left, F.col("value"))).alias("value"),
    )
    return (
        paired.where(F.col("value").isNotNull())
        .groupBy(file, "name")
        .agg(F.max_by("value", F.struct("row", "pair")).alias("value"))
    )


def grading_fill(rows: Column, defaults: dict[str, str] | None = None) -> Column:
    """Grading parts from ``array<struct<name, value>>``, defaults where none is found.

    A row counts for every part its name contains, blanks aside; the last such row wins.
    """
    defaults = GRADING_DEFAULTS if defaults is None else defaults

    def last_value(part: str) -> Column:
        hits = F.filter(
            rows, lambda r: F.contains(F.replace(r["name"], F.lit(" "), F.lit("")), F.lit(part))
        )
        return F.try_element_at(hits, F.lit(-1))["value"]

    return F.array(
        *[
            F.struct(F.lit(part).alias("part"), F.coalesce(last_value(part), F.lit(default)).alias("value"))
            for part, default in defaults.items()
        ]
    )
