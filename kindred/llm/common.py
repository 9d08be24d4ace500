"""Helpers that several operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.session import spread_width

# The characters that end a word in every contract of this package: space and \t \n \x0b \f \r.
WORD_GAPS = " \t\n\x0b\f\r"
WORD_GAP_CLASS = r"[\x20\x09-\x0D]+"


def fold(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo ``n``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def one_text_per_id(rows: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, the columns ``more`` and ``mark`` (a hash of the text), one row for each id and ``more``.

    Of several texts of an id the one with the smallest hash counts.
    """
    return rows.select("doc_id", *more, F.xxhash64("text").alias("mark")).groupBy("doc_id", *more).agg(F.min("mark").alias("mark"))


def texts_of(rows: DataFrame, chosen: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``more`` and ``text`` of the ``chosen`` ids, one row for each of their rows.

    ``chosen`` is a bounded table with ``doc_id``, ``mark`` and ``more``, sent to the tasks; so the result
    is bounded by it, however often an id repeats.
    """
    marked = rows.withColumn("mark", F.xxhash64("text"))
    on = ["doc_id", "mark", *[c for c in more if c in rows.columns]]
    return marked.join(F.broadcast(chosen), on).dropDuplicates(["doc_id", "mark", *more]).select("doc_id", *more, "text")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where ``body`` uses it in lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z; other characters stay as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[dict[str, list]]], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch; it yields columns of output rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in fn(batch):
                yield pa.RecordBatch.from_pydict(columns, schema=target)

    target = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of a partition sorted by ``keys``, also where a group spans batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
        labels = list(zip(*columns, strict=True))
        start = 0
        for i, label in enumerate(labels):
            if label != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, label
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], dict[str, list] | None], schema: str) -> DataFrame:
    """Apply ``fn`` to every group of ``keys``; the caller bounds the groups.

    One sort per partition and one stream of Arrow batches, so that many tiny groups cost
    no more than a few large ones.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, keys):
            columns = fn(group)
            if columns is not None:
                yield pa.RecordBatch.from_pydict(columns, schema=target)

    parts = df.repartition(spread_width(df), *keys).sortWithinPartitions(*keys)
    return parts.mapInArrow(run, schema)
