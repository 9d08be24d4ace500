"""Column expressions over ``array<double>`` vectors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once, also where a lambda uses it per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def l2_normalise(vec: Column) -> Column:
    """Unit vector; a zero vector stays zero."""

    def scale(v: Column) -> Column:
        return let(
            norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)
        )

    return let(vec, scale)


def vector_sum(vec: Column) -> Column:
    """Aggregate: element-wise sum, one buffer per group and map-side combined."""
    return vector_to_array(Summarizer.sum(array_to_vector(vec)))


def vector_mean(vec: Column) -> Column:
    """Aggregate: element-wise mean, one buffer per group and map-side combined."""
    return vector_to_array(Summarizer.mean(array_to_vector(vec)))


def parse_literal(text: Column) -> Column:
    """``"[0.1, 0.2]"`` to ``array<double>``; null when the text is no list."""
    return F.from_json(text, "array<double>")
