"""Predicates that the dialect names differently from Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def like_segments(column: Column, pattern: str) -> Column:
    """LIKE in which only % is a wildcard: an underscore or backslash stands for itself."""
    escaped = pattern.replace("\\", "\\\\").replace("_", "\\_")
    return column.like(escaped)


def all_equal(columns: Sequence[Column], values: Sequence[object]) -> Column:
    """Row-value equality."""
    out = F.lit(True)
    for c, v in zip(columns, values, strict=True):
        out = out & (c == v)
    return out


def rows_in(columns: Sequence[Column], rows: Sequence[Sequence[object]]) -> Column:
    """Row-value IN over a literal list."""
    out = F.lit(False)
    for row in rows:
        out = out | all_equal(columns, row)
    return out


def date_key(column: Column) -> Column:
    """A date as a yyyymmdd integer."""
    return (F.year(column) * 10000 + F.month(column) * 100 + F.day(column)).cast("int")
