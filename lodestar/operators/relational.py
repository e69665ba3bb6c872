"""Relational operators as small functions over DataFrames. Catalyst does the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dimension up to this many bytes in memory is sent to every executor. Catalyst's estimate of a scan is the size
#: of its files, which are encoded and compressed; in memory they take INFLATED times that, about.
BROADCAST_BYTES, INFLATED = 64 << 20, 4


def size_in_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's result."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its estimated size allows it; else the planner and adaptive
    execution choose a shuffled join."""
    return F.broadcast(df) if size_in_bytes(df) * INFLATED <= limit else df


def scan(df: DataFrame, where: Column | str | None = None, columns: Sequence[str] = ()) -> DataFrame:
    out = df if where is None else df.where(where)
    return out.select(*columns) if columns else out


def hash_join(fact: DataFrame, dimension: DataFrame, on: list[tuple[str, str]], how: str = "inner") -> DataFrame:
    """An equi join that builds on the dimension."""
    return fact.join(maybe_broadcast(dimension), [F.col(a) == F.col(b) for a, b in on], how)


def star_join(fact: DataFrame, dimensions: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """The fact table with each (dimension, fact key, dimension key), the most selective first by size,
    so that later probes see fewer rows."""
    for dimension, key, own in sorted(dimensions, key=lambda d: size_in_bytes(d[0])):
        fact = hash_join(fact, dimension, [(key, own)])
    return fact


def band_join(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of left whose value lies in [low, high] of right: an equi join on bins of `width`, to which
    a right row goes once for each bin that it touches, then the exact test."""
    binned = left.withColumn("_bin", F.floor(F.col(value) / width))
    spread = F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))
    ranged = right.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(spread))
    inside = (F.col(value) >= F.col(low)) & (F.col(value) <= F.col(high))
    return binned.join(ranged, "_bin").where(inside).drop("_bin")


def aggregate(df: DataFrame, keys: Sequence[str | Column], *aggregates: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


def salted_sum(df: DataFrame, keys: Sequence[str], value: str, name: str, salts: int = 32) -> DataFrame:
    """A grouped exact sum in two steps, for inputs that reach the exchange already skewed."""
    salt = (F.rand(7) * salts).cast("int").alias("_salt")
    part = df.select(*keys, value, salt).groupBy(*keys, "_salt").agg(F.sum(value).alias("_part"))
    return part.groupBy(*keys).agg(F.sum("_part").alias(name))


def order_by(df: DataFrame, *columns: tuple[str, str], limit: int | None = None) -> DataFrame:
    """Sorted by (column, "asc" or "desc"); with a limit, a top-k without a full sort."""
    out = df.orderBy(*(F.desc(c) if way == "desc" else F.asc(c) for c, way in columns))
    return out if limit is None else out.limit(limit)


def materialized(df: DataFrame, limit: int | None = None) -> list[str]:
    """Result rows in the stdout sink's form, streamed partition by partition."""
    kinds = {"int": "int", "bigint": "int", "float": "float", "double": "float", "string": "string"}
    out = []
    for i, row in enumerate(df.toLocalIterator()):
        if limit is not None and i >= limit:
            break
        cells = [f"({kinds.get(k, k)}) {v}" for v, (_, k) in zip(row, df.dtypes)]
        out.append(f"Tuple {i}: " + ", ".join(cells))
    return out
