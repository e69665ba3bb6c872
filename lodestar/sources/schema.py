"""The declared-schema format and the files it describes.

One table per line: ``TABLE|COLUMN:TYPE[:WIDTH]|...`` with the types INTEGER, DECIMAL, DATE (a yyyymmdd
integer) and TEXT:WIDTH. Names are upper-cased, fields without a colon are skipped.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from math import ceil
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "INTEGER": T.IntegerType(),
    "DECIMAL": T.DecimalType(15, 2),
    "DATE": T.IntegerType(),
    "TEXT": T.StringType(),
}
#: Rows that one task may sort; what a quantile may be wrong by is a share of 1 / ACCURACY of the rows.
FEW, ACCURACY = 100_000, 10_000


def parse_schema(text: str) -> dict[str, T.StructType]:
    """The tables of a schema text, by upper-case name."""
    out: dict[str, T.StructType] = {}
    for line in text.splitlines():
        name, *columns = line.strip().split("|")
        if not name:
            continue
        fields = []
        for column in columns:
            if ":" not in column:
                continue
            label, kind, *width = (x.strip() for x in column.split(":"))
            if kind.upper() not in _TYPES:
                raise ValueError(f"unknown type {kind!r} of column {label!r} in table {name!r}")
            metadata = {"declared": kind.upper()} | ({"width": int(width[0])} if width else {})
            fields.append(T.StructField(label.upper(), _TYPES[kind.upper()], True, metadata))
        out[name.strip().upper()] = T.StructType(fields)
    return out


def format_schema(tables: dict[str, T.StructType]) -> str:
    """The schema text of tables, as parse_schema reads it."""
    names = {T.IntegerType: "INTEGER", T.LongType: "INTEGER", T.DecimalType: "DECIMAL", T.DoubleType: "DECIMAL"}
    lines = []
    for table, schema in tables.items():
        parts = [table.upper()]
        for f in schema:
            kind = f.metadata.get("declared") or names.get(type(f.dataType), "TEXT")
            width = f":{f.metadata.get('width', 255)}" if kind == "TEXT" else ""
            parts.append(f"{f.name.upper()}:{kind}{width}")
        lines.append("|".join(parts))
    return "\n".join(lines)


def read_tbl(spark: SparkSession, path: str, schema: T.StructType, delimiter: str = "|") -> DataFrame:
    """A delimited text file; texts longer than their declared width are cut to it."""
    raw = spark.read.schema(schema).option("sep", delimiter).csv(path)
    cut = [
        F.substring(f.name, 1, f.metadata["width"]).alias(f.name) if "width" in f.metadata else F.col(f.name)
        for f in schema
    ]
    return raw.select(*cut)


def write_columns(
    df: DataFrame, path: str, sort_by: Sequence[str] = (), partition_by: Sequence[str] = ()
) -> None:
    """Parquet, encoded by column; sorted files have narrow row-group statistics on sort_by, which take
    the place of a sorted index (range filters skip row groups) and make runs for RLE."""
    out = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by) if sort_by else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> None:
    """A table whose joins on key need no shuffle, one file for each bucket; at path, or in the warehouse."""
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_columns(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def kth_smallest(df: DataFrame, column: str, k: int) -> Any:
    """The k-th smallest value of a column, or its largest, if it has fewer; nulls don't count, and without values
    there is None.

    Approximate quantiles on both sides of the k-th row bound a range, whose ends are ranked exactly. The range
    shrinks until FEW rows are left: no task sorts all rows.
    """
    value = F.col(column)
    rows = df.select(column).where(value.isNotNull())
    n = rows.count()
    k = min(k, n)
    if k < 1:
        return None
    while n > FEW:
        ends = [max(0.0, (k - 1) / n - 2 / ACCURACY), min(1.0, k / n + 2 / ACCURACY)]
        low, high = rows.agg(F.percentile_approx(column, ends, ACCURACY)).first()[0]
        ranks = (F.count_if(test) for test in (value < low, value <= low, value < high, value <= high))
        below_low, to_low, below_high, to_high = rows.agg(*ranks).first()
        if below_low < k <= to_low:
            return low
        if below_high < k <= to_high:
            return high
        if k <= below_low:
            rows, n = rows.where(value < low), below_low
        elif k <= below_high:
            rows, n, k = rows.where((value > low) & (value < high)), below_high - to_low, k - to_low
        else:
            rows, n, k = rows.where(value > high), n - to_high, k - to_high
    return rows.orderBy(column).limit(k).agg(F.max(column)).first()[0]


def skewed(df: DataFrame, column: str, share: float, order: Sequence[str]) -> DataFrame:
    """df with the value of `column` in the first row by `order` put into the first `share` of rows, rounded up.
    Nulls come last.

    Which rows come first is decided by an exact quantile of the first order column, not by numbering all rows
    in one task; ties at the quantile are all taken.
    """
    if not 0 <= share <= 1:
        raise ValueError("share must lie between 0 and 1")
    places = [x for c in order for x in (F.col(c).isNull(), F.col(c))]
    first = df.agg(F.min_by(column, F.struct(*places))).scalar()
    bound = kth_smallest(df, order[0], ceil(Decimal(str(share)) * df.count())) if share else None
    hit: Column = F.lit(False) if bound is None else F.col(order[0]) <= F.lit(bound)
    return df.withColumn(column, F.when(hit, first).otherwise(F.col(column)))
