"""Synthetic star-schema tables of any scale, made by Spark itself: every cell is a hash of its row number,
so that tables are the same on each run, and no row depends on another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows at scale factor 1 (fixed values).
ROWS = {"region": 5, "nation": 25, "customer": 150_000, "supplier": 10_000, "part": 200_000, "orders": 1_500_000,
        "lineitem": 6_000_000}
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
TYPES = ("STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _below(n: int, salt: int) -> Column:
    """A number in 0..n-1 by row and column."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(n))


def _pick(values: tuple[str, ...], salt: int) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (_below(len(values), salt) + 1).cast("int"))


def _money(most: int, salt: int) -> Column:
    return _below(most * 100, salt) / 100.0


def _day(salt: int) -> Column:
    return F.date_add(F.lit("1995-01-01").cast("date"), _below(2500, salt).cast("int")).cast("timestamp_ntz")


def rows_of(table: str, scale: float) -> int:
    n = ROWS[table]
    return n if table in ("region", "nation") else max(1, round(n * scale))


def generated(spark: SparkSession, table: str, scale: float = 1.0) -> DataFrame:
    """One of the tables named in ROWS."""
    n = {t: rows_of(t, scale) for t in ROWS}
    name = lambda label: F.concat(F.lit(f"{label}#"), F.lpad(F.col("id").cast("string"), 9, "0"))
    key = F.col("id")
    columns = {
        "region": [key.cast("int").alias("r_regionkey"), F.element_at(F.array(*map(F.lit, REGIONS)), (key + 1).cast("int")).alias("r_name")],
        "nation": [key.cast("int").alias("n_nationkey"), F.concat(F.lit("NATION_"), key.cast("string")).alias("n_name"), (key % 5).cast("int").alias("n_regionkey")],
        "customer": [key.alias("c_custkey"), name("Customer").alias("c_name"), _below(25, 1).cast("int").alias("c_nationkey"), (_money(11_000, 2) - 1000).alias("c_acctbal"), _pick(SEGMENTS, 3).alias("c_mktsegment")],
        "supplier": [key.alias("s_suppkey"), name("Supplier").alias("s_name"), _below(25, 4).cast("int").alias("s_nationkey"), (_money(11_000, 5) - 1000).alias("s_acctbal")],
        "part": [key.alias("p_partkey"), name("Part").alias("p_name"), F.concat(F.lit("Brand#"), (_below(25, 6) + 1).cast("string")).alias("p_brand"), _pick(TYPES, 7).alias("p_type"), (_below(50, 8) + 1).cast("int").alias("p_size"), (900 + key % 200_001 / 10.0).alias("p_retailprice")],
        "orders": [key.alias("o_orderkey"), _below(n["customer"], 9).alias("o_custkey"), _pick(("F", "O", "P"), 10).alias("o_orderstatus"), _money(500_000, 11).alias("o_totalprice"), _day(12).alias("o_orderdate"), _pick(PRIORITIES, 13).alias("o_orderpriority")],
        "lineitem": [_below(n["orders"], 14).alias("l_orderkey"), _below(n["part"], 15).alias("l_partkey"), _below(n["supplier"], 16).alias("l_suppkey"), (_below(7, 17) + 1).cast("int").alias("l_linenumber"), (_below(50, 18) + 1).cast("double").alias("l_quantity"), _money(100_000, 19).alias("l_extendedprice"), (_below(11, 20) / 100.0).alias("l_discount"), (_below(9, 21) / 100.0).alias("l_tax"), _pick(("A", "N", "R"), 22).alias("l_returnflag"), _pick(("F", "O"), 23).alias("l_linestatus"), _day(24).alias("l_shipdate")],
    }
    return spark.range(n[table]).select(*columns[table])


def write_tables(spark: SparkSession, folder: str, scale: float) -> None:
    """All tables as Parquet under folder."""
    for table in ROWS:
        generated(spark, table, scale).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
