"""Views over the Parquet tables, and the tables that are derived from them."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .schema import write_bucketed

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

#: Derived tables, in SQL that both Spark and a reference database read the same way.
DERIVED = {
    "partsupp": """
        SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey,
               CAST(sum(l_quantity) AS INT) AS ps_availqty, min(l_extendedprice) AS ps_supplycost
        FROM lineitem GROUP BY l_partkey, l_suppkey""",
    "ssb_part": """
        SELECT p_partkey, p_name, p_type, p_size,
               concat('MFGR#', m) AS p_mfgr, concat('MFGR#', m, c) AS p_category,
               concat('MFGR#', m, c, 1 + p_partkey % 40) AS p_brand1
        FROM (SELECT part.*, CAST(1 + floor((CAST(substring(p_brand, 7) AS INT) - 1) / 5.0) AS INT) AS m,
                     1 + (CAST(substring(p_brand, 7) AS INT) - 1) % 5 AS c FROM part) AS b""",
    "ssb_supplier": """
        SELECT s_suppkey, s_name, concat(n_name, '_', s_suppkey % 10) AS s_city, n_name AS s_nation, r_name AS s_region
        FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey""",
    "ssb_customer": """
        SELECT c_custkey, c_name, concat(n_name, '_', c_custkey % 10) AS c_city, n_name AS c_nation,
               r_name AS c_region, c_mktsegment
        FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey""",
    "ssb_lineorder": """
        SELECT l_orderkey AS lo_orderkey, l_linenumber AS lo_linenumber, o_custkey AS lo_custkey,
               l_partkey AS lo_partkey, l_suppkey AS lo_suppkey,
               CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INT) AS lo_orderdate,
               o_orderpriority AS lo_orderpriority, CAST(l_quantity AS INT) AS lo_quantity,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS lo_extendedprice,
               CAST(round(l_discount * 100) AS INT) AS lo_discount,
               CAST(round(l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l_discount * 100) AS INT)) AS lo_revenue,
               CAST(round(l_extendedprice * 60) AS BIGINT) AS lo_supplycost
        FROM lineitem, orders WHERE l_orderkey = o_orderkey""",
    "ssb_ddate": """
        SELECT CAST(year(d) * 10000 + month(d) * 100 + day(d) AS INT) AS d_datekey, CAST(year(d) AS INT) AS d_year,
               CAST(year(d) * 100 + month(d) AS INT) AS d_yearmonthnum,
               concat(substring('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month(d) * 3 - 2 AS INT), 3), year(d))
                   AS d_yearmonth,
               CAST(1 + floor((dayofyear(d) - 1) / 7.0) AS INT) AS d_weeknuminyear
        FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) AS x""",
}
#: Names of the star schema's tables in its own queries.
STAR = {"part": "ssb_part", "supplier": "ssb_supplier", "customer": "ssb_customer", "lineorder": "ssb_lineorder",
        "ddate": "ssb_ddate"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Derived tables that are stored once, as loading does, with the key that their rows are bucketed by.
LOADED = {"partsupp": "ps_partkey", "ssb_lineorder": None, "ssb_ddate": None}
BUCKETS = 8

#: Tables of a session by path and state of their files: reading a footer again takes a job.
_known: dict[tuple, DataFrame] = {}


def _state(spark: SparkSession, path: str) -> tuple[int, int]:
    """Time and bytes of a table's files, which tell whether it was written anew."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(p).getModificationTime(), fs.getContentSummary(p).getLength()


def _remembered(key: tuple, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a key, whose last part is a state; a table in another state is forgotten."""
    if key not in _known:
        for old in [k for k in _known if k[:-1] == key[:-1]]:
            del _known[old]
        _known[key] = make()
    return _known[key]


def shared_folder(spark: SparkSession) -> str | None:
    """Where driver and executors can both write: what spark.checkpoint.dir names. Only sessions in local mode
    without the setting get a temporary folder; others without it have none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        return None
    if not _temporary:
        _temporary.append(tempfile.mkdtemp(prefix="lodestar-"))
        atexit.register(shutil.rmtree, _temporary[0], ignore_errors=True)
    return f"file://{_temporary[0]}"


_temporary: list[str] = []


def _stored(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """A derived table, written to the folder and read again; bucketed by its key, if it has one."""
    label = f"lodestar_{name}_{uuid.uuid4().hex}"
    path, own, key = f"{folder}/{label}", spark.sql(DERIVED[name]), LOADED[name]
    if key is None:
        own.write.parquet(path)
        return spark.read.schema(own.schema).parquet(path)
    write_bucketed(own, label, key, BUCKETS, path)
    return spark.table(label)


def register(spark: SparkSession, sf_dir: str, star: bool = False, uses: str = "") -> None:
    """Temporary views of all tables; with star, the star schema's names hide the others. Of LOADED, those that
    `uses` names are read as stored, the others are computed where they are read."""
    here = spark.sparkContext.applicationId, spark._jsparkSession.hashCode(), sf_dir  # views belong to a session
    states = {name: _state(spark, f"{sf_dir}/{name}.parquet") for name in BASE}
    for name, state in states.items():
        base = _remembered((*here, name, "", state), lambda: table(spark, sf_dir, name))
        base.createOrReplaceTempView(name)
    folder = shared_folder(spark)
    derived = {}
    for name, text in DERIVED.items():
        state = tuple(s for x, s in states.items() if re.search(rf"\b{x}\b", text))
        stored = folder if name in LOADED and re.search(rf"\b{name}\b", uses) else None
        make = (lambda: _stored(spark, name, stored)) if stored else (lambda: spark.sql(text))
        derived[name] = _remembered((*here, name, stored or "", state), make)
    for name, df in derived.items():
        df.createOrReplaceTempView(name)
    if star:
        for name, own in STAR.items():
            derived[own].createOrReplaceTempView(name)


def preload(spark: SparkSession, names: list[str], budget: int) -> list[str]:
    """Caches views that a query reads more than once, the smallest first by Catalyst's estimate, as long
    as they fit the budget in bytes together. Gives the names of those that do."""
    sizes = {n: int(str(spark.table(n)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for n in names}
    kept: list[str] = []
    for name in sorted(sizes, key=sizes.__getitem__):
        budget -= sizes[name]
        if budget < 0:
            break
        spark.catalog.cacheTable(name)
        kept.append(name)
    return kept


def with_derived(sql: str) -> str:
    """sql after WITH clauses for those derived tables that it names."""
    used = [n for n in DERIVED if n in sql]
    if not used:
        return sql
    return "WITH " + ", ".join(f"{n} AS ({DERIVED[n].strip()})" for n in used) + " " + sql.strip()
