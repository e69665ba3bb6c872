"""The thirteen star-schema queries, over tables derived from TPC-H ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.nested import run_sql
from ..sources.tables import STAR, register, with_derived
from . import Query

_JOINS = {
    "d": "lo_orderdate = d_datekey",
    "p": "lo_partkey = p_partkey",
    "s": "lo_suppkey = s_suppkey",
    "c": "lo_custkey = c_custkey",
}
_TABLES = {"d": "ddate", "p": "part", "s": "supplier", "c": "customer"}


def _flight(dimensions: str, where: str, measure: str, keys: str = "", order: str = "") -> str:
    tables = ", ".join(f"{{{t}}}" for t in ["lineorder", *(_TABLES[d] for d in dimensions)])
    joins = " AND ".join(_JOINS[d] for d in dimensions)
    head = f"{keys}, " if keys else ""
    tail = (f" GROUP BY {keys}" if keys else "") + (f" ORDER BY {order}" if order else "")
    return f"SELECT {head}{measure} FROM {tables} WHERE {joins} AND {where}{tail}"


_Q1 = "CAST(sum(lo_extendedprice * lo_discount) AS BIGINT) AS revenue"
_SUM = "CAST(sum(lo_revenue) AS BIGINT) AS revenue"
_PROFIT = "CAST(sum(lo_revenue - lo_supplycost) AS BIGINT) AS profit"
_YEARS = "d_year >= 1995 AND d_year <= 2000"

SQL = {
    "ssb_q1_1": _flight("d", "d_year = 1996 AND lo_discount >= 1 AND lo_discount <= 3 AND lo_quantity < 25", _Q1),
    "ssb_q1_2": _flight(
        "d", "d_yearmonthnum = 199701 AND lo_discount >= 4 AND lo_discount <= 6 AND lo_quantity >= 26 AND lo_quantity <= 35", _Q1
    ),
    "ssb_q1_3": _flight(
        "d",
        "d_weeknuminyear = 6 AND d_year = 1997 AND lo_discount >= 5 AND lo_discount <= 7 AND lo_quantity >= 26 AND lo_quantity <= 35",
        _Q1,
    ),
    "ssb_q2_1": _flight(
        "psd", "p_category = 'MFGR#12' AND s_region = 'AMERICA'", _SUM, "d_year, p_brand1", "d_year, p_brand1"
    ),
    "ssb_q2_2": _flight(
        "psd",
        "p_brand1 >= 'MFGR#2221' AND p_brand1 <= 'MFGR#2228' AND s_region = 'ASIA'",
        _SUM, "d_year, p_brand1", "d_year, p_brand1",
    ),
    "ssb_q2_3": _flight(
        "psd", "p_brand1 = 'MFGR#2239' AND s_region = 'EUROPE'", _SUM, "d_year, p_brand1", "d_year, p_brand1"
    ),
    "ssb_q3_1": _flight(
        "csd", f"c_region = 'ASIA' AND s_region = 'ASIA' AND {_YEARS}",
        _SUM, "c_nation, s_nation, d_year", "d_year ASC, revenue DESC",
    ),
    "ssb_q3_2": _flight(
        "csd", f"c_nation = 'NATION_3' AND s_nation = 'NATION_3' AND {_YEARS}",
        _SUM, "c_city, s_city, d_year", "d_year ASC, revenue DESC",
    ),
    "ssb_q3_3": _flight(
        "csd",
        "(c_city = 'NATION_3_1' OR c_city = 'NATION_3_5') AND (s_city = 'NATION_3_1' OR s_city = 'NATION_3_5') "
        f"AND {_YEARS}",
        _SUM, "c_city, s_city, d_year", "d_year ASC, revenue DESC",
    ),
    "ssb_q3_4": _flight(
        "csd",
        "(c_city = 'NATION_3_1' OR c_city = 'NATION_3_5') AND (s_city = 'NATION_3_1' OR s_city = 'NATION_3_5') "
        "AND d_yearmonth = 'Dec1997'",
        _SUM, "c_city, s_city, d_year", "d_year ASC, revenue DESC",
    ),
    "ssb_q4_1": _flight(
        "scpd", "c_region = 'AMERICA' AND s_region = 'AMERICA' AND (p_mfgr = 'MFGR#1' OR p_mfgr = 'MFGR#2')",
        _PROFIT, "d_year, c_nation", "d_year, c_nation",
    ),
    "ssb_q4_2": _flight(
        "cspd",
        "c_region = 'AMERICA' AND s_region = 'AMERICA' AND (d_year = 1997 OR d_year = 1998) "
        "AND (p_mfgr = 'MFGR#1' OR p_mfgr = 'MFGR#2')",
        _PROFIT, "d_year, s_nation, p_category", "d_year, s_nation, p_category",
    ),
    "ssb_q4_3": _flight(
        "scpd",
        "c_region = 'AMERICA' AND s_nation = 'NATION_6' AND (d_year = 1997 OR d_year = 1998) AND p_category = 'MFGR#14'",
        _PROFIT, "d_year, s_city, p_brand1", "d_year, s_city, p_brand1",
    ),
}


def _run(text: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, uses=text.format_map(STAR))
        return run_sql(spark, text.format_map(STAR))

    return query


def queries() -> dict[str, Query]:
    return {name: _run(text) for name, text in SQL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_derived(text.format_map(STAR)) for name, text in SQL.items()}
