"""Nested queries in their own form and in set-based form, and the TPC-H queries built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import nested as plans
from ..sources.tables import register, with_derived
from . import Query

_COLUMNS = "s_acctbal, s_name, n_name, p_partkey, p_brand"
_OUTER = "p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_nationkey = n_nationkey"
_MEDIUM = "p_size = 20 AND p_type LIKE 'MEDIUM%'"
_INNER = "s_suppkey = ps_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey"
_DEEP = "l_partkey = ps_partkey AND l_orderkey = o_orderkey AND l_returnflag = 'N' AND o_orderpriority <> '1-URGENT'"


def _least_cost(where: str, op: str, inner_tables: str, inner: str, more: str = "") -> str:
    """Parts and suppliers whose cost compares with the least cost of a correlated subquery."""
    return (
        f"SELECT {_COLUMNS} FROM part, partsupp, supplier, nation{more} WHERE {_OUTER} AND {where} "
        f"AND ps_supplycost {op} (SELECT min(ps_supplycost) FROM {inner_tables} WHERE {inner})"
    )


def _joined(where: str, derived: str, test: str, more: str = "") -> str:
    """The same shape with the subquery as a derived table t1."""
    return (
        f"SELECT {_COLUMNS} FROM part, partsupp, supplier, nation{more}, ({derived}) t1 "
        f"WHERE {_OUTER} AND {where} AND {test}"
    )


def _per_part(tables: str, where: str) -> str:
    return f"SELECT min(ps_supplycost) AS t1_cost, ps_partkey AS t1_partkey FROM {tables} {where} GROUP BY ps_partkey"


_REGIONS = "partsupp, supplier, nation, region"
_SAME = "ps_supplycost = t1_cost AND p_partkey = t1_partkey"
_ASIA, _NOT_ASIA = f"{_INNER} AND r_name = 'ASIA'", f"{_INNER} AND r_name <> 'ASIA'"
_WHOLE = ", region"
_REGION_JOIN = "n_regionkey = r_regionkey"
_ACCT = f"SELECT {_COLUMNS} FROM part, partsupp, supplier, nation WHERE {_OUTER} AND {_MEDIUM} AND s_acctbal = ({{}})"
_DATE = "CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INT)"
_J_OUTER = (
    "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' "
    "AND o_orderdate <= TIMESTAMP '1997-02-01 00:00:00' AND "
)
_QUANTITY = (
    "SELECT {} AS t1_quantity{} FROM lineitem, part WHERE {} AND p_partkey = l_partkey AND p_size = 20 "
    "AND p_type LIKE 'MEDIUM%'"
)
_CUSTOMERS = (
    "FROM orders, customer, nation, region{} WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey "
    "AND n_regionkey = r_regionkey AND o_totalprice > 200000 AND "
)
_SUM_Q = "CAST(sum(l_quantity) AS BIGINT)"

#: Queries that run as they are, after rewriting J scalars.
SQL = {
    "qf1": _least_cost(_MEDIUM, "=", _REGIONS, f"p_partkey = ps_partkey AND {_ASIA}"),
    "qf1_unnested": _joined(_MEDIUM, _per_part(_REGIONS, f"WHERE {_ASIA}"), _SAME),
    "qf2_selective": _least_cost(
        f"{_MEDIUM} AND p_brand LIKE '%5'", "=", _REGIONS, f"p_partkey = ps_partkey AND {_NOT_ASIA}"
    ),
    "qf2_selective_unnested": _joined(
        f"{_MEDIUM} AND p_brand LIKE '%5'", _per_part(_REGIONS, f"WHERE {_NOT_ASIA}"), _SAME
    ),
    "qf33_mem": _least_cost(
        _MEDIUM, "=", f"{_REGIONS}, lineitem, orders", f"p_partkey = ps_partkey AND {_NOT_ASIA} AND {_DEEP}"
    ),
    "qf33_mem_unnested": _joined(
        _MEDIUM, _per_part(f"{_REGIONS}, lineitem, orders", f"WHERE {_NOT_ASIA} AND {_DEEP}"), _SAME
    ),
    "qf4_idx": _least_cost("p_type LIKE 'MEDIUM%'", "=", _REGIONS, f"p_partkey = ps_partkey AND {_NOT_ASIA}"),
    "qf4_idx_unnested": _joined("p_type LIKE 'MEDIUM%'", _per_part(_REGIONS, f"WHERE {_NOT_ASIA}"), _SAME),
    "qf5_skew": _ACCT.format("SELECT min(s_acctbal) FROM supplier WHERE ps_suppkey = s_suppkey"),
    "qf5_skew_unnested": _joined(
        _MEDIUM,
        "SELECT min(s_acctbal) AS t1_acctbal, s_suppkey AS t1_suppkey FROM supplier GROUP BY s_suppkey",
        "s_acctbal = t1_acctbal AND ps_suppkey = t1_suppkey",
    ),
    "qf6_skew2": _ACCT.format(
        "SELECT min(s_acctbal) FROM supplier, nation, region WHERE ps_suppkey = s_suppkey "
        "AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'"
    ),
    "qf6_skew2_unnested": _joined(
        _MEDIUM,
        "SELECT min(s_acctbal) AS t1_acctbal, s_suppkey AS t1_suppkey FROM supplier, nation, region "
        "WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY s_suppkey",
        "s_acctbal = t1_acctbal AND ps_suppkey = t1_suppkey",
    ),
    "qf32_mem": "SELECT c_name, n_name, r_name "
    + _CUSTOMERS.format("")
    + f"10 > ({_QUANTITY.format(_SUM_Q, '', 'o_orderkey = l_orderkey')})",
    "qf32_mem_unnested": "SELECT t1_quantity, c_name, n_name, r_name "
    + _CUSTOMERS.format(
        ", (" + _QUANTITY.format(_SUM_Q, ", l_orderkey AS t1_orderkey", "1 = 1") + " GROUP BY l_orderkey) t1"
    )
    + "o_orderkey = t1_orderkey AND 10 > t1_quantity",
    # Not equivalent to their nested partners: the inequality became a join. Queries of their own. q16_unnested pairs
    # rows by inequalities alone, as its text asks, and plans as a nested loop.
    "qf3_mem_unnested": _joined(_MEDIUM, _per_part(_REGIONS, f"WHERE {_NOT_ASIA}"), _SAME),
    "q2_simple": _least_cost(
        f"{_MEDIUM} AND {_REGION_JOIN}", "=", "partsupp", "p_partkey = ps_partkey", _WHOLE
    ),
    "q2_unnested_simple": _joined(
        f"{_MEDIUM} AND {_REGION_JOIN}", _per_part("partsupp", ""), _SAME, _WHOLE
    ),
    "q2_unnested": _joined(
        f"{_MEDIUM} AND {_REGION_JOIN}", _per_part(_REGIONS, f"WHERE {_ASIA}"), _SAME, _WHOLE
    ),
    "q2_sub_simple": _least_cost(
        f"p_brand = 'Brand#5' AND {_REGION_JOIN}", "=", "partsupp", "p_partkey = ps_partkey", _WHOLE
    ),
    "type_ja": _least_cost(
        f"{_MEDIUM} AND {_REGION_JOIN} AND r_name = 'ASIA'", "=", _REGIONS, f"p_partkey = ps_partkey AND {_ASIA}", _WHOLE
    ),
    "type_ja_unnested": _joined(
        f"{_MEDIUM} AND {_REGION_JOIN} AND r_name = 'ASIA'", _per_part(_REGIONS, f"WHERE {_ASIA}"), _SAME, _WHOLE
    ),
    "type_j": _J_OUTER + "o_totalprice > (SELECT l_extendedprice FROM lineitem WHERE l_orderkey = o_orderkey)",
    "type_j_unnested": "SELECT o_orderkey FROM lineitem, orders WHERE l_orderkey = o_orderkey "
    "AND o_totalprice > l_extendedprice AND o_orderdate > TIMESTAMP '1997-01-01 00:00:00' "
    "AND o_orderdate < TIMESTAMP '1997-01-10 00:00:00' GROUP BY o_orderkey",
    "type_j2": "SELECT c_name FROM customer, nation WHERE c_nationkey = n_nationkey AND n_name = 'NATION_3' "
    "AND '1-URGENT' IN (SELECT o_orderpriority FROM orders WHERE o_custkey = c_custkey)",
    "type_j2_unnested": "SELECT c_name FROM customer, nation, orders WHERE c_nationkey = n_nationkey "
    "AND o_custkey = c_custkey AND n_name = 'NATION_3' AND o_orderpriority = '1-URGENT' GROUP BY c_name",
    "type_n_scalar": "SELECT n_name FROM nation WHERE n_regionkey = (SELECT r_regionkey FROM region WHERE r_name = 'ASIA')",
    "type_n_set": "SELECT count(*) AS n FROM orders WHERE o_orderpriority IN "
    "(SELECT o_orderpriority FROM orders WHERE o_totalprice > 400000)",
    "type_a": "SELECT s_name FROM supplier WHERE s_acctbal = (SELECT max(s_acctbal) FROM supplier)",
    "nested_twice": "SELECT c_name FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) + 4000 FROM customer "
    "WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = "
    "(SELECT r_regionkey FROM region WHERE r_name = 'EUROPE')))",
    "subquery_in_select": "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n FROM nation",
    "subquery_in_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey "
    "HAVING count(*) > (SELECT 2 * count(*) / count(DISTINCT o_custkey) FROM orders)",
    "any_all": "SELECT p_partkey FROM part WHERE p_retailprice > ALL (SELECT p_retailprice FROM part WHERE p_size = 3) "
    "OR p_size = ANY (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)",
    "q4": "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate IN "
    "(SELECT l_shipdate FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY o_orderpriority ORDER BY o_orderpriority",
    "q4_exists": "SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE EXISTS "
    "(SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate < o_orderdate) GROUP BY o_orderpriority "
    "ORDER BY o_orderpriority",
    "q16": "SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp, part "
    "WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#9' AND p_type NOT LIKE 'MED%' AND ps_suppkey NOT IN "
    "(SELECT s_suppkey FROM supplier WHERE s_name LIKE '%1%') GROUP BY p_brand, p_type, p_size "
    "ORDER BY supplier_cnt DESC, p_brand, p_type, p_size",
    "q16_unnested": "SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt "
    "FROM partsupp, part, supplier WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#9' AND p_type NOT LIKE 'MED%' "
    "AND s_name LIKE '%11' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND ps_suppkey <> s_suppkey "
    "GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size",
    "q18": f"SELECT c_name, c_custkey, o_orderkey, {_DATE} AS o_date, o_totalprice, {_SUM_Q} AS quantity "
    "FROM customer, orders, lineitem WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey "
    "HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey "
    "GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate",
}
#: The oracle's text where the dialect's own isn't standard.
STANDARD = {
    "type_j": _J_OUTER
    + "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND o_totalprice > l_extendedprice)",
}

#: Rows paired by inequalities alone, none of whose partner's columns are asked for. Not equivalent to qf7 either.
_FIRST_BRANDS = f"{_MEDIUM} AND {_REGION_JOIN} AND p_brand LIKE 'Brand#1%'"
_LEAST_IN_ASIA = _per_part(_REGIONS, f"WHERE {_ASIA}")
QF7_UNNESTED = _joined(_FIRST_BRANDS, _LEAST_IN_ASIA, "ps_supplycost > t1_cost AND p_partkey <> t1_partkey", _WHOLE)

#: Inequality correlation: nested text for the oracle, a leave-one-out plan for Spark.
LEAVE_ONE_OUT = {
    "qf3_mem": (
        "=", "<> 'ASIA'", "min",
        _least_cost("p_type LIKE 'MEDIUM%'", "=", _REGIONS, f"p_partkey <> ps_partkey AND {_NOT_ASIA}"),
    ),
    # The same over quantities, which tie, so that there are rows.
    "qf3_quantity": (
        "=", "<> 'ASIA'", "min",
        _least_cost("p_type LIKE 'MEDIUM%'", "=", _REGIONS, f"p_partkey <> ps_partkey AND {_NOT_ASIA}").replace(
            "ps_supplycost", "ps_availqty"
        ),
    ),
    "qf7": (
        ">", "= 'ASIA'", "min",
        _least_cost(
            f"{_MEDIUM} AND {_REGION_JOIN} AND p_brand LIKE 'Brand#1%'", ">", _REGIONS,
            f"p_partkey <> ps_partkey AND {_ASIA}", _WHOLE,
        ),
    ),
    "q2": (
        ">", "= 'ASIA'", "min",
        _least_cost(f"{_MEDIUM} AND {_REGION_JOIN}", ">", _REGIONS, f"p_partkey <> ps_partkey AND {_ASIA}", _WHOLE),
    ),
}
_OUTER_OF = {
    "qf3_mem": "p_type LIKE 'MEDIUM%'",
    "qf3_quantity": "p_type LIKE 'MEDIUM%'",
    "qf7": f"{_MEDIUM} AND p_brand LIKE 'Brand#1%'",
    "q2": _MEDIUM,
}


def _sql(text: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, uses=text)
        return plans.run_sql(spark, text)

    return query


def _leave_one_out(name: str) -> Query:
    op, region, kind, text = LEAVE_ONE_OUT[name]
    value = "ps_availqty" if name == "qf3_quantity" else "ps_supplycost"

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, uses=text)
        outer = spark.sql(
            f"SELECT {_COLUMNS}, {value} FROM part, partsupp, supplier, nation WHERE {_OUTER} AND {_OUTER_OF[name]}"
        )
        inner = spark.sql(f"SELECT ps_partkey AS k, {value} AS v FROM {_REGIONS} WHERE {_INNER} AND r_name {region}")
        found = plans.leave_one_out(outer, inner, "p_partkey", "k", value, op, "v", kind)
        return found.drop(value)

    return query


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, uses=QF7_UNNESTED)
    outer = spark.sql(
        f"SELECT {_COLUMNS}, ps_supplycost FROM part, partsupp, supplier, nation{_WHOLE} WHERE {_OUTER} AND {_FIRST_BRANDS}"
    )
    inner = spark.sql(_LEAST_IN_ASIA)
    return plans.counted_pairs(outer, inner, "p_partkey", "t1_partkey", "ps_supplycost", "t1_cost").drop("ps_supplycost")


# Strategies over the nation, supplier and orders tables, each with its nested form as the oracle.
def _balances(kind: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir)
        outer = spark.table("customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") * 60).alias("v"))
        if kind == "count":
            outer = outer.withColumn("v", F.pmod("c_custkey", F.lit(120)))
        inner = spark.table("supplier")
        found = plans.leave_one_out(outer, inner, "c_nationkey", "s_nationkey", "v", ">", "s_acctbal", kind)
        return found.select("c_custkey")

    return query


def _balances_sql(kind: str) -> str:
    value = "c_custkey % 120" if kind == "count" else "c_acctbal * 60"
    inner = "CAST(s_acctbal AS DECIMAL(28, 4))" if kind in ("sum", "count") else "s_acctbal"
    return (
        f"SELECT c_custkey FROM customer WHERE {value} > "
        f"(SELECT {kind}({inner}) FROM supplier WHERE c_nationkey <> s_nationkey)"
    )


def _first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    lines = spark.table("lineitem").withColumn(
        "place", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    )
    outer = spark.table("orders")
    found = plans.first_match(
        outer, lines, [("o_orderkey", "l_orderkey")], "o_totalprice", ">", "l_extendedprice", "place"
    )
    return found.select("o_orderkey")


def _unnested_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    customer, orders = spark.table("customer"), spark.table("orders")
    found = plans.unnested_count(customer, orders, [("c_custkey", "o_custkey")], F.lit(5), ">")
    return found.select("c_custkey")


_OWN: dict[str, tuple[Query, str]] = {
    **{f"leave_one_out_{k}": (_balances(k), _balances_sql(k)) for k in ("min", "max", "sum", "count")},
    "qf7_unnested": (_paired, with_derived(QF7_UNNESTED)),
    "first_match": (
        _first_match,
        "SELECT o_orderkey FROM orders, (SELECT l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey "
        "ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r FROM lineitem) AS l "
        "WHERE o_orderkey = l_orderkey AND r = 1 AND o_totalprice > l_extendedprice",
    ),
    "unnested_count": (
        _unnested_count,
        "SELECT c_custkey FROM customer WHERE 5 > (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)",
    ),
}


def queries() -> dict[str, Query]:
    out = {name: _sql(text) for name, text in SQL.items()}
    out |= {name: _leave_one_out(name) for name in LEAVE_ONE_OUT}
    return out | {name: q for name, (q, _) in _OWN.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: with_derived(STANDARD.get(name, text)) for name, text in SQL.items()}
    out |= {name: with_derived(x[3]) for name, x in LEAVE_ONE_OUT.items()}
    return out | {name: text for name, (_, text) in _OWN.items()}
