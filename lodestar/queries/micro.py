"""One query per operator, predicate, aggregate and function."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import date_key, like_segments, rows_in
from ..operators import relational as R
from ..plans.costmodel import PLANS, CostModel, Step
from ..plans.nested import in_set, run_sql
from ..sources.generate import generated
from ..sources.schema import (
    format_schema, parse_schema, read_columns, read_tbl, skewed, write_bucketed, write_columns,
)
from ..sources.tables import preload, register, shared_folder, with_derived
from . import Query

_S = "CAST(sum(CAST({} AS DECIMAL(18, 4))) AS DOUBLE)"
_PRICE = _S.format("l_extendedprice")

#: Parts with a value that is null, not a number, infinite or none of these.
_ODD = (
    "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN CAST('Infinity' AS DOUBLE) "
    "WHEN 2 THEN -CAST('Infinity' AS DOUBLE) WHEN 3 THEN p_retailprice END AS v FROM part"
)

#: Queries that Spark and the oracle read alike.
SQL = {
    # scans and projections
    "scan": "SELECT p_partkey, p_brand FROM part",
    "scan_point": "SELECT p_partkey, p_brand FROM part WHERE p_partkey = 20",
    "scan_range": "SELECT o_orderkey FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900",
    "scan_like_brand": "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#2%'",
    "scan_like_type": "SELECT p_partkey, p_brand FROM part WHERE p_type LIKE 'MEDIUM%'",
    "scan_partsupp": "SELECT ps_partkey, ps_suppkey, ps_availqty, ps_supplycost FROM partsupp",
    "project_star": "SELECT * FROM region",
    "project_table_star": "SELECT n.*, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey",
    "project_alias": "SELECT s.s_suppkey AS id, s.s_name AS label FROM supplier s",
    "project_arithmetic": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, "
    "l_quantity + 1 AS more, l_quantity / 2 AS half FROM lineitem",
    "project_over_aggregates": "SELECT l_returnflag, sum(l_quantity) / count(*) AS each_one FROM lineitem GROUP BY l_returnflag",
    "project_constant": "SELECT 7 AS seven, p_brand, count(*) AS n FROM part GROUP BY p_brand",
    "project_derived": "SELECT t.k, t.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE t.n > 15",
    "distinct": "SELECT DISTINCT p_type, p_size FROM part",
    # predicates
    "filter_eq": "SELECT count(*) AS a FROM part WHERE p_size = 20",
    "filter_eq_text": "SELECT count(*) AS a FROM part WHERE p_brand = 'Brand#3'",
    "filter_ne": "SELECT count(*) AS a FROM part WHERE p_size <> 20",
    "filter_ne_caret": "SELECT count(*) AS a FROM part WHERE p_brand ^= 'Brand#3'",
    "filter_gt": "SELECT count(*) AS a FROM lineitem WHERE l_discount > 0.05",
    "filter_lt": "SELECT count(*) AS a FROM lineitem WHERE l_quantity < 10",
    "filter_ge": "SELECT count(*) AS a FROM part WHERE p_brand >= 'Brand#2'",
    "filter_le": "SELECT count(*) AS a FROM part WHERE p_brand <= 'Brand#2'",
    "filter_in": "SELECT p_partkey FROM part WHERE p_type IN ('MEDIUM', 'PROMO')",
    "filter_in_int": "SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)",
    "filter_not_in": "SELECT p_partkey FROM part WHERE p_type NOT IN ('MEDIUM', 'PROMO')",
    "filter_like_middle": "SELECT p_partkey FROM part WHERE p_type LIKE '%DI%'",
    "filter_like_end": "SELECT p_partkey FROM part WHERE p_type LIKE '%O'",
    "filter_like_parts": "SELECT p_partkey FROM part WHERE p_type LIKE 'M%I%M'",
    "filter_like_one": "SELECT p_partkey FROM part WHERE p_brand LIKE 'Brand#_'",
    "filter_not_like": "SELECT p_partkey FROM part WHERE p_type NOT LIKE '%DI%'",
    "filter_columns": "SELECT count(*) AS a FROM lineitem WHERE l_discount > l_tax",
    "filter_and_or": "SELECT count(*) AS a FROM part WHERE (p_size = 1 OR p_size = 2 OR p_brand = 'Brand#7') "
    "AND (p_type = 'PROMO' OR p_retailprice > 1000)",
    "filter_or_across": "SELECT count(*) AS a FROM part, partsupp WHERE p_partkey = ps_partkey "
    "AND ((p_size = 1 AND ps_availqty > 10) OR (p_size = 2 AND ps_availqty > 20))",
    "filter_not": "SELECT count(*) AS a FROM part WHERE NOT (p_size > 10 AND p_type = 'PROMO')",
    "filter_null": "SELECT count(*) AS a FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL",
    "filter_not_null": "SELECT count(*) AS a FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NOT NULL",
    "filter_between": "SELECT count(*) AS a FROM lineitem WHERE l_quantity BETWEEN 5 AND 9",
    "filter_date": "SELECT count(*) AS a FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01 00:00:00'",
    "filter_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "filter_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey)",
    "filter_row_in": "SELECT p_partkey FROM part WHERE (p_size, p_type) IN ((1, 'PROMO'), (2, 'SMALL'))",
    "filter_row_in_query": "SELECT count(*) AS a FROM lineitem WHERE (l_partkey, l_suppkey) IN "
    "(SELECT ps_partkey, ps_suppkey FROM partsupp WHERE ps_availqty > 60)",
    "filter_not_exists_some": "SELECT c_custkey FROM customer WHERE NOT EXISTS "
    "(SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "filter_regexp": "SELECT p_partkey FROM part WHERE REGEXP_LIKE(p_brand, '^Brand#(1[0-9]|[2-4])$')",
    "filter_regexp_flags": "SELECT p_partkey FROM part WHERE REGEXP_LIKE(p_type, '^med|MO$', 'i')",
    "filter_like_escape": "SELECT n_name FROM nation WHERE n_name LIKE 'NATION/_1%' ESCAPE '/'",
    "filter_not_like_escape": "SELECT n_name FROM nation WHERE n_name NOT LIKE '%!_1_' ESCAPE '!'",
    "filter_nan": f"SELECT p_partkey FROM ({_ODD}) AS t WHERE v IS NAN",
    "filter_not_nan": f"SELECT p_partkey FROM ({_ODD}) AS t WHERE v IS NOT NAN",
    "filter_infinite": f"SELECT p_partkey FROM ({_ODD}) AS t WHERE v IS INFINITE",
    "filter_not_infinite": f"SELECT p_partkey FROM ({_ODD}) AS t WHERE v IS NOT INFINITE",
    "filter_case": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS c FROM part",
    "filter_case_simple": "SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 1 ELSE 0 END AS c FROM part",
    # joins
    "join_inner": "SELECT p_brand, ps_suppkey FROM part, partsupp WHERE p_partkey = ps_partkey AND p_size = 7",
    "join_on": "SELECT n_name, r_name FROM nation INNER JOIN region ON n_regionkey = r_regionkey",
    "join_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT OUTER JOIN customer ON c_custkey = o_custkey AND o_totalprice > 300000",
    "join_full": "SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey AND c_acctbal > 0",
    "join_cross": "SELECT r_name, s_suppkey FROM region CROSS JOIN supplier",
    "join_natural": "SELECT * FROM (SELECT n_nationkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT s_nationkey AS k, s_name FROM supplier) b",
    "join_using": "SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) a JOIN (SELECT s_nationkey AS k, s_name FROM supplier) b USING (k)",
    "join_self": "SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_two_keys": "SELECT count(*) AS a FROM lineitem, partsupp WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_extendedprice > ps_supplycost",
    "join_many_to_many": "SELECT count(*) AS a FROM orders, customer, supplier WHERE o_custkey = c_custkey AND c_nationkey = s_nationkey AND o_totalprice > 300000",
    "join_chain": f"SELECT n_name, {_PRICE} AS revenue FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey "
    "AND l_orderkey = o_orderkey AND c_nationkey = n_nationkey GROUP BY n_name",
    "join_without_key": "SELECT count(*) AS a FROM region, supplier WHERE r_regionkey < s_nationkey",
    # aggregates
    "agg_min": "SELECT min(ps_supplycost) AS a FROM partsupp",
    "agg_scalar": f"SELECT {_PRICE} AS s, min(l_tax) AS lo, max(l_tax) AS hi, avg(l_quantity) AS m, count(*) AS n, count(l_tax) AS c FROM lineitem",
    "agg_group": "SELECT min(ps_supplycost) AS a, ps_partkey FROM partsupp GROUP BY ps_partkey",
    "agg_group_text": f"SELECT l_returnflag, l_linestatus, {_PRICE} AS s, avg(l_quantity) AS m, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_group_decimal": "SELECT l_discount, l_tax, count(*) AS n FROM lineitem GROUP BY l_discount, l_tax",
    "agg_expression": f"SELECT {_S.format('l_extendedprice * l_discount')} AS s FROM lineitem WHERE l_quantity < 24",
    "agg_count_distinct": "SELECT p_brand, count(DISTINCT p_size) AS n FROM part GROUP BY p_brand",
    "agg_constant_key": "SELECT 1 AS one, count(*) AS n FROM part GROUP BY 1",
    "agg_key_expression": "SELECT p_size % 5 AS k, count(*) AS n FROM part GROUP BY p_size % 5",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15",
    "agg_having_sum": "SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200",
    "agg_empty": "SELECT min(p_size) AS lo, CAST(sum(p_size) AS BIGINT) AS s, count(*) AS n FROM part WHERE p_size > 1000",
    "agg_rollup": "SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ROLLUP (p_type, p_brand)",
    "agg_cube": "SELECT p_type, p_size, count(*) AS n FROM part GROUP BY CUBE (p_type, p_size)",
    "agg_grouping_sets": "SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_type), (p_brand), ())",
    "agg_statistics": "SELECT round(stddev_samp(p_size), 6) AS sd, round(var_pop(p_size), 6) AS v, "
    "round(corr(p_size, p_retailprice), 6) AS c, round(covar_pop(p_size, p_size), 6) AS cv FROM part",
    "agg_regression": "SELECT round(regr_slope(p_retailprice, p_size), 6) AS slope, CAST(regr_count(p_retailprice, p_size) AS BIGINT) AS n FROM part",
    "agg_median": "SELECT l_returnflag, median(l_quantity) AS m FROM lineitem GROUP BY l_returnflag",
    # order and limit
    "order_one": "SELECT p_partkey FROM part ORDER BY p_partkey",
    "order_mixed": "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey ASC, n_name DESC",
    "order_three": "SELECT p_type, p_size, p_partkey FROM part ORDER BY p_type, p_size DESC, p_partkey",
    "order_aggregate": "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand",
    "order_nulls": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey ORDER BY o_orderkey DESC NULLS LAST, c_custkey",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    # scalar functions
    "fn_unary": "SELECT p_partkey, -p_size AS a, +p_size AS b FROM part",
    "fn_concat": "SELECT p_partkey, p_brand || '/' || p_type AS a FROM part",
    "fn_power": "SELECT p_partkey, power(p_size, 2) AS a FROM part",
    "fn_cast": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS a, CAST(l_orderkey AS VARCHAR(20)) AS b FROM lineitem",
    "fn_date_parts": "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m FROM orders",
    "fn_time_zone": "SELECT o_orderkey, o_orderdate AT TIME ZONE 'America/New_York' AS t FROM orders",
    "fn_interval": "SELECT count(*) AS a FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01 00:00:00' + INTERVAL '3' MONTH",
}
#: The oracle's text where its syntax differs.
STANDARD = {
    "filter_ne_caret": "SELECT count(*) AS a FROM part WHERE p_brand <> 'Brand#3'",
    "filter_regexp": "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#(1[0-9]|[2-4])$')",
    "filter_regexp_flags": "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '^med|MO$', 'i')",
    "filter_nan": f"SELECT p_partkey FROM ({_ODD}) AS t WHERE isnan(v)",
    "filter_not_nan": f"SELECT p_partkey FROM ({_ODD}) AS t WHERE NOT isnan(v)",
    "filter_infinite": f"SELECT p_partkey FROM ({_ODD}) AS t WHERE isinf(v)",
    "filter_not_infinite": f"SELECT p_partkey FROM ({_ODD}) AS t WHERE NOT isinf(v)",
    "fn_time_zone": "SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS t FROM orders",
}


def _star(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, uses="ssb_lineorder ssb_ddate")
    t = spark.table
    fact = R.star_join(
        t("ssb_lineorder"),
        [
            (t("ssb_ddate").where("d_year = 1997"), "lo_orderdate", "d_datekey"),
            (t("ssb_supplier").where("s_region = 'ASIA'"), "lo_suppkey", "s_suppkey"),
            (t("ssb_part").where("p_mfgr = 'MFGR#3'"), "lo_partkey", "p_partkey"),
        ],
    )
    out = R.aggregate(fact, ["s_nation", "p_category"], F.sum("lo_revenue").alias("revenue"))
    return R.order_by(out, ("s_nation", "asc"), ("revenue", "desc"))


def _semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return in_set(spark.table("customer"), spark.table("orders"), [("c_custkey", "o_custkey")]).select("c_custkey")


def _anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    customer, orders = spark.table("customer"), spark.table("orders")
    dear = orders.where("o_totalprice > 300000")
    return R.hash_join(customer, dear, [("c_custkey", "o_custkey")], "left_anti").select("c_custkey")


def _band(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    bands = spark.table("supplier").select("s_suppkey", F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 100).alias("hi"))
    customers = spark.table("customer").select("c_custkey", "c_acctbal")
    return R.band_join(customers, bands, "c_acctbal", "lo", "hi", 100.0).select("c_custkey", "s_suppkey")


def _salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    lines = spark.table("lineitem").withColumn("q", F.col("l_quantity").cast("bigint"))
    return R.salted_sum(lines, ["l_returnflag"], "q", "q")


def _skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, uses="partsupp")
    out = skewed(spark.table("partsupp"), "ps_suppkey", 0.3, ["ps_partkey", "ps_suppkey"])
    return out.groupBy("ps_suppkey").agg(F.count("*").alias("n"))


def _loaded_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as delimited text and read back by its declared schema."""
    register(spark, sf_dir)
    text = "PART|P_PARTKEY:INTEGER|P_BRAND:TEXT:7|P_SIZE:INTEGER|P_RETAILPRICE:DECIMAL"
    path = _new_path(spark)
    columns = [c.lower() for c in parse_schema(text)["PART"].names]
    spark.table("part").select(*columns).write.option("sep", "|").csv(path)
    part = read_tbl(spark, path, parse_schema(format_schema(parse_schema(text)))["PART"])
    price = F.col("P_RETAILPRICE").cast("double").alias("p_retailprice")
    return part.select(F.col("P_PARTKEY").alias("p_partkey"), F.col("P_BRAND").alias("p_brand"), F.col("P_SIZE").alias("p_size"), price)


def _loaded_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file sorted by a column, whose statistics serve as its index, read by a range of it."""
    register(spark, sf_dir)
    path = _new_path(spark)
    write_columns(spark.table("orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, sort_by=["o_totalprice"])
    return read_columns(spark, path, ["o_orderkey", "o_totalprice"]).where("o_totalprice BETWEEN 250000 AND 300000")


def _loaded_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by the values of a column, of which one is read."""
    register(spark, sf_dir)
    path = _new_path(spark)
    write_columns(spark.table("part").select("p_partkey", "p_type"), path, partition_by=["p_type"])
    return read_columns(spark, path).where("p_type = 'PROMO'").select("p_partkey", F.col("p_type").cast("string").alias("p_type"))


def _loaded_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of two tables with the same buckets, which needs no shuffle."""
    register(spark, sf_dir)
    names = [f"lodestar_{t}_{uuid.uuid4().hex}" for t in ("o", "l")]
    for name, table, key in zip(names, ("orders", "lineitem"), ("o_orderkey", "l_orderkey")):
        write_bucketed(spark.table(table), name, key, 4, _new_path(spark))
    both = spark.table(names[0]).join(spark.table(names[1]), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.groupBy("o_orderstatus").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("q"), F.count("*").alias("n"))


def _preloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that reads a table twice, of what was kept in memory within a budget."""
    register(spark, sf_dir)
    preload(spark, ["nation", "region", "lineitem"], 1 << 20)
    return run_sql(spark, PRELOADED)


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, "nation").join(generated(spark, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def _costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cost model says of its plans, and of a nested one whose inner part runs for each of 100 rows."""
    rows = []
    for scale in (1, 20):
        model = CostModel(scale)
        rows += [(name, scale, model.estimate(steps).total) for name, steps in PLANS.items()]
        outer, inner = [Step("scan", "partsupp", ("ps_supplycost",), "ps")], [Step("filter", "ps", ("ps_supplycost",), "f", 0.1)]
        rows.append(("nested", scale, model.estimate(outer, inner, 100).total))
    return spark.createDataFrame(rows, "plan string, scale int, ms double").withColumn("ms", F.round("ms", 6))


#: The same by its formulas: milliseconds of a fixed part, scanned bytes, and passes over rows.
_COST = {
    "select": "29 * 2e5 * s / 1731343 + ceil(2e5 * s / 65536) * 0.026 * 29",
    "filter": "54 * 2e5 * s / 1731343 + ceil(2e5 * s / 524288) * 4.16 + ceil(2e5 * s / 6 / 65536) * 0.026 * 29",
    "aggregation": "4 * 8e5 * s / 1731343 + ceil(8e5 * s / 131072) * 0.086",
    "groupby": "8 * 8e5 * s / 1731343 + ceil(8e5 * s / 131072) * 0.51",
    "join": "29 * 2e5 * s / 1731343 + 4 * 8e5 * s / 1731343 + ceil(2e5 * s / 1048576) * 1.22 + ceil(8e5 * s / 1048576) * 3.7 "
    "+ 8e5 * s / 1048576 * 25 * 0.167 + ceil(8e5 * s / 65536) * 0.026 * 25",
    "nested": "4 * 8e5 * s / 1731343 + 100 * ceil(8e5 * s / 524288) * 4.16",
}


def _new_path(spark: SparkSession) -> str:
    folder = shared_folder(spark)
    if folder is None:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{folder}/lodestar-{uuid.uuid4().hex}"


PRELOADED = (
    "SELECT n_name FROM nation, region WHERE n_regionkey = r_regionkey AND n_nationkey > "
    "(SELECT avg(n_nationkey) FROM nation WHERE n_regionkey = r_regionkey)"
)


def _like(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    nation = spark.table("nation")
    return nation.where(like_segments(F.col("n_name"), "NATION_1%")).select("n_name")


def _rows_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    columns = [F.col("p_size"), F.col("p_type")]
    return spark.table("part").where(rows_in(columns, [(3, "PROMO"), (4, "LARGE")])).select("p_partkey")


def _date_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.table("orders").groupBy(date_key(F.col("o_orderdate")).alias("k")).agg(F.count("*").alias("n"))


_OWN: dict[str, tuple[Query, str]] = {
    "join_star": (
        _star,
        "SELECT s_nation, p_category, CAST(sum(lo_revenue) AS BIGINT) AS revenue FROM ssb_lineorder, ssb_ddate, "
        "ssb_supplier, ssb_part WHERE lo_orderdate = d_datekey AND lo_suppkey = s_suppkey AND lo_partkey = p_partkey "
        "AND d_year = 1997 AND s_region = 'ASIA' AND p_mfgr = 'MFGR#3' GROUP BY s_nation, p_category",
    ),
    "join_semi": (_semi, "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "join_anti": (_anti, "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)"),
    "join_band": (
        _band,
        "SELECT c_custkey, s_suppkey FROM customer, supplier WHERE c_acctbal >= s_acctbal AND c_acctbal <= s_acctbal + 100",
    ),
    "agg_salted": (
        _salted,
        "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY l_returnflag",
    ),
    "skew_group": (
        _skew,
        "SELECT k AS ps_suppkey, count(*) AS n FROM (SELECT CASE WHEN ps_partkey <= (SELECT max(ps_partkey) FROM (SELECT "
        "ps_partkey, row_number() OVER (ORDER BY ps_partkey) AS r, count(*) OVER () AS c FROM partsupp) AS y WHERE r <= "
        "ceil(0.3 * c)) THEN (SELECT ps_suppkey FROM partsupp ORDER BY ps_partkey, ps_suppkey LIMIT 1) ELSE ps_suppkey END "
        "AS k FROM partsupp) AS x GROUP BY k",
    ),
    "load_text": (_loaded_text, "SELECT p_partkey, substring(p_brand, 1, 7) AS p_brand, p_size, round(p_retailprice, 2) AS p_retailprice FROM part"),
    "load_sorted": (_loaded_sorted, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 250000 AND 300000"),
    "load_partitioned": (_loaded_parts, "SELECT p_partkey, p_type FROM part WHERE p_type = 'PROMO'"),
    "load_bucketed": (
        _loaded_buckets,
        "SELECT o_orderstatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, count(*) AS n FROM orders, lineitem "
        "WHERE o_orderkey = l_orderkey GROUP BY o_orderstatus",
    ),
    "load_preload": (_preloaded, PRELOADED),
    "cost_model": (
        _costs,
        " UNION ALL ".join(
            f"SELECT '{name}' AS plan, CAST(s AS INT) AS scale, round(12 + {text}, 6) AS ms FROM (VALUES (1.0e0), (20.0e0)) AS v(s)"
            for name, text in _COST.items()
        ),
    ),
    "generate_nation": (
        _generated,
        "SELECT CAST(i AS INT) AS n_nationkey, concat('NATION_', i) AS n_name, CAST(i % 5 AS INT) AS n_regionkey, "
        "CAST(i % 5 AS INT) AS r_regionkey, ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][i % 5 + 1] AS r_name "
        "FROM range(25) AS t(i)",
    ),
    "filter_like_segments": (_like, "SELECT n_name FROM nation WHERE starts_with(n_name, 'NATION_1')"),
    "filter_rows_in": (
        _rows_in,
        "SELECT p_partkey FROM part WHERE (p_size = 3 AND p_type = 'PROMO') OR (p_size = 4 AND p_type = 'LARGE')",
    ),
    "fn_date_key": (
        _date_key,
        "SELECT CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INT) AS k, count(*) AS n "
        "FROM orders GROUP BY 1",
    ),
}


def _run(text: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, uses=text)
        return run_sql(spark, text)

    return query


def queries() -> dict[str, Query]:
    return {name: _run(text) for name, text in SQL.items()} | {name: q for name, (q, _) in _OWN.items()}


def oracle_sql() -> dict[str, str]:
    out = {name: with_derived(STANDARD.get(name, text)) for name, text in SQL.items()}
    return out | {name: with_derived(text) for name, (_, text) in _OWN.items()}
