import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators import relational as R
from lodestar.sources import schema as S

_TEXT = """PART|P_PARTKEY:INTEGER|P_NAME:TEXT:5||P_PRICE:DECIMAL
DDATE|D_DATEKEY:DATE|D_YEAR:INTEGER
"""


def test_schema_text():
    tables = S.parse_schema(_TEXT)
    assert [f.name for f in tables["PART"]] == ["P_PARTKEY", "P_NAME", "P_PRICE"]
    assert tables["PART"]["P_PRICE"].dataType == T.DecimalType(15, 2)
    assert tables["DDATE"]["D_DATEKEY"].dataType == T.IntegerType()
    assert S.parse_schema(S.format_schema(tables)) == tables
    assert S.parse_schema("") == {}
    with pytest.raises(ValueError):
        S.parse_schema("T|A:BLOB")


def test_tbl_round_trip(spark, tmp_path):
    (tmp_path / "part.tbl").write_text("1|screwdriver|2.50\n2|nut|0.10\n3||\n")
    part = S.read_tbl(spark, str(tmp_path / "part.tbl"), S.parse_schema(_TEXT)["PART"])
    assert [tuple(r)[:2] for r in part.orderBy("P_PARTKEY").collect()] == [(1, "screw"), (2, "nut"), (3, None)]
    S.write_columns(part, str(tmp_path / "out"), sort_by=["P_PARTKEY"])
    back = S.read_columns(spark, str(tmp_path / "out"), ["P_NAME"])
    assert back.columns == ["P_NAME"] and back.count() == 3


def test_bucketed_join_needs_no_shuffle(spark, views):
    from lodestar.plans.metrics import physical_plan

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        S.write_bucketed(views.table("orders").select("o_orderkey", "o_custkey"), "b_orders", "o_orderkey", 4)
        S.write_bucketed(views.table("lineitem").select("l_orderkey", "l_quantity"), "b_lines", "l_orderkey", 4)
        joined = spark.table("b_lines").join(spark.table("b_orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        assert "Exchange" not in physical_plan(joined)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS b_orders")
        spark.sql("DROP TABLE IF EXISTS b_lines")


def test_skew_injection(spark):
    df = spark.range(1000).select("id", (F.col("id") % 97 + 3).alias("v"))
    out = S.skewed(df, "v", 0.25, ["id"])
    hit = out.where("v = 3").count()
    assert out.count() == 1000 and abs(hit - (250 + sum(1 for i in range(251, 1000) if i % 97 == 0))) <= 2
    assert S.skewed(df, "v", 0.0, ["id"]).exceptAll(df).count() == 0
    with pytest.raises(ValueError):
        S.skewed(df, "v", 2, ["id"])


def test_skew_injection_is_exact(spark):
    """More rows than an approximate quantile tells apart, ties, and nulls, which come last."""
    n = 1_200_000
    df = spark.range(n).select(((F.col("id") * 700_001) % n).alias("id"), F.lit(1).alias("v"))
    df = df.withColumn("v", F.when(F.col("id") == 0, 7).otherwise(F.col("v")))
    assert S.skewed(df, "v", 0.3, ["id"]).where("v = 7").agg(F.count("*"), F.max("id")).first() == (360_000, 359_999)
    for k in (1, 2, 131_073, 599_999, n, n + 5):
        assert S.kth_smallest(df, "id", k) == min(k, n) - 1
    ties = df.select((F.col("id") >= 400_000).cast("int").alias("id"))
    assert [S.kth_smallest(ties, "id", k) for k in (400_000, 400_001)] == [0, 1]
    odd = spark.createDataFrame([(None, 5), (2, None), (2, 3), (4, 6)], "id int, v int")
    assert sorted(map(str, S.skewed(odd, "v", 0.25, ["id", "v"]).collect())) == [
        "Row(id=2, v=3)", "Row(id=2, v=3)", "Row(id=4, v=6)", "Row(id=None, v=5)"
    ]
    assert S.kth_smallest(odd.limit(0), "id", 1) is None


def test_materialized_form(spark):
    df = spark.createDataFrame([(1, 2.5, "x")], "a int, b double, c string")
    assert R.materialized(df) == ["Tuple 0: (int) 1, (float) 2.5, (string) x"]
    assert R.materialized(df, 0) == []


def test_broadcast_is_checked(spark):
    small = spark.range(10)
    assert R.size_in_bytes(small) < 1000
    assert "broadcast" in R.maybe_broadcast(small)._jdf.queryExecution().logical().toString()
    assert "broadcast" not in R.maybe_broadcast(small, 1)._jdf.queryExecution().logical().toString()


def test_cli(spark, sf_dir, tmp_path, capsys):
    from lodestar.cli import main

    (tmp_path / "q.sql").write_text("select r_name from region where r_regionkey ^= 0 order by r_name;")
    assert main([str(tmp_path / "q.sql"), "--data", sf_dir]) == 0
    assert capsys.readouterr().out.startswith("Tuple 0: (string) ")
    (tmp_path / "n.sql").write_text("select n_name from nation where n_regionkey = (select min(r_regionkey) from region)")
    assert main([str(tmp_path / "n.sql"), "--data", sf_dir, "--types"]) == 0
    assert capsys.readouterr().out.strip() == "A scalar"


def test_preload_keeps_to_its_budget(views):
    from lodestar.sources.tables import preload

    try:
        assert preload(views, ["lineitem", "region"], 100_000) == ["region"]
        assert views.catalog.isCached("region") and not views.catalog.isCached("lineitem")
    finally:
        views.catalog.clearCache()


def test_generated_tables(spark, tmp_path):
    from lodestar.queries import star
    from lodestar.sources.generate import ROWS, generated, rows_of, write_tables

    write_tables(spark, str(tmp_path), 0.001)
    for name in ROWS:
        df = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        assert df.count() == rows_of(name, 0.001)
        assert df.exceptAll(generated(spark, name, 0.001)).count() == 0
    assert star.queries()["ssb_q1_1"](spark, str(tmp_path)).count() == 1
    assert generated(spark, "orders", 0.001).schema["o_orderdate"].dataType == T.TimestampNTZType()


def test_tables_written_anew_are_read_anew(spark, tmp_path):
    import time

    from lodestar.sources.generate import write_tables
    from lodestar.sources.tables import register

    folder = str(tmp_path)
    write_tables(spark, folder, 0.0005)
    register(spark, folder, uses="partsupp")
    before = spark.table("partsupp").agg(F.sum("ps_availqty")).first()[0]
    assert spark.table("lineitem").count() == 3000
    time.sleep(1.1)
    write_tables(spark, folder, 0.001)
    register(spark, folder, uses="partsupp")
    assert spark.table("lineitem").count() == 6000
    assert spark.table("partsupp").agg(F.sum("ps_availqty")).first()[0] > before


def test_derived_tables_are_stored_once(spark, sf_dir):
    from lodestar.plans.metrics import physical_plan
    from lodestar.sources.tables import register

    register(spark, sf_dir, uses="SELECT * FROM partsupp")
    plan = physical_plan(spark.sql("SELECT ps_partkey, min(ps_supplycost) FROM partsupp GROUP BY ps_partkey"))
    assert "Exchange" not in plan and "l_partkey" not in plan
    register(spark, sf_dir)
    assert "l_partkey" in physical_plan(spark.table("partsupp"))
