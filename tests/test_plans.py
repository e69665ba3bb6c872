import pytest
from pyspark.sql import functions as F

from lodestar.functions.predicates import like_segments
from lodestar.plans import metrics, nested
from lodestar.plans.costmodel import PLANS, Calibration, CostModel, Step, catalyst_statistics
from lodestar.plans.dialect import UnsupportedSyntax, normalized
from lodestar.queries import nested as queries


def test_dialect_brings_quirks_to_spark():
    assert normalized("select a -- no; comment\nfrom t where x ^= 'a;--b' ;\n ;") == "select a  \nfrom t where x <> 'a;--b'"
    assert normalized('SELECT "A b" FROM t') == "SELECT `A b` FROM t"


@pytest.mark.parametrize(
    "text",
    [
        "SELECT a FROM t WHERE a IS A SET",
        "SELECT a FROM t, u WHERE t.a = u.b (+)",
        "SELECT ROWNUM FROM t",
        "SELECT a FROM t WHERE a LIKE2 'x'",
        "DELETE FROM t",
        "SELECT a FROM t CONNECT BY a",
    ],
)
def test_dialect_refuses(text):
    with pytest.raises(UnsupportedSyntax):
        normalized(text)


def test_dialect_ignores_keywords_in_literals():
    assert normalized("SELECT 'ROWNUM (+)' FROM t") == "SELECT 'ROWNUM (+)' FROM t"


@pytest.mark.parametrize(
    "name, kinds",
    [("qf1", {"JA"}), ("type_n_set", {"N"}), ("type_a", {"A"}), ("type_j2", {"J"}), ("q16", {"N"}), ("q4_exists", {"J"})],
)
def test_classification(views, name, kinds):
    assert {q.type for q in nested.classify(views, queries.SQL[name])} == kinds


def test_levels_are_found(views):
    assert [q.type for q in nested.classify(views, queries.SQL["nested_twice"])] == ["A", "N", "N"]


def test_scalar_with_many_rows_becomes_exists():
    text = nested.rewritten("SELECT a FROM t WHERE b > (SELECT c FROM u WHERE d = 'x (') AND e < 3")
    assert text == "SELECT a FROM t WHERE EXISTS (SELECT 1 FROM u WHERE b > c AND ( d = 'x (')) AND e < 3"
    kept = "SELECT a FROM t WHERE b > (SELECT min(c) FROM u WHERE d = a)"
    assert nested.rewritten(kept) == kept


@pytest.mark.parametrize("name", list(queries.LEAVE_ONE_OUT) + ["type_j", "type_j2", "qf1", "qf5_skew", "q16", "any_all"])
def test_no_pairs_of_all_rows(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    assert "CartesianProduct" not in metrics.physical_plan(df)
    assert not metrics.quadratic(df)


def test_leave_one_out_edge_cases(spark):
    outer = spark.createDataFrame([(1, 5), (2, 5), (None, 5), (3, None)], "k int, v int")
    inner = spark.createDataFrame([(1, 1), (1, 2), (2, None), (None, 0)], "i int, w int")
    for kind in ("min", "max", "sum", "count"):
        outer.createOrReplaceTempView("o")
        inner.createOrReplaceTempView("n")
        want = spark.sql(f"SELECT k, v FROM o WHERE v > (SELECT {kind}(w) FROM n WHERE o.k <> n.i)").collect()
        got = nested.leave_one_out(outer, inner, "k", "i", "v", ">", "w", kind).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)), kind
    assert nested.leave_one_out(outer, inner.limit(0), "k", "i", "v", ">", "w").count() == 0


@pytest.mark.parametrize("copies", [1, 3, 1 << 16])
def test_counted_pairs(spark, monkeypatch, copies):
    """Each outer row as often as a join by both inequalities gives it: ties, nulls, NaN, no inner rows."""
    monkeypatch.setattr(nested, "COPIES", copies)
    outer = [(i % 40, float(i % 17)) for i in range(90)] + [(3, 2.0)] * 3 + [(None, 9.0), (4, None), (5, float("nan")), (50, -1.0)]
    inner = [(k, float(k * 7 % 11)) for k in range(30)] + [(None, 0.0), (60, None), (61, float("nan")), (62, 400.0)]
    o, i = spark.createDataFrame(outer, "k int, v double"), spark.createDataFrame(inner, "i int, w double")
    plain = o.join(i, (F.col("v") > F.col("w")) & (F.col("k") != F.col("i"))).select("k", "v")
    got = nested.counted_pairs(o, i, "k", "i", "v", "w")
    text = lambda df: sorted(map(str, df.collect()))
    assert got.columns == ["k", "v"] and len(text(plain)) > 1000 and text(got) == text(plain)
    assert nested.counted_pairs(o, i.limit(0), "k", "i", "v", "w").count() == 0


@pytest.mark.parametrize("copies, held", [(10, 3), (1 << 16, 7), (1 << 16, 512)])
def test_counted_pairs_hold_few_copies(spark, monkeypatch, copies, held):
    """Generated code keeps what it makes of a row until it is read, so a row's copies are handed to it a few at a time."""
    monkeypatch.setattr(nested, "COPIES", copies)
    monkeypatch.setattr(nested, "HELD", held, raising=False)
    o = spark.createDataFrame([(0, 500.0), (1, 1050.5), (2, 0.5), (2000, 9000.0)], "k int, v double")
    i = spark.range(1100).selectExpr("CAST(id AS INT) AS i", "CAST(id AS DOUBLE) AS w")
    got = nested.counted_pairs(o, i, "k", "i", "v", "w")
    assert {r.k: r["count"] for r in got.groupBy("k").count().collect()} == {0: 499, 1: 1050, 2: 1, 2000: 1100}
    got.collect()
    steps = [x for x in got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Generate" in x]
    assert "array_repeat(true, _held" in steps[0] and "*(" in steps[0]
    assert f"Some({held})" in steps[1] and "_copies" in steps[1] and "*(" not in steps[1]


def test_inequalities_plan_no_product(spark, sf_dir):
    plan = queries.queries()["qf7_unnested"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_compare_all_and_any(spark):
    outer = spark.createDataFrame([(1, 5), (2, 1), (3, 9), (4, None)], "k int, v int")
    inner = spark.createDataFrame([(1, 1), (1, 7), (2, 0), (4, 1), (2, None)], "i int, w int")
    on = [("k", "i")]
    assert {r.k for r in nested.exists_compare(outer, inner, on, "v", ">", "w").collect()} == {1, 2}
    assert {r.k for r in nested.compare_all(outer, inner, on, "v", ">", "w").collect()} == {3}


@pytest.mark.parametrize("op", ["=", "<>", "<", "<=", ">", ">="])
@pytest.mark.parametrize("inner", [[], [3], [1, 3], [1, 3, None], [None], [3, 3]])
def test_quantified_comparisons(spark, op, inner):
    """Against a plain reading, in which what a null leaves open is false."""
    import operator

    holds = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    values = [0, 1, 2, 3, 4, None]
    spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x int").createOrReplaceTempView("q_outer")
    spark.createDataFrame([(v,) for v in inner], "z int").createOrReplaceTempView("q_inner")
    true = lambda x, y: x is not None and y is not None and holds(x, y)
    for word, every in (("ANY", any), ("ALL", all)):
        df = nested.run_sql(spark, f"SELECT i FROM q_outer WHERE x {op} {word} (SELECT z FROM q_inner)")
        assert not metrics.quadratic(df) or "IdentityBroadcastMode" in metrics.physical_plan(df)
        assert {r.i for r in df.collect()} == {i for i, x in enumerate(values) if every(true(x, y) for y in inner)}, word
    got = nested.run_sql(spark, "SELECT i FROM q_outer WHERE x NOT IN (SELECT z FROM q_inner)")
    assert {r.i for r in got.collect()} == {r.i for r in spark.sql("SELECT i FROM q_outer WHERE x NOT IN (SELECT z FROM q_inner)").collect()}
    assert "NullAware" not in metrics.physical_plan(got) and "isNullAwareAntiJoin" not in metrics.physical_plan(got)


def test_operators_as_functions():
    assert normalized("SELECT a FROM t WHERE b.c IS NOT NAN") == "SELECT a FROM t WHERE (b.c IS NOT NULL AND NOT isnan(b.c))"
    assert "abs(f(x, g(y))) = double('Infinity')" in normalized("SELECT a FROM t WHERE f(x, g(y)) IS INFINITE")
    assert normalized("SELECT a FROM t WHERE REGEXP_LIKE(a, 'x,)', 'in')") == (
        "SELECT a FROM t WHERE regexp_like(a, concat('(?i)(?s)', 'x,)'))"
    )
    zone = "convert_timezone(current_timezone(), {}, CAST({} AS TIMESTAMP_NTZ))"
    assert normalized("SELECT d AT TIME ZONE 'Asia/Tokyo' FROM t") == f"SELECT {zone.format(chr(39) + 'Asia/Tokyo' + chr(39), 'd')} FROM t"
    assert normalized("SELECT d AT LOCAL FROM t") == f"SELECT {zone.format('current_timezone()', 'd')} FROM t"
    assert normalized("SELECT 'a IS NAN' FROM t") == "SELECT 'a IS NAN' FROM t"
    with pytest.raises(UnsupportedSyntax):
        normalized("SELECT a FROM t WHERE REGEXP_LIKE(a, 'x', 'q')")


def test_unnested_matches_nested(views):
    orders, lines = views.table("orders"), views.table("lineitem")
    got = nested.unnested(orders, lines, [("o_orderkey", "l_orderkey")], "o_totalprice", "<", F.min("l_extendedprice"))
    want = views.sql(
        "SELECT * FROM orders WHERE o_totalprice < (SELECT min(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey)"
    )
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_like_treats_only_percent_as_wildcard(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), ("a\\b",), ("aab",)], "s string")
    keep = lambda p: {r.s for r in df.where(like_segments(F.col("s"), p)).collect()}
    assert keep("a_b") == {"a_b"} and keep("a\\b") == {"a\\b"} and keep("%ab") == {"aab"} and len(keep("a%b")) == 4


def test_filters_and_columns_reach_the_scan(views):
    plan = metrics.physical_plan(views.sql("SELECT o_orderkey FROM orders WHERE o_orderkey < 50"))
    assert "PushedFilters: [IsNotNull(o_orderkey), LessThan(o_orderkey,50)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_cost_model():
    model = CostModel(2.0)
    cost = model.estimate(PLANS["aggregation"])
    passes = -(-1_600_000 // 131_072)
    assert cost.total == pytest.approx(12 + 4 * 1_600_000 / 1_731_343 + passes * 0.086)
    inner = [Step("filter", "ps", ("ps_supplycost",), "f", 0.1)]
    once = model.estimate([PLANS["aggregation"][0]], inner, 1).total
    ten = model.estimate([PLANS["aggregation"][0]], inner, 10).total
    assert ten - once == pytest.approx(9 * Calibration().filter_pass * -(-1_600_000 // 524_288))
    join = model.estimate(PLANS["join"])
    assert join.rows["j"] == 1_600_000 and set(join.by_op) == {"fixed", "scan", "join", "materialize"}
    with pytest.raises(ValueError):
        model.estimate([Step("sort", "part", (), "x")])


def test_metrics(views):
    df = views.table("nation").where("n_regionkey = 1")
    done = metrics.report(df)
    assert done.rows == df.count() and done.seconds > 0 and "FileScan" in done.operators
    assert catalyst_statistics(df)["bytes"] > 0
