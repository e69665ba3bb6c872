"""Nested queries: their types, and set-based plans for those that Spark cannot run or runs as a
cartesian product.

Types: N, a set or value without correlation; A, an aggregate without; J, correlated without
aggregate; JA, correlated with one. Spark decorrelates N, A, J sets and JA with equalities. The other
cases are rewritten here: a J scalar with many inner rows, JA with an inequality, and ANY / ALL.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .dialect import normalized, split_literals

_COMPARE = {
    "=": lambda a, b: a == b,
    "<>": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


@dataclass(frozen=True)
class Subquery:
    """A subquery of an analyzed plan."""

    type: str
    form: str  # scalar, set or exists
    outer: tuple[str, ...]


def _seq(x: Any) -> list:
    return [x.apply(i) for i in range(x.size())]


def classify(spark: SparkSession, sql: str) -> list[Subquery]:
    """The subqueries of a query's WHERE, HAVING and SELECT, outermost first, by Catalyst's analysis."""
    found: list[Subquery] = []
    forms = {"ScalarSubquery": "scalar", "ListQuery": "set", "Exists": "exists"}

    def aggregates(plan: Any) -> bool:
        name = plan.getClass().getSimpleName()
        if name == "Aggregate":
            return True
        return name in ("Project", "Filter", "SubqueryAlias", "Sort") and any(map(aggregates, _seq(plan.children())))

    def expression(e: Any) -> None:
        form = forms.get(e.getClass().getSimpleName())
        if form:
            outer = tuple(dict.fromkeys(a.sql().split(".")[-1].strip("`") for a in _seq(e.outerAttrs())))
            kind = ("JA" if outer else "A") if aggregates(e.plan()) else ("J" if outer else "N")
            found.append(Subquery(kind, form, outer))
            plan(e.plan())
        for child in _seq(e.children()):
            expression(child)

    def plan(p: Any) -> None:
        for e in _seq(p.expressions()):
            expression(e)
        for child in _seq(p.children()):
            plan(child)

    plan(spark.sql(normalized(sql))._jdf.queryExecution().analyzed())
    return found


def exists_compare(
    outer: DataFrame, inner: DataFrame, on: list[tuple[str, str]], value: str, op: str, inner_value: str
) -> DataFrame:
    """outer rows whose value compares with that of some inner row that agrees on the keys: the reading
    of a J scalar as a set, and of `op ANY`. A semi join with the comparison as residual."""
    condition = _COMPARE[op](F.col(value), F.col(inner_value))
    for a, b in on:
        condition = (F.col(a) == F.col(b)) & condition
    return outer.join(inner, condition, "left_semi")


def compare_all(
    outer: DataFrame, inner: DataFrame, on: list[tuple[str, str]], value: str, op: str, inner_value: str
) -> DataFrame:
    """outer rows whose value compares with that of every inner row that agrees on the keys (`op ALL`);
    rows without inner rows stay; a null on either side that leaves it open drops the row."""
    holds = F.coalesce(_COMPARE[op](F.col(value), F.col(inner_value)), F.lit(False))
    condition = ~holds
    for a, b in on:
        condition = (F.col(a) == F.col(b)) & condition
    return outer.join(inner, condition, "left_anti")


def first_match(
    outer: DataFrame, inner: DataFrame, on: list[tuple[str, str]], value: str, op: str, inner_value: str, order: str
) -> DataFrame:
    """outer rows whose value compares with that of the first inner row by `order`."""
    keys = [b for _, b in on]
    first = inner.groupBy(*keys).agg(F.min_by(inner_value, order).alias("_first"))
    joined = outer.join(first, [F.col(a) == F.col(b) for a, b in on])
    return joined.where(_COMPARE[op](F.col(value), F.col("_first"))).select(*outer.columns)


def unnested(
    outer: DataFrame, inner: DataFrame, on: list[tuple[str, str]], value: str, op: str, aggregate: Column
) -> DataFrame:
    """JA with equalities: the aggregate per key, joined back. A key without inner rows has a null
    aggregate, so the comparison drops it; pass count aggregates to `unnested_count`."""
    keys = [b for _, b in on]
    per_key = inner.groupBy(*keys).agg(aggregate.alias("_agg"))
    joined = outer.join(per_key, [F.col(a) == F.col(b) for a, b in on])
    return joined.where(_COMPARE[op](F.col(value), F.col("_agg"))).select(*outer.columns)


def unnested_count(outer: DataFrame, inner: DataFrame, on: list[tuple[str, str]], value: Column, op: str) -> DataFrame:
    """JA with count(*): keys without inner rows count 0."""
    keys = [b for _, b in on]
    per_key = inner.groupBy(*keys).agg(F.count("*").alias("_agg"))
    joined = outer.join(per_key, [F.col(a) == F.col(b) for a, b in on], "left")
    return joined.where(_COMPARE[op](value, F.coalesce("_agg", F.lit(0)))).select(*outer.columns)


def leave_one_out(
    outer: DataFrame, inner: DataFrame, key: str, inner_key: str, value: str, op: str, inner_value: str, kind: str = "min"
) -> DataFrame:
    """JA with an inequality: value op (SELECT kind(inner_value) FROM inner WHERE key <> inner_key).

    min and max need the best two keys only: the best serves every row but those of its own key, which
    take the second. sum and count are the total less the own group. No cartesian product.
    """
    # An equality could become a join key, and an exchange cannot wait for a subquery.
    compare = (lambda a, b: (a <= b) & (a >= b)) if op == "=" else _COMPARE[op]
    keyed = inner.where(F.col(inner_key).isNotNull())
    if kind in ("min", "max"):
        best = (F.min if kind == "min" else F.max)(inner_value).alias("v")
        per_key = keyed.groupBy(F.col(inner_key).alias("k")).agg(best).where("v IS NOT NULL")
        two = per_key.orderBy(F.col("v") if kind == "min" else F.desc("v")).limit(2)
        low, high = F.min(F.struct("v", "k")), F.max(F.struct("v", "k"))
        first, second = (low, high) if kind == "min" else (high, low)
        second = F.when(F.count("*") > 1, second).getField("v")
        # A scalar subquery of one row, which runs with the query; null without inner rows.
        top = two.agg(F.struct(first.alias("first"), second.alias("second")).alias("top")).scalar()
        other = F.when(F.col(key) == top["first"]["k"], top["second"]).otherwise(top["first"]["v"])
        return outer.where(F.col(key).isNotNull() & compare(F.col(value), other))
    if kind not in ("sum", "count"):
        raise ValueError(f"no leave-one-out plan for {kind}")
    # Decimals, so that a difference of sums is exact.
    measure = F.col(inner_value).cast("decimal(28,4)")
    own = keyed.groupBy(F.col(inner_key).alias("_k")).agg(
        F.sum(measure).alias("_s"), F.count(measure).alias("_n")
    )
    sums = F.struct(F.coalesce(F.sum("_s"), F.lit(0)).alias("s"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    total = own.agg(sums.alias("total")).scalar()
    # A null key differs from no key, so its subquery is empty: a count of 0, a null sum.
    n = F.when(F.col(key).isNull(), 0).otherwise(total["n"] - F.coalesce("_n", F.lit(0)))
    s = total["s"] - F.coalesce("_s", F.lit(0))
    other = n if kind == "count" else F.when(n > 0, s)
    joined = outer.join(own, F.col(key) == F.col("_k"), "left")
    return joined.where(compare(F.col(value), other)).select(*outer.columns)


#: Ranges of values that are ranked apart from each other, copies of a row that one place makes, and copies of it that are
#: held at a time: generated code keeps all that it makes of a row until they are read.
RANGES, COPIES, HELD = 64, 1 << 16, 512


def counted_pairs(outer: DataFrame, inner: DataFrame, key: str, inner_key: str, value: str, inner_value: str) -> DataFrame:
    """outer rows joined with inner ON value > inner_value AND key <> inner_key, without inner's columns, of which
    inner_key is unique: each outer row as often as it has partners.

    The partners are counted, not met: inner rows of a smaller value, ranked by a running count within ranges of
    values, less the own key's. No cartesian product; the rest of the work is the result's rows, which leave
    evenly from all tasks.
    """
    pairs = inner.select(F.col(inner_key).alias("_k"), F.col(inner_value).alias("_v")).where("_k IS NOT NULL AND _v IS NOT NULL")
    asked = outer.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    values = asked.select(F.col(value).alias("_v"), F.lit(0).alias("_n"), F.lit(1).alias("_asked"))
    values = values.unionByName(pairs.select("_v", F.lit(1).alias("_n"), F.lit(0).alias("_asked")))
    values = values.groupBy("_v").agg(F.sum("_n").alias("_n"), F.max("_asked").alias("_asked"))
    ends = pairs.agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 1000)).first()[0]
    place = F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end < F.col("_v"))) if ends else F.lit(0)
    values = values.withColumn("_range", place)
    before = lambda w: F.coalesce(F.sum("_n").over(w.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each range, so that the window without a partition is small.
    starts = values.groupBy("_range").agg(F.sum("_n").alias("_n"), F.max("_v").alias("_v"))
    starts = starts.select(F.col("_range"), before(Window).alias("_start"))
    below = values.withColumn("_in_range", before(Window.partitionBy("_range"))).where("_asked = 1")
    below = below.join(F.broadcast(starts), "_range").select("_v", (F.col("_start") + F.col("_in_range")).alias("_below"))
    own = pairs.withColumnRenamed("_v", "_own")
    told = asked.join(below, F.col(value) == F.col("_v")).join(own, F.col(key) == F.col("_k"), "left")
    n = F.col("_below") - F.when(F.col("_own") < F.col(value), 1).otherwise(0)
    told = told.select(*outer.columns, n.alias("_n")).where("_n > 0")
    parts = told.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {COPIES}"))))
    parts = parts.repartition(4 * outer.sparkSession.sparkContext.defaultParallelism)
    copies = F.least(F.lit(COPIES), F.col("_n") - F.col("_part") * COPIES).cast("int")
    parts = parts.select(*outer.columns, copies.alias("_copies"))
    # A lambda keeps this step out of the generated code of the next, which so reads HELD copies at a time.
    held = lambda at: F.least(F.lit(HELD), F.col("_copies") - at)
    parts = parts.withColumn("_held", F.explode(F.transform(F.expr(f"sequence(0, _copies - 1, {HELD})"), held)))
    return parts.select(*outer.columns, F.explode(F.array_repeat(F.lit(True), F.col("_held"))).alias("_copy")).drop("_copy")


def in_set(outer: DataFrame, inner: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """IN (SELECT ...), correlated or not."""
    return outer.join(inner, [F.col(a) == F.col(b) for a, b in on], "left_semi")


def _closing(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if not depth:
            return i
    raise ValueError("a parenthesis is not closed")


_SCALAR = re.compile(
    r"([\w.]+)\s*(?:(=|<>|!=|<=|>=|<|>)\s*(?:(ANY|SOME|ALL)\s*)?|\b(NOT)\s+IN\s*)\((?=\s*SELECT\b)", re.I
)
_CALL = re.compile(r"\b(?:min|max|sum|avg|count)\s*\(", re.I)


def _quantified(value: str, op: str, every: bool, inner: str) -> str:
    """value op ANY or ALL over an inner query of one column y that runs by itself, without a nested loop:
    the inner minimum and maximum decide, or an equi join where equality does. A null that leaves it open
    counts as false; ALL over no rows is true."""
    of = lambda what: f"(SELECT {what} FROM ({inner}) AS _any)"
    same = f"EXISTS (SELECT 1 FROM ({inner}) AS _any WHERE {value} = _any.y)"
    if not every:
        if op == "=":
            return same
        if op == "<>":
            return f"coalesce({value} <> {of('min(_any.y)')} OR {value} <> {of('max(_any.y)')}, false)"
        return f"coalesce({value} {op} {of('min(_any.y)' if op in ('>', '>=') else 'max(_any.y)')}, false)"
    whole = "CASE WHEN count(*) = count(_any.y) THEN {}(_any.y) END"
    none = f"{of('count(*)')} = 0"
    if op == "<>":
        return f"({none} OR ({value} IS NOT NULL AND {of('count(*) = count(_any.y)')})) AND NOT {same}"
    ends = ("min", "max") if op == "=" else ("max",) if op in (">", ">=") else ("min",)
    tests = " AND ".join(f"{value} {op} {of(whole.format(x))}" for x in ends)
    return f"({none} OR coalesce({tests}, false))"


def rewritten(sql: str, closed: Callable[[str], bool] = lambda inner: False) -> str:
    """sql with J scalars, ANY / ALL comparisons and NOT IN as EXISTS, NOT EXISTS or scalars.

    `x > (SELECT y FROM t WHERE ...)` without an aggregate may have many inner rows, and is read as
    `x > ANY`. `closed` tells whether an inner query runs by itself: a scalar that does is left alone,
    and ANY / ALL over one reads a derived table, where no inner column can hide an outer one. NOT IN over
    one is `<> ALL`, so that a plain anti join takes the place of the null-aware one, whose inner side is
    always broadcast.
    Literals are put aside first, so that their content is never read as SQL.
    """

    def restored(x: str) -> str:
        return re.sub("\x00(\\d+)\x00", lambda m: literals[int(m[1])], x)

    literals: list[str] = []
    text = ""
    for quoted, part in split_literals(normalized(sql)):
        if quoted:
            literals.append(part)
            part = f"\x00{len(literals) - 1}\x00"
        text += part
    at = 0
    while m := _SCALAR.search(text, at):
        end = _closing(text, m.end() - 1)
        inner = text[m.end() : end]
        head = re.match(r"\s*SELECT\s+(.*?)\s+FROM\s", inner, re.I | re.S)
        quantified = "ALL" if m[4] else (m[3] or "").upper()
        plain = head and not _CALL.search(head[1]) and "," not in head[1]
        correlated = bool(re.search(r"\bWHERE\b", inner, re.I))
        grouped = re.search(r"\bGROUP\s+BY\b|\bLIMIT\b", inner, re.I)
        alone = bool(plain) and closed(restored(inner))
        if not plain or grouped or not (quantified or (correlated and not alone)) or m[4] and not alone:
            at = m.end()
            continue
        op = "<>" if m[4] or m[2] == "!=" else m[2]
        if alone:
            test = _quantified(m[1], op, quantified == "ALL", f"SELECT {head[1]} AS y{inner[head.end(1) :]}")
            text = text[: m.start()] + f"({test})" + text[end + 1 :]
            at = m.start() + len(test) + 2
            continue
        test = f"{m[1]} {op} {head[1]}"
        if quantified == "ALL":
            test = f"NOT coalesce({test}, false)"
        rest = inner[head.end(1) :]
        if correlated:
            rest = re.sub(r"\bWHERE\b", lambda w: f"WHERE {test} AND (", rest, count=1, flags=re.I) + ")"
        else:
            rest = f"{rest} WHERE {test}"
        exists = ("NOT " if quantified == "ALL" else "") + f"EXISTS (SELECT 1{rest})"
        text = text[: m.start()] + exists + text[end + 1 :]
        at = m.start()
    return restored(text)


def run_sql(spark: SparkSession, sql: str) -> DataFrame:
    """A query of the dialect as a DataFrame."""

    def closed(inner: str) -> bool:
        state = spark._jsparkSession.sessionState()
        return state.analyzer().execute(state.sqlParser().parsePlan(inner)).resolved()

    return spark.sql(rewritten(sql, closed))
