"""Every query with an oracle gives the oracle's rows."""

import decimal

import pytest

import __spark_entry__ as entry
from lodestar.queries import micro, nested, star

_SQL = micro.oracle_sql() | nested.oracle_sql() | star.oracle_sql()


def _cell(x):
    if isinstance(x, decimal.Decimal):
        return ("n", float(x))
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return ("n", float(x))
    return ("s", str(x))


@pytest.mark.parametrize("name", sorted(_SQL))
def test_matches_oracle(name, spark, sf_dir, oracle):
    df = entry.queries()[name](spark, sf_dir)
    got = [r.asDict() for r in df.collect()]
    found = oracle.execute(entry.oracle_sql()[name])
    names = sorted(d[0] for d in found.description)
    assert sorted(df.columns) == names
    at = {d[0]: i for i, d in enumerate(found.description)}
    want = sorted(tuple(_cell(r[at[c]]) for c in names) for r in found.fetchall())
    assert sorted(tuple(_cell(r[c]) for c in names) for r in got) == want


def test_operators_read_whole_tables(spark, sf_dir):
    n = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("lineitem", "region", "supplier")}
    rows = lambda name: entry.queries()[name](spark, sf_dir)
    assert rows("project_arithmetic").count() == rows("fn_cast").count() == n["lineitem"]
    assert rows("join_cross").count() == n["region"] * n["supplier"]
    keys = [r.s_nationkey for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").collect()]
    assert rows("join_without_key").first().a == sum(r < k for r in range(n["region"]) for k in keys)


def test_every_reference_query_has_an_oracle():
    own = micro.queries() | nested.queries() | star.queries()
    assert set(own) == set(_SQL)
    assert set(own) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
