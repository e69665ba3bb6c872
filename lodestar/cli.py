"""python -m lodestar.cli --data DIR [--star] [--explain | --types | --report] FILE.sql"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators.relational import materialized
from .plans.metrics import report
from .plans.nested import classify, run_sql
from .sources.tables import register


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Runs one query of the dialect over a folder of Parquet tables.")
    parser.add_argument("file")
    parser.add_argument("--data", required=True)
    parser.add_argument("--star", action="store_true", help="use the star schema's tables")
    parser.add_argument("--explain", action="store_true", help="print the plan instead")
    parser.add_argument("--types", action="store_true", help="print the types of nested queries instead")
    parser.add_argument("--report", action="store_true", help="print time, rows and operators instead")
    parser.add_argument("--limit", type=int, default=None)
    args = parser.parse_args(argv)
    with open(args.file) as f:
        text = f.read()
    spark = SparkSession.builder.appName("lodestar").getOrCreate()
    register(spark, args.data, args.star)
    if args.types:
        for q in classify(spark, text):
            print(q.type, q.form, ",".join(q.outer))
        return 0
    df = run_sql(spark, text)
    if args.explain:
        df.explain("formatted")
    elif args.report:
        print(report(df))
    else:
        print("\n".join(materialized(df, args.limit)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
