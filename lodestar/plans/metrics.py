"""Row counts per operator, run time and a plan summary."""

from __future__ import annotations

import re
import time
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """df that counts its rows while an action runs through it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def physical_plan(df: DataFrame) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def plan_summary(df: DataFrame) -> dict[str, int]:
    """How often each physical operator occurs."""
    names = re.findall(r"^[\s:+\-*()0-9]*([A-Z][A-Za-z]+)", physical_plan(df), re.M)
    return dict(Counter(names))


def quadratic(df: DataFrame) -> bool:
    """Whether the plan pairs all rows of two inputs."""
    return bool(re.search(r"CartesianProduct|BroadcastNestedLoopJoin", physical_plan(df)))


@dataclass(frozen=True)
class Report:
    seconds: float
    rows: int
    operators: dict[str, int]


def report(df: DataFrame) -> Report:
    """Runs df without collecting it."""
    counted, seen = observed(df, "result")
    began = time.perf_counter()
    counted.write.format("noop").mode("overwrite").save()
    return Report(time.perf_counter() - began, seen.get["rows"], plan_summary(df))
