"""Quality rules (operator 7): risk-controlled thresholds. DataFrame functions only.

Every document is measured in whole by array functions where it is read; nothing is exploded. Base
rules reject texts below 20 words and texts of which over 30 % of the words lie in repeated 8-word
windows. Further rules compare a rate (symbols per word, repeated lines, words in repeated windows)
with a cutoff of the document's stratum. Cutoffs are learnt on the labelled documents, as a holdout,
along a fixed path: all rules start off, and each step makes one of them one notch stricter. In each
stratum the steps are tested in this order, and the path ends before the first at which the exact
binomial test doesn't show that its cutoffs together reject at most `risk` of the stratum's good
documents. A fixed sequence needs no correction within a stratum, as only the first true null can be
rejected in error; over the strata `delta` is divided by their number. So all promises hold at once with
probability 1 - delta or more. Strata with fewer labels than a first step needs even without a rejected
document are one stratum together, whose promise is about them together: that choice looks at their
numbers of labels only. If these too are few, nothing more is rejected there, nor where no label is.

The path and the strata are fixed, so the table of counts has some 100 cells at any size of input.

Cases: a null text counts as empty and fails the base rules; a null or unlisted lang is in the stratum
"other"; labels without a document, null labels and null ids are ignored; a document is good if all
its labels are 1; repeated rows are measured and kept or rejected alike; an empty table gives no rows;
without labels only the base rules hold; columns of docs named like measures don't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_path

#: Base rules (fixed values of the contract).
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
STRATA = ("en", "de", "fr", "es")
#: Cutoffs of each rate, loosest first; a rate above its cutoff rejects.
GRID = {
    "symbol_rate": (0.8, 0.4, 0.2, 0.1, 0.05, 0.02),
    "line_rate": (0.7, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeat_rate": (0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
}
#: A cutoff that no rate exceeds.
OFF = 1e9
#: The cutoffs of each step, in the order of GRID's rules.
PATH = [
    tuple(grid[i] if j <= k else (grid[i - 1] if i else OFF) for j, grid in enumerate(GRID.values()))
    for i in range(6)
    for k in range(len(GRID))
]
RISK, DELTA = 0.02, 0.05
WORD_GAP = r"[ \t-\r]+"


def _pairs(a: Column, step: int) -> Column:
    """Hashes of each element with the one `step` further on."""
    n = F.greatest(F.size(a) - step, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(a, step + 1, n), lambda x, y: F.xxhash64(x, y))


def measured(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang) as a struct `doc` beside its measures."""
    out = docs.select(F.struct("*").alias("doc"), F.coalesce("text", F.lit("")).alias("t"))
    out = out.select(
        "doc",
        "t",
        F.array_remove(F.split("t", WORD_GAP), "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t-\r]")).alias("lines"),
    )
    out = out.select(
        "doc",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    rest = ["doc", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    for step in (1, 2, 4):  # hashes of 2, 4 and 8 words
        out = out.select(*rest, _pairs(F.col("h"), step).alias("h"))
    again = F.size("h") > F.size(F.array_distinct("h"))
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.select(*rest, F.when(again, placed).alias("s"))
    out = out.select(*rest, "s", F.transform("s", lambda x: x["h"]).alias("h"))
    after = F.zip_with("h", F.slice("h", 2, F.size("h")), lambda x, y: F.coalesce(x == y, F.lit(False)))
    out = out.select(*rest, "s", after.alias("e"))
    before = F.concat(F.array(F.lit(False)), F.slice("e", 1, F.greatest(F.size("e") - 1, F.lit(0))))
    hit = F.zip_with("e", before, lambda x, y: x | y)
    starts = F.zip_with("s", hit, lambda x, y: F.when(y, x["i"]))
    out = out.select(*rest, F.sort_array(F.array_compact(starts)).alias("at"))
    gaps = F.zip_with(
        "at", F.slice("at", 2, F.size("at")), lambda x, y: F.least(F.coalesce(y - x, F.lit(WINDOW)), F.lit(WINDOW))
    )
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.select(*rest, F.coalesce(F.when(F.col("at").isNotNull(), covered), F.lit(0)).alias("n_repeat_words"))
    return out.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "symbol_rate": F.col("n_symbols") / F.greatest("n_words", F.lit(1)),
            "line_rate": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
            "repeat_rate": F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
            "stratum": F.when(F.col("doc.lang").isin(*STRATA), F.col("doc.lang")).otherwise("other"),
        }
    )


def _log_factorial(x: Column) -> Column:
    small = F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))
    z = F.greatest(x, F.lit(1)).cast("double")
    series = z * F.log(z) - z + 0.5 * F.log(2 * math.pi * z) + 1 / (12 * z) - 1 / (360 * z * z * z)
    return F.when(x <= 20, small).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float | Column) -> Column:
    """P(X <= k) for X of n trials at p, where k < n * p; else 1. Summed from k down by the ratio of
    neighbouring terms, which falls below any rounding within some 40 standard deviations, or sooner if the
    first ratio is small."""
    given = F.struct(k.cast("long").alias("k"), n.cast("long").alias("n"), (p if isinstance(p, Column) else F.lit(p)).alias("p"))
    return F.transform(F.array(given), lambda x: _binomial_tail(x["k"], x["n"], x["p"])).getItem(0)


def _binomial_tail(k: Column, n: Column, p: Column) -> Column:
    log_term = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(p) + (n - k) * F.log1p(-p)
    ratio = k * (1 - p) / ((n - k + 1) * p)
    terms = F.least(k, F.ceil(50 + 40 * F.sqrt(n * p)), F.when(ratio < 1, F.ceil(2 - 40 / F.log(ratio))).otherwise(0))
    state = F.struct(F.lit(1.0).alias("total"), F.lit(1.0).alias("term"))

    def add(a: Column, j: Column) -> Column:
        i = k - j
        term = a["term"] * i / (n - i + 1) * ((1 - p) / p)
        return F.struct((a["total"] + term).alias("total"), term.alias("term"))

    steps = F.when(terms > 0, F.sequence(F.lit(0).cast("long"), terms - 1)).otherwise(F.array().cast("array<long>"))
    total = F.aggregate(steps, state, add, lambda a: a["total"])
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(log_term) * total)


def least_labels(risk: float, delta: float) -> int:
    """Good documents that a stratum needs for a promise if none of them is rejected."""
    return math.ceil(math.log(delta / (len(STRATA) + 1)) / math.log1p(-risk))


def cutoffs(
    rows: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA
) -> DataFrame:
    """(stratum, step, rates' cutoffs): the last step of PATH that holds in each stratum that has one;
    rows(doc_id, stratum, rates, base_failed), which should be a table, as measures aren't cheap."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"))
    held = rows.where("NOT base_failed").join(good.where("q = 1"), "doc_id", "left_semi")

    def rejected(step: tuple[float, ...]) -> Column:
        bad = F.lit(False)
        for rule, cutoff in zip(GRID, step):
            bad = bad | (F.col(rule) > cutoff)
        return bad

    counts = [F.count_if(rejected(step)).alias(f"k{i}") for i, step in enumerate(PATH)]
    counted = held.groupBy("stratum").agg(F.count("*").alias("n"), *counts)
    own = F.when(F.col("n") >= least_labels(risk, delta), F.col("stratum")).otherwise("together")
    group = Window.partitionBy(own)
    pooled = counted.select(
        "stratum",
        F.sum("n").over(group).alias("n"),
        F.array(*(F.sum(f"k{i}").over(group) for i in range(len(PATH)))).alias("ks"),
    )
    holds = F.transform("ks", lambda k: binomial_tail(k, F.col("n"), risk) <= delta / (len(STRATA) + 1))
    first = F.array_position(holds, False)
    step = F.when(first == 0, len(PATH)).otherwise(first - 1).cast("int")
    values = F.array(*(F.array(*map(F.lit, step)) for step in PATH))
    found = pooled.select("stratum", step.alias("step")).where("step > 0")
    return found.select("stratum", "step", F.element_at(values, F.col("step")).alias("c")).select(
        "stratum", "step", *(F.col("c")[i].alias(rule) for i, rule in enumerate(GRID))
    )


def verdict(chosen: DataFrame) -> Column:
    """Whether a measured document is kept. The chosen cutoffs are a bounded table: a row per stratum at
    most."""
    bad = F.col("base_failed")
    for row in chosen.collect():
        for rule in GRID:
            bad = bad | ((F.col("stratum") == row["stratum"]) & (F.col(rule) > row[rule]))
    return ~bad


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("stratum", *GRID)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, measures, base_failed, kept): a row per row of docs."""
    rows = measured(docs).select(
        "doc.doc_id", *(F.col(c).cast("long") for c in COUNTS), "base_failed", *RATES
    )
    rows, _ = cut(rows, "quality")
    return rows.select("doc_id", *COUNTS, "base_failed", verdict(cutoffs(rows, labels)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rejected ones. Measures are taken twice rather than texts moved between tasks.

    The row number keeps the filter above the measures: pushed below them, it would repeat them all.
    """
    slim, path = cut(measured(docs.select("doc_id", "text", "lang")).select("doc.doc_id", "base_failed", *RATES), "quality")
    keep = verdict(cutoffs(slim, labels))
    drop_path(docs.sparkSession, path)
    rows = measured(docs).withColumn("row", F.monotonically_increasing_id())
    return rows.where(keep & (F.col("row") >= 0)).select("doc.*")
