"""Secret scans (operator 1): fixed patterns and a randomness test battery. DataFrame functions only.

Base spans are the matches of three fixed patterns. The method adds tokens of TOKEN that look drawn at
random. For each, the smallest encoding that holds it is inferred, and three tests ask whether its
symbols are uniform and independent: chi-squared over the alphabet (by the Wilson-Hilferty cube root),
runs above and below the alphabet's middle, and lag-one serial correlation. A token that fails one at the
CRITICAL value, Bonferroni-corrected for three tests, isn't random.

Passing is not enough, as short tokens pass easily. A token counts as found only if it also rejects its
encoding's null of structured text (NULLS), by the same statistics: chi-squared, which is the number of
equal pairs of symbols, against symbols that repeat as those of words and numbers do; and runs, which is
the number of changes between small letters, capitals, digits and the rest (between halves of the
alphabet for digits alone, and none for letters of one case), against text that seldom changes. Each gives
an exact binomial tail, and Fisher's method one p-value of both. Serial correlation has no such null, as
structured text may have none, and only vetoes.

Benjamini-Hochberg at level FDR runs per encoding and length class (by powers of two) over all tokens of
the corpus: per class and step of a tenth of a decade the tokens are counted, which gives a table of
bounded size, and the largest p-value that holds is the class's cutoff, rounded to the strict side.

Cases: a null text is empty; texts without matches have no spans; repeated rows give equal rows; an
empty table gives none; ids may be null; other columns are ignored by scan() and kept by redact().
Spans are in code points, the end exclusive, and of whole matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_path
from .quality import binomial_tail

#: Base patterns, in the order in which spans with equal starts are listed (fixed values of the contract).
ASSIGN = (
    r"""(?:(?i)password|passwd|secret|token|api_?key(?-i))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")
#: Candidates of the battery: runs of base64 characters of either alphabet.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Two-sided normal value of 0.01 / 3.
CRITICAL = 2.935
#: Level of false discoveries.
FDR = 0.05
#: Alphabets by size (fixed values), as patterns of their tokens and in order of their symbols. Hex, letters and
#: base36 come in either case.
ALPHABETS = {
    10: ("^[0-9]+$", "0123456789"),
    16: ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    26: ("^([a-z]+|[A-Z]+)$", "abcdefghijklmnopqrstuvwxyz"),
    32: ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    36: ("^([a-z0-9]+|[A-Z0-9]+)$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    64: ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
#: Structured text of each encoding: the chance that two symbols are equal, at least, and that neighbours change,
#: at most (random ones: 1 / size, and 0.5, 0.47, -, 0.3, 0.4 and 0.6).
NULLS = {10: (0.15, 0.25), 16: (0.1, 0.2), 26: (0.055, 0.0), 32: (0.06, 0.12), 36: (0.055, 0.15), 64: (0.045, 0.25)}
HIGHEST_CLASS, STEPS = 16, 400


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once."""
    return F.transform(F.array(value), body).getItem(0)


def matches(pattern: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Array of (start, end, text) of a pattern's matches in column t, leftmost and not overlapping.

    The pieces between matches give the places; a match that `keep` rejects still takes its room.
    """
    each = F.zip_with(
        F.split("t", pattern, -1),
        F.regexp_extract_all("t", F.lit(pattern), F.lit(0)),
        lambda gap, text: F.struct(
            F.length(gap).alias("gap"),
            text.alias("text"),
            (keep(text) if keep else text.isNotNull()).alias("ok"),
        ),
    )
    empty = F.array().cast("array<struct<s:int,e:int,x:string>>")

    def add(a: Column, m: Column) -> Column:
        s = a["at"] + m["gap"]
        e = s + F.length(m["text"])
        one = F.array(F.struct(s.alias("s"), e.alias("e"), m["text"].alias("x")))
        return F.struct(
            F.coalesce(e, s).alias("at"), F.when(m["ok"], F.concat(a["out"], one)).otherwise(a["out"]).alias("out")
        )

    found = F.aggregate(each, F.struct(F.lit(0).alias("at"), empty.alias("out")), add, lambda a: a["out"])
    return F.when(F.col("t").rlike(pattern), found).otherwise(empty)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _next(a: Column, f: Callable[[Column, Column], Column]) -> Column:
    n = F.size(a) - 1
    return F.zip_with(F.slice(a, 1, n), F.slice(a, 2, n), f)


def _of_size(size: Column, values: dict[int, object]) -> Column:
    out = F.lit(values[64])
    for n in sorted(values, reverse=True)[1:]:
        out = F.when(size == n, F.lit(values[n])).otherwise(out)
    return out


def _battery(size: Column, x: Column) -> Column:
    """For the indices x over an alphabet of `size`: whether they pass, their equal pairs, and the changes
    between the halves of the alphabet."""
    n = F.size(x).cast("double")
    df = size - 1.0
    square = _total(
        F.transform(F.array_distinct(x), lambda d: F.pow(F.size(F.filter(x, lambda y: y == d)).cast("double"), 2))
    )
    high = _total(F.transform(x, lambda y: F.when(2 * y >= size, 1.0).otherwise(0.0)))
    changes = _total(_next(x, lambda a, b: F.when((2 * a >= size) != (2 * b >= size), 1.0).otherwise(0.0)))
    mean = _total(F.transform(x, lambda a: a.cast("double"))) / n

    def judged(v: Column) -> Column:
        chi = (F.pow((v["square"] * size / n - n) / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        both = 2 * v["high"] * (n - v["high"])
        spread = both * (both - n) / (n * n * (n - 1))
        runs = F.when(spread > 0, F.abs(v["changes"] - both / n) / F.sqrt(spread)).otherwise(math.inf)
        over = _total(_next(x, lambda a, b: (a - v["mean"]) * (b - v["mean"])))
        under = _total(F.transform(x, lambda a: (a - v["mean"]) * (a - v["mean"])))
        serial = F.when(under > 0, F.abs(over / under) * F.sqrt(n)).otherwise(math.inf)
        return F.struct(
            ((chi <= CRITICAL) & (runs <= CRITICAL) & (serial <= CRITICAL)).alias("ok"),
            ((v["square"] - n) / 2).alias("equal"),
            v["changes"].alias("changes"),
        )

    return let(F.struct(square.alias("square"), high.alias("high"), changes.alias("changes"), mean.alias("mean")), judged)


def _structured(size: Column, n: Column, equal: Column, changed: Column) -> Column:
    """The p-value of the null of structured text: Fisher's of pairs and changes, or that of pairs alone."""
    rate = _of_size(size, {k: v[1] for k, v in NULLS.items()})
    pairs = binomial_tail(equal, n * (n - 1) / 2, _of_size(size, {k: v[0] for k, v in NULLS.items()}))
    turns = binomial_tail(n - 1 - changed, n - 1, 1 - rate)
    both = let(F.greatest(pairs * turns, F.lit(1e-60)), lambda x: x * (1 - F.log(x)))
    return F.when(size == 26, pairs).otherwise(both)


def _tested(m: Column) -> Column:
    """Candidate with its class, its score (minus ten times the p-value's logarithm) and verdict."""
    text = m["x"]
    chars = F.split(F.translate(text, "-_", "+/"), "")
    size = F.lit(64)
    for n, (pattern, _) in reversed(ALPHABETS.items()):
        size = F.when(text.rlike(pattern), n).otherwise(size) if pattern else size

    def index(a: Column, cs: Column) -> Column:
        where = _of_size(a, {n: x for n, (_, x) in ALPHABETS.items()})
        folded = a.isin(16, 26, 36)
        return F.transform(cs, lambda c: F.instr(where, F.when(folded, F.lower(c)).otherwise(c)).cast("int") - 1)

    def sort(c: Column) -> Column:
        return F.when(c.rlike("[a-z]"), 0).when(c.rlike("[A-Z]"), 1).when(c.rlike("[0-9]"), 2).otherwise(3)

    def verdict(a: Column, cs: Column, b: Column) -> Column:
        classes = _total(_next(F.transform(cs, sort), lambda x, y: F.when(x != y, 1.0).otherwise(0.0)))
        changed = F.when(a == 10, b["changes"]).otherwise(classes)
        p = let(changed, lambda c: _structured(a, F.size(cs).cast("double"), b["equal"], c))
        score = F.least(F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-40)))), F.lit(STEPS))
        group = 32 * a + F.least(F.floor(F.log2(F.length(text).cast("double"))), F.lit(HIGHEST_CLASS))
        return F.struct(
            m["s"].alias("s"), m["e"].alias("e"), group.cast("int").alias("group"), score.cast("int").alias("score"),
            b["ok"].alias("ok"),
        )

    return let(
        size,
        lambda a: let(
            chars, lambda cs: let(let(index(a, cs), lambda x: _battery(a.cast("double"), x)), lambda b: verdict(a, cs, b))
        ),
    )


def _of_kind(found: Column, k: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["s"].alias("s"), F.lit(k).alias("k"), m["e"].alias("e")))


def spans(docs: DataFrame) -> DataFrame:
    """docs as a struct `doc`, with `base` (start, kind, end) and `tokens`, the tested candidates."""
    out = docs.select(F.struct("*").alias("doc"), F.coalesce("text", F.lit("")).alias("t"))
    long_value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 8
    out = out.select(
        "doc", "t", matches(ASSIGN, long_value).alias("m0"), matches(ACCESS).alias("m1"), matches(HEX).alias("m2")
    )
    base = F.concat(*(_of_kind(F.col(f"m{k}"), k) for k in range(3)))
    out = out.select("doc", "t", F.sort_array(base).alias("base"))
    out = out.select("doc", "t", "base", matches(TOKEN).alias("found"))
    free = F.filter("found", lambda m: ~F.exists("base", lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])))
    return out.select("doc", "t", "base", free.alias("found")).select(
        "doc", "t", "base", F.transform("found", _tested).alias("tokens")
    )


def limits(rows: DataFrame) -> DataFrame:
    """(group, least): the lowest score that is a discovery in each class; rows(tokens)."""
    counts = (
        rows.select(F.explode("tokens").alias("x")).groupBy("x.group", "x.score").agg(F.count("*").alias("n"))
    )
    all_of = Window.partitionBy("group")
    down = all_of.orderBy(F.desc("score"))
    steps = counts.select("group", "score", F.sum("n").over(down).alias("found"), F.sum("n").over(all_of).alias("m"))
    holds = F.pow(F.lit(10.0), -F.col("score") / 10.0) * F.col("m") <= FDR * F.col("found")
    return steps.where(holds).groupBy("group").agg(F.min("score").alias("least"))


def _found(chosen: DataFrame) -> Column:
    """The discoveries as spans. The chosen limits are a bounded table: a row per class."""
    rows = chosen.collect()
    if not rows:
        return F.array().cast("array<struct<s:int,k:int,e:int>>")
    least = F.create_map(*(F.lit(x) for row in rows for x in (row["group"], row["least"])))
    real = F.filter("tokens", lambda x: x["ok"] & F.coalesce(x["score"] >= least[x["group"]], F.lit(False)))
    return _of_kind(real, 3)


def _written(a: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(a, lambda m: F.concat_ws(":", F.element_at(names, m["k"] + 1), m["s"], m["e"])), ","
    )


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random): a row per row of docs."""
    rows, _ = cut(spans(docs.select("doc_id", "text")).select("doc.doc_id", "base", "tokens"), "secrets")
    out = rows.select("doc_id", "base", F.sort_array(F.concat("base", _found(limits(rows)))).alias("all"))

    def count(k: int) -> Column:
        return F.size(F.filter("all", lambda m: m["k"] == k)).cast("long")

    return out.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(_written("base"), 256).alias("base_sha256"),
        _written("all").alias("spans"),
        count(3).alias("n_random"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of `text` replaced by a mark, overlapping spans by one; a null text stays
    null; n_chars, where docs has it, is counted anew. Texts are scanned twice rather than moved."""
    slim, path = cut(spans(docs.select("text")).select("tokens"), "secrets")
    found = limits(slim)
    found_here = _found(found)
    drop_path(docs.sparkSession, path)
    rows = spans(docs).select("doc", "t", F.sort_array(F.concat("base", found_here)).alias("all"))

    def add(a: Column, m: Column) -> Column:
        gap = F.substring(F.col("t"), a["at"] + 1, F.greatest(m["s"] - a["at"], F.lit(0)))
        new = m["s"] >= a["at"]
        return F.struct(
            F.greatest(a["at"], m["e"]).alias("at"),
            F.when(new, F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.aggregate(
        "all", start, add, lambda a: F.concat(a["out"], F.substring(F.col("t"), a["at"] + 1, F.lit(2**31 - 1)))
    )
    changed = F.size("all") > 0
    out = rows.select("doc", F.when(changed, text).alias("new"))
    columns = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    for i, c in enumerate(docs.columns):
        if c == "text":
            columns[i] = F.coalesce("new", "doc.text").alias(c)
        if c == "n_chars":
            kind = docs.schema[c].dataType
            columns[i] = F.coalesce(F.length("new").cast(kind), F.col("doc.n_chars")).alias(c)
    return out.select(*columns)
