"""Suffix-array dedup (operator 10): passages of `length` bytes that start more than once.

A suffix array of the whole corpus would move every suffix. Content decides instead which suffixes can
be equal: the anchor of a window of `length` bytes is its smallest hash over grams of GRAM bytes, so
that equal windows have equal anchors. Consecutive windows with one anchor form a segment, about 170
bytes long, and only segments whose anchor occurs again go on:

1. Each document's segments are found where it is read: (anchor, hash of the segment's bytes).
2. Anchors that occur once are dropped. Equal segments are counted (combined before the shuffle), so
   that thousands of copies of a passage become one segment with a count: all its windows repeat.
3. Anchors with several different segments: one text of each goes to the shard of its anchor, where a
   suffix array over the window starts is built by prefix doubling, up to `length`. Windows with a
   common prefix of `length` are neighbours there. The longest previous factor of a start reaches
   `length` just where the previous or the next smaller position in suffix order lies in the same run
   of such neighbours; the first position of a run is the one that has neither.
4. Shards with more than MOST different segments (a passage in very many surroundings) are cut by what
   lies around the anchor: windows whose anchors lie WIDTH bytes apart at most share a core, and go to
   the shard of that core. There too equal surroundings are counted, and only where different ones
   share a core are the windows of one of each compared, by count.

keep="first" removes later copies and keeps the first by (doc_id, place); keep="none" removes all. A span
tells whether it holds later copies, so one search serves both. Strings of `length` bytes that repeat lie
within the repeated passages of any smaller length, so a second search for longer ones reads those alone.

Cases: null and empty texts have no windows and stay; texts below `length` bytes stay; rows that agree
in doc_id and text count as documents of their own with keep="none" and share one fate with "first";
a null doc_id comes first in order; an empty table gives no rows; other columns are kept. Removing
bytes may cut a character of several bytes; the digests are over bytes, and texts drop such remains.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_path

#: Bytes of a gram.
GRAM = 64
#: Bytes of a passage that the pipeline removes: less than any 51 words of prose.
PASSAGE = 220
#: Different segments that share a shard, at most.
MOST = 512
#: Offsets that share a core.
WIDTH = 20
#: Bytes whose windows or suffixes a task handles at once, at least.
CHUNK = 1 << 20

LOWEST = -(2**63)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Grams:
    """Hashes of all grams of a byte array: a polynomial over the integers modulo 2^64."""

    def __init__(self, size: int):
        self.size = size
        with np.errstate(over="ignore"):
            self.values = _mixed(np.arange(1, 257, dtype=np.uint64) * _PRIME)
            self.powers = np.cumprod(np.full(size, _PRIME, dtype=np.uint64))
            inverse = np.uint64(pow(int(_PRIME), -1, 2**64))
            self.inverses = np.cumprod(np.full(size, inverse, dtype=np.uint64))

    def __call__(self, data: np.ndarray, gram: int) -> np.ndarray:
        n = len(data)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])
            return _mixed((sums[gram:] - sums[:-gram]) * self.inverses[: n + 1 - gram])


_grams: list[Grams] = []


def grams(data: np.ndarray, gram: int) -> np.ndarray:
    if not _grams or _grams[0].size < len(data):
        _grams[:] = [Grams(max(len(data), CHUNK + CHUNK // 4))]
    return _grams[0](data, gram)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    if width == 1 or n < width:
        return x[: max(0, n - width + 1)]
    full = np.full((n + width - 1) // width * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    full[:n] = x
    rows = full.reshape(-1, width)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def segments(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For texts of `length` bytes or more: (text's number, first start, starts, offset of the anchor,
    hash of the anchor, hash of the bytes that the segment's windows cover)."""
    from xxhash import xxh3_64_digest

    whole = b"".join(texts)
    data = np.frombuffer(whole, dtype=np.uint8)
    sizes = np.asarray([len(x) for x in texts], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    hashes = grams(data, gram)
    place = np.uint64((1 << 28) - 1)
    keys = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_min(keys, length - gram + 1) & place).astype(np.int64)
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(texts)), windows)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows - begin, windows)
    anchor = anchor[starts]
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    count = np.diff(np.r_[first, len(owner)])
    lo = starts[first]
    ends = lo + count - 1 + length
    covers = np.frombuffer(
        b"".join([xxh3_64_digest(whole[i:j]) for i, j in zip(lo.tolist(), ends.tolist())]), dtype=">u8"
    )
    own = owner[first]
    return own, lo - begin[own], count, anchor[first] - lo, hashes[anchor[first]], covers


def _slices(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """Parts of a very long text that together have all its windows once."""
    if len(text) <= CHUNK:
        yield 0, text
        return
    for at in range(0, len(text) - length + 1, CHUNK - length + 1):
        yield at, text[at : at + CHUNK]


def _keyed(docs: DataFrame) -> DataFrame:
    """Whole rows as a struct `doc`, so that no column clashes, with their key and text."""
    return docs.select(
        F.struct("*").alias("doc"),
        "text",
        F.coalesce("doc_id", F.lit(LOWEST)).alias("_key"),
        F.shiftright(F.xxhash64(F.coalesce("text", F.lit(""))), 32).cast("int").alias("_hash"),
    )


PLACE = "lo:int,hi:int,later:boolean"
OCCURRENCES = "anchor long, cover long, _key long, _hash int, lo int, n int, off int"


def occurrences(keyed: DataFrame, length: int, gram: int, within: DataFrame | None = None) -> DataFrame:
    """A row per segment of each document, or of those parts of it that the spans of `within` cover."""
    rows = keyed.select("_key", "_hash", "text", F.lit(None).cast(f"array<struct<{PLACE}>>").alias("_spans"))
    if within is not None:
        rows = rows.drop("_spans").join(within, ["_key", "_hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            own, lo, n, off, anchor, cover = segments([x[3] for x in held], length, gram)
            key, hashed, shift = (np.asarray([x[k] for x in held], dtype=np.int64)[own] for k in range(3))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor.view(np.int64)),
                    pa.array(cover.astype(np.uint64).view(np.int64)),
                    pa.array(key),
                    pa.array(hashed.astype(np.int32)),
                    pa.array((lo + shift).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                    pa.array(off.astype(np.int32)),
                ],
                names=["anchor", "cover", "_key", "_hash", "lo", "n", "off"],
            )

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("_key", "_hash", "text", "_spans")))
            for key, hashed, text, spans in rows:
                data = (text or "").encode()
                parts = [(0, len(data))] if spans is None else merged([(x["lo"], x["hi"]) for x in spans])
                for lo, hi in parts:
                    if hi - lo < length:
                        continue
                    for at, part in _slices(data[lo:hi], length):
                        held.append((key, hashed, lo + at, part))
                        size += len(part)
                        if size >= CHUNK:
                            yield flush()
                            held.clear()
                            size = 0
        if held:
            yield flush()

    return rows.select("_key", "_hash", "text", "_spans").mapInArrow(run, OCCURRENCES)


def window_runs(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix order of the starts of all whole windows of the texts, up to `length` bytes.

    Gives (text's number, start within it, run) in suffix order; starts in a run share `length` bytes,
    and are in order of text and place. Ranks by prefixes of 8 bytes are doubled up to the length.
    """
    sizes = np.asarray([len(x) for x in texts], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(texts)), windows)
    starts = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows - begin, windows)
    data = np.frombuffer(b"".join(texts) + bytes(8), dtype=np.uint8)
    n = len(data) - 8
    key = np.zeros(n, dtype=np.uint64)
    depth = min(8, length)
    for j in range(depth):
        key = (key << np.uint64(8)) | data[j : j + n]

    def ranked(x: np.ndarray) -> np.ndarray:
        order = np.argsort(x)
        x = x[order]
        rank = np.empty(len(x), dtype=np.uint64)
        rank[order] = np.cumsum(np.r_[False, x[1:] != x[:-1]]).astype(np.uint64)
        return rank

    rank = ranked(key)
    while 2 * depth < length:
        after = np.zeros(n, dtype=np.uint64)
        after[: n - depth] = rank[depth:]
        rank = ranked((rank << np.uint64(32)) | after)
        depth *= 2
    last = rank[starts]
    if depth < length:
        last = ranked((last << np.uint64(32)) | rank[starts + (length - depth)])
    order = np.argsort(last, kind="stable")
    run = np.cumsum(np.r_[False, last[order][1:] != last[order][:-1]])
    return owner[order], (starts - begin[owner])[order], run


def longest_previous_factor(data: bytes) -> np.ndarray:
    """For each place the length of the longest string that starts there and at an earlier place.

    The exact array of one text: suffix array, common prefixes of neighbours, and previous and next
    smaller positions in suffix order with a stack.
    """
    n = len(data)
    rank, step = np.frombuffer(data, dtype=np.uint8).astype(np.int64), 1
    while n and step < n:
        after = np.full(n, -1)
        after[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 257) + after, return_inverse=True)[1]
        step *= 2
    order = np.argsort(rank, kind="stable") if n else np.zeros(0, np.int64)
    place = np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    common, h = [0] * (n + 1), 0
    for i in range(n):
        if place[i]:
            j = order[place[i] - 1]
            while i + h < n and j + h < n and data[i + h] == data[j + h]:
                h += 1
            common[place[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    out = np.zeros(n, dtype=np.int64)
    stack: list[tuple[int, int]] = []  # (position, common prefix with the one below)
    for r in range(n + 1):
        i, shared = (int(order[r]), common[r]) if r < n else (-1, 0)
        while stack and stack[-1][0] > i:
            top, below = stack.pop()
            out[top] = max(below, shared)
            shared = min(shared, below)
        stack.append((i, shared))
    return out


def _spans(lo: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the runs of consecutive window starts, which are in order."""
    first = np.r_[True, lo[1:] != lo[:-1] + 1]
    return lo[first], lo[np.r_[first[1:], True]] + length


SPANS = "_key long, _hash int, lo int, hi int, later boolean"


def _shard_spans(rows: DataFrame, length: int, keep: str) -> DataFrame:
    """Spans that suffix arrays over the shards find; rows(anchor, _key, _hash, lo, want, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            own, at, runs = window_runs([x[5] for x in rows], length)
            later = np.r_[False, runs[1:] == runs[:-1]]
            hit = later if keep == "first" else later | np.r_[later[1:], False]
            hit = hit & np.asarray([x[4] for x in rows])[own]
            own, at, later = own[hit], at[hit], later[hit]
            order = np.lexsort((at, own, later))
            own, at, later = own[order], at[order], later[order]
            out: list[tuple] = []
            parts = np.flatnonzero((own[1:] != own[:-1]) | (later[1:] != later[:-1])) + 1
            for k in np.split(np.arange(len(own)), parts):
                if len(k):
                    x = rows[own[k[0]]]
                    for i, j in zip(*_spans(at[k], length)):
                        out.append((x[1], x[2], x[3] + int(i), x[3] + int(j), bool(later[k[0]])))
            if out:
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], names=["_key", "_hash", "lo", "hi", "later"]
                )

        for batch in batches:
            columns = ("anchor", "_key", "_hash", "lo", "want", "bytes")
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if held and held[-1][:4] == row[:4]:
                    continue  # a row that repeats another in doc_id and text
                if size >= CHUNK // 2 and row[0] != held[-1][0]:
                    yield from flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield from flush(held)

    dealt = rows.repartition("anchor").sortWithinPartitions("anchor", "_key", "_hash", "lo")
    return dealt.mapInArrow(run, SPANS)


def _core_spans(cores: DataFrame, length: int, keep: str) -> DataFrame:
    """Spans of windows that share a core; cores(core, cover, _key, _hash, lo, windows).

    As with segments, equal covers are counted first: all windows of a cover that occurs again repeat.
    Only one of each different cover has its windows compared, by count.
    """
    place = F.struct("_key", "_hash", "lo", "windows")
    each = cores.groupBy("core", "cover").agg(F.count("*").alias("m"), F.min(place).alias("p0"))
    each, _ = cut(each, "cores")
    again = each.where("m > 1").select("core", "cover", "p0")
    here = F.struct("_key", "_hash", "lo")
    copies = cores.join(again, ["core", "cover"]).select(
        "_key",
        "_hash",
        "lo",
        (F.col("lo") + F.size("windows") + (length - 1)).alias("hi"),
        (here != F.struct("p0._key", "p0._hash", "p0.lo")).alias("later"),
    )
    several, _ = cut(each.groupBy("core").agg(F.count("*").alias("covers")).where("covers > 1").select("core"), "several")
    single = each.join(several, "core", "left_semi").select(
        "core", "m", "p0._key", "p0._hash", "p0.lo", F.posexplode("p0.windows").alias("i", "window")
    )
    single = single.select("core", "window", "m", "_key", "_hash", (F.col("lo") + F.col("i")).alias("lo"))
    found = single.groupBy("core", "window").agg(F.count("*").alias("n"), F.min(here).alias("first")).where("n > 1")
    found, _ = cut(found, "windows")
    found = single.join(found, ["core", "window"])
    found = found.where("m = 1") if keep == "none" else found
    later = (here != F.col("first")).alias("later")
    found = found.select("_key", "_hash", "lo", (F.col("lo") + length).alias("hi"), later)
    return _united([copies, found], keep)


def _united(found: list[DataFrame], keep: str) -> DataFrame:
    """The spans that `keep` asks for. Each part is a table of its own, so that adaptive execution can split
    its hot keys whatever stands beside it."""
    parts = [cut(x.where("later") if keep == "first" else x, "spans")[0] for x in found]
    return functools.reduce(DataFrame.unionByName, parts)


def _texts(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of the wanted segments, and the cores of those in crowded shards."""
    from xxhash import xxh3_64_intdigest

    listed = wanted.groupBy("_key", "_hash").agg(
        F.collect_list(F.struct("anchor", "lo", "n", "off", "want", "crowded")).alias("wanted")
    )
    rows = keyed.select("_key", "_hash", "text").join(listed, ["_key", "_hash"])
    rows = rows.select("_key", "_hash", "text", "wanted")

    def signed(x: int) -> int:
        return x - (1 << 64) if x >> 63 else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for key, hashed, text, wanted in zip(
                *(batch.column(c).to_pylist() for c in ("_key", "_hash", "text", "wanted"))
            ):
                data = text.encode()
                for w in wanted:
                    lo, n = w["lo"], w["n"]
                    if not w["crowded"]:
                        out.append((w["anchor"], 0, key, hashed, lo, w["want"], data[lo : lo + n - 1 + length], None))
                        continue
                    a = lo + w["off"]
                    offsets = range(w["off"], w["off"] - n, -1)
                    for j in range(offsets[-1] // WIDTH, offsets[0] // WIDTH + 1):
                        i0 = a - min(offsets[0], j * WIDTH + WIDTH - 1)
                        i1 = a - max(offsets[-1], j * WIDTH)
                        core = data[a - j * WIDTH : a - (j * WIDTH + WIDTH - 1) + length]
                        seed = (w["anchor"] + j) & 0x7FFFFFFFFFFFFFFF
                        windows = [signed(xxh3_64_intdigest(data[i : i + length])) for i in range(i0, i1 + 1)]
                        cover = signed(xxh3_64_intdigest(data[i0 : i1 + length], i0 - a + (1 << 20)))
                        out.append(
                            (signed(xxh3_64_intdigest(core, seed)), cover, key, hashed, i0, w["want"], None, windows)
                        )
                if len(out) >= 2000:
                    yield batched(out)
                    out = []
        if out:
            yield batched(out)

    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.int64()))
    names = ("anchor", "cover", "_key", "_hash", "lo", "want", "bytes", "windows")

    def batched(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=list(names))

    return rows.mapInArrow(
        run,
        "anchor long, cover long, _key long, _hash int, lo int, want boolean, bytes binary, windows array<long>",
    )


def repeated_spans(
    docs: DataFrame, length: int = 400, keep: str = "first", gram: int | None = None, within: DataFrame | None = None
) -> DataFrame:
    """(_key, _hash, lo, hi, later): byte spans that repeat, as yet not merged. keep="first" gives those of later
    copies; "none" all, where only their union counts; "both" all, where each window is told first or later.
    within(_key, _hash, _spans) bounds what is searched; all copies of what it holds must lie in it."""
    spark = docs.sparkSession
    keyed = _keyed(docs)
    gram = gram or min(GRAM, length // 4)
    all_of, path = cut(occurrences(keyed, length, gram, within), "segments")
    groups = (
        all_of.groupBy("anchor")
        .agg(F.count("*").alias("m"), F.min("cover").alias("c0"), F.max("cover").alias("c1"))
        .where("m > 1")
        .select("anchor", (F.col("c0") < F.col("c1")).alias("several"))
    )
    # As a table of its own, so that the join has its own exchanges and its hot anchors can be split.
    groups, groups_path = cut(groups, "anchors")
    some, some_path = cut(all_of.join(groups, "anchor"), "shared")
    drop_path(spark, path)
    drop_path(spark, groups_path)
    place = F.struct("_key", "_hash", "lo", "n", "off")
    each = some.groupBy("anchor", "cover", "several").agg(F.count("*").alias("m"), F.min(place).alias("p0"))
    each, each_path = cut(each, "covers")
    again = each.where("m > 1").select("anchor", "cover", "p0")
    copies = some.join(again, ["anchor", "cover"]).select(
        "_key",
        "_hash",
        "lo",
        (F.col("lo") + F.col("n") + (length - 1)).alias("hi"),
        (F.struct("_key", "_hash", "lo") != F.struct("p0._key", "p0._hash", "p0.lo")).alias("later"),
    )
    several = each.where("several")
    crowd = several.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > MOST)
    crowd, _ = cut(crowd.select("anchor", F.lit(True).alias("crowded")), "crowded")
    wanted = several.join(crowd, "anchor", "left").select(
        "anchor",
        "p0.*",
        (F.lit(keep != "none") | (F.col("m") == 1)).alias("want"),
        F.coalesce("crowded", F.lit(False)).alias("crowded"),
    )
    texts, texts_path = cut(_texts(keyed, wanted, length), "texts")
    shards = _shard_spans(texts.where("bytes IS NOT NULL").select("anchor", "_key", "_hash", "lo", "want", "bytes"), length, keep)
    cores = texts.where("windows IS NOT NULL").select(
        F.col("anchor").alias("core"), "cover", "_key", "_hash", "lo", "windows"
    )
    spans = _united([copies, shards], keep).unionByName(_core_spans(cores, length, keep))
    for p in (some_path, each_path, texts_path):
        drop_path(spark, p)
    return spans


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _listed(spans: DataFrame) -> DataFrame:
    return spans.groupBy("_key", "_hash").agg(F.collect_list(F.struct("lo", "hi", "later")).alias("_spans"))


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    rows = _keyed(docs).join(_listed(spans), ["_key", "_hash"], "left")
    return rows.select("doc", F.col("doc.text").alias("text"), "_spans")


def _kept(text: str | None, spans: list | None) -> tuple[bytes, list[tuple[int, int]], int]:
    data = (text or "").encode()
    runs = merged([(x["lo"], x["hi"]) for x in spans]) if spans else []
    at, parts = 0, []
    for lo, hi in runs:
        parts.append(data[at:lo])
        at = hi
    parts.append(data[at:])
    return b"".join(parts), runs, len(data)


def removal_digests(docs: DataFrame, length: int = 400, keep: str = "none", passage: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): a row per row of docs.

    With `passage`, at most `length`: also the text without later copies of passages of so many bytes, as
    remove_repeats() gives it. The search for `length` then reads what that for `passage` has found.
    """
    if passage is None:
        spans = repeated_spans(docs, length, keep)
    elif passage > length:
        raise ValueError("passages are no longer than `length`")
    else:
        shorter = repeated_spans(docs, passage, "both")
        wide = shorter.groupBy("_key", "_hash").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        wide = wide.where(F.col("hi") - F.col("lo") >= length).select("_key", "_hash")
        within, _ = cut(_listed(shorter.join(wide, ["_key", "_hash"], "left_semi")), "within")
        # `later` now tells the passages' spans from the others.
        spans = repeated_spans(docs, length, keep, within=within).withColumn("later", F.lit(False))
        spans = spans.unionByName(shorter.where("later"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist()):
                spans = spans or []
                rows.append(_kept(text, spans if passage is None else [x for x in spans if not x["later"]]))
                if passage is not None:
                    later = [x for x in spans if x["later"]]
                    texts.append(_kept(text, later)[0].decode("utf-8", "ignore") if later else text)
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_bytes": pa.array([n for _, _, n in rows], pa.int64()),
                "n_removed": pa.array([n - len(k) for k, _, n in rows], pa.int64()),
                "n_spans": pa.array([len(r) for _, r, _ in rows], pa.int64()),
                "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k, _, _ in rows], pa.string()),
            }
            yield pa.RecordBatch.from_pydict(columns | ({} if passage is None else {"text": pa.array(texts, pa.string())}))

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return _with_spans(docs, spans).select("doc.doc_id", "text", "_spans").mapInArrow(
        run, schema + ("" if passage is None else ", text string")
    )


def remove_repeats(docs: DataFrame, length: int = 400, keep: str = "first") -> DataFrame:
    """docs with the repeated bytes taken out of `text`; a null text stays null.

    The remains of a character that was cut are dropped; n_chars, where docs has it, is counted anew.
    """
    @F.pandas_udf("string")
    def kept(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series(
            [
                t if t is None or s is None else _kept(t, list(s))[0].decode("utf-8", "ignore")
                for t, s in zip(text, spans)
            ],
            dtype=object,
        )

    out = _with_spans(docs, repeated_spans(docs, length, keep))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(kept("text", "_spans")).alias("text")
    out = out.select(*(text if c == "text" else F.col(f"doc.`{c}`") for c in docs.columns))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        count = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind)
        out = out.withColumn("n_chars", count)
    return out
