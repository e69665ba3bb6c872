"""Near copies (the pipeline's near_dedup): 5-word shingles with a Jaccard similarity of 0.8 or more.

Words are those of operator 4. A document is the set of its shingles' XXH64; documents with equal sets
are one node. Nodes link if their sets' exact Jaccard similarity is 4/5 at least, and a group is what
links reach.

Plan: operator 4 comes first. Sets have SimHash fingerprints over the same shingles, its BK-trees over shards
link those within RADIUS bits, and what they link is held against the exact similarity. As that radius misses
most pairs at 0.8, further candidates are those that share one of BANDS keys of ROWS minima each; a pair at
0.8 has no such key with a chance of (1 - 0.8 ** ROWS) ** BANDS, some 1e-8, and a closer pair with a smaller
one. Nothing else is left to chance.

Each node is compared with one other, the smallest of the bucket it shares most often; then buckets are cut
into pieces of about MOST nodes. In each node's largest bucket, each piece is compared with itself and the
first, so that a dense group becomes one component by a few rows a node, not by some for each of its buckets.
At last, in every bucket that still holds several components, a piece is compared with itself, and nodes
outside the bucket's most frequent component with all pieces: a pair across pieces without such a node is in
one component already. A pair is skipped if it is known to be in one component, or if sizes or parity
bitmaps (a lower bound of the symmetric difference) rule 0.8 out. Each task passes on a spanning
forest. Only texts that have a candidate are moved.

Cases: null and empty texts have the empty set and are one group; a text of fewer than five words has
one shingle; null ids and repeated rows as in operator 4.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, drop_path
from .simhash import labelled, links, majority, shingle_hashes

SHINGLE = 5
BANDS, ROWS = 60, 6
#: Bits by which fingerprints of candidates differ, at most.
RADIUS = 3
#: Nodes of a piece, about; bits of a parity bitmap; shingles that are hashed at once.
MOST, PARITY, CHUNK = 128, 2048, 4096
#: Bytes of sets that a task keeps for later groups, about.
KEPT = 32 << 20

_ODD = np.random.default_rng(5).integers(0, 2**31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def shingles(text: str | None) -> np.ndarray:
    """The set of shingles, as sorted hashes."""
    return np.unique(np.frombuffer(shingle_hashes(text, SHINGLE), dtype=np.uint64))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key per band; none for the empty set."""
    from xxhash import xxh64_digest

    if not len(own):
        return np.zeros(0, np.int64)
    low = own.astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(low), CHUNK):
        np.minimum(least, (_ODD * low[at : at + CHUNK]).min(axis=1), out=least)
    data, step = least.tobytes(), 4 * ROWS
    keys = b"".join([xxh64_digest(data[k * step : (k + 1) * step], k) for k in range(BANDS)])
    return np.frombuffer(keys, dtype=np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, sim, keys): fp stands for the set of shingles, sim is their SimHash fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            fps, sims, keys = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = shingle_hashes(text, SHINGLE)
                sims.append(majority(hashes))
                own = np.unique(np.frombuffer(hashes, dtype=np.uint64))
                fps.append(xxh64_intdigest(own.tobytes()))
                keys.append(band_keys(own))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *keys])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(np.asarray(fps, dtype=np.uint64).view(np.int64)),
                    pa.array(np.asarray(sims, dtype=np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                ],
                names=["doc_id", "text_hash", "fp", "sim", "keys"],
            )

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long, sim long, keys array<long>")


def _parity(own: np.ndarray) -> np.ndarray:
    odd = np.bincount((own & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def link_group(role: np.ndarray, label: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between components `label` of a group, as a spanning forest. Nodes of role 0 are compared with each
    other, those of role 2 with all others but their like; role 1 is only compared with."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    bits = np.stack([_parity(x) for x in sets])
    root = label.copy()
    tree = np.flatnonzero(role < 2)
    out = []
    for i in np.flatnonzero(role != 1):
        j = tree[tree > i] if role[i] == 0 else tree
        j = j[root[j] != root[i]]
        both = sizes[j] + sizes[i]
        j = j[9 * np.minimum(sizes[j], sizes[i]) >= 4 * both]
        j = j[9 * np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64) <= sizes[j] + sizes[i]]
        for k in j.tolist():
            if root[k] == root[i]:
                continue
            shared = len(np.intersect1d(sets[i], sets[k], assume_unique=True))
            if 9 * shared >= 4 * (sizes[i] + sizes[k]):
                out.append((int(i), k))
                root[root == root[k]] = root[i]
    return out


def _compared(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links in the groups (key, low) of rows(key, low, role, fp, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held, own, now = 0, [], None

        def set_of(fp: int, text: str | None) -> np.ndarray:
            nonlocal held
            if fp not in known:
                if held > KEPT:
                    known.clear()
                    held = 0
                known[fp] = shingles(text)
                held += known[fp].nbytes
            return known[fp]

        def flush() -> Iterator[pa.RecordBatch]:
            role, fp, label, sets = zip(*own)
            found = link_group(np.array(role), np.array(label, dtype=np.int64), list(sets))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fp[x[k]] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"]
                )
            own.clear()

        names = ("key", "low", "role", "fp", "label", "text")
        for batch in batches:
            for key, low, role, fp, label, text in zip(*(batch.column(c).to_pylist() for c in names)):
                if (key, low) != now:
                    if own:
                        yield from flush()
                    now = (key, low)
                own.append((role, fp, label, set_of(fp, text)))
        if own:
            yield from flush()

    dealt = rows.join(texts, "fp").select("key", "low", "role", "fp", "label", "text")
    dealt = dealt.repartition("key", "low").sortWithinPartitions("key", "low")
    return dealt.mapInArrow(run, "a long, b long")


def _by_simhash(fps: DataFrame) -> DataFrame:
    """(fp, key): pairs of sets that operator 4 links: sets of one fingerprint with its smallest set, and the smallest
    sets of linked fingerprints, as the smaller linked to a larger one's."""
    sims = fps.groupBy("sim").agg(F.min("fp").alias("one"))
    sims, _ = cut(sims, "sims")
    found, path = cut(links(sims.select(F.col("sim").alias("fp")), RADIUS), "sim_links")
    one = lambda c: sims.select(F.col("sim").alias(c), F.col("one").alias(f"one_{c}"))
    pairs = found.join(one("a"), "a").join(one("b"), "b").select(
        F.greatest("one_a", "one_b").alias("fp"), F.least("one_a", "one_b").alias("key")
    )
    same = fps.select("sim", "fp").distinct().join(sims, "sim").where("fp != one").select("fp", F.col("one").alias("key"))
    out, _ = cut(pairs.unionByName(same).distinct(), "sim_pairs")
    drop_path(fps.sparkSession, path)
    return out


def _with_one(members: DataFrame) -> DataFrame:
    """(fp, key): each node with the smallest of the bucket that it shares most often."""
    most = members.where("fp != least").groupBy("fp", "least").agg(F.sum("weight").alias("n"))
    return most.groupBy("fp").agg(F.max(F.struct("n", "least")).alias("x")).select("fp", F.col("x.least").alias("key"))


def _of_pairs(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links among pairs(fp, key)."""
    star, path = cut(pairs.distinct(), "stars")
    pieces = star.groupBy("key").agg(F.ceil(F.count("*") / MOST).cast("int").alias("pieces"))
    asks = pieces.select(
        "key", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("low"), F.lit(2).alias("role"), F.col("key").alias("fp")
    )
    found = star.join(pieces, "key").select(
        "key", F.pmod(F.xxhash64("fp"), "pieces").cast("int").alias("low"), F.lit(1).alias("role"), "fp"
    )
    rows = asks.unionByName(found).select("key", "low", "role", "fp", F.col("fp").alias("label"))
    out, _ = cut(_compared(rows, texts), "links")
    drop_path(pairs.sparkSession, path)
    return out


def _in_pieces(members: DataFrame, labels: DataFrame, texts: DataFrame, whole: bool) -> DataFrame:
    """Links in the buckets that hold several components, by labels(fp, root): all, or at first, in each node's
    largest bucket of more than MOST, those within pieces and with the first piece."""
    if whole:
        chosen = members.select("key", "n", "fp")
    else:
        largest = members.where(F.col("n") > MOST).groupBy("fp").agg(F.max(F.struct("n", "key")).alias("x"))
        chosen = largest.select("x.key", "x.n", "fp")
    pieces = F.ceil(F.col("n") / MOST).cast("int")
    told = chosen.join(labels, "fp", "left").select(
        "key", "fp", F.coalesce("root", "fp").alias("label"), pieces.alias("pieces"),
        F.pmod(F.xxhash64("fp"), pieces).cast("int").alias("own"),
    )
    told, path = cut(told, "told")
    counts = told.groupBy("key", "label").agg(F.count("*").alias("n"))
    open_ = counts.groupBy("key").agg(F.count("*").alias("labels"), F.max(F.struct("n", "label")).alias("x"))
    open_ = open_.where("labels > 1").select("key", F.col("x.label").alias("lead"))
    # A row for each piece, not for each node.
    pieced = told.groupBy("key", "pieces", "own").agg(F.collect_list(F.struct("fp", "label")).alias("nodes"))
    nodes = pieced.join(open_, "key").select("key", "pieces", "own", "lead", F.explode("nodes").alias("x"))
    nodes = nodes.select("key", "pieces", "own", "lead", "x.*")
    others = F.sequence(F.lit(0), F.col("pieces") - 1)
    spread = F.col("label") != F.col("lead") if whole else F.col("own") == 0
    targets = F.when(spread, others).otherwise(F.array("own"))
    rows = nodes.select("key", "own", "fp", "label", F.explode(targets).alias("low"))
    rows = rows.select("key", "low", F.when(F.col("own") == F.col("low"), 0).otherwise(2).alias("role"), "fp", "label")
    out, _ = cut(_compared(rows, texts), "links")
    drop_path(members.sparkSession, path)
    return out


def components(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, component_fp) for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    fps, _ = cut(signatures(docs), "shingles")
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    nodes = fps.groupBy("fp").agg(F.min(F.struct(key.alias("_key"), F.col("text_hash").alias("_hash"))).alias("one"))
    bands = fps.select("fp", F.explode("keys").alias("key")).distinct()
    bands, bands_path = cut(bands, "bands")
    shared = bands.groupBy("key").agg(
        F.count("*").alias("n"), F.min("fp").alias("least"), F.expr("bit_xor(xxhash64(fp))").alias("same")
    )
    # Buckets with the same nodes count once.
    shared = shared.where("n > 1").groupBy("n", "least", "same").agg(F.min("key").alias("key"), F.count("*").alias("weight"))
    shared, shared_path = cut(shared, "shared")
    members, members_path = cut(bands.join(shared.drop("same"), "key"), "members")
    drop_path(spark, bands_path)
    drop_path(spark, shared_path)
    pairs = _by_simhash(fps)
    asked = members.select("fp").unionByName(pairs.select("fp")).unionByName(pairs.select(F.col("key").alias("fp")))
    wanted, wanted_path = cut(asked.distinct().join(nodes, "fp").select("fp", "one.*"), "wanted")
    texts = docs.select(key.alias("_key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"), "text")
    texts = texts.join(wanted, ["_key", "_hash"]).groupBy("fp").agg(F.first("text").alias("text"))
    texts, texts_path = cut(texts, "texts")
    drop_path(spark, wanted_path)
    found = _of_pairs(pairs.unionByName(_with_one(members)), texts)
    for whole in (False, True):
        labels, _ = cut(connected_components(found, "a", "b").withColumnRenamed("node", "fp"), "labels")
        more = _in_pieces(members, labels, texts, whole)
        # A link from each node to its component's root stands for all links so far.
        found = labels.where("fp != root").select(F.col("fp").alias("a"), F.col("root").alias("b")).unionByName(more)
    out = labelled(fps.drop("keys", "sim"), found)
    for path in (members_path, texts_path):
        drop_path(spark, path)
    return out
