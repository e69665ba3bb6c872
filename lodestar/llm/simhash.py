"""SimHash near-dedup (operator 4): BK-trees over shards of fingerprints.

A document's words are lower-cased (A-Z) and split at ASCII white space; its fingerprint has a bit
where more than half of its shingles' XXH64 have it. Fingerprints link at `radius` differing bits or
fewer, and a group is what links reach.

Plan: documents become fingerprints where they are read; equal fingerprints are one node. Of five
blocks of bits, two at least agree in a pair that differs in three bits or fewer, so every node goes
to ten shards, by two blocks each. A shard is cut into pieces of about MOST nodes, each of which is a
BK-tree: children are keyed by their integer Hamming distance to the parent, and a search follows only
edges within the radius of its own distance. Trees are rows of a table, and each piece searches the trees
of its shard from its own number on. If all trees together take TREE_BYTES or fewer, they are broadcast, so
that searches stay where their pieces lie; else, as they grow with the corpus, they go to the searches by a
join on the shard, whose hot shards adaptive execution splits. A search and a tree meet as two rows of
bounded size, and a node is never a row per piece. Each task passes on a spanning forest of its links, not
all pairs.

Cases: null and empty texts have fingerprint zero, and link like any other; texts of one or two words
have one shingle; a null doc_id takes part in links but never names a group unless all members are
null; repeated rows are in the same group; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, drop_path

#: Nodes in a shard tree, about.
MOST = 1024
#: Bits of the five blocks.
BLOCKS = (13, 13, 13, 13, 12)
#: Nodes and edges of trees that a task handles together, at least; bytes of trees that are broadcast, at most.
ROWS, TREE_BYTES = 100_000, 16 << 20


def shingle_hashes(text: str | None, shingle: int = 3, seed: int = 42) -> bytes:
    """The shingles' hashes, 8 bytes each, repeats included."""
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()
    if not words:
        return b""
    if len(words) < shingle:
        return xxh64_digest(b" ".join(words), seed)
    return b"".join([xxh64_digest(b" ".join(x), seed) for x in zip(*(words[i:] for i in range(shingle)))])


def majority(hashes: bytes) -> int:
    """The bits that more than half of the hashes have, as an unsigned integer."""
    n = len(hashes) // 8
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 100_000):
        part = np.frombuffer(hashes, dtype=np.uint8, offset=8 * at, count=8 * min(100_000, n - at))
        ones += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint, as an unsigned integer."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_hash, fp): fp as a signed long; text_hash tells rows of the same doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x, shingle, seed) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(np.asarray(fps, dtype=np.uint64).view(np.int64)),
                ],
                names=["doc_id", "text_hash", "fp"],
            )

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


class Forest:
    """BK-trees of many groups, built and searched together.

    A group's nodes lie together, and the first is its root. An edge has a key, its parent's place times 65
    plus the distance, and a child; edges are sorted by key.
    """

    def __init__(self, sizes: np.ndarray, fp: np.ndarray, edges: tuple[np.ndarray, np.ndarray] | None = None):
        """fp: distinct within a group. Edges that are not given are built: all nodes descend at once; of those at
        the same parent and distance, the first becomes the child, and the others go on to it."""
        self.fp, self.sizes = fp, sizes
        self.roots = np.cumsum(sizes) - sizes
        if edges:
            self.keys, self.children = edges
            return
        at = np.repeat(self.roots, sizes)
        todo = np.flatnonzero(at != np.arange(len(fp)))
        keys, children = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(todo):
            parent = at[todo]
            key = parent * 65 + np.bitwise_count(fp[todo] ^ fp[parent])
            order = np.argsort(key, kind="stable")
            key, todo = key[order], todo[order]
            new = np.r_[True, key[1:] != key[:-1]]
            keys.append(key[new])
            children.append(todo[new])
            child = np.repeat(todo[new], np.diff(np.r_[np.flatnonzero(new), len(key)]))
            at[todo] = child
            todo = todo[~new]
        key = np.concatenate(keys)
        order = np.argsort(key)
        self.keys, self.children = key[order], np.concatenate(children)[order]

    def trees(self) -> list[bytes]:
        """Each group's nodes and edges, counted from its own first node."""
        ends = np.searchsorted(self.keys, 65 * np.r_[self.roots, len(self.fp)])
        out = []
        for root, size, i, j in zip(self.roots.tolist(), self.sizes.tolist(), ends[:-1].tolist(), ends[1:].tolist()):
            parts = self.fp[root : root + size].view(np.int64), self.keys[i:j] - 65 * root, self.children[i:j] - root
            out.append(np.concatenate(parts).tobytes())
        return out

    @classmethod
    def of(cls, trees: list[bytes]) -> Forest:
        """The forest of trees; a tree of n nodes has n - 1 edges."""
        sizes = np.asarray([(len(t) // 8 + 2) // 3 for t in trees], dtype=np.int64)
        flat = np.frombuffer(b"".join(trees), dtype=np.int64)
        begin = np.cumsum(3 * sizes - 2) - (3 * sizes - 2)
        roots = np.cumsum(sizes) - sizes

        def part(start: np.ndarray, count: np.ndarray, add: np.ndarray) -> np.ndarray:
            place = np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            return flat[place] + np.repeat(add, count)

        fp = part(begin, sizes, 0 * roots).view(np.uint64)
        keys = part(begin + sizes, sizes - 1, 65 * roots)
        return cls(sizes, fp, (keys, part(begin + 2 * sizes - 1, sizes - 1, roots)))

    def search(self, group: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, node) within the radius, level by level; group tells each query's tree."""
        q, node = np.arange(len(fp)), self.roots[group]
        while len(q):
            d = np.bitwise_count(fp[q] ^ self.fp[node]).astype(np.int64)
            near = d <= radius
            yield q[near], node[near]
            low = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right") - low
            q = np.repeat(q, n)
            node = self.children[np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(q))]


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that links reach."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (nxt := label[label] != label).any():
            label[nxt] = label[label[nxt]]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def link_trees(asks: list[bytes], trees: list[bytes], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of each of asks and the nodes of the tree beside it, as a spanning forest."""
    forest = Forest.of(trees)
    fp = np.frombuffer(b"".join(asks), dtype=np.uint64)
    group = np.repeat(np.arange(len(asks)), [len(x) // 8 for x in asks])
    every, place = np.unique(np.concatenate([fp, forest.fp]), return_inverse=True)
    left, right = [], []
    for q, node in forest.search(group, fp, radius):
        a, b = place[q], place[len(fp) + node]
        real = a != b
        left.append(a[real])
        right.append(b[real])
    label = spanning(len(every), np.concatenate(left), np.concatenate(right)) if left else np.arange(len(every))
    own = np.flatnonzero(label != np.arange(len(every)))
    return every[own], every[label[own]]


def pieces(nodes: DataFrame) -> DataFrame:
    """(shard, piece, fps): the nodes of shards with more than one, about MOST to a piece, as bytes."""
    shifts, at = [], 64
    for bits in BLOCKS:
        at -= bits
        shifts.append(at)
    blocks = [F.shiftrightunsigned("fp", s).bitwiseAND((1 << b) - 1) for s, b in zip(shifts, BLOCKS)]
    shards = [
        F.lit(t << 26) + F.shiftleft(blocks[i], 13) + blocks[j]
        for t, (i, j) in enumerate((i, j) for i in range(5) for j in range(i + 1, 5))
    ]
    dealt = nodes.select("fp", F.explode(F.array(*shards)).alias("shard"))
    shared = dealt.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
    shared, _ = cut(shared, "shards")
    number = F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / MOST)).alias("piece")
    return dealt.join(shared, "shard").select("shard", number, "fp").groupBy("shard", "piece").agg(
        F.sort_array(F.collect_list("fp")).alias("fps")
    )


def trees_of(cells: DataFrame) -> DataFrame:
    """(shard, piece, asks, tree) of pieces: the nodes, and the BK-tree of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fps")
            sizes = np.diff(np.asarray(fps.offsets)).astype(np.int64)
            fp = np.asarray(fps.flatten()).view(np.uint64)
            ends = np.r_[0, 8 * np.cumsum(sizes)].tolist()
            data = fp.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("shard"),
                    batch.column("piece"),
                    pa.array([data[i:j] for i, j in zip(ends, ends[1:])], pa.binary()),
                    pa.array(Forest(sizes, fp).trees(), pa.binary()),
                ],
                names=["shard", "piece", "asks", "tree"],
            )

    return cells.mapInArrow(run, "shard long, piece long, asks binary, tree binary")


def links(nodes: DataFrame, radius: int = 3, tree_bytes: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` that join what all links join. tree_bytes takes the place
    of TREE_BYTES."""
    if radius > 3:
        raise ValueError("two of five blocks agree only up to three differing bits")
    table, _ = cut(trees_of(pieces(nodes)), "trees")
    trees = table.select("shard", F.col("piece").alias("other"), "tree")
    size = table.agg(F.sum(F.length("tree"))).first()[0] or 0
    if size <= (TREE_BYTES if tree_bytes is None else tree_bytes):
        trees = F.broadcast(trees)
    rows = table.select("shard", "piece", "asks").join(trees, "shard").where("piece <= other").select("asks", "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks: list[bytes] = []
        trees: list[bytes] = []
        work = 0

        def flush() -> Iterator[pa.RecordBatch]:
            a, b = link_trees(asks, trees, radius)
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
                )

        for batch in batches:
            for ask, tree in zip(batch.column("asks").to_pylist(), batch.column("tree").to_pylist()):
                asks.append(ask)
                trees.append(tree)
                # Pairs of nodes bound what a search holds.
                work += len(ask) // 8 * (len(tree) // 24 + 1) // 20 + len(tree) // 24 + 1
                if work >= ROWS:
                    yield from flush()
                    asks, trees, work = [], [], 0
        if asks:
            yield from flush()

    return rows.mapInArrow(run, "a long, b long")


def components(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp, component_id, component_fp) for every row of docs(doc_id, text)."""
    fps, _ = cut(fingerprints(docs, shingle), "simhash")
    found, path = cut(links(fps.select("fp").distinct(), radius), "links")
    out = labelled(fps, found)
    drop_path(docs.sparkSession, path)
    return out


def labelled(fps: DataFrame, found: DataFrame) -> DataFrame:
    """fps(doc_id, text_hash, fp) with component_id and component_fp, by links found(a, b) between fps."""
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    labels = connected_components(found, "a", "b").withColumnRenamed("node", "fp")
    linked = nodes.join(labels, "fp")
    smallest = linked.groupBy("root").agg(F.min("first").alias("low"))
    linked = linked.select("fp", "root").join(smallest, "root")
    whole = nodes.join(linked, "fp", "left").select(
        "fp",
        F.coalesce("low", F.when(F.col("root").isNull(), F.col("first"))).alias("component_id"),
        F.coalesce("root", "fp").alias("component_fp"),
    )
    # As a table of its own, so that the join can split a fingerprint that very many documents have.
    whole, _ = cut(whole, "components")
    return fps.join(whole, "fp").select("doc_id", "text_hash", "fp", "component_id", "component_fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): a row per row of docs."""
    return components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = components) -> DataFrame:
    """docs with one document of each group: that with the smallest doc_id."""
    key = F.coalesce("doc_id", F.lit(-(2**63))).alias("_key")
    kept = (
        groups(docs)
        .where("doc_id <=> component_id")
        .groupBy("component_fp")
        .agg(F.min(F.struct(key, F.col("text_hash").alias("_hash"))).alias("k"))
        .select("k.*")
    )
    keyed = docs.select(F.struct("*").alias("doc"), key, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"))
    one = keyed.join(kept, ["_key", "_hash"], "left_semi")
    return one.dropDuplicates(["_key", "_hash"]).select("doc.*")
