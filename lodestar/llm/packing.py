"""Packing (operator 5): Karmarkar-Karp multiway differencing of tokenized documents into windows.

A bucket of documents is cut into pieces, which differencing spreads over as many windows as their tokens
fill; while a window exceeds the capacity, the number of windows rises. Windows below the capacity are
padded to it, some 0.5 % of a bucket's tokens, and up to a window at the end of each task.

Cases: a null text is empty and still has its end token; an empty table gives no rows; repeated rows
are packed once each; very long documents are cut into full windows first; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Entries of a worker's word cache; beyond it the cache starts anew (results don't change).
CACHE = 800_000
#: Tokens that are packed together, at least; bounds a worker's memory.
BUCKET = 1_000_000
#: Pieces of a window, at least; share of tokens that is cut into small pieces, and these' part of a window.
QUARTER, FINE, SMALL = 4, 0.01, 64

#: Bytes of text that are encoded together, at least.
TEXT_BYTES = 8 << 20

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


#: How a tokenizers file must prepare texts for words to be encoded one by one (fixed values): small letters, and
#: pieces of letters, single digits and other marks, between which white space is only a boundary.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class WordEncoder:
    """Encodes texts with a tokenizers file.

    If the file prepares texts as NORMALIZER and PRE_TOKENIZER say, words between ASCII white space are
    encoded once and kept; unknown words of a batch are encoded in one call, and offsets tell which ids
    belong to which word. Arrow splits the texts and numbers their words, so that Python sees a batch's
    different words only. With any other file each text is encoded as it is.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.by_word = parts["normalizer"] == NORMALIZER and parts["pre_tokenizer"] == PRE_TOKENIZER
        self.known: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> None:
        """Encodes unknown words. A comma or full stop after a letter or digit is always a token of its
        own and ASCII capitals don't count, so words that differ in these are encoded once."""
        known, cores = self.known, []
        for w in words:
            core = w[:-1] if w[-1:] in (".", ",") and w[-2:-1].isalnum() and w[-2] < "\u0250" else w
            cores.append(core.lower() if core.isascii() else core)
        self._encode([c for c in dict.fromkeys([*cores, ",", "."]) if c not in known])
        for w, core in zip(words, cores):
            if w not in known:
                tail = w[-1] if len(core) < len(w) else ""
                known[w] = known[core] + known[tail] if tail else known[core]

    def _encode(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            e = self.tokenizer.encode_batch([" ".join(some)], add_special_tokens=False)[0]
            ids = np.asarray(e.ids, dtype="<u4")
            starts = np.cumsum([0] + [len(w) + 1 for w in some])
            first = np.asarray([o[0] for o in e.offsets], dtype=np.int64)
            cuts = np.searchsorted(first, starts).tolist()
            ids = ids.tobytes()
            for w, i, j in zip(some, cuts, cuts[1:]):
                self.known[w] = ids[4 * i : 4 * j]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; a null text has none."""
        if not self.by_word:
            whole = self.tokenizer.encode_batch(texts.fill_null("").to_pylist(), add_special_tokens=False)
            return [np.asarray(x.ids, dtype="<u4").tobytes() for x in whole]
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        ends = np.asarray(words.offsets)
        coded = words.flatten().dictionary_encode()
        own = coded.dictionary.to_pylist()
        got = [self.known.get(w) for w in own]
        new = [w for w, x in zip(own, got) if x is None]
        if new:
            if len(self.known) + len(new) > CACHE:
                self.known.clear()
            self.learn(new)
            got = [self.known[w] if x is None else x for w, x in zip(own, got)]
        at = np.asarray(coded.indices)
        sizes = np.asarray([len(x) for x in got], dtype=np.int64) // 4
        ids = np.frombuffer(b"".join(got), dtype="<u4")
        count = sizes[at]
        before = np.r_[0, np.cumsum(count)]
        place = np.repeat((np.cumsum(sizes) - sizes)[at] - before[:-1], count) + np.arange(before[-1])
        ids = ids[place].tobytes()
        bounds = (4 * before[ends - ends[0]]).tolist()
        return [ids[i:j] for i, j in zip(bounds, bounds[1:])]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least `size` bytes, where there are so many."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.nbytes for x in held) >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held and sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def karmarkar_karp(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0..k-1) of each item by multiway differencing.

    Every item starts as a partial partition of k sums, all zero but one. The two with the widest
    spread are merged with opposing order, largest sum on smallest, and the common part is taken
    off; walking the merges back gives the windows.
    """
    n = len(sizes)
    if k <= 1 or n <= 1:
        return np.zeros(n, dtype=np.int64)
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    merged: list[tuple[int, int, np.ndarray]] = []

    def of(i: int) -> np.ndarray:
        if i >= n:
            return sums.pop(i)
        v = np.zeros(k, dtype=np.int64)
        v[0] = sizes[i]
        return v

    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        v = of(a) + of(b)[::-1]
        order = np.argsort(-v, kind="stable").astype(np.int32)
        v = v[order]
        v -= v[-1]
        i = n + len(merged)
        sums[i] = v
        merged.append((a, b, order))
        heapq.heappush(heap, (-int(v[0]), i))
    window = np.zeros(n, dtype=np.int64)
    at = {n + len(merged) - 1: np.arange(k)}
    for i in range(len(merged) - 1, -1, -1):
        a, b, order = merged[i]
        here = at.pop(n + i)
        own = np.empty(k, dtype=np.int64)
        own[order] = here
        for child, slots in ((a, own), (b, own[::-1])):
            if child < n:
                window[child] = slots[0]
            else:
                at[child] = slots
    return window


def cut_into_pieces(lengths: list[int], capacity: int) -> list[tuple[int, int, int]]:
    """(document, start, length) of pieces of a quarter of a window at most. Of the longest, as many as hold
    the share FINE of all tokens are cut small, so that differencing ends with pieces that even out windows."""
    most, small = max(1, capacity // QUARTER), max(1, capacity // SMALL)
    pieces = [(d, at, min(most, n - at)) for d, n in enumerate(lengths) for at in range(0, n, most)]
    pieces.sort(key=lambda x: x[2])
    fine = int(FINE * sum(x[2] for x in pieces))
    out = []
    while fine > 0 and pieces and pieces[-1][2] > small:
        d, start, length = pieces.pop()
        fine -= length
        out += [(d, at, min(small, start + length - at)) for at in range(start, start + length, small)]
    return sorted(pieces + out)


def pack(lengths: list[int], capacity: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) so that every id is in exactly one sequence.

    Full windows are cut off long documents first. Differencing spreads the pieces of the rest over as few
    windows as could hold them; where one exceeds the capacity, their number rises and all are spread anew.
    """
    seq = itertools.count()
    rest = list(lengths)
    for d, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            yield d, start, capacity, next(seq), 0
        rest[d] = n % capacity
    items = cut_into_pieces(rest, capacity)
    sizes = np.asarray([x[2] for x in items], dtype=np.int64)
    k = -(-int(sizes.sum()) // capacity)
    if not k:
        return
    while True:
        own = karmarkar_karp(sizes, k)
        over = int(np.bincount(own, sizes, minlength=k).max()) - capacity
        if over <= 0:
            break
        k += max(1, k * over // (2 * capacity))
    order = np.argsort(own, kind="stable")
    bounds = np.searchsorted(own[order], np.arange(k + 1))
    for w in range(k):
        here = order[bounds[w] : bounds[w + 1]]
        s, offset = next(seq), 0
        for i in here:
            d, start, length = items[i]
            yield d, lengths[d] - rest[d] + start, length, s, offset
            offset += length


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 4096, bucket: int = BUCKET, forget: bool = False
) -> DataFrame:
    """Tokenizes and packs docs(doc_id, text); a row per piece, with PIECES as columns.

    Needs no shuffle: each task packs what it reads, a bucket of tokens at a time, so that memory is
    bounded and a hot source or a skewed key plays no part. With forget, a worker's word cache goes at
    the end of each task, where other stages share the workers' memory.
    """
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        enc = encoder(tokenizer)
        ids: list[bytes] = []
        keys: list[int | None] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal base, held
            rows = list(pack([len(x) // 4 for x in ids], capacity))
            for at in range(0, len(rows), 50_000):
                some = rows[at : at + 50_000]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([keys[r[0]] for r in some], pa.int64()),
                        "start": pa.array([r[1] for r in some], pa.int64()),
                        "length": pa.array([r[2] for r in some], pa.int64()),
                        "ids_crc32": pa.array(
                            [zlib.crc32(ids[r[0]][4 * r[1] : 4 * (r[1] + r[2])]) for r in some], pa.int64()
                        ),
                        "doc_tokens": pa.array([len(ids[r[0]]) // 4 for r in some], pa.int64()),
                        "sequence_id": pa.array([base + r[3] for r in some], pa.int64()),
                        "offset": pa.array([r[4] for r in some], pa.int64()),
                    }
                )
            base += max((r[3] for r in rows), default=-1) + 1
            held = 0
            ids.clear()
            keys.clear()

        for batch in gathered(batches, TEXT_BYTES):
            for key, got in zip(batch.column("doc_id").to_pylist(), enc.encode(batch.column("text"))):
                got += end
                ids.append(got)
                keys.append(key)
                held += len(got) // 4
                if held >= bucket:
                    yield from flush()
        if ids:
            yield from flush()
        if forget:
            enc.known.clear()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


__all__ = ["WordEncoder", "encoder", "karmarkar_karp", "pack", "pack_documents"]
