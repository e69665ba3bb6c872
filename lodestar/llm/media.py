"""Media columns (operator 6): local image descriptors find cropped, resized, mirrored or edited copies.

An image (binary PGM, 8 bit) gives corners at several scales: Harris responses that are the largest of
their neighbourhood and above a share of the image's maximum. Each corner has the direction of its
intensity centroid and, turned by it, BITS binary brightness tests; the tests are closed under reflection,
so that a mirrored image's bits are known. A stated set of queries is searched against all images:
corners meet by Hamming tables, keyed by each of BANDS bands of a descriptor; of those that meet,
MOST_BITS differing bits or fewer are matches, and each match votes for a turn, a scale and a shift of the
query: LEAST_VOTES corners that agree make a copy. No candidate is dropped.

If the queries' descriptors take TABLE_BYTES or fewer, they go to the tasks with the function, which build the
tables, and images are read where they lie. Otherwise both sides are joined on (band, value), the
matches of a query and an image meet by a second exchange, and no side is gathered; adaptive execution
splits values that very many corners have. Both ways give the same rows.

Images with equal bytes are one class; only its representative, the one with the smallest id, is
described and matched, so copies are not expanded into pairs.

Cases: null, empty and undecodable media, and images without corners, match nothing; null media are a
class each, with their id; a null id joins a class but doesn't represent it, unless alone; repeated rows
are members of the same class; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Levels of the pyramid, and those that images with a side below SMALL have besides.
SCALES, UPWARD, SMALL = (1.0, 0.8, 0.64, 0.512), (1.25, 1.5625, 1.953125), 48
STEP = 0.8
BORDER, REACH, BITS, TURNS = 8, 5, 256, 32
BANDS, BAND_BITS = 12, 21
MOST_BITS, LEAST_VOTES = 44, 4
#: Width of a vote for the shift, in pixels, and for the turn, in steps of a full turn / TURNS.
SHIFT, TURN = 6.0, 3
#: Share of the strongest response that a corner has at least.
LEAST_RESPONSE = 0.02
#: Bytes of descriptors that go to the tasks, at most; their tables take some twelve times that in a worker.
TABLE_BYTES = 8 << 20
#: Pixels, corners and candidates that are worked on at once, about.
PIXELS, CORNERS, CANDIDATES = 1 << 19, 1000, 1 << 20
#: Images whose corners are looked up together.
IMAGES = 100

_rng = np.random.default_rng(11)
_HALF = np.clip(_rng.normal(0, 2.8, (BITS // 2, 2, 2)), -REACH, REACH)
#: Tests and their mirror images, so that a mirrored image's bits are the same with the halves exchanged.
_TESTS = np.concatenate([_HALF, _HALF * [1, -1]])
_ANGLES = np.arange(TURNS) * 2 * np.pi / TURNS
_ROTATED = np.rint(
    np.stack(
        [
            np.cos(_ANGLES)[:, None, None] * _TESTS[None, :, :, 0] - np.sin(_ANGLES)[:, None, None] * _TESTS[None, :, :, 1],
            np.sin(_ANGLES)[:, None, None] * _TESTS[None, :, :, 0] + np.cos(_ANGLES)[:, None, None] * _TESTS[None, :, :, 1],
        ],
        axis=-1,
    )
).astype(np.int32)  # turn, test, end, (x, y)
_DISC = np.array(
    [(x, y) for x in range(-REACH, REACH + 1) for y in range(-REACH, REACH + 1) if x * x + y * y <= REACH * REACH],
    dtype=np.int32,
)


def pgm(image: np.ndarray) -> bytes:
    h, w = image.shape
    return b"P5 %d %d 255\n" % (w, h) + np.ascontiguousarray(image, dtype=np.uint8).tobytes()


def decode(data: bytes | None) -> np.ndarray | None:
    """The image of a binary PGM without comments, or None."""
    try:
        kind, w, h, most, _ = (data or b"").split(None, 4)
        at = data.index(most, data.index(h, data.index(w) + len(w)) + len(h)) + len(most) + 1
        size = int(w) * int(h)
        if kind != b"P5" or int(most) != 255 or len(data) - at != size or not size:
            return None
        return np.frombuffer(data, dtype=np.uint8, offset=at).reshape(int(h), int(w))
    except ValueError:
        return None


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2r+1) x (2r+1) windows of images (n, h, w); edges repeat."""
    n, h, w = x.shape
    s = np.cumsum(np.pad(x, ((0, 0), (r + 1, r), (r, r)), mode="edge"), axis=1)
    s = s[:, 2 * r + 1 :] - s[:, : h]
    s = np.cumsum(np.pad(s, ((0, 0), (0, 0), (1, 0))), axis=2)
    return s[:, :, 2 * r + 1 :] - s[:, :, : w]


def _resized(x: np.ndarray, scale: float) -> np.ndarray:
    if scale == 1:
        return x
    n, h, w = x.shape
    rows = (np.arange(int(h * scale)) + 0.5) / scale - 0.5
    cols = (np.arange(int(w * scale)) + 0.5) / scale - 0.5
    y0, x0 = (np.clip(np.floor(v).astype(int), 0, m - 2) for v, m in ((rows, h), (cols, w)))
    fy, fx = np.clip(rows - y0, 0, 1)[None, :, None], np.clip(cols - x0, 0, 1)[None, None, :]
    a = x[:, y0] * (1 - fy) + x[:, y0 + 1] * fy
    return a[:, :, x0] * (1 - fx) + a[:, :, x0 + 1] * fx


def describe(images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For images (n, h, w): each corner's image, its (x, y, scale, turn) and its packed bits."""
    owners, places, bits = [np.zeros(0, np.int64)], [np.zeros((0, 4), np.float32)], [np.zeros((0, BITS // 8), np.uint8)]
    whole = images.astype(np.float32)
    for scale in SCALES + (UPWARD if min(images.shape[1:]) < SMALL else ()):
        x = _resized(whole, scale)
        n, h, w = x.shape
        if min(h, w) <= 2 * BORDER:
            continue
        smooth = _box(x, 1) / 9
        gy, gx = np.gradient(smooth, axis=(1, 2))
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        # Maxima of their neighbourhood, so that a crop has the corners that its original has.
        peak = np.ones_like(r, dtype=bool)
        for dy in (-2, -1, 0, 1, 2):
            for dx in (-2, -1, 0, 1, 2):
                if (dy, dx) != (0, 0):
                    peak &= r >= np.roll(r, (dy, dx), axis=(1, 2))
        most = r.max(axis=(1, 2))
        peak &= (r > LEAST_RESPONSE * most[:, None, None]) & (r > 1.0)
        inner = np.zeros((h, w), dtype=bool)
        inner[BORDER : h - BORDER, BORDER : w - BORDER] = True
        i, y, xx = np.nonzero(peak & inner)
        if not len(i):
            continue
        wide = _box(x, 1) / 9
        turn = np.zeros(len(i), dtype=int)
        for at in range(0, len(i), CORNERS):
            s = slice(at, at + CORNERS)
            disc = wide[i[s, None], y[s, None] + _DISC[:, 1], xx[s, None] + _DISC[:, 0]]
            angle = np.arctan2(disc @ _DISC[:, 1].astype(np.float32), disc @ _DISC[:, 0].astype(np.float32))
            turn[s] = np.rint(angle / (2 * np.pi) * TURNS).astype(int) % TURNS
        for at in range(0, len(i), CORNERS):
            s = slice(at, at + CORNERS)
            off = _ROTATED[turn[s]]
            v = wide[i[s, None, None], y[s, None, None] + off[..., 1], xx[s, None, None] + off[..., 0]]
            owners.append(i[s])
            bits.append(np.packbits(v[:, :, 0] < v[:, :, 1], axis=1))
            own = np.stack([(xx[s] + 0.5) / scale, (y[s] + 0.5) / scale, np.full(len(i[s]), 1 / scale), turn[s]], axis=1)
            places.append(own.astype(np.float32))
    return np.concatenate(owners), np.concatenate(places), np.concatenate(bits)


def mirrored(place: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of the image's mirror image, but for a shift."""
    place = place.copy()
    place[:, 0] *= -1
    place[:, 3] = (TURNS // 2 - place[:, 3]) % TURNS
    return place, np.roll(bits, BITS // 16, axis=1)


def bands(bits: np.ndarray) -> np.ndarray:
    """(corner, band): the bands' values."""
    flat = np.unpackbits(bits, axis=1)[:, : BANDS * BAND_BITS].reshape(-1, BANDS, BAND_BITS)
    return flat.astype(np.int32) @ (1 << np.arange(BAND_BITS, dtype=np.int32))


class Tables:
    """The Hamming tables of a block of queries."""

    def __init__(self, owner: np.ndarray, place: np.ndarray, bits: np.ndarray):
        self.owner, self.place = owner, place
        self.words = np.asfortranarray(np.ascontiguousarray(bits).view(np.uint64))
        values = bands(bits)
        self.order = [np.argsort(values[:, k], kind="stable") for k in range(BANDS)]
        #: Of each band: the values that occur, and where the corners of each start in the order.
        self.values, self.starts = [], []
        for k, o in enumerate(self.order):
            own = values[o, k]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
            self.values.append(own[first])
            self.starts.append(np.r_[first, len(own)])

    def lookup(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(band, corner): where the query corners of the same value start in the band's order, and how many there are."""
        values = bands(bits)
        lo, count = np.zeros((2, BANDS, len(bits)), dtype=np.int64)
        for k in range(BANDS if len(self.owner) else 0):
            at = np.minimum(np.searchsorted(self.values[k], values[:, k]), len(self.values[k]) - 1)
            lo[k] = self.starts[k][at]
            count[k] = np.where(self.values[k][at] == values[:, k], self.starts[k][at + 1] - lo[k], 0)
        return lo, count

    def matches(self, bits: np.ndarray, lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (corner, query corner) that share a band and differ in few bits, from the corners' lookup. Bits are
        compared a word at a time, and only of pairs that may still match; each pair is then told once."""
        words, n = np.asfortranarray(np.ascontiguousarray(bits).view(np.uint64)), len(self.owner)
        found = []
        for k in range(BANDS):
            m = np.repeat(np.arange(len(bits)), count[k])
            q = self.order[k][np.repeat(lo[k] - np.cumsum(count[k]) + count[k], count[k]) + np.arange(len(m))]
            differ = np.zeros(len(m), dtype=np.uint16)
            for own, other in zip(words.T, self.words.T):
                differ += np.bitwise_count(own[m] ^ other[q])
                near = np.flatnonzero(differ <= MOST_BITS)
                m, q, differ = m[near], q[near], differ[near]
            found.append(m * n + q)
        pairs = np.sort(np.concatenate(found))
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)]]
        return pairs // n, pairs % n

    def copies(self, owner: np.ndarray, place: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(query, image, votes) where votes for one turn, scale and shift suffice. Images, whose corners
        lie together, are taken as many at a time as CANDIDATES allow; one is never cut."""
        if not len(owner) or not len(self.owner):
            return
        lo, count = self.lookup(bits)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        part = (np.cumsum(np.add.reduceat(count.sum(axis=0), first)) - 1) // CANDIDATES
        cuts = np.r_[first[np.r_[True, part[1:] != part[:-1]]], len(owner)]
        for i, j in zip(cuts, cuts[1:]):
            m, q = self.matches(bits[i:j], lo[:, i:j], count[:, i:j])
            m += i
            size = int(owner[j - 1]) + 1
            pair = self.owner[q].astype(np.int64) * size + owner[m]
            for p, c in voted(pair, q, self.place[q], place[m]).items():
                yield p // size, p % size, c


def _frequent(keys: np.ndarray, least: int) -> np.ndarray:
    """Whether a key occurs so often."""
    ordered = np.sort(keys)
    often = ordered[least - 1 :][ordered[least - 1 :] == ordered[: max(0, len(keys) - least + 1)]]
    often = often[np.r_[True, often[1:] != often[:-1]][: len(often)]]
    if not len(often):
        return np.zeros(len(keys), dtype=bool)
    return often[np.minimum(np.searchsorted(often, keys), len(often) - 1)] == keys


def _key(*columns: np.ndarray) -> np.ndarray:
    """A number per row, equal if all columns are; what would not fit in 62 bits is numbered anew."""
    key, span = np.zeros(len(columns[0]), dtype=np.int64), 1
    for c in columns:
        c = c - c.min()
        wide = int(c.max()) + 1
        if span * wide >> 62:
            key, c = (np.unique(x, return_inverse=True)[1] for x in (key, c))
            span, wide = int(key.max()) + 1, int(c.max()) + 1
        key, span = key * wide + c, span * wide
    return key


def voted(pair: np.ndarray, q: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """For each pair of a query and an image the votes for one turn, scale and shift, if they suffice. q tells
    query corners apart; a and b are the places of both ends of each match. Matches of a pair and scale, then those
    of a bin, that are fewer than LEAST_VOTES are left out before the query corners of the rest are told apart."""
    best: dict[int, int] = {}
    if len(pair) < LEAST_VOTES:
        return best
    kept = _frequent(_key(pair), LEAST_VOTES)
    pair, q, a, b = pair[kept], q[kept], a[kept], b[kept]
    ratio = b[:, 2] / a[:, 2]
    scale = np.rint(np.log(ratio) / np.log(STEP)).astype(np.int64)
    if len(pair):
        kept = _frequent(_key(pair, scale), LEAST_VOTES)
        pair, q, a, b, ratio, scale = pair[kept], q[kept], a[kept], b[kept], ratio[kept], scale[kept]
    if not len(pair):
        return best
    turn = (b[:, 3] - a[:, 3]) % TURNS
    angle = turn * (2 * np.pi / TURNS)
    sx = b[:, 0] - ratio * (np.cos(angle) * a[:, 0] - np.sin(angle) * a[:, 1])
    sy = b[:, 1] - ratio * (np.sin(angle) * a[:, 0] + np.cos(angle) * a[:, 1])
    for shift in range(8):  # grids moved by half a step, so that agreeing votes share a bin in one
        half = [0.5 * (shift >> k & 1) for k in range(3)]
        spot = (
            np.floor(turn / TURN + half[0]).astype(np.int64) % (TURNS // TURN + 1),
            np.floor(sx / SHIFT + half[1]).astype(np.int64),
            np.floor(sy / SHIFT + half[2]).astype(np.int64),
        )
        key = _key(pair, scale, *spot)
        some = np.flatnonzero(_frequent(key, LEAST_VOTES))
        if not len(some):
            continue
        some = some[np.lexsort((q[some], key[some]))]
        bin_, corner = key[some], q[some]
        first = np.r_[True, bin_[1:] != bin_[:-1]]
        at = np.flatnonzero(first)
        count = np.add.reduceat(first | np.r_[True, corner[1:] != corner[:-1]], at, dtype=np.int64)
        for p, c in zip(pair[some[at]][count >= LEAST_VOTES].tolist(), count[count >= LEAST_VOTES].tolist()):
            best[p] = max(best.get(p, 0), c)
    return best


def _grouped(images: list[np.ndarray | None]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Images of equal shape together, of about PIXELS at once."""
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, x in enumerate(images):
        if x is not None:
            shapes.setdefault(x.shape, []).append(i)
    for (h, w), own in shapes.items():
        step = max(1, PIXELS // (h * w))
        for at in range(0, len(own), step):
            part = own[at : at + step]
            yield part, np.stack([images[i] for i in part])


FEATURES = "id long, content string, places binary, bits binary"


def features(media: DataFrame) -> DataFrame:
    """A row per row of media(id, media): a digest of the bytes, and the corners."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("media").to_pylist()
            places, bits = [b""] * len(data), [b""] * len(data)
            for own, images in _grouped([decode(x) for x in data]):
                owner, place, bit = describe(images)
                order = np.argsort(owner, kind="stable")
                ends = np.searchsorted(owner[order], np.arange(len(own) + 1))
                for k, i in enumerate(own):
                    part = order[ends[k] : ends[k + 1]]
                    places[i], bits[i] = place[part].tobytes(), bit[part].tobytes()
            digests = [None if x is None else hashlib.sha256(x).hexdigest() for x in data]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column("id"),
                    "content": pa.array(digests, pa.string()),
                    "places": pa.array(places, pa.binary()),
                    "bits": pa.array(bits, pa.binary()),
                }
            )

    return media.select("id", "media").mapInArrow(run, FEATURES)


def _unpacked(places: list[bytes], bits: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = np.frombuffer(b"".join(places), dtype=np.float32).reshape(-1, 4)
    bit = np.frombuffer(b"".join(bits), dtype=np.uint8).reshape(-1, BITS // 8)
    return np.repeat(np.arange(len(places)), [len(b) // (BITS // 8) for b in bits]), place, bit


MATCHES = "query_id long, id long, votes long"


def _batch(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["query_id", "id", "votes"])


def _search(images: DataFrame, ids: list[int], places: list[bytes], bits: list[bytes]) -> DataFrame:
    """Matches of the images with queries whose corners go to the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, place, bit = _unpacked(places, bits)
        other, other_bit = mirrored(place, bit)
        both = np.concatenate([place, other]), np.concatenate([bit, other_bit])
        tables = Tables(np.concatenate([2 * owner, 2 * owner + 1]), *both)
        for batch in batches:
            own = batch.column("id").to_pylist()
            at_all, bits_all = batch.column("places").to_pylist(), batch.column("bits").to_pylist()
            found: dict[tuple[int, int], int] = {}
            for at in range(0, len(own), IMAGES):
                for q, i, n in tables.copies(*_unpacked(at_all[at : at + IMAGES], bits_all[at : at + IMAGES])):
                    key = ids[q // 2], own[at + i]
                    found[key] = max(n, found.get(key, 0))
            rows = [(q, i, n) for (q, i), n in found.items() if q != i]
            if rows:
                yield _batch(rows)

    return images.select("id", "places", "bits").mapInArrow(run, MATCHES)


WORDS = BITS // 64
CORNER = "band int, value int, id long, corner long, x float, y float, scale float, turn float, " + ", ".join(f"w{k} long" for k in range(WORDS))


def _banded(images: DataFrame, sides: int) -> DataFrame:
    """A row per corner and band; with two sides the mirrored corners too, with odd numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for i, places, bits in zip(ids, batch.column("places").to_pylist(), batch.column("bits").to_pylist()):
                _, place, bit = _unpacked([places], [bits])
                for side in range(sides):
                    at, own = mirrored(place, bit) if side else (place, bit)
                    n, values = len(own), bands(own)
                    words = np.ascontiguousarray(own).view(np.int64)
                    flat = lambda x: np.tile(x, BANDS)
                    columns = [
                        pa.array(np.repeat(np.arange(BANDS, dtype=np.int32), n)), pa.array(values.T.ravel().astype(np.int32)),
                        pa.array(np.full(n * BANDS, i, dtype=np.int64)), pa.array(flat(2 * np.arange(n, dtype=np.int64) + side)),
                        *(pa.array(flat(at[:, k])) for k in range(4)), *(pa.array(flat(words[:, k])) for k in range(WORDS)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in CORNER.split(", ")])

    return images.select("id", "places", "bits").mapInArrow(run, CORNER)


def _band_masks() -> np.ndarray:
    """(band, word): the bits of each band in the words of a descriptor."""
    bits = np.zeros((BANDS, BITS), dtype=np.uint8)
    for k in range(BANDS):
        bits[k, k * BAND_BITS : (k + 1) * BAND_BITS] = 1
    return np.packbits(bits, axis=1).view(np.int64)


def _joined(images: DataFrame, queries: DataFrame) -> DataFrame:
    """The same matches by a join of the Hamming tables of both sides."""
    words = [f"w{k}" for k in range(WORDS)]
    q = _banded(queries, 2).select("band", "value", *(F.col(c).alias(f"q_{c}") for c in ("id", "corner", "x", "y", "scale", "turn", *words)))
    both = q.join(_banded(images, 1), ["band", "value"]).where("q_id != id")
    differ = [F.col(f"q_{w}").bitwiseXOR(F.col(w)) for w in words]
    near = both.where(sum((F.bit_count(x) for x in differ), F.lit(0)) <= MOST_BITS)
    # A pair that shares several bands counts in the first.
    for k, mask in enumerate(_band_masks()):
        own = [x.bitwiseAND(F.lit(m)) for x, m in zip(differ, mask.tolist()) if m]
        near = near.where((F.col("band") <= k) | (reduce(Column.bitwiseOR, own) != 0))
    ends = ("x", "y", "scale", "turn")
    near = near.select("q_id", "id", (F.col("q_corner") % 2).alias("side"), "q_corner", *(f"q_{c}" for c in ends), *ends)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            col = lambda c: rows.column(c).to_numpy()
            keys = np.stack([col("q_id"), col("id"), col("side")])
            first = np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)]
            pair, of = np.cumsum(first) - 1, np.flatnonzero(first)
            a, b = np.stack([col(f"q_{c}") for c in ends], axis=1), np.stack([col(c) for c in ends], axis=1)
            best: dict[tuple[int, int], int] = {}
            for p, n in voted(pair, col("q_corner"), a, b).items():
                key = int(keys[0, of[p]]), int(keys[1, of[p]])
                best[key] = max(n, best.get(key, 0))
            if best:
                yield _batch([(q, i, n) for (q, i), n in best.items()])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= CANDIDATES // 8:
                rows = pa.Table.from_batches(held)
                last = rows.column("q_id").to_numpy() == rows.column("q_id")[-1].as_py()
                end = int(np.argmax(last & (rows.column("id").to_numpy() == rows.column("id")[-1].as_py())))
                if end:
                    yield from flush(rows.slice(0, end))
                held = rows.slice(end).to_batches()
        if held and sum(x.num_rows for x in held):
            yield from flush(pa.Table.from_batches(held))

    dealt = near.repartition("q_id", "id").sortWithinPartitions("q_id", "id", "side")
    return dealt.mapInArrow(run, MATCHES)


def near_copies(media: DataFrame, is_query: Column, table_bytes: int | None = None) -> DataFrame:
    """(kind, id, class_id, votes) of media(id, media); table_bytes takes the place of TABLE_BYTES.

    kind "member": each row's id and its class, the smallest id with the same bytes. kind "match": a
    class that holds a query, as id, and another class that is a cropped or edited copy of it.
    """
    rows, _ = cut(features(media), "corners")
    classes = rows.where("content IS NOT NULL").groupBy("content").agg(
        F.min("id").alias("class_id"), F.max(F.coalesce(is_query, F.lit(False))).alias("asks")
    )
    classes, _ = cut(classes, "classes")
    none = F.lit(None).cast("long").alias("votes")
    members = rows.join(classes, "content", "left").select(
        F.lit("member").alias("kind"),
        "id",
        F.when(F.col("content").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        none,
    )
    chosen = classes.where("class_id IS NOT NULL").select(F.col("class_id").alias("id"), "content", "asks")
    described = rows.where("length(bits) > 0").join(chosen, ["id", "content"])
    described, _ = cut(described.dropDuplicates(["id", "content"]), "described")
    asking = described.where("asks").select("id", "places", "bits")
    size = asking.agg(F.sum(F.length("bits"))).first()[0] or 0
    if size <= (TABLE_BYTES if table_bytes is None else table_bytes):
        rows = asking.collect()  # of the size just checked
        found = _search(described, [r["id"] for r in rows], [bytes(r["places"]) for r in rows], [bytes(r["bits"]) for r in rows])
    else:
        found = _joined(described, asking)
    return members.unionByName(
        found.select(F.lit("match").alias("kind"), F.col("query_id").alias("id"), F.col("id").alias("class_id"), "votes")
    )


def rendered(vectors: DataFrame, side: int = 64) -> DataFrame:
    """(id, media): a texture for each of vectors(id, embedding), for tables that have no images.

    A vector weighs fixed waves and spots, so that equal vectors give equal images, and near ones near
    images. A null or empty vector gives null media; a missing entry counts as zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [None if not v else pgm(texture(v, side)) for v in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "media": pa.array(media, pa.binary())})

    return vectors.select("id", "embedding").mapInArrow(run, "id long, media binary")


_patterns: dict[tuple[int, int], np.ndarray] = {}


def texture(vector: list[float], side: int = 64) -> np.ndarray:
    n = len(vector)
    if (n, side) not in _patterns:
        rng = np.random.default_rng(n)
        y, x = np.mgrid[0:side, 0:side] / side
        waves = []
        for _ in range(n):
            turn, rate, phase = rng.uniform(0, 2 * np.pi), rng.uniform(6, 13), rng.uniform(0, 2 * np.pi)
            cx, cy, wide = rng.uniform(0, 1), rng.uniform(0, 1), rng.uniform(0.1, 0.3)
            spot = np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * wide * wide))
            waves.append(spot * np.cos(2 * np.pi * rate * (x * np.cos(turn) + y * np.sin(turn)) + phase))
        _patterns[n, side] = np.stack(waves).reshape(n, -1)
    v = np.nan_to_num(np.asarray([x or 0.0 for x in vector], dtype=np.float64), posinf=1, neginf=-1)
    flat = v @ _patterns[n, side]
    most = np.abs(flat).max() or 1.0
    return np.rint(127.5 + 127.5 * flat / most).astype(np.uint8).reshape(side, side)
