"""The pipeline's near_dedup against all pairs of documents."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lodestar.llm import nearcopies, simhash


def plain_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_groups(texts):
    """For each row its group, as the smallest row that links reach: Jaccard of 0.8 or more over all pairs."""
    sets = [plain_set(t) for t in texts]
    has = defaultdict(list)
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    empty = None
    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in has[s])
        near = [j for j, n in shared.items() if 10 * n >= 8 * (len(own) + len(sets[j]) - n)]
        if not own:
            near = [] if empty is None else [empty]
            empty = i if empty is None else empty
        for j in near:
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
        for s in own:
            has[s].append(i)
    return [top(i) for i in range(len(texts))]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_stage_keeps_one_of_each_group(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    roots = plain_groups([t for _, t in rows])
    want = sorted({rows[r][0] for r in roots})
    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == want


@pytest.mark.parametrize("most", [3, 128])
def test_groups_of_edited_copies(spark, monkeypatch, most):
    """Pairs on both sides of 0.8, chains, and a dense group that is cut into pieces."""
    monkeypatch.setattr(nearcopies, "MOST", most)
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(8, 200))]
        texts += [" ".join(words)] + [edited(rng, words, rng.randrange(1, 2 + len(words) // 25)) for _ in range(4)]
    words = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    for _ in range(60):
        words = edited(rng, words, 1).split()  # a chain: neighbours are near, the ends are not
        texts.append(" ".join(words))
    texts += [edited(rng, words, 4) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nearcopies.components(df).collect()}
    roots = plain_groups(texts)
    assert 40 < len(set(roots)) < len(texts)
    assert [got[i] for i in range(len(texts))] == roots


def test_simhash_links_are_held_against_similarity(spark, monkeypatch):
    """Without any band, operator 4's links remain; those below 0.8 don't count."""
    monkeypatch.setattr(nearcopies, "band_keys", lambda own: np.zeros(0, np.int64))
    rng = random.Random(5)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        texts += [" ".join(words), edited(rng, words, 1)]
    texts += ["same words each time " * n for n in (30, 40)] + ["a", "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nearcopies.components(df).collect()}
    roots = plain_groups(texts)
    assert all(roots[got[i]] == roots[i] for i in got)
    near = [i for i in range(0, 60, 2) if (simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[i + 1], 5)).bit_count() <= 3]
    assert len(near) > 5 and all(got[i + 1] == i for i in near)
    assert got[61] == 60 and got[62] != got[63]


def test_rows_of_a_dense_group(spark, monkeypatch):
    """A node is some rows for each of its buckets at most, not one for each piece of each."""
    monkeypatch.setattr(nearcopies, "MOST", 16)
    made = []
    compared = nearcopies._compared
    monkeypatch.setattr(nearcopies, "_compared", lambda rows, texts: made.append(rows.count()) or compared(rows, texts))
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [edited(rng, words, 1) for _ in range(400)]
    texts += [edited(rng, words, 14) for _ in range(10)]  # in the group's buckets, and not in the group
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nearcopies.components(df).collect()}
    assert [got[i] for i in range(len(texts))] == plain_groups(texts)
    keys = Counter(k for t in set(texts) for k in set(nearcopies.band_keys(nearcopies.shingles(t)).tolist()))
    members = sum(n for n in keys.values() if n > 1)
    assert sum(made) < 3 * members


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "a B"), (5, "a b"), (6, "é " * 3000), (None, "a b"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = nearcopies.components(df).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in out) == [
        ("1", 1), ("2", 1), ("3", 1), ("4", 4), ("5", 5), ("5", 5), ("6", 6), ("None", 1), ("None", 5)
    ]
    assert nearcopies.components(df.limit(0)).count() == 0
    assert len(nearcopies.band_keys(np.arange(10_000, dtype=np.uint64))) == nearcopies.BANDS
