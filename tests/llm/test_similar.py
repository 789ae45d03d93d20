"""Near-duplicates of the pipeline against all pairs of texts."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import simhash, similar


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def plain_groups(texts):
    """The least position of each text's component over all pairs at a similarity of 0.8 or more."""
    sets, root = list(map(plain_set, texts)), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(texts))]


def near_copies():
    rng = random.Random(6)
    texts = [None, "", " \n", "a b", "A  b", "a b c"]
    for n, times, changes in ((300, 30, (0, 1, 3, 6, 9, 14)), (100, 30, (1, 2, 3, 6)), (60, 40, (1, 2))):
        for _ in range(6):
            base = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(times // 5):
                copy = list(base)
                for at in rng.sample(range(n), rng.choice(changes)):
                    copy[at] = f"new{rng.randrange(10**6)}"
                texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_stage_links_all_similar_texts(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    want = plain_groups(texts)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, "").collect())
    assert kept == sorted(set(want)) and len(kept) < 100 < len(texts)


def test_stage_takes_candidates_from_fingerprints(spark, monkeypatch):
    # With no candidates by shingles a copy within 3 bits still goes, unless its shingles differ too much.
    words = [f"w{i}" for i in range(500)]
    a = words * 4
    b = list(a)
    for at in range(4, 500, 2):
        b[at] = f"x{at}"
    texts = [" ".join(x) for x in (a, [*a, "end"], b)]
    bits = [simhash.fingerprint(t.encode()) for t in texts]
    assert all((bits[0] ^ x).bit_count() <= 3 for x in bits[1:])
    monkeypatch.setattr(similar, "near_duplicates", lambda docs: docs.select("doc_id", F.col("doc_id").alias("component_id")))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_copies(spark, docs, "").collect()) == [0, 2]


@pytest.mark.parametrize("hubs", [(), (1,), (2, 4)])
def test_crowded_keys_lose_no_pair(spark, hubs):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    # A chain and a crowd around it: most pairs share keys, not all are similar.
    for i in range(60):
        copy = list(base)
        for at in rng.sample(range(200), rng.choice((1, 3, 5, 8))):
            copy[at] = f"x{i}"
        texts.append(" ".join(copy))
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[5]), (3, texts[3])], "doc_id int, text string")
    got = defaultdict(set)
    for r in similar.near_duplicates(docs, crowd=3, hubs=hubs).collect():
        got[r["doc_id"]].add(r["component_id"])
    want = plain_groups(texts)
    assert got == {i: {c} for i, c in enumerate(want)} | {None: {want[5]}}
    assert 1 < len(set(want)) < len(texts)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    for n, s in ((2000, 0.8), (2000, 0.5), (60, 0.8)):
        same = 0
        for _ in range(40):
            pool = rng.integers(1 << 63, size=2 * n, dtype=np.uint64)
            both = round(2 * n * s / (1 + s))
            a, b = pool[:n], np.concatenate([pool[:both], pool[n : 2 * n - both]])
            x, y = similar.signatures([np.unique(a), np.unique(b)])
            same += (x == y).mean() / 40
        assert abs(same - s) < 0.03
    none = similar.signatures([np.zeros(0, dtype=np.uint64), np.array([7], dtype=np.uint64)])
    assert (none[0] == similar.EMPTY).all() and len(set(none[1].tolist())) == 1
