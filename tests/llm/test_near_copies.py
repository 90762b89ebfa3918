"""The pipeline's near-dedup against all pairs by brute force, on planted copies of Jaccard 0.8 to 0.95 and texts below 0.8."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from palimpsest.llm import near_copies

VOCAB = [f"w{i}" for i in range(5000)]


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def planted():
    """Texts with copies in which 2 to 9 of 200 words differ (0.95 to below 0.65), a family of many copies, short and empty texts."""
    r = random.Random(5)
    out = []
    for k in range(40):
        words = [r.choice(VOCAB) for _ in range(200)]
        copy = list(words)
        for i in r.sample(range(5, 195, 12), 1 + k % 8):
            copy[i] = "changed"
        out += [" ".join(words), "  ".join(copy).upper()]
    base = [r.choice(VOCAB) for _ in range(150)]
    for k in range(40):
        copy = list(base)
        for i in r.sample(range(5, 145, 9), k % 5):
            copy[i] = f"x{k}"
        out.append(" ".join(copy))
    return out + [None, "", " \n", "one two", "One  two", "one two three", out[0]]


def kept(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in range(len(texts)) if root[i] == i}


@pytest.mark.parametrize("tile", [1024, 8])
def test_stage_drops_copies_from_0_8(spark, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "TILE", tile)
    texts = planted()
    pairs = [jaccard(texts[2 * k], texts[2 * k + 1]) for k in range(40)]
    assert sum(0.8 <= p < 0.85 for p in pairs) >= 5 and sum(0.7 < p < 0.8 for p in pairs) >= 5
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    out = corpus_pipeline.near_dedup(spark, docs.repartition(5), "")
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == kept(texts)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_similarity_is_exact():
    texts = planted()
    sets = near_copies.shingles(pa.array(texts), 5)
    for a, b in zip(range(0, 80, 2), range(1, 80, 2)):
        x, y = sets[a], sets[b]
        assert len(np.intersect1d(x, y)) / len(np.union1d(x, y)) == jaccard(texts[a], texts[b])
    four, five = np.arange(4, dtype=np.uint64), np.arange(5, dtype=np.uint64)
    assert near_copies.alike(four, five, 0.8) and not near_copies.alike(four[:3], five[:4], 0.8)
