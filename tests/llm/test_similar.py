"""The pipeline's near-dedup against all pairs of documents compared."""

from __future__ import annotations

import random

import numpy as np
import pytest

from factorloom.llm import components, simhash


def brute_kept(rows, least=0.8):
    sets = []
    for _, text in rows:
        own = (text or "").lower().split()
        sets.append({tuple(own[k : k + 5]) for k in range(len(own) - 4)} or {tuple(own)})
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9 and root[a] != root[b]:
                root = [root[b] if x == root[a] else x for x in root]
    return sorted(min(i for (i, _), x in zip(rows, root, strict=True) if x == r) for r in set(root))


@pytest.mark.parametrize("paired", [8, 4])
def test_near_copies_go(spark, paired, monkeypatch):
    import corpus_pipeline as pipeline

    monkeypatch.setattr(components, "PAIRED", paired)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    base = [rng.choices(words, k=rng.randrange(3, 250)) for _ in range(12)]
    rows = [(900, None), (901, ""), (902, " ")]
    for k in range(120):
        own = list(rng.choice(base))
        for _ in range(rng.randrange(6)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((k, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_kept(rows)
    assert sorted(r["doc_id"] for r in simhash.one_of_similar(df).collect()) == want
    assert sorted(r["doc_id"] for r in pipeline.drop_near_copies(spark, df, "").collect()) == want
    assert simhash.one_of_similar(df.limit(0)).collect() == []


def test_pairs_at_the_least_similarity_share_a_segment():
    rng = random.Random(7)
    for n in (5, 9, 10, 20, 60, 200, 1000, 5000):
        found = 0
        for _ in range(200):
            union = np.array([rng.getrandbits(64) for _ in range(max(n, 5))], dtype=np.uint64)
            gone = rng.sample(range(len(union)), len(union) // 5)
            split = rng.randrange(len(gone) + 1)
            a, b = (np.sort(np.delete(union, x)) for x in (gone[:split], gone[split:]))
            found += bool(set(simhash.segment_keys(a, 0.8).tolist()) & set(simhash.segment_keys(b, 0.8).tolist()))
        assert found >= 190, (n, found)


def test_points_of_segments_and_of_whole_fingerprints():
    """Segments go by the counts of their pairs of bits, and pairs in a cell by the distance of these before that of bits."""
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 1 << 63, (500, 4), dtype=np.uint64) for _ in range(2))
    low = np.bitwise_count(simhash.points(a) ^ simhash.points(b)).sum(axis=1, dtype=int)
    far = np.bitwise_count(a ^ b).sum(axis=1, dtype=int)
    counts = lambda x: np.unpackbits(x.astype(">u8").view(np.uint8), axis=1).reshape(len(x), -1, 2).sum(axis=2, dtype=int)
    assert (low == np.abs(counts(a) - counts(b)).sum(axis=1)).all() and (low <= far).all() and (low < far).any()
    asked = []

    def point(x):
        asked.append(len(x))
        return simhash.points(x)

    nearness = components.Nearness(lambda x, y: np.full(np.broadcast(x, y).shape, 120), point=point)
    sizes = np.full(500, 40)
    i, j, found = components.near_in_block(a, b, (sizes, sizes), nearness)
    every = np.bitwise_count(a[:, None] ^ b[None, :]).sum(axis=2, dtype=int)
    assert asked == [500, 500] and sorted(zip(i, j, strict=True)) == sorted(zip(*np.nonzero(every <= 120), strict=True)) and (found == every[i, j]).all()
    # a print and one whose pairs of bits count the same make one cell
    one, other = (np.array([x], dtype=np.uint64) << np.uint64(32) for x in (0b0101, 0b1010))
    assert simhash.segment_keys(one, 0.8).tolist() == simhash.segment_keys(other, 0.8).tolist()
