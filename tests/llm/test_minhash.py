"""MinHash near-duplicates against all pairs of documents compared, and links in crowded cells."""

from __future__ import annotations

import random

import numpy as np
import pytest
from conftest import DATA

from factorloom.llm import components, lines, minhash


def brute(rows, words=2, percent=80):
    sets = []
    for _, text in rows:
        own = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").split()
        sets.append({tuple(own[k : k + words]) for k in range(len(own) - words + 1)} or ({tuple(own)} if own else set()))
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and root[a] != root[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root = [root[b] if x == root[a] else x for x in root]
    least = {r: min((i for (i, _), x in zip(rows, root, strict=True) if x == r and i is not None), default=None) for r in set(root)}
    return sorted(((i, len(s), least[r], i == least[r]) for (i, _), s, r in zip(rows, sets, root, strict=True)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(count, seed, words=3000, group=12):
    rng = random.Random(seed)
    known = [f"w{k}" for k in range(words)]
    base = [rng.choices(known, k=rng.randrange(3, 250)) for _ in range(group)]
    rows = []
    for k in range(count):
        own = list(rng.choice(base))
        for _ in range(rng.randrange(12)):
            own[rng.randrange(len(own))] = rng.choice(known)
        rows.append((k, " ".join(own)))
    return rows


def test_same_as_all_pairs(spark):
    rows = made(150, 5) + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "two words"), (None, "two  WORDS"), (None, "alone null"), (907, "x" * 50_000)]
    rows += [(3, rows[3][1]), (910, "É é"), (911, "é é")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, Kept int")
    assert got(minhash.near_duplicates(df)) == brute(rows)
    assert minhash.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize("block", [7, 4096])
def test_crowded_cells_lose_nothing(spark, monkeypatch, block):
    """Near copies of one text, many of which are linked with few others, whatever the sizes of blocks and of cells compared at once."""
    monkeypatch.setattr(components, "PAIRED", 3)
    monkeypatch.setattr(components, "BLOCK", block)
    rows = made(120, 9, group=2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(df)) == brute(rows)


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(minhash.near_duplicates(df)) == brute(rows)


def test_signatures_tell_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        errors = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
            n = int(1000 * share)
            rest = (1000 - n) // 2
            a, b = both[: n + rest], np.concatenate([both[:n], both[n + rest :]])
            x, y = (minhash.low_bits(minhash.minima(s)) for s in (a, b))
            errors.append(minhash.estimate(x, y) - n / 1000)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_pairs_at_the_least_similarity_share_a_band_and_pass_the_estimate():
    rng = random.Random(7)
    for n in (5, 10, 60, 1000):
        shared = passed = 0
        for _ in range(300):
            union = np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64)
            gone = rng.sample(range(n), n // 5)
            split = rng.randrange(len(gone) + 1)
            a, b = (minhash.minima(np.sort(np.delete(union, x))) for x in (gone[:split], gone[split:]))
            shared += bool(set(minhash.bands(a).tolist()) & set(minhash.bands(b).tolist()))
            passed += minhash.apart(minhash.low_bits(a), minhash.low_bits(b)) <= minhash.differing(0.8)
        assert shared >= 299 and passed >= 299, (n, shared, passed)


@pytest.mark.parametrize("common", [True, False])
def test_near_lines_in_one_crowded_block(spark, common):
    """200 pairs of lines of 40 words with 8 edits each; with common words at either end all share a block."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=rng.randrange(4, 9)))
    ends = [word() for _ in range(4)], [word() for _ in range(4)]
    rows = []
    for k in range(200):
        own = [word() for _ in range(32 if common else 40)]
        own = ends[0] + own + ends[1] if common else own
        other = list(own)
        for at in rng.sample(range(4, 36) if common else range(40), 8):
            other[at] = word()
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r["doc_id"] for r in lines.dedup_lines(df).collect() if r["n_removed"]}
    assert gone <= set(range(1, 400, 2)) and len(gone) >= 180, len(gone)
    if common:
        assert len(gone) == 200
