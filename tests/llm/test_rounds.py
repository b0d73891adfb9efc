"""Links that lie together are connected in one round, and votes by digits are plain counts."""

from __future__ import annotations

import random

import numpy as np

from factorloom.llm import components, lines


def test_chain_takes_few_jobs(spark):
    rng = random.Random(4)
    names = [rng.randrange(-(10**18), 10**18) for _ in range(3000)]
    links = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in zip(names, names[1:], strict=False) if a != names[1500]]
    df = spark.createDataFrame(rng.sample(links, len(links)), "a long, b long").coalesce(1)
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        got = {r["node"]: r["root"] for r in components.components(df).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    first, second = {got[n] for n in names[:1501]}, {got[n] for n in names[1501:]}
    assert len(got) == 3000 and len(first) == len(second) == 1 and first != second and first <= set(names[:1501])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) <= 16


def test_stars_in_parts_connect_the_same(spark, monkeypatch):
    monkeypatch.setattr(components, "STARRED", 50)
    rng = random.Random(8)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    whole = components.first_of(*np.array(links).T, 400)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert {(got[a], whole[a]) for a in got} == {(r, whole[r]) for r in got.values()}


def test_votes_are_counts():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**64, 50, dtype=np.uint64)
    sizes = np.array([1, 2, 3, 4, 5, 7, 8, 9, 300, 2])
    codes, starts = rng.integers(0, 50, sizes.sum()), np.cumsum(sizes) - sizes
    got = lines.votes(hashes, codes, starts)
    for k, (start, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        own = hashes[codes[start : start + n]]
        assert int(got[k]) == sum(1 << b for b in range(64) if 2 * int((own >> np.uint64(b) & np.uint64(1)).sum()) > n)
