"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import pytest
from conftest import DATA

from factorloom.llm import resampling


def brute(rows, target, buckets=10_000, longest=1, min_words=20, percent=10):
    lower = {c: c + 32 for c in range(65, 91)}

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return len(words), [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]

    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out, long = [], []
    for k, (i, text) in enumerate(rows):
        n, own = features(text)
        weight = sum(gain(bucket(f)) for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n >= min_words:
            long.append(k)
    order = sorted(long, key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for rank, k in enumerate(order[: percent * len(long) // 100]):
        out[k][4] = rank + 1
    return sorted(map(repr, map(tuple, out)))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (3, 35), (1, 100), (1, 0)])
def test_same_as_plain(spark, longest, percent):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, "a b " * 30), (7_001, None), (7_002, ""), (7_003, "Ünï-cödé 日本 x1 " * 9), (7_004, "word " * 40_000), (7_005, "-- !!"), (7_006, "\x00A\x7fz " * 20)]
    bench = [r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet").select("text").collect()] + [None, ""]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, Rank int")
    target = spark.createDataFrame([(t,) for t in bench], "text string")
    found = resampling.resample(docs, target, longest=longest, percent=percent)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert got(found) == brute(rows, bench, longest=longest, percent=percent)


def test_ties_repeated_rows_and_empty_tables(spark):
    rows = [(k // 2, "same words over and over again " * 5) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    none = docs.limit(0)
    found = resampling.resample(docs, none, percent=33).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 67))
    ranked = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert [(-r["score"], r["doc_id"]) for r in ranked] == sorted((-r["score"], r["doc_id"]) for r in ranked)
    assert resampling.resample(none, docs).collect() == []
    # without words in the target all buckets are alike but for the corpus
    assert {r["weight"] for r in found} == {resampling.resample(docs, none).first()["weight"]}


def test_counts_are_of_every_partition(spark):
    docs = spark.createDataFrame([(k, "alpha beta alpha") for k in range(100)], "doc_id long, text string").repartition(7)
    counts, long = resampling.bucket_counts(docs, "text", 10_000, 1, 3)
    assert long == 100 and counts.sum() == 300 and counts[crc32(b"alpha") % 10_000] == 200
    assert resampling.bucket_counts(docs.limit(0), "text", 10_000, 1, 3)[0].sum() == 0
