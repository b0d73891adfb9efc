"""SimHash, quality rules, toxicity, search and the pipeline against brute force and held-out labels."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F

from factorloom.llm import components, quality, simhash, topk, toxicity
from factorloom.llm import queries as llm

SMALL = str(DATA / "sf0.001")


def brute_fingerprint(text, words=3):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not own:
        return 0
    shingles = [" ".join(own[k : k + words]) for k in range(len(own) - words + 1)] or [" ".join(own)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_fingerprints_and_components(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in docs]
    rows += [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n\t"), (10**6 + 3, "ÀB a\x0bC"), (None, rows[0][1]), rows[1]]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
        if all((prints[a] ^ prints[b]).bit_count() > 2 or root[a] == root[b] for a in range(len(rows)) for b in range(a)):
            break
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(least.get(r, math.inf), i if i is not None else math.inf)
    want = Counter((i, f"{f:016x}", int(least[r])) for (i, _), f, r in zip(rows, prints, root))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert sum(r["first"] for r in got) == len(set(root))


@pytest.mark.parametrize("heavy", [64, 2])
def test_links_connect_all_pairs(spark, heavy):
    rng = random.Random(heavy)
    bases = [rng.getrandbits(64) for _ in range(6)]
    prints = set(bases)
    for _ in range(400):
        x = rng.choice(bases)
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "f long"), heavy=heavy)
    pairs = [(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)

    def groups(edges):
        root = {x: x for x in prints}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[top(a)] = top(b)
        return Counter(frozenset(x for x in prints if top(x) == t) for t in {top(x) for x in prints})

    every = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2]
    assert groups(pairs) == groups(every)


def test_point_distance_is_a_lower_bound(spark):
    rng = random.Random(1)
    rows = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(500)]
    p = f"bit_count({simhash.point('a')} ^ {simhash.point('b')})"
    got = spark.createDataFrame(rows, "a long, b long").selectExpr(f"{p} AS m", "bit_count(a ^ b) AS h", "a", "b").collect()
    count = lambda x, s: (x >> 2 * s & 3).bit_count()
    for r in got:
        assert r["m"] == sum(abs(count(r["a"], s) - count(r["b"], s)) for s in range(32)) <= r["h"]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (None, 3), (7, 6)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in got}
    assert len(roots) == 301 + 200 and len({roots[k] for k in range(301)}) == 1 and len(set(roots.values())) == 2
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_one_of_each(spark):
    rows = [(3, "a b c d", "x"), (1, "a b c d", "y"), (None, "a b c d", "z"), (2, "other words in here", "w"), (2, "other words in here", "w"), (9, None, "v"), (8, "", "u")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _row string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([rows[1], rows[3], rows[6]], key=repr)
    assert got.columns == ["doc_id", "text", "_row"]
    assert simhash.one_of_each(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def brute_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    inside = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_measures(spark):
    rng = random.Random(4)
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts += ["".join(rng.choices(["a ", "b ", "a b a b a ", "\n", "\x0b", "#", "é", " ", "x"], k=rng.randrange(60))) for _ in range(300)]
    texts += [None, "", " ", "a", "one two three four five " * 3, "w " * 20_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = df.select("text", quality.measures(F.col("text")).alias("m")).select("text", "m.*").collect()
    assert all(tuple(r)[1:] == brute_measures(r["text"]) for r in got)


def test_binomial_bound():
    assert quality.binomial_upper(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100))
    assert quality.binomial_upper(5, 5, 0.05) == 1.0
    k, n, d = 3, 200, 0.01
    p = quality.binomial_upper(k, n, d)
    assert sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) == pytest.approx(d, rel=1e-6)


def test_cutoffs_keep_their_guarantee(spark):
    rng = random.Random(6)
    rows = []
    for k in range(6000):
        good = rng.random() < 0.8
        share = (0.0 if rng.random() < 0.995 else 0.3) if good else rng.choice([0.0, 0.2, 0.3])
        rows.append((rng.choice(["en", "de", None]), good, k % 2 == 0, 100, 500, int(500 * share), 0, 0))
    kinds = "stratum string, good boolean, holdout boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    df = spark.createDataFrame(rows, kinds)
    cutoffs = quality.fit(df, risk=0.03)
    assert set(cutoffs.strata) == {"en", "de", ""} and all("symbols" in c for c in cutoffs.strata.values())
    out = quality.verdicts(df, cutoffs, F.col("stratum")).collect()
    bad = [r for r in out if not r["good"]]
    assert sum(not r["kept"] for r in bad) / len(bad) > 0.5
    for s in ("en", "de", None):
        good = [r for r in out if r["good"] and r["stratum"] == s]
        assert sum(not r["kept"] for r in good) / len(good) <= 0.03
    assert quality.fit(df.limit(0)) == quality.Cutoffs()
    few = quality.fit(df.limit(40), risk=0.01)
    assert not few.strata and not few.other


def test_quality_query(spark):
    got = llm.op6_quality(spark, str(DATA / "sf0.1")).join(spark.read.parquet(f"{DATA}/sf0.1/labels.parquet"), "doc_id").toPandas()
    rest = got[~got["base_failed"]]
    assert (~rest.loc[rest["quality"] == 1, "kept"]).mean() <= 0.02
    assert (~rest.loc[rest["quality"] == 0, "kept"]).mean() >= 0.8


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, None, 1), (None, "word " * 30, "en", 2), (1, "", "en", 3)], "doc_id long, text string, lang string, N_Words int")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    got = quality.judge(docs, labels)
    assert [c.lower() for c in got.columns] == ["doc_id", "text", "lang", *quality.BASE, "base_failed", "kept"]
    assert all(r["base_failed"] and not r["kept"] for r in got.collect())
    assert quality.judge(docs.limit(0), labels.limit(0)).collect() == []


def test_toxicity_of_held_out_documents(spark):
    folder = str(DATA / "sf0.1")
    got = llm.op7_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    y, s = held["toxic"].to_numpy(), held["score"].to_numpy()
    assert s.min() >= 0 and s.max() <= 1 and (held["predicted"] == (s >= 0.3)).all()
    assert toxicity._area(s, y) >= 0.93
    assert held.loc[y == 1, "predicted"].mean() >= 0.85 and held.loc[y == 0, "predicted"].mean() <= 0.04


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "word " * 10_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0), labels.filter("toxic = 0")):
        model = toxicity.fit(docs, some)
        got = docs.select(toxicity.scores(F.col("text"), model)).collect()
        assert len(got) == 4 and all(0 <= r[0] <= 1 for r in got)
    assert docs.limit(0).select(toxicity.scores(F.col("text"), model)).collect() == []


def brute_top(rows, queries, k):
    out = []
    for q, v in queries:
        own = sorted((-sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(own[:k])]
    return sorted(out)


def test_top_k(spark):
    rng = random.Random(8)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(8)]) for k in range(700)]
    rows += [(700 + k, [0.5] * 8) for k in range(300)] + [(5000 + k, [1.0, 2.0]) for k in range(3)]
    bad = [(1, None), (2000, []), (2001, [1.0, None]), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").repartition(3)
    asked = [r for r in rows if r[0] % 50 == 0]
    got = topk.search(df, df.filter("vec_id % 50 = 0"), block=200)
    assert sorted(map(tuple, got.collect())) == brute_top(rows, asked, 5)
    assert topk.search(df.limit(0), df.limit(0)).collect() == []


def test_top_k_of_huge_numbers(spark):
    rows = [(0, [1e9, 1.0]), (1, [1e9, 0.5]), (2, [1e9, 0.25]), (3, [-1e9, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, df.filter("vec_id = 0"), k=2, scale=1.0)
    assert [r["vec_id"] for r in got.orderBy("rank").collect()] == [1, 2]
    far = topk.search(df, df.filter("vec_id = 0"), k=3, scale=1e6).orderBy("rank").collect()
    assert [r["vec_id"] for r in far] == [1, 2, 3] and far[0]["score"] == 2**63 - 1


def test_bounds_hold_and_rule_out():
    rng = np.random.default_rng(2)
    for dim, spread, share in ((4, rng.exponential(size=(5000, 1)), 0.5), (64, 1.0, 0.4)):
        v = rng.normal(size=(5000, dim))
        v = np.floor(256 * v / np.linalg.norm(v, axis=1)[:, None] * spread)
        pivots = topk.choose_pivots(v[:500])
        table, squares = pivots.distances(v), (v**2).sum(axis=1)
        assert np.allclose(table[:, 1:], np.linalg.norm(v[:, None] - pivots.points[None], axis=2), atol=1e-4)
        bounds = topk.upper_bounds(pivots.places(table[:20]), pivots.places(table), squares[:20], squares)
        assert (bounds >= v[:20] @ v.T).all()
        for q in range(20):
            open_ = np.flatnonzero(np.arange(5000) != q)
            _, products, seen = topk.best(v[q], bounds[q], open_, np.arange(5000), v, 5, float("-inf"), False)
            assert seen < share * 5000 and products.tolist() == sorted((v @ v[q])[open_], reverse=True)[:5]


def test_products_beyond_a_long_are_ranked(spark):
    rows = [(k, [1e10 * (k + 1), 1.0]) for k in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, df.filter("vec_id = 0"), k=3, scale=1.0).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [8, 7, 6] and all(r["score"] == 2**63 - 1 for r in got)
    keys = [topk.sort_key(x) for x in (-(2**90), -(2**64), -300, -1, 0, 1, 255, 256, 2**63, 2**64, 2**90)]
    assert keys == sorted(keys)


def test_repeated_vectors_and_queries(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.search(df, df.filter("vec_id = 50"), k=2)
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == sorted([(1, 1, 65536), (2, 1, 65536), (1, 2, 131072), (2, 1, 32768)])


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as pipeline
    from factorloom.llm.common import stored
    from test_lines import brute

    folder = str(DATA / "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    kept = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        docs = stored(stage(spark, docs, folder))
        kept.append(docs)
        if k < 4:
            assert docs.columns == columns
    scores = llm.op7_toxicity(spark, folder)
    assert ids(kept[0]) == ids(scores.filter("score < 0.3"))
    assert ids(kept[1]) < ids(kept[0])
    assert ids(kept[1]) == ids(quality.judge(kept[0], spark.read.parquet(f"{folder}/labels.parquet")).filter("kept"))
    rows = sorted((r["doc_id"], r["text"]) for r in kept[1].collect())
    prints = {i: t for i, t, _ in brute(rows)} if len(rows) < 400 else None
    after = {r["doc_id"]: r["text"] for r in kept[2].collect()}
    if prints:
        assert after == {i: t for i, t in prints.items() if t.strip()}
    assert all(r["n_chars"] == len(r["text"]) for r in kept[2].collect() if r["text"] != dict(rows)[r["doc_id"]])
    classes = simhash.near_duplicates(kept[2]).toPandas()
    assert ids(kept[3]) == set(classes.loc[classes["first"], "doc_id"])
    assert ids(kept[4]) == ids(kept[3]) and pipeline.ORACLE_SQL is None
    assert Counter(r["doc_id"] for r in kept[4].filter("start = 0").collect()).most_common(1)[0][1] == 1
