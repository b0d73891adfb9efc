"""Vector codes against plain rounds of nearest entries and means."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from conftest import DATA

from factorloom.llm import codes
from factorloom.llm.queries import codes_sql, op13_codes


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda x, book: min((distance(x, e), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, v, _ in kept:
                x = cut(v)[p]
                groups.setdefault(nearest(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], {}
    for i, v, lab in kept:
        near = [nearest(x, b) for x, b in zip(cut(v), books, strict=True)]
        error = sum(d for d, _ in near)
        by_label[lab] = by_label.get(lab, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in near), error, lab))
    return sorted((repr((i, c, e, by_label[lab], digest)) for i, c, e, lab in out))


def test_same_as_plain_rounds(spark):
    rng = random.Random(1)
    rows = [(k, [rng.choice([-1.0, -0.5, 0.0, 0.25, 1.0]) for _ in range(8)], rng.choice([None, 1, 2])) for k in range(300)]
    rows += [(None, [0.5] * 8, 1), (3, rows[3][1], 2), (4, None, 1), (5, [], 1), (6, [None] + [1.0] * 7, 1), (7, [float("nan")] + [0.0] * 7, 1), (8, [float("inf")] * 8, None)]
    df = spark.createDataFrame([(i, v, lab, "x") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, Code string")
    for entries in (256, 17):
        assert sorted(repr(tuple(r)) for r in codes.compress(df, entries=entries).collect()) == brute(rows, entries=entries)
    assert codes.compress(df.limit(0)).collect() == []
    assert codes.compress(df.filter("vec_id = 4 and embedding is null")).collect() == []
    with pytest.raises(ValueError):
        codes.fit(df, parts=3)
    # vectors of another length take no part
    more = df.unionByName(spark.createDataFrame([(900, [1.0] * 12, 1, "x")], df.schema))
    assert codes.compress(more).count() == codes.compress(df).count()


def test_huge_components_are_cut(spark):
    df = spark.createDataFrame([(k, [3e38 if k % 2 else -3e38] * 4, 1) for k in range(6)], "vec_id long, embedding array<float>, label int")
    assert {r["error"] for r in codes.compress(df).collect()} == {0}
    assert {r["error"] for r in codes.compress(df, entries=1, rounds=0).collect()} == {0, 4 * (2 * codes.LARGEST) ** 2}


@pytest.mark.parametrize("spread", [2, 40])
def test_tree_finds_the_first_of_the_nearest(spread):
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread, (256, 5))
    entries[100:120] = entries[:20]
    points = rng.integers(-spread, spread, (3000, 5))
    index, squares = codes.KdTree.of(entries).nearest(points)
    every = ((points[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    assert (squares == every.min(axis=1)).all() and (index == every.argmin(axis=1)).all()
    same = codes.KdTree.of(np.zeros((50, 3), dtype=np.int64))
    assert (same.nearest(rng.integers(-9, 9, (20, 3)))[0] == 0).all()


def test_decoded_error(spark):
    df = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet")
    books = codes.fit(df, rounds=2)
    rows = codes.decode(codes.encode(df, books), books).collect()
    for r in rows[:50]:
        v = [math.floor(1024 * x) for x in r["embedding"]]
        assert sum((a - b) ** 2 for a, b in zip(v, r["vector"], strict=True)) == r["error"]


def test_query_is_its_sql(spark):
    folder = DATA / "sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    found = op13_codes(spark, str(folder))
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({codes_sql()})").fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
