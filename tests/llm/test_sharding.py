"""Shards against their SQL with small limits, and their edge cases."""

from __future__ import annotations

import duckdb
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from factorloom.llm import sharding
from factorloom.llm.queries import sharding_sql


@pytest.mark.parametrize("limit", [2_000, 50_000, 400_000])
def test_same_as_sql(spark, limit):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    got = sharding.shard(docs, ["doc_id"], F.octet_length("text"), limit, step=5).drop("text")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/sf0.001/documents.parquet'")
    want = con.execute(f"SELECT doc_id, depth, prefix, n_bytes FROM ({sharding_sql(limit)})").fetchall()
    assert sorted(tuple(r) for r in got.select("doc_id", "depth", "prefix", "n_bytes").collect()) == sorted(want)


def test_limits_hold_with_a_hot_key(spark):
    rows = [(k % 7 if k % 3 else 1, 100 + k % 50) for k in range(3000)] + [(None, 10), (None, None), (99, 99_999)]
    df = spark.createDataFrame(rows, "key long, size long").repartition(3)
    got = sharding.shard(df, ["key"], F.col("size"), 5_000)
    sums = got.groupBy("depth", "prefix", "page").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).collect()
    assert got.count() == len(rows)
    assert all(r["b"] <= 5_000 or r["n"] == 1 for r in sums)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "id long, text string, Depth int")
    assert sharding.shard(empty, ["id"], F.octet_length("text"), 10).collect() == []
    df = spark.createDataFrame([(1, "a" * 50, 7), (1, "a" * 50, 7), (None, None, 8)], "id long, text string, Depth int")
    got = sharding.shard(df, ["id"], F.octet_length("text"), 60)
    assert got.columns == ["id", "text", "depth", "prefix", "page", "n_bytes"]
    assert sorted(r["n_bytes"] for r in got.collect()) == [0, 50, 50]
    assert len({(r["depth"], r["prefix"], r["page"]) for r in got.collect() if r["id"] == 1}) == 2
