"""Importance resampling of documents towards the word distribution of a target, in two passes over the texts.

The features of a text are its runs of consecutive words; each falls into one of
a fixed number of buckets. The first pass counts buckets with ``np.bincount``: a
partition gives one vector, as long as there are buckets, and ``treeReduce``
adds these up, so the driver gets a few vectors whatever the corpus holds. What
a bucket gains, the log of its share in the target over its share in the corpus,
is broadcast. The second pass gathers gains by bucket and sums them up for each
document by a weighted ``np.bincount``.

Documents are drawn by the largest sums of their mean gain and a Gumbel noise
that a hash of the id gives, which is sampling without replacement with
probabilities that go with the exponent of the gain. Sums are whole numbers of a
narrow range, so a count for each is all that a draw from the whole corpus needs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import durable, quoted, slices, worker_memory

#: What separates words: U+0000 to U+007F without digits and letters. A-Z become a-z.
SEPARATORS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
TABLE = bytes.maketrans(SEPARATORS + bytes(range(65, 91)), b" " * len(SEPARATORS) + bytes(range(97, 123)))


def words_of(text: str) -> list[bytes]:
    """The words of a text in UTF-8: what stands between ASCII characters that are neither digits nor letters, A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(TABLE).split()


def features_of(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` words, joined by a space, repeats included."""
    found = words
    for n in range(2, longest + 1):
        found = found + list(map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)))
    return found


def bucketed(texts: list[str], buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, features of each text, the features' buckets, text after text)."""
    n_words = np.zeros(len(texts), dtype=np.int64)
    n_features = np.zeros(len(texts), dtype=np.int64)
    found: list[bytes] = []
    for k, text in enumerate(texts):
        words = words_of(text)
        own = features_of(words, longest)
        n_words[k], n_features[k] = len(words), len(own)
        found += own
    return n_words, n_features, (np.fromiter(map(crc32, found), dtype=np.uint32, count=len(found)) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(docs: DataFrame, text_col: str, buckets: int, longest: int, min_words: int) -> tuple[np.ndarray, int]:
    """How many features of all texts each bucket has, and how many texts have ``min_words`` words or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("bucket counts", lambda: None)
        total = np.zeros(buckets + 1, dtype="<i8")
        for batch in batches:
            for part in slices([t or "" for t in batch.column(0).to_pylist()]):
                n_words, _, found = bucketed(part, buckets, longest)
                total[:buckets] += np.bincount(found, minlength=buckets)
                total[buckets] += int((n_words >= min_words).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    vectors = docs.select(quoted(text_col).cast("string").alias("t")).mapInArrow(run, "v binary").rdd
    if not vectors.getNumPartitions():
        return np.zeros(buckets, dtype=np.int64), 0
    total = vectors.map(lambda r: np.frombuffer(r["v"], dtype="<i8")).treeReduce(lambda a, b: a + b)
    return total[:buckets], int(total[buckets])


def gains_of(target: np.ndarray, corpus: np.ndarray) -> np.ndarray:
    """Of each bucket a thousand times the log of its share in the target over that in the corpus, both with one more in each; floored."""
    n, t, s = len(corpus), float(target.sum()), float(corpus.sum())
    ratios = ((target + 1.0) * (s + n)) / ((corpus + 1.0) * (t + n))
    return np.array([math.floor(1000 * math.log(x)) for x in ratios.tolist()], dtype=np.int64)


def noise(id_col: Column, seed: int) -> Column:
    """A thousand times the Gumbel noise, floored, that the first 32 bits of the SHA-256 of ``seed:id`` stand for; of a null id those of ``seed:``."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    buckets: int = 10_000,
    longest: int = 1,
    min_words: int = 20,
    percent: int = 10,
    seed: int = 2024,
) -> DataFrame:
    """(id, n_features, weight, score, rank) of each row of ``docs``; rank is null unless the row is drawn.

    weight: the mean gain of the text's features, floored, 0 without any; score:
    weight and the noise of the id. Of the N texts with ``min_words`` words or
    more the ``percent`` N / 100 with the highest scores are drawn, equal scores
    by smaller id. ``target`` may be any table of texts.

    Null texts are empty and have no features; null ids have one noise and come
    last among equal scores. Repeated rows are documents of their own: with one
    id they have one noise, and those that are alike in all else stand in any
    order. Of an empty table nothing comes out; an empty target is one where all
    buckets are alike. Other columns aren't read.
    """
    corpus, n_long = bucket_counts(docs, text_col, buckets, longest, min_words)
    wanted, _ = bucket_counts(target, target_col, buckets, longest, min_words)
    gains = docs.sparkSession.sparkContext.broadcast(gains_of(wanted, corpus).astype(np.float64))
    kind = docs.select(quoted(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("gains", lambda: None)
        for batch in batches:
            n_words, n_features, sums = [], [], []
            for part in slices([t or "" for t in batch.column(1).to_pylist()]):
                words, features, found = bucketed(part, buckets, longest)
                own = np.repeat(np.arange(len(part)), features)
                # gains are whole numbers, so their sums are exact in doubles
                sums.append(np.bincount(own, weights=gains.value[found], minlength=len(part)).astype(np.int64))
                n_words.append(words)
                n_features.append(features)
            none = [np.zeros(0, dtype=np.int64)]
            counts, total = np.concatenate(n_features + none), np.concatenate(sums + none)
            weight = total // np.maximum(counts, 1)
            long = np.concatenate(n_words + none) >= min_words
            arrays = [batch.column(0), pa.array(counts), pa.array(weight), pa.array(long)]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "n_features", "weight", "long"])

    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("t"))
    rows = rows.mapInArrow(run, f"id {kind}, n_features long, weight long, long boolean")
    scored = durable(rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
    least, above = _threshold(scored.filter("long"), n_long * percent // 100)
    if least is None:
        return _result(scored.withColumn("rank", F.lit(None).cast("long")), id_col)
    # scores are whole numbers of a narrow range, so there are few of them; those of one score are a small part of all
    own = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight")
    before = docs.sparkSession.createDataFrame(above, "score long, above long")
    top = scored.filter(F.col("long") & (F.col("score") >= least)).join(F.broadcast(before), "score")
    top = top.withColumn("rank", F.col("above") + F.row_number().over(own))
    top = top.withColumn("rank", F.when(F.col("rank") <= n_long * percent // 100, F.col("rank"))).drop("above")
    rest = scored.filter(~F.col("long") | (F.col("score") < least)).withColumn("rank", F.lit(None).cast("long"))
    return _result(top.unionByName(rest), id_col)


def _result(rows: DataFrame, id_col: str) -> DataFrame:
    return rows.select(F.col("id").alias(id_col), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def _threshold(scored: DataFrame, count: int) -> tuple[int | None, list[tuple[int, int]]]:
    """The least score of the ``count`` highest, and for it and each higher score how many rows are above."""
    if count <= 0:
        return None, []
    # a row for each distinct score: gains and noise are thousandths within some tens of thousands
    above, total = [], 0
    for r in scored.groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect():
        if total >= count:
            break
        above.append((r["score"], total))
        total += r["n"]
    return (above[-1][0], above) if above else (None, [])
