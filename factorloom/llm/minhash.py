"""Near-duplicate documents by b-bit MinHash.

A document's set holds its distinct shingles. Of each of ``HASHES`` hash
functions the least value over the set is taken; two sets agree on one with the
probability of their Jaccard similarity. Runs of ``ROWS`` minima are bands, and
documents that agree on a band are candidates. Of each minimum only the lowest
two bits are kept, so a signature is a few 64-bit numbers. Those of different
minima agree by chance a quarter of the time, so the share of differing ones is
three quarters of what the similarity lacks to 1; candidates that differ in more
than links do are left out, the others are verified on their full sets.

Equal sets are one by a 128-bit hash. What is linked in cells that very many
documents share is found without looking at all pairs; see ``components``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import durable, join_hot, light, quoted, slices, stored, worker_memory
from factorloom.llm.components import Nearness, linked_in_cells

#: Minima, of which each gives the signature two bits; bands, and minima in a band. Sets of similarity 0.8 share no band once in ten thousand.
HASHES, BANDS, ROWS = 256, 24, 5
#: Standard deviations of the estimate that a link's may be off: four in a hundred thousand links are.
DEVIATIONS = 4.0
#: Shingles whose hashes are taken at a time.
CHUNK = 256
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.random.default_rng(12).integers(0, 1 << 63, (2, HASHES), dtype=np.uint64)
FACTORS, SHIFTS = _ODD[0] << np.uint64(1) | np.uint64(1), _ODD[1] << np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Of each text the distinct 64-bit hashes of its shingles, in order.

    A-Z are lower-cased; words are what stands between U+0020 and U+0009 to
    U+000D. A text of fewer words is one shingle, one without a word none.
    """
    found = [t.encode("utf-8", "replace").lower().split() for t in texts]
    sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    digest = xxhash.xxh3_64_intdigest
    codes: dict[bytes, int] = {}
    hashes = np.fromiter((codes.get(w) or codes.setdefault(w, digest(w)) for own in found for w in own), dtype=np.uint64, count=int(sizes.sum()))
    # a run of words is hashed by its words' hashes, one after the other
    runs = np.zeros(max(0, len(hashes) - words + 1), dtype=np.uint64)
    for k in range(words):
        runs = _mixed(runs * MIX[0] + hashes[k : k + len(runs)])
    out, at = [], 0
    for n in sizes.tolist():
        if n >= words:
            out.append(np.unique(runs[at : at + n - words + 1]))
        elif n:
            one = np.full(1, n, dtype=np.uint64)
            for k in range(at, at + n):
                one = _mixed(one * MIX[2] + hashes[k : k + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set that isn't empty."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), CHUNK):
        np.minimum(least, (hashes[i : i + CHUNK, None] * FACTORS + SHIFTS).min(axis=0), out=least)
    return least


def low_bits(least: np.ndarray) -> np.ndarray:
    """The signature: two bits of each minimum, packed into 64-bit numbers. The bits come from a mixture, as those of products run alike."""
    two = (_mixed(least) & np.uint64(3)).reshape(-1, 32)
    return np.bitwise_or.reduce(two << (2 * np.arange(32, dtype=np.uint64)), axis=1).view(np.int64)


def bands(least: np.ndarray) -> np.ndarray:
    """A number for each band."""
    own = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    found = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        found = _mixed(found * MIX[0] + own[:, k])
    return found.view(np.int64)


def differing(least: float) -> int:
    """How many minima's bits may differ for sets of similarity ``least``, with room for chance."""
    p = (1 - least) * 3 / 4
    return int(np.ceil(HASHES * p + DEVIATIONS * np.sqrt(HASHES * p * (1 - p))))


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity that two signatures tell, without what agrees by chance."""
    return 1 - 4 / 3 * float(apart(a, b)) / HASHES


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """How many minima's bits differ."""
    return int(Nearness(differing, True).far(a.view(np.uint64), b.view(np.uint64)).sum())


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """(row, id, digest, size, s, bands) for (row, id, text); an empty set has no signature."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("signatures", lambda: None)
        for batch in batches:
            digests, sizes, signs, own_bands = [], [], [], []
            for part in slices([t or "" for t in batch.column(2).to_pylist()]):
                for own in shingle_sets(part, words):
                    digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                    sizes.append(len(own))
                    if len(own):
                        least = minima(own)
                        signs.append(low_bits(least))
                        own_bands.append(bands(least))
            has = np.append(0, np.cumsum(np.array(sizes) > 0)).astype(np.int32)
            lists = lambda found, width: pa.ListArray.from_arrays(pa.array(has * np.int32(width)), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *found])))
            arrays = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists(signs, HASHES // 32), lists(own_bands, BANDS)]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "id", "digest", "size", "s", "bands"])

    return docs.mapInArrow(run, f"row long, id {kind}, digest binary, size long, s array<long>, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """(u, x) for (u, text): the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("sets", lambda: None)
        for batch in batches:
            done = 0
            for part in slices([t or "" for t in batch.column(1).to_pylist()]):
                sets = shingle_sets(part, words)
                ends = np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.uint64), *sets]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), lists], ["u", "x"])
                done += len(part)

    return docs.mapInArrow(run, "u long, x array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 2, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row of ``docs``.

    Rows are linked if 100 times what their sets share is ``percent`` (at least
    50) times what they have together, or more. ``component_id`` is the least id
    that links lead to, the own one included; ``kept`` is true for rows with
    that id.

    Null texts are empty; those without a word are linked with nothing. Rows
    with null ids are linked and have their component's least id; if it has no
    other, that is null, and they are kept. Repeated rows have equal sets, so
    all with the least id are kept. Of an empty table nothing comes out. Other
    columns aren't read.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent is from 50 to 100")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    rows = stored(rows)
    marked = stored(_signed(rows, words))
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id"))
    sets = marked.filter("size > 0").groupBy("digest").agg(F.min("row").alias("u"), F.min(own).alias("least"), F.count("*").alias("n"))
    sets = durable(sets)
    n = sets.count()
    heads = marked.join(light(sets.select(F.col("u").alias("row")), n), "row", "left_semi").withColumnRenamed("row", "u")

    def details(needed: DataFrame) -> DataFrame:
        texts = rows.select(F.col("row").alias("u"), "text").join(light(needed, needed.count()), "u", "left_semi")
        return _sets(texts, words).withColumn("bytes", 8 * F.size("x"))

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    most = differing(percent / 100)

    def bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(100 * np.minimum(a, b) >= percent * np.maximum(a, b), most, -1)

    nearness = Nearness(bits, True)
    cells = heads.select("u", F.explode("bands").alias("cell"))
    roots = linked_in_cells(cells, heads.select("u", "size", "s"), nearness, details, similar)
    roots = durable(roots.toDF("u", "root"))
    rooted = sets.join(light(roots, roots.count()), "u", "left").withColumn("root", F.coalesce("root", "u"))
    rooted = durable(rooted.select("digest", "root", "least", "n"))
    least = durable(rooted.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("k")))
    classes = durable(join_hot(rooted.select("digest", "root", "n"), least, "root", "k").select("digest", "first", "n"))
    with_set = join_hot(marked.filter("size > 0").select("id", "digest", "size"), classes, "digest", "n")
    found = with_set.select("id", "size", F.col("first.id").alias("component_id"))
    found = found.unionByName(marked.filter("size = 0").select("id", "size", F.col("id").alias("component_id")))
    return found.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), "component_id", F.expr("id <=> component_id").alias("kept"))
