"""Near-duplicate documents by SimHash, with a segment-popcount embedding as the lower bound.

A 64-bit fingerprint is cut into 32 segments of two bits; the point of a
fingerprint is the vector of its segments' bit counts. A differing bit moves
one coordinate by one at most, so the Manhattan distance of points is never
over the Hamming distance of fingerprints. Counts are written in unary (two
bits for 0, 1, 2), which makes that distance the bit count of an XOR.

Fingerprints within distance 2 differ in 2 of the 5 groups of coordinates at
most, so they share a cell of the grid over some 3 groups: ten grids give all
candidates, the Manhattan distance discards most, and the Hamming distance
verifies. In a cell with many distinct fingerprints, where pairs would grow
with the square, links are found exactly by the fingerprints they have in
between: two within distance 2 are both within 1 of another, and each group
around such a midpoint is a star.

A fingerprint of 64 bits that differs in a few stands for near copies of very
long texts only. ``one_of_similar`` therefore takes longer fingerprints, in
which a shingle votes in one segment only: a shingle that one text has and the
other hasn't leaves all other segments as they are, so similar texts agree on
whole segments, and the Manhattan distance of their points there is zero. A cell
holds the texts with one point there. In it the Manhattan distance of the points
of whole fingerprints, of all shingles, discards most pairs, the Hamming distance
others, and what is left is verified by all shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import durable, fresh, join_hot, light, quoted, stored, worker_memory
from factorloom.llm.components import Nearness, components, linked_in_cells

SEED = 42
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Bits of a chunk of shingles that are counted at a time.
CHUNK = 8192


def _tables(max_bits: int, more: int = 3) -> list[int]:
    """Masks over the unary point: every choice of ``more`` of the max_bits + more groups of segments."""
    edges = [round(32 * k / (max_bits + more)) for k in range(max_bits + more + 1)]
    groups = [sum(3 << 2 * s for s in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(groups, more)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_of(text: str, words: int = 3) -> int:
    """The fingerprint of one text; see ``fingerprints``."""
    found = text.translate(LOWER).translate({c: 32 for c in range(9, 14)}).split(" ")
    found = [w for w in found if w]
    if not found:
        return 0
    if len(found) <= words:
        shingles = [" ".join(found)]
    else:
        shingles = list(map(" ".join, zip(*(found[k:] for k in range(words)), strict=False)))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(shingles), CHUNK):
        part = shingles[i : i + CHUNK]
        hashes = np.fromiter((digest(s, SEED) for s in part), dtype=">u8", count=len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(shingles)).tobytes(), "big")


def fingerprints(text: Column, words: int = 3) -> Column:
    """SimHash of texts over shingles of ``words`` words, as a (signed) 64-bit number.

    A-Z are lower-cased; words are what stands between U+0020 and U+0009 to
    U+000D. A bit is set if over half of the shingles' XXH64 (seed 42) have it
    set, repeats counted. A text of fewer words is one shingle; null and empty
    texts have zero.
    """

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        worker_memory("fingerprints", lambda: None)
        for batch in batches:
            yield pd.Series([_signed(fingerprint_of(t, words)) if t else 0 for t in batch], dtype="int64")

    return run(text)


def point(f: str) -> str:
    """SQL for the point of a fingerprint: for each two bits the unary form of how many are set."""
    low = "6148914691236517205L"  # 0101...
    return f"((({f} | shiftrightunsigned({f}, 1)) & {low}) | shiftleft(({f} & shiftrightunsigned({f}, 1)) & {low}, 1))"


def points(prints: np.ndarray) -> np.ndarray:
    """``point`` of the 64-bit numbers of an array; the bit count of two points' XOR is their Manhattan distance."""
    low, one = np.uint64(0x5555555555555555), np.uint64(1)
    return ((prints | prints >> one) & low) | (prints & prints >> one & low) << one


def links(prints: DataFrame, max_bits: int = 2, heavy: int = 64) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``prints`` (f), so that all pairs within ``max_bits`` are connected.

    Every row is a pair within ``max_bits``. Pairs that share a cell of at most
    ``heavy`` fingerprints are all found; larger cells give the stars around
    midpoints instead, for which ``max_bits`` must be 2 or less.
    """
    if not 1 <= max_bits <= 2:
        raise ValueError("links are for one or two differing bits")
    keys = F.array(*[F.expr(f"_point & {_signed(m)}L") for m in _tables(max_bits)])
    cells = (
        prints.select("f", F.expr(point("f")).alias("_point"))
        .select("f", F.posexplode(keys).alias("grid", "cell"))
        .repartition("grid", "cell")
    )
    sizes = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    shared = durable(cells.join(sizes, ["grid", "cell"]))
    light = shared.filter(F.col("n") <= heavy)
    near = (F.bit_count(F.expr(f"{point('a')} ^ {point('b')}")) <= max_bits) & (
        F.bit_count(F.expr("a ^ b")) <= max_bits
    )
    pairs = light.select("grid", "cell", F.col("f").alias("a")).join(
        light.select("grid", "cell", F.col("f").alias("b")), ["grid", "cell"]
    )
    pairs = pairs.filter(F.col("a") < F.col("b")).filter(near).select("a", "b")
    crowded = shared.filter(F.col("n") > heavy).select("f").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << k)).cast("long") for k in range(64)])
    around = crowded.select("f", F.explode(F.transform(flips, lambda x: F.col("f").bitwiseXOR(x))).alias("mid"))
    around = durable(around)
    centres = around.groupBy("mid").agg(F.min("f").alias("a"), F.count("*").alias("n")).filter("n > 1")
    stars = around.join(centres, "mid").filter("a <> f").select("a", F.col("f").alias("b"))
    return pairs.unionAll(stars).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2
) -> DataFrame:
    """(id, fingerprint, component_id, first) for each row of ``docs``.

    Rows whose fingerprints differ in ``max_bits`` bits or fewer are linked;
    ``component_id`` is the least id that links lead to, itself included, and
    ``fingerprint`` has 16 hexadecimal digits. ``first`` is true for one row of
    each component, which has the least id.

    Null and empty texts have fingerprint zero and are linked like any other.
    Rows with null ids are linked and have their component's least id, null if
    it has no other. Repeated rows are kept; one of them is ``first``. Of an
    empty table nothing comes out. Other columns aren't read.
    """
    (row,) = fresh(docs, "_row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    return _judged(rows, row, id_col, text_col, words, max_bits).drop("_judged_row")


def _judged(docs: DataFrame, row: str, id_col: str, text_col: str, words: int, max_bits: int) -> DataFrame:
    """(_judged_row, id, fingerprint, component_id, first) for rows with numbers of their own."""
    rows = durable(
        docs.select(
            F.col(row).alias("row"), quoted(id_col).alias("id"), fingerprints(quoted(text_col), words).alias("f")
        )
    )
    # ids that are null come last; of repeated ids the first row is the first
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    prints = durable(rows.groupBy("f").agg(F.min(own).alias("least"), F.count("*").alias("n")))
    roots = components(links(prints.select("f"), max_bits)).toDF("f", "root")
    rooted = durable(prints.join(roots, "f", "left").withColumn("root", F.coalesce("root", "f")))
    least = durable(rooted.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("k")))
    classes = durable(join_hot(rooted.select("f", "root", "n"), least, "root", "k").select("f", "least", "n"))
    hexed = F.lower(F.lpad(F.hex("f"), 16, "0"))
    return join_hot(rows, classes, "f", "n").select(
        F.col("row").alias("_judged_row"),
        F.col("id").alias(id_col),
        hexed.alias("fingerprint"),
        F.col("least.id").alias("component_id"),
        (F.col("row") == F.col("least.row")).alias("first"),
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` without the rows that aren't the first of their component; see ``near_duplicates``.

    The row with the least id stays, all its columns as they are; of repeated
    rows one does. Rows that go are found by numbers, so texts are not
    shuffled while those are few enough to be broadcast.
    """
    (row,) = fresh(docs, "_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    gone = durable(_judged(rows, row, id_col, text_col, words, max_bits).filter("not first").select(F.col("_judged_row").alias(row)))
    return rows.join(light(gone, gone.count()), row, "left_anti").drop(row)


#: Segments of a long fingerprint that are used, of all that it has.
USED = 8
#: 64-bit words of a text's sketch, by which SimHash of all its shingles similar texts' fingerprints are near. Similar sets differ in 0.15 of the bits at most, small ones in more.
SKETCH, DIFFERING, SMALL, DIFFERING_SMALL = 4, 64, 30, 100
#: Shingles in a segment of the shortest texts of a class, the least class's shingles, the next one's share of them.
SHINGLES, FIRST, RATIO = 2.4, 10, 1.6


def shingle_hashes(text: str, words: int = 5) -> np.ndarray:
    """The distinct XXH64 of a text's shingles in order, words as in ``fingerprints``; of a text without words one hash."""
    found = [w for w in text.translate(LOWER).translate({c: 32 for c in range(9, 14)}).split(" ") if w]
    digest = xxhash.xxh64_intdigest
    shingles = map(" ".join, zip(*(found[k:] for k in range(words)), strict=False)) if len(found) > words else [" ".join(found)]
    return np.unique(np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64))


def segment_keys(hashes: np.ndarray, least: float) -> np.ndarray:
    """A number for each used segment of a text's long fingerprint; similar texts have one in common.

    The number of segments goes with the number of shingles, in classes; a text
    whose like may have so many more as to be in the next class has that
    class's segments too. A segment's print is the SimHash of its shingles, its
    number follows from the point of that.
    """
    n = len(hashes)
    own = max(0, int(np.floor(np.log(n / FIRST) / np.log(RATIO) + 1e-9)))
    out = []
    for kind in (own, own + 1):
        if kind > own and n < least * FIRST * RATIO**kind - 1e-9:
            continue
        count = max(5, round(FIRST * RATIO**kind / SHINGLES))
        # the low bits tell the segment, so that those of the votes are free of it
        at = (hashes % np.uint64(count)).astype(np.int64)
        some = np.flatnonzero(at < USED)
        order = some[np.argsort(at[some], kind="stable")]
        at = at[order]
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])[: len(at)])
        if not len(starts):
            continue
        bits = np.unpackbits(hashes[order].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        sizes = np.diff(np.append(starts, len(at)))
        prints = points(np.packbits(2 * ones > sizes[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64))
        salt = (np.uint64(kind * USED + 1) + at[starts].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out.append((prints ^ salt) * np.uint64(0xBF58476D1CE4E5B9))
    return np.concatenate(out) if out else hashes[:1]


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes, of ``SKETCH`` times 64 bits."""
    ones = np.zeros(64 * SKETCH, dtype=np.int64)
    salts = np.arange(1, SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    for i in range(0, len(hashes), CHUNK):
        x = hashes[i : i + CHUNK, None] * salts[None, :]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        ones += np.unpackbits(x.astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes)).view(">u8").astype(np.uint64).view(np.int64)


def _shingled(docs: DataFrame, words: int, least: float | None) -> DataFrame:
    """(row, id, digest, size, s, hashes) for (row, id, text): all shingles' hashes, or, with ``least``, the sketch and the segments' keys."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory("shingles", lambda: None)
        for batch in batches:
            digests, sizes, taken, sketches = [], [], [], [np.zeros(0, dtype=np.int64)]
            for text in batch.column(2).to_pylist():
                own = shingle_hashes(text or "", words)
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                taken.append((own if least is None else segment_keys(own, least)).view(np.int64))
                if least is not None:
                    sketches.append(sketch_of(own))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in taken])]).astype(np.int32)
            hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *taken])))
            width = 0 if least is None else SKETCH
            of_sketch = pa.ListArray.from_arrays(np.arange(len(taken) + 1, dtype=np.int32) * width, pa.array(np.concatenate(sketches)))
            arrays = [batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), of_sketch, hashes]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "id", "digest", "size", "s", "hashes"])

    return docs.mapInArrow(run, f"row long, id {kind}, digest binary, size int, s array<long>, hashes array<long>")


def one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """``docs`` without near copies: rows whose shingles of ``words`` words have Jaccard similarity ``least`` or more are linked.

    Of each group that links connect the row with the least id stays, ids that
    are null last; of repeated rows one does. Texts of fewer words are one
    shingle; null texts are empty, and all empty ones are equal. All columns
    stay as they are; of an empty table nothing comes out.
    """
    (row,) = fresh(docs, "_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    texts = rows.select(F.col(row).alias("row"), quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    own = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))
    marked = stored(_shingled(texts, words, least))
    sets = durable(marked.groupBy("digest").agg(F.min("row").alias("u"), F.min(own).alias("least"), F.count("*").alias("n")))
    first = sets.select(F.col("u").alias("row"))
    heads = marked.select("row", "size", "s", "hashes").join(light(first, sets.count()), "row", "left_semi").withColumnRenamed("row", "u")

    def details(needed: DataFrame) -> DataFrame:
        needed = needed.withColumnRenamed("u", "row")
        return _shingled(texts.join(light(needed, needed.count()), "row", "left_semi"), words, None).select(F.col("row").alias("u"), F.col("hashes").alias("x"), (8 * F.size("hashes")).alias("bytes"))

    def similar(x: np.ndarray, y: np.ndarray) -> bool:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= least * (len(x) + len(y) - both) - 1e-9

    def bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        small, large = np.minimum(a, b), np.maximum(a, b)
        return np.where(small >= least * large - 1e-9, np.where(small < SMALL, DIFFERING_SMALL, DIFFERING), -1)

    nearness = Nearness(bits, point=points)
    cells = heads.select("u", F.explode("hashes").alias("cell"))
    roots = linked_in_cells(cells, heads.select("u", "size", "s"), nearness, details, similar).toDF("u", "root")
    rooted = sets.join(roots, "u", "left").withColumn("root", F.coalesce("root", "u"))
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias(row))
    gone = durable(marked.select(F.col("row").alias(row)).join(kept, row, "left_anti"))
    return rows.join(light(gone, gone.count()), row, "left_anti").drop(row)
