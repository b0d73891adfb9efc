"""Compression of vectors to codes: for each part of a vector the place of its nearest entry in a codebook.

Components become whole numbers, so every distance and every sum is exact and
results don't depend on how rows are dealt. In each round a kd-tree of every
codebook is broadcast; tasks look up the nearest entries by branch and bound
and add up, for each entry, how many parts it has and their sums. Spark adds up
the tasks' sums, of which the driver gets a row for each entry.

The search takes all vectors of a batch through the tree at once: each goes to
the side of the split where it lies first, then to the other if the box there is
no farther than the nearest entry so far. Boxes as far as that are searched too,
so of equally near entries the one with the lower index is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import durable, join_hot, quoted

#: Entries of a leaf of the trees; vectors that go through a tree together.
LEAF, TOGETHER = 8, 4096
#: Scaled components are cut to this size, so that sums of squares fit a long.
LARGEST = 1 << 26


@dataclass(frozen=True)
class KdTree:
    """A codebook's entries, and boxes that halve them: children of a box, its bounds, and the entries of a leaf."""

    entries: np.ndarray
    low: np.ndarray
    high: np.ndarray
    axis: tuple[int, ...]
    split: tuple[int, ...]
    children: tuple[tuple[int, int] | None, ...]
    members: tuple[np.ndarray | None, ...]

    @staticmethod
    def of(entries: np.ndarray, leaf: int = LEAF) -> KdTree:
        """The tree of a codebook, cut at the median of the widest side."""
        low, high, axis, split, children, members = [], [], [], [], [], []

        def add(some: np.ndarray) -> int:
            at, own = len(low), entries[some]
            low.append(own.min(axis=0))
            high.append(own.max(axis=0))
            widest = int((high[at] - low[at]).argmax())
            axis.append(widest)
            order = some[np.argsort(own[:, widest], kind="stable")]
            middle = len(order) // 2
            split.append(int(entries[order[middle], widest]))
            children.append(None)
            members.append(None)
            if len(some) <= leaf or low[at][widest] == high[at][widest]:
                members[at] = np.sort(some)
            else:
                children[at] = (add(order[:middle]), add(order[middle:]))
            return at

        add(np.arange(len(entries)))
        return KdTree(entries, np.array(low), np.array(high), tuple(axis), tuple(split), tuple(children), tuple(members))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry, of equally near ones the first."""
        best = np.full(len(points), np.iinfo(np.int64).max)
        index = np.zeros(len(points), dtype=np.int64)

        def visit(box: int, rows: np.ndarray) -> None:
            inside = self.members[box]
            if inside is not None:
                off = points[rows, None, :] - self.entries[inside][None, :, :]
                squares = np.einsum("ijk,ijk->ij", off, off)
                nearest = squares.argmin(axis=1)  # members are in order, so the first is the one with the lowest index
                found, where = squares[np.arange(len(rows)), nearest], inside[nearest]
                better = (found < best[rows]) | ((found == best[rows]) & (where < index[rows]))
                best[rows[better]], index[rows[better]] = found[better], where[better]
                return
            left, right = self.children[box]
            first = points[rows, self.axis[box]] < self.split[box]
            for near, far, some in ((left, right, rows[first]), (right, left, rows[~first])):
                if not len(some):
                    continue
                visit(near, some)
                own = points[some]
                off = np.maximum(self.low[far] - own, 0) + np.maximum(own - self.high[far], 0)
                some = some[np.einsum("ij,ij->i", off, off) <= best[some]]
                if len(some):
                    visit(far, some)

        for at in range(0, len(points), TOGETHER):
            visit(0, np.arange(at, min(at + TOGETHER, len(points))))
        return index, best


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, index and component."""

    entries: np.ndarray
    scale: float

    def digest(self) -> str:
        """SHA-256 of all components by part, index and place, as decimal numbers with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _usable(df: DataFrame, vector_col: str, dim: int | None = None) -> DataFrame:
    v = quoted(vector_col)
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(v.isNotNull() & (F.size(v) > 0 if dim is None else F.size(v) == dim) & whole)


def _scaled(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * v), -LARGEST, LARGEST).astype(np.int64)


def fit(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding"
) -> Codebooks | None:
    """Codebooks of ``entries`` entries for each of ``parts`` equal parts of the vectors; None without a vector.

    Each component x becomes floor(scale * x), cut to ``LARGEST``. The books
    start as the vectors with the smallest ids, as many as there are if that are
    fewer, null ids last, equal ids in the order of the vectors. Each round
    gives every part to its nearest entry, equally near ones to the first, and
    makes each entry the floored mean of its parts; unused ones stay. Vectors
    that are null or empty, or hold a null or a component that isn't finite, take
    no part; neither do those of another length than the first one has. That
    length must be a multiple of ``parts``.
    """
    usable = _usable(vectors.select(quoted(id_col).alias("id"), quoted(vector_col).alias("v")), "v")
    start = usable.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not start:
        return None
    dim = len(start[0]["v"])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components have no {parts} equal parts")
    own = _usable(usable, "v", dim)
    if any(len(r["v"]) != dim for r in start):
        start = own.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    width = dim // parts
    with np.errstate(over="ignore"):
        made = np.clip(np.floor(scale * np.array([r["v"] for r in start], dtype=np.float64)), -LARGEST, LARGEST).astype(np.int64)
    books = made.reshape(len(made), parts, width).transpose(1, 0, 2).copy()
    sc = vectors.sparkSession.sparkContext
    for _ in range(rounds):
        trees = sc.broadcast([KdTree.of(b) for b in books])
        n = books.shape[1]

        def sums(batches: Iterator[pa.RecordBatch], trees=trees, n=n) -> Iterator[pa.RecordBatch]:
            count = np.zeros((parts, n), dtype=np.int64)
            total = np.zeros((parts, n, width), dtype=np.int64)
            for batch in batches:
                points = _scaled(batch.column(0), dim, scale).reshape(-1, parts, width)
                for p, tree in enumerate(trees.value):
                    index, _ = tree.nearest(np.ascontiguousarray(points[:, p]))
                    count[p] += np.bincount(index, minlength=n)
                    order = np.argsort(index, kind="stable")
                    found, starts = np.unique(index[order], return_index=True)
                    if len(found):
                        total[p, found] += np.add.reduceat(points[order, p], starts, axis=0)
            p, k = np.nonzero(count)
            lists = pa.ListArray.from_arrays(np.arange(0, (len(p) + 1) * width, width, dtype=np.int32)[: len(p) + 1], pa.array(total[p, k].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(k), pa.array(count[p, k]), lists], ["part", "entry", "n", "sums"])

        added = own.select("v").mapInArrow(sums, "part long, entry long, n long, sums array<long>")
        each = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)]
        for r in added.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():  # a row for each entry
            books[r["part"], r["entry"]] = np.array([r[f"s{i}"] // r["n"] for i in range(width)])
        trees.unpersist()
    return Codebooks(books, scale)


def encode(vectors: DataFrame, books: Codebooks, vector_col: str = "embedding", code: str = "code", error: str = "error") -> DataFrame:
    """``vectors`` that the books are for, with their code, two hexadecimal digits a part, and its error, the squared distance of what the code stands for.

    All columns stay; ones called like the new are replaced. Rows whose vector
    ``fit`` would leave out go. Books of over 256 entries have as many more
    digits as their indexes take, the same for all parts.
    """
    parts, n, width = books.entries.shape
    digits = max(2, len(f"{n - 1:x}"))
    trees = vectors.sparkSession.sparkContext.broadcast([KdTree.of(b) for b in books.entries])
    names = [c for c in vectors.columns if c.lower() not in (code.lower(), error.lower())]
    rows = _usable(vectors.select(*map(quoted, names)), vector_col, parts * width)
    at, scale = names.index(vector_col), books.scale

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexed = np.array([f"{k:0{digits}x}" for k in range(n)], dtype=object)
        for batch in batches:
            points = _scaled(batch.column(at), parts * width, scale).reshape(-1, parts, width)
            codes, errors = np.full(len(points), "", dtype=object), np.zeros(len(points), dtype=np.int64)
            for p, tree in enumerate(trees.value):
                index, squares = tree.nearest(np.ascontiguousarray(points[:, p]))
                codes, errors = codes + hexed[index], errors + squares
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.string()), pa.array(errors)], [*batch.schema.names, code, error])

    schema = rows.select("*", F.lit("").alias(code), F.lit(0).cast("long").alias(error)).schema
    return rows.mapInArrow(run, schema)


def decode(codes: DataFrame, books: Codebooks, code: str = "code", vector: str = "vector") -> DataFrame:
    """``codes`` and the vector that each code stands for, in whole numbers; null where there is no code."""
    parts, n, _ = books.entries.shape
    digits = max(2, len(f"{n - 1:x}"))
    entry = lambda p: F.conv(F.substring(quoted(code), p * digits + 1, digits), 16, 10).cast("int")
    book = lambda p: F.lit(books.entries[p].tolist()) if n else F.array()
    return codes.withColumn(vector, F.when(quoted(code).isNotNull(), F.concat(*[F.get(book(p), entry(p)) for p in range(parts)])))


def compress(
    vectors: DataFrame,
    parts: int = 4,
    entries: int = 256,
    rounds: int = 4,
    scale: float = 1024.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of each vector that takes part; see ``fit`` and ``encode``.

    label_error: the sum of the errors of all rows with the same label, nulls
    being one label; null where it doesn't fit a long. Repeated rows are vectors
    of their own, each with its code. Without vectors nothing comes out.
    """
    found = fit(vectors, parts, entries, rounds, scale, id_col, vector_col)
    kind = vectors.select(quoted(id_col)).schema[0].dataType.simpleString()
    if found is None:
        return vectors.sparkSession.createDataFrame([], f"`{id_col}` {kind}, code string, error long, label_error long, codebooks_sha256 string")
    label = quoted(label_col)
    own = vectors.select(quoted(id_col).alias("id"), quoted(vector_col).alias("v"), F.when(label.isNull(), "").otherwise(F.concat(F.lit("="), label.cast("string"))).alias("key"))
    coded = durable(encode(own, found, "v").drop("v"))
    sums = durable(coded.groupBy("key").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("k")))
    joined = join_hot(coded, sums, "key", "k")
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256"))
