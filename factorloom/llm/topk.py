"""Exact search of the vectors with the largest inner products, by elimination with a table of pivots.

Of every vector its distances to many pivots are computed once, beforehand; the
first pivot is the origin. By |q - x|^2 = |q|^2 + |x|^2 - 2 qx a lower bound of a
distance is an upper bound of an inner product. All pivots together give more
than the largest of their single bounds: the distances say where a vector lies
in the space that the pivots span and how far it is from there, so the distance
of two vectors is at least that of these places and of these heights. That is
the largest lower bound which the distances allow.

Vectors are dealt into cells by their nearest pivot. Cells whose pivots are
near each other are one block until it is large enough for the bounds to order
many candidates (in a block of some tens every candidate is evaluated), and
large ones are cut by a hash of the ids too, so tasks are of bounded size. The ranges of a block's distances
bound all products between two blocks. Each block of queries first searches the
block of vectors with the highest bound; its k-th best products then rule out
whole blocks, and in the others single vectors: each query goes through what is
left in the order of the bound, in runs, and stops when no bound reaches the
k-th best product so far. A window takes the k best of all blocks'.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.llm.common import durable, light, quoted, stored

#: Vectors that pivots are chosen among at most.
SAMPLE = 2048
#: Pivots beside the origin at most, and at most such a share of the vectors' length: with all of it the table is the vectors.
PIVOTS, PIVOT_SHARE = 128, 0.8
BLOCK = 8192
#: Candidates that a query evaluates at a time at first, and queries whose bounds are held at a time.
RUN, TOGETHER = 64, 256


def scaled(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, in double precision."""
    return np.floor(scale * vectors.astype(np.float64))


@dataclass(frozen=True)
class Pivots:
    """Vectors none of which is a sum of multiples of others, and the triangular factor of their inner products."""

    points: np.ndarray
    factor: np.ndarray

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """The pivot table: for each vector its distances to the origin and to each pivot."""
        squares = (vectors**2).sum(axis=1)
        others = squares[:, None] + (self.points**2).sum(axis=1)[None, :] - 2 * vectors @ self.points.T
        return np.sqrt(np.maximum(np.column_stack([squares, others]), 0))

    def places(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, height): where in the pivots' space each vector of a table lies, and how far from that."""
        squares = table[:, 0] ** 2
        if not len(self.points):
            return np.zeros((len(table), 0)), table[:, 0]
        products = (squares[:, None] + (self.points**2).sum(axis=1)[None, :] - table[:, 1:] ** 2) / 2
        place = np.linalg.solve(self.factor, products.T).T
        return place, np.sqrt(np.maximum(squares - (place**2).sum(axis=1), 0))


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> Pivots:
    """Rows of a sample, each the one farthest from the space of those before it."""
    rest = sample.astype(np.float64)
    largest = np.sqrt((rest**2).sum(axis=1)).max(initial=0.0)
    found: list[int] = []
    for _ in range(min(count, len(sample), int(PIVOT_SHARE * sample.shape[1]))):
        squares = (rest**2).sum(axis=1)
        k = int(squares.argmax())
        if not np.isfinite(squares[k]) or squares[k] <= (1e-3 * largest) ** 2:
            break
        found.append(k)
        along = rest[k] / np.sqrt(squares[k])
        rest = rest - np.outer(rest @ along, along)
    points = sample[found].astype(np.float64)
    return Pivots(points, np.linalg.cholesky(points @ points.T) if found else np.zeros((0, 0)))


def chain(points: np.ndarray) -> np.ndarray:
    """Of each pivot its place in a walk that goes on to the nearest of the others."""
    place = np.zeros(max(1, len(points)), dtype=np.int32)
    left = list(range(1, len(points)))
    here = 0
    for k in range(1, len(points)):
        here = min(left, key=lambda i: (((points[i] - points[here]) ** 2).sum(), i))
        left.remove(here)
        place[here] = k
    return place


def upper_bounds(asked: tuple[np.ndarray, np.ndarray], places: tuple[np.ndarray, np.ndarray], squares: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of queries with vectors, with room for what doubles round."""
    found = asked[0] @ places[0].T + np.outer(asked[1], places[1])
    found += 1e-6 * (squares[:, None] + more[None, :]) + 1
    return np.where(np.isnan(found), np.inf, found)


def best(query: np.ndarray, bounds: np.ndarray, open_: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, least: float, exact: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, products, how many were evaluated) of the k best of the open candidates of one query that reach ``least``.

    Equal products go by smaller id. exact: products as whole numbers of any size.
    """
    found, products = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object if exact else np.float64)
    open_ = open_[bounds[open_] >= least]
    seen, run = 0, RUN
    while len(open_):
        if len(open_) > run:
            parts = np.argpartition(-bounds[open_], run - 1)
            now, open_ = open_[parts[:run]], open_[parts[run:]]
        else:
            now, open_ = open_, open_[:0]
        seen += len(now)
        if exact:
            whole = [[int(x) for x in v] for v in vectors[now].tolist()]
            own = [int(x) for x in query.tolist()]
            new = np.array([sum(a * b for a, b in zip(own, v, strict=True)) for v in whole], dtype=object)
        else:
            new = vectors[now] @ query
        found, products = np.concatenate([found, ids[now]]), np.concatenate([products, new])
        rank = sorted(range(len(found)), key=lambda i: (-products[i], found[i]))[:k] if exact else np.lexsort((found, -products))[:k]
        found, products = found[rank], products[rank]
        if len(found) == k:
            open_ = open_[bounds[open_] >= float(products[-1])]
        run *= 2
    return found, products, seen


def sort_key(product: int) -> bytes:
    """Bytes in whose order whole numbers of any size are in theirs."""
    size = abs(product).bit_length() // 8 + 1
    raw = abs(product).to_bytes(size, "big")
    made = size.to_bytes(4, "big") + raw
    return b"\x01" + made if product >= 0 else b"\x00" + bytes(255 - x for x in made)


def search_block(
    queries: np.ndarray, query_ids: np.ndarray, least: np.ndarray, asked: np.ndarray, vectors: np.ndarray, ids: np.ndarray, table: np.ndarray, pivots: Pivots, k: int
) -> tuple[list[int], list[int], list[int], int]:
    """(query's place, id, product, how many were evaluated) of the k best of a block of vectors for each of a block of queries.

    asked, table: the queries' and the vectors' rows of the pivot table; least: what a query's product must reach.
    """
    place, found, products, seen = [], [], [], 0
    with np.errstate(over="ignore", invalid="ignore"):
        largest = max(np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0))
        exact = not largest**2 * queries.shape[1] < 2**52
        places, squares = pivots.places(table), table[:, 0] ** 2
        for at in range(0, len(queries), TOGETHER):
            part = slice(at, at + TOGETHER)
            bounds = upper_bounds(pivots.places(asked[part]), places, asked[part, 0] ** 2, squares)
            for i in range(len(bounds)):
                open_ = np.flatnonzero(ids != query_ids[at + i])
                x, p, n = best(queries[at + i], bounds[i], open_, ids, vectors, k, least[at + i], exact)
                place += [at + i] * len(x)
                found += x.tolist()
                products += [int(y) for y in p]
                seen += n
    return place, found, products, seen


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    values = column.combine_chunks()
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
    block: int = BLOCK,
) -> DataFrame:
    """(query_id, rank, id, score): of each row of ``queries`` the ``k`` rows of ``vectors`` with the largest inner products.

    Both have integer ids and arrays of floats, each component x of which
    becomes floor(scale * x). Rows with the query's own id are no candidates.
    Equal products go by smaller id; fewer than ``k`` candidates are all
    returned. Vectors that are null or empty or hold a null or a component that
    isn't finite, before or after scaling, and rows with null ids, take no part;
    vectors of different lengths aren't compared. Repeated rows are candidates
    each; of repeated queries one is asked, but those with one id and different
    vectors are asked each. Products that don't fit a long are cut to the
    nearest that does once all are ranked. Other columns aren't read.
    """
    found = searched(vectors, queries, k, scale, id_col, vector_col, pivots, block)[0]
    order = Window.partitionBy("query_id", "nth").orderBy(F.desc("key"), "id", "row")
    ranked = found.withColumn("row", F.monotonically_increasing_id()).withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def searched(vectors: DataFrame, queries: DataFrame, k: int, scale: float, id_col: str, vector_col: str, pivots: int, block: int) -> tuple[DataFrame, DataFrame]:
    """((query_id, nth, id, score, key), (seen, open)): each searched block's k best, and how many of how many candidates of a pair of blocks were evaluated."""

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(quoted(id_col).cast("long").alias("id"), quoted(vector_col).alias("v"))
        whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(scale))) < float("inf")))
        return rows.filter(F.col("id").isNotNull() & (F.size("v") > 0) & whole).withColumn("dim", F.size("v"))

    everything, asked = usable(vectors), usable(queries).distinct()
    asked = asked.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("v")))
    sample = everything.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v", "dim").collect()
    known: dict[int, Pivots] = {}
    for dim in {r["dim"] for r in sample}:
        known[dim] = choose_pivots(scaled(np.array([r["v"] for r in sample if r["dim"] == dim], dtype=np.float64), scale), pivots)

    walks = {dim: chain(p.points) for dim, p in known.items()}

    def of(dim: int) -> Pivots:
        return known.get(dim) or Pivots(np.zeros((0, dim)), np.zeros((0, 0)))

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                v = scaled(rows.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
                with np.errstate(over="ignore", invalid="ignore"):
                    table = np.nan_to_num(of(dim).distances(v), nan=np.inf)
                lists = lambda m: pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), pa.array(m.ravel()))
                nearest = walks[dim][table[:, 1:].argmin(axis=1)] if table.shape[1] > 1 else np.zeros(len(table), dtype=np.int32)
                arrays = [rows.column("id"), rows.column("nth"), rows.column("dim"), lists(v), lists(table), pa.array(nearest)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "nth", "dim", "v", "t", "near"])

    def blocks(df: DataFrame) -> DataFrame:
        rows = stored(df.select("id", "nth", "dim", "v").mapInArrow(tabled, "id long, nth int, dim int, v array<double>, t array<double>, near int"))
        # a row for each pivot: cells in the order of the walk, put together to blocks, of which the last takes what is left
        walk = Window.partitionBy("dim").orderBy("near")
        cells = rows.groupBy("dim", "near").agg(F.count("*").alias("n"))
        cells = cells.withColumns({"before": F.sum("n").over(walk) - F.col("n"), "all": F.sum("n").over(Window.partitionBy("dim"))})
        cells = cells.withColumn("group", F.least(F.floor(F.col("before") / block), F.greatest(F.lit(1), F.floor(F.col("all") / block)) - 1))
        whole = F.sum("n").over(Window.partitionBy("dim", "group"))
        cells = cells.select("dim", "near", "group", F.greatest(F.lit(1), F.round(whole / block)).cast("long").alias("parts"))
        cut = F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int")
        placed = rows.join(F.broadcast(cells), ["dim", "near"])
        return placed.withColumn("cell", F.struct("dim", "group", cut.alias("cut"))).drop("near", "group", "parts")

    widest = 1 + max((len(p.points) for p in known.values()), default=0)

    def ranges(df: DataFrame, name: str) -> DataFrame:
        """Of each block the least and the largest distance to each pivot."""
        each = lambda agg: F.array(*[agg(F.get("t", F.lit(i))) for i in range(widest)])
        return df.groupBy("cell").agg(each(F.min).alias(f"{name}_lo"), each(F.max).alias(f"{name}_hi"), F.count("*").alias(f"{name}_n")).withColumnRenamed("cell", name)

    left, right = blocks(asked), blocks(everything.withColumn("nth", F.lit(0)))
    gap: Column = F.aggregate(
        F.arrays_zip("a_lo", "a_hi", "b_lo", "b_hi"),
        F.lit(0.0),
        lambda s, x: F.greatest(s, F.coalesce(x["a_lo"] - x["b_hi"], F.lit(0.0)), F.coalesce(x["b_lo"] - x["a_hi"], F.lit(0.0))),
    )
    top_a, top_b = F.get("a_hi", F.lit(0)), F.get("b_hi", F.lit(0))
    bound = (top_a * top_a + top_b * top_b - gap * gap) / 2 * (1 + 1e-6) + 1
    # blocks of the stated queries against blocks of all vectors: one row for some 8192 times 8192 products
    routes = ranges(left, "a").join(ranges(right, "b"), F.col("a.dim") == F.col("b.dim"))
    routes = routes.select("a", "b", F.least(bound, top_a * top_b * (1 + 1e-6) + 1).alias("bound"), "b_n")
    first = Window.partitionBy("a").orderBy(F.desc("bound"), F.desc("b_n"), "b")
    routes = durable(routes.withColumn("place", F.row_number().over(first)))
    schema = "query_id long, nth int, id long, score long, key binary, seen long, open long"

    def evaluate(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({n: pa.array([], t) for n, t in zip(["query_id", "nth", "id", "score", "key", "seen", "open"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()], strict=True)})
        dim = a.column("dim")[0].as_py()
        own = of(dim)
        width = 1 + len(own.points)
        place, ids, products, seen = search_block(
            _matrix(a.column("v"), dim), a.column("id").to_numpy(), a.column("least").to_numpy(), _matrix(a.column("t"), width),
            _matrix(b.column("v"), dim), b.column("id").to_numpy(), _matrix(b.column("t"), width), own, k,
        )
        take = pa.array(place, pa.int64())
        clipped = [max(-(2**63), min(2**63 - 1, p)) for p in products]
        rows = pa.table(
            {
                "query_id": a.column("id").take(take), "nth": a.column("nth").take(take), "id": pa.array(ids, pa.int64()),
                "score": pa.array(clipped, pa.int64()), "key": pa.array(map(sort_key, products), pa.binary()),
                "seen": pa.nulls(len(ids), pa.int64()), "open": pa.nulls(len(ids), pa.int64()),
            }
        )
        count = pa.table({n: pa.array([x], rows.schema.field(n).type) for n, x in zip(rows.column_names, [None] * 5 + [seen, len(a) * len(b)], strict=True)})
        return pa.concat_tables([rows, count])

    def run(asked_rows: DataFrame, pairs: DataFrame, n: int) -> DataFrame:
        a = asked_rows.join(light(pairs, n), F.col("cell") == F.col("a"))
        b = right.join(light(pairs.toDF("_a", "_b"), n), F.col("cell") == F.col("_b"))
        a = a.select("a", "b", "id", "nth", "dim", "v", "t", "least")
        b = b.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "id", "dim", "v", "t")
        return a.groupBy("a", "b").cogroup(b.groupBy("a", "b")).applyInArrow(evaluate, schema)

    none = float("-inf")
    pairs = routes.filter("place = 1").select("a", "b")
    every = one = stored(run(left.withColumn("least", F.lit(none)), pairs, pairs.count()))
    later = routes.filter("place > 1")
    if later.take(1):
        kth = one.filter("id is not null").groupBy(F.col("query_id").alias("id"), "nth").agg(F.min("score").cast("double").alias("low"), F.count("*").alias("n"))
        # a score at the end of a long may stand for any beyond it
        known_low = kth.select("id", "nth", F.when((F.col("n") >= k) & (F.abs("low") < 2.0**62), F.col("low") - 1.0 - F.abs("low") * 1e-9).otherwise(none).alias("least"))
        asked_rows = left.join(known_low, ["id", "nth"], "left").withColumn("least", F.coalesce("least", F.lit(none)))
        asked_rows = stored(asked_rows)
        lows = asked_rows.groupBy(F.col("cell").alias("a")).agg(F.min("least").alias("least"))
        rest = later.join(lows, "a").filter(F.isnan("bound") | (F.col("bound") >= F.col("least")))
        rest = durable(rest.select("a", "b"))
        every = one.unionAll(run(asked_rows, rest, rest.count()))
    return every.filter("id is not null").select("query_id", "nth", "id", "score", "key"), every.filter("id is null").select("seen", "open")
