"""Connected components of a table of links, by contraction, and links found in cells.

In each round every node hooks to the neighbour (or itself) that comes first in
a random order, which is the order of a hash of the node. Links between hooks
make up the next, smaller graph. A constant share of the nodes goes in each
round, whatever the graph looks like. Before each round a task replaces what it
has of the links, some at a time, by stars around the first node of what these
connect, so what lies together is done in one round. Neighbourhoods are only
ever aggregated to their minimum, so a node with very many links is no burden,
and nothing but counts comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from factorloom.llm.common import HOT_KEYS, durable, join_hot, light, stored

#: Of so many nodes one goes into the sample that tells which cells are hot.
HOT_SAMPLE = 32
#: In cells of up to so many members all pairs that may be links are looked at.
PAIRED = 8
#: Groups of up to so many members are compared together.
TOGETHER = 64
#: Parts that cells are dealt to, and cells that a task deals out at a time.
PARTS, DEALT = 512, 1 << 20
#: Members of a cell in a block, and those in a block whose details are there too.
BLOCK, LINKED = 16_384, 1024
#: Pairs whose sketches are compared at a time, and rows of small cells.
AT_A_TIME, ROWS = 1 << 18, 20_000
#: Bytes of details that a task holds of one side of a group of pairs, about.
HELD = 8 << 20
#: Links that a task makes stars of at a time, about.
STARRED = 1 << 19


def first_of(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least of the numbers under ``n`` that the links (i, j) connect each number with."""
    first = np.arange(n)
    while True:
        x, y = first[i], first[j]
        apart = x != y
        if not apart.any():
            return first
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(first, np.maximum(x, y), np.minimum(x, y))
        while (first[first] != first).any():
            first = first[first]


def _stars(links: DataFrame) -> DataFrame:
    """Links (a, b) of longs that connect what ``links`` do: those that lie together in a task as stars around the first in the order of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= STARRED:
                yield of(held)
                held = []
        if held:
            yield of(held)

    def of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        a, b, ha, hb = (table.column(c).to_numpy() for c in ("a", "b", "ha", "hb"))
        nodes, at = np.unique(np.concatenate([a, b]), return_index=True)
        hashes = np.concatenate([ha, hb])[at]
        order = np.lexsort((nodes, hashes))
        nodes, place = nodes[order], np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        known = nodes[np.argsort(nodes)]
        first = first_of(place[np.searchsorted(known, a)], place[np.searchsorted(known, b)], len(nodes))
        some = np.flatnonzero(first != np.arange(len(nodes)))
        return _links(nodes[some], nodes[first[some]])

    return links.select("a", "b", F.xxhash64("a").alias("ha"), F.xxhash64("b").alias("hb")).mapInArrow(run, "a long, b long")


def components(links: DataFrame, limit: int = 200) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b): nodes that links connect have the same root, a node of theirs.

    Links may be repeated, stand in either or both directions, or lead from a
    node to itself; links with a null end are left out. Without links the
    result is empty. More than ``limit`` rounds raise an error, as no result is
    then whole; about twenty are what a chain of a billion nodes takes.
    """
    kind = links.schema["a"].dataType
    # read from Parquet, as what the optimizer knows of checkpointed links may grow from round to round
    starred = _stars if isinstance(kind, LongType) and isinstance(links.schema["b"].dataType, LongType) else DataFrame.distinct
    edges = stored(starred(links.filter("a is not null and b is not null and a <> b").select("a", "b")))
    steps: list[DataFrame] = []
    for _ in range(limit):
        if edges.isEmpty():
            break
        ends = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = F.struct(F.xxhash64("b").alias("h"), F.col("b"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"))
        hooks = durable(
            ends.groupBy("a")
            .agg(F.min(order).alias("first"), F.count("*").alias("n"))
            .select(F.col("a").alias("node"), F.least("first", own)["b"].alias("root"), "n")
        )
        steps.append(hooks.select("node", "root"))
        joined = join_hot(edges, hooks.toDF("a", "ra", "n"), "a", "n")
        joined = join_hot(joined, hooks.toDF("b", "rb", "n"), "b", "n")
        joined = joined.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = durable(starred(joined.distinct()))
    else:
        raise RuntimeError(f"links are not connected after {limit} rounds")
    if not steps:
        return links.sparkSession.createDataFrame([], f"node {kind.simpleString()}, root {kind.simpleString()}")
    found = steps.pop()
    while steps:  # what a round hooked to may have moved on in later rounds
        later = found.toDF("root", "_to")
        found = steps.pop().join(later, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return found


def _shared(cells: DataFrame) -> DataFrame:
    """The rows (cell, u, n) of cells that have n > 1 members, each once.

    Cells that may hold a large part of all rows are told from a sample of the
    nodes; they are never gathered in one task, whatever the sample says of others.
    """
    sample = cells.filter(F.pmod(F.xxhash64(F.col("u"), F.lit(1)), F.lit(HOT_SAMPLE)) == 0)
    counts = durable(sample.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 2"))
    least = (counts.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS
    hot = F.broadcast(counts.filter(F.col("n") > least).orderBy(F.desc("n")).limit(HOT_KEYS).select("cell"))
    own = Window.partitionBy("cell")
    cold = cells.join(hot, "cell", "left_anti").withColumns({"_lo": F.min("u").over(own), "_hi": F.max("u").over(own)})
    cold = cold.filter("_lo <> _hi").select("cell", "u").distinct().withColumn("n", F.count("*").over(own))
    some = durable(cells.join(hot, "cell").distinct())
    sizes = some.groupBy("cell").agg(F.count("*").alias("n"))  # as few as hot cells
    return cold.unionByName(some.join(F.broadcast(sizes.filter("n > 1")), "cell"))


def as_binary(longs: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary for each run of so many longs."""
    ends = np.append(0, np.cumsum(lengths) * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(longs))])


def longs_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The longs of all rows of lists or binaries without nulls, and how many each row has."""
    x = column.combine_chunks()
    if not pa.types.is_binary(x.type):
        return x.flatten().to_numpy(), x.value_lengths().to_numpy()
    if not len(x) or x.buffers()[2] is None:
        return np.zeros(0, dtype=np.int64), np.zeros(len(x), dtype=np.int32)
    ends = np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, 4 * x.offset)
    return np.frombuffer(x.buffers()[2], np.int64, int(ends[-1] - ends[0]) // 8, int(ends[0])), np.diff(ends) // 8


def shared_cells(nodes: DataFrame) -> DataFrame:
    """The rows (cell, u, n) of cells that have n > 1 nodes u, each once; nodes: (u, cells), rows may be repeated, cells being longs in a binary.

    Tasks deal cells out in arrays, one for each part of all cells, as there may
    be many for each node and most are of one node only. Members of hot cells,
    as a sample of the nodes tells these, are dealt out by node, so they are
    never gathered in one task; their n is what the sample says.
    """

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(longs_of(pa.chunked_array([batch.column(0)]))[0])], ["cell"])

    sample = nodes.filter(F.pmod(F.xxhash64(F.col("u"), F.lit(1)), F.lit(HOT_SAMPLE)) == 0).select("cells").mapInArrow(opened, "cell long")
    counts = durable(sample.groupBy("cell").agg(F.count("*").alias("n")).filter("n > 2"))
    least = (counts.agg(F.sum("n")).first()[0] or 0) // HOT_KEYS
    found = counts.filter(F.col("n") > least).orderBy(F.desc("n")).limit(HOT_KEYS).orderBy("cell").collect()
    hot, size = np.array([r["cell"] for r in found], dtype=np.int64), np.array([r["n"] * HOT_SAMPLE for r in found], dtype=np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, cells, n = [], [], 0
        for batch in batches:
            own, lengths = longs_of(pa.chunked_array([batch.column(1)]))
            us.append(np.repeat(batch.column(0).to_numpy(), lengths))
            cells.append(own)
            n += len(own)
            if n >= DEALT:
                yield parted(np.concatenate(us), np.concatenate(cells))
                us, cells, n = [], [], 0
        if n:
            yield parted(np.concatenate(us), np.concatenate(cells))

    def parted(u: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
        part = _part(cell)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, cell), len(hot) - 1)
            part = np.where(hot[at] == cell, PARTS + _part(u), part)
        order = np.argsort(part.astype(np.uint16), kind="stable")
        lengths = np.bincount(part, minlength=2 * PARTS)
        some = np.flatnonzero(lengths)
        columns = [pa.array(some.astype(np.int32)), as_binary(u[order], lengths[some]), as_binary(cell[order], lengths[some])]
        return pa.RecordBatch.from_arrays(columns, ["part", "us", "cells"])

    def met(table: pa.Table) -> Iterator[pa.RecordBatch]:
        u, cell = longs_of(table.column("us"))[0], longs_of(table.column("cells"))[0]
        is_hot = np.repeat(table.column("part").to_numpy() >= PARTS, longs_of(table.column("us"))[1])
        order = np.argsort(cell)
        same = cell[order][1:] == cell[order][:-1]
        some = order[(np.append(False, same) | np.append(same, False))[: len(order)] | is_hot[order]]
        u, cell, is_hot = u[some], cell[some], is_hot[some]
        order = np.lexsort((u, cell))
        u, cell, is_hot = u[order], cell[order], is_hot[order]
        first = np.append(True, cell[1:] != cell[:-1])[: len(cell)]
        once = first | np.append(True, u[1:] != u[:-1])[: len(cell)]
        u, cell, is_hot, first = u[once], cell[once], is_hot[once], first[once]
        starts = np.flatnonzero(first)
        members = np.diff(np.append(starts, len(cell)))
        n = np.repeat(members, members)
        if len(hot):
            n = np.where(is_hot, size[np.minimum(np.searchsorted(hot, cell), len(hot) - 1)], n)
        taken = n > 1
        yield pa.RecordBatch.from_arrays([pa.array(cell[taken]), pa.array(u[taken]), pa.array(n[taken])], ["cell", "u", "n"])

    return _streamed(nodes.select("u", "cells").mapInArrow(dealt, "part int, us binary, cells binary"), ["part", "part"], met, "cell long, u long, n long")


def _part(x: np.ndarray) -> np.ndarray:
    """The part of each of some longs: the highest bits of a product."""
    return (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PARTS.bit_length() + 1)).astype(np.int64)


@dataclass(frozen=True)
class Nearness:
    """What every link fulfils, by the sizes and sketches of its ends.

    ``bits`` is how many bits of the sketches may differ, under 0 where sizes
    are too unlike. Sketches of more bits, twice as many or another power of
    two, hold the shorter ones: their halves' exclusive or.
    """

    bits: Callable[[np.ndarray, np.ndarray], np.ndarray]
    #: Bits come in pairs that count as one.
    paired: bool = False
    #: What is never over the number of differing bits, by points that are made of the sketches; pairs go by it first.
    point: Callable[[np.ndarray], np.ndarray] | None = None

    def far(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of differing bits of words."""
        x = a ^ b
        return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555) if self.paired else x)


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (a row each) of so many words, by the exclusive or of halves."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def near_in_block(a: np.ndarray, b: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], nearness: Nearness) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, far) of the pairs of two blocks of sketches that may be links; few sizes in the first block leave few pairs to compare."""
    (p, of_a), (q, of_b) = (np.unique(x, return_inverse=True) for x in sizes)
    kind = np.int16 if 64 * a.shape[1] < 1 << 15 else np.int32
    table = np.minimum(nearness.bits(p[:, None], q[None, :]), 64 * a.shape[1]).astype(kind)
    fits = np.flatnonzero((table >= 0).any(axis=0)[of_b])
    b, most = b[fits], table[of_a][:, of_b[fits]] if len(p) > 1 else table[:, of_b[fits]]
    p, q = (a, b) if nearness.point is None else (nearness.point(a), nearness.point(b))
    low = np.zeros((len(a), len(b)), dtype=kind)
    for w in range(a.shape[1]):
        low += nearness.far(p[:, w, None], q[None, :, w])
    i, j = np.nonzero(low <= most)
    if nearness.point is None:
        return i, fits[j], low[i, j]
    far = nearness.far(a[i], b[j]).sum(axis=1, dtype=np.int32)
    near = far <= np.broadcast_to(most, low.shape)[i, j]
    return i[near], fits[j[near]], far[near]


class Members:
    """Sketches and sizes of rows, and which of these may be links."""

    def __init__(self, rows: pa.Table, nearness: Nearness):
        self.nearness = nearness
        self.size = rows.column("size").to_numpy().astype(np.int64)
        words, self.widths = longs_of(rows.column("s"))
        self.words = words.view(np.uint64)
        self.starts = np.cumsum(self.widths) - self.widths
        kinds, self.kind = np.unique(self.widths, return_inverse=True)
        self.kinds = kinds.tolist()

    def _sketches(self, rows: np.ndarray, width: int, words: int) -> np.ndarray:
        return folded(self.words[self.starts[rows][:, None] + np.arange(width)[None, :]], words)

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, far) of those of the pairs of rows that may be links."""
        most = self.nearness.bits(self.size[i], self.size[j])
        fits = most >= 0
        i, j, most = i[fits], j[fits], most[fits]
        kind = self.kind[i] * len(self.kinds) + self.kind[j]
        found, distances = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for own in np.unique(kind).tolist():
            x, y = self.kinds[own // len(self.kinds)], self.kinds[own % len(self.kinds)]
            all_own = np.flatnonzero(kind == own)
            step = max(1, AT_A_TIME // max(x, y))
            for at in range(0, len(all_own), step):
                some = all_own[at : at + step]
                a, b = self._sketches(i[some], x, min(x, y)), self._sketches(j[some], y, min(x, y))
                if self.nearness.point is not None:
                    low = self.nearness.far(self.nearness.point(a), self.nearness.point(b)).sum(axis=1, dtype=np.int32) <= most[some]
                    some, a, b = some[low], a[low], b[low]
                far = self.nearness.far(a, b).sum(axis=1, dtype=np.int64)
                near = far <= most[some]
                found.append(some[near])
                distances.append(far[near])
        taken = np.concatenate(found)
        return i[taken], j[taken], np.concatenate(distances)

    def near_within(self, starts: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, far) of the pairs within some of the groups of rows that begin at ``starts`` that may be links."""
        sizes = np.diff(np.append(starts, len(self.size)))
        left = np.repeat(np.where(some, sizes, 0), sizes) - (np.arange(len(self.size)) - np.repeat(starts, sizes))  # rows from one to its group's end
        most = int(sizes[some].max(initial=0))
        none = np.zeros(0, dtype=np.int64)
        found, i, j, n = [], [none], [none], 0
        for d in range(1, most):
            one = np.flatnonzero(left > d)
            i.append(one)
            j.append(one + d)
            n += len(one)
            if n >= AT_A_TIME or d == most - 1:
                found.append(self.near(np.concatenate(i), np.concatenate(j)))
                i, j, n = [], [], 0
        return tuple(np.concatenate([none, *(x[k] for x in found)]) for k in range(3))

    def all_pairs(self, starts: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``near_within`` of all groups that are ``one_sided``, then ``pairs`` of each other one."""
        together = self.one_sided(starts, side)
        yield self.near_within(starts, together)
        ends = np.append(starts[1:], len(self.size))
        for start, end in zip(starts[~together].tolist(), ends[~together].tolist(), strict=True):
            yield from self.pairs(start, end, side)

    def one_sided(self, starts: np.ndarray, side: np.ndarray) -> np.ndarray:
        """Which of the groups of rows that begin at ``starts``, sorted by side, have few members, all of one side, so that they are compared together."""
        ends = np.append(starts[1:], len(self.size))
        return (ends - starts <= TOGETHER) & (side[starts] == side[ends - 1])

    def pairs(self, start: int, end: int, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, far) of the pairs of rows from start to end that may be links: of different sides, if there are two."""
        cross = side[start] != side[end - 1]
        rows = np.arange(start, end)
        for x in self.kinds:
            for y in self.kinds:
                left, right = rows[self.widths[start:end] == x], rows[self.widths[start:end] == y]
                if cross:
                    left, right = left[side[left] == side[start]], right[side[right] != side[start]]
                elif y < x:
                    continue
                if not len(left) or not len(right):
                    continue
                own = not cross and x == y
                left, right = (rows[np.argsort(self.size[rows], kind="stable")] for rows in (left, right))
                a, b = self._sketches(left, x, min(x, y)), self._sketches(right, y, min(x, y))
                step = max(1, AT_A_TIME // len(right))
                for at in range(0, len(left), step):
                    some, low = left[at : at + step], at if own else 0
                    i, j, far = near_in_block(a[at : at + step], b[low:], (self.size[some], self.size[right[low:]]), self.nearness)
                    once = i < j if own else slice(None)
                    yield some[i[once]], right[low + j[once]], far[once]


class Joined:
    """Which of some rows are joined, by labels."""

    def __init__(self, labels: np.ndarray):
        self.labels = labels
        self.moved: dict[int, int] = {}

    def of(self, row: int) -> int:
        x = int(self.labels[row])
        while x in self.moved:
            x = self.moved[x]
        return x

    def join(self, a: int, b: int) -> bool:
        x, y = self.of(a), self.of(b)
        if x != y:
            self.moved[max(x, y)] = min(x, y)
        return x != y

    def settle(self) -> None:
        """The labels as they are after all joins."""
        if self.moved:
            to = np.arange(int(self.labels.max()) + 1)
            for x in sorted(self.moved):  # what a label moved to is less than it
                to[x] = to[self.moved[x]]
            self.labels, self.moved = to[self.labels], {}


def forest(i: np.ndarray, j: np.ndarray, far: np.ndarray, joined: Joined) -> list[tuple[int, int]]:
    """Of the pairs (i, j) of rows some that connect what all of them connect: each j's nearest first, none between rows that are joined already."""
    order = np.lexsort((far, j))
    i, j = i[order], j[order]
    found = []
    while True:
        apart = joined.labels[i] != joined.labels[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return found
        first = np.flatnonzero(np.append(True, j[1:] != j[:-1]))
        found += [(a, b) for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True) if joined.join(a, b)]
        joined.settle()


def _streamed(rows: DataFrame, keys: list[str], of: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, least: int = 1) -> DataFrame:
    """What ``of`` makes of the rows, which come sorted, some whole groups at a time (of ``least`` rows, if there are so many).

    Keys are longs and ints; the last tells the rows of a group apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not len(batch):
                continue
            if held and n >= least:
                cut = _starts([held[-1].slice(len(held[-1]) - 1), batch], keys[:-1])
                if len(cut) > 1:  # the last group that begins there may go on
                    at = int(cut[-1]) - 1
                    yield from of(pa.Table.from_batches([*held, batch.slice(0, at)]))
                    held, n = [], 0
                    batch = batch.slice(at)
            held.append(batch)
            n += len(batch)
        if held:
            yield from of(pa.Table.from_batches(held))

    return rows.repartition(*keys[:-1]).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _starts(batches: list[pa.RecordBatch], keys: list[str]) -> np.ndarray:
    """Where groups start in the rows of some batches."""
    table = pa.Table.from_batches(batches)
    own = [table.column(n).to_numpy() for n in keys]
    return np.append(0, np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in own])) + 1)


GROUP = ["cell", "_i", "_k"]


def _blocked(rows: DataFrame, size: str, block: int) -> DataFrame:
    """``rows`` with _i, _k and _p: a cell of up to ``block`` members (so many as ``size`` says) is one group, in others there is one for any two blocks (_i, _k) of members, _p telling the row's block."""
    zero = F.lit(0)
    few = rows.filter(F.col(size) <= block).withColumns({"_i": zero, "_k": zero, "_p": zero})
    parts = F.ceil(F.col(size) / block).cast("int")
    many = rows.filter(F.col(size) > block).withColumn("_p", F.pmod(F.xxhash64("u", F.lit(3)), parts).cast("int"))
    many = many.withColumn("_q", F.explode(F.sequence(zero, parts - 1)))
    many = many.withColumns({"_i": F.least("_p", "_q"), "_k": F.greatest("_p", "_q")}).drop("_q")
    return few.unionByName(many)


def _near_pairs(members: DataFrame, nearness: Nearness, paired: int, block: int) -> DataFrame:
    """(cell, a, b) of pairs in cells that may be links: all of cells of up to ``paired`` members, whose cell is null; of others enough to connect what all would."""

    def compared(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        own = Members(rows, nearness)
        cell, u, side = (rows.column(c).to_numpy() for c in ("cell", "u", "_p"))
        starts = _starts(rows.to_batches(), GROUP)
        sizes = np.diff(np.append(starts, len(u)))
        whole = rows.column("n").to_numpy()[starts] <= paired
        i, j, _ = own.near_within(starts, whole)
        yield _links(u[i], u[j], pa.nulls(len(i), pa.int64()))
        joined = Joined(np.arange(len(u)))
        together = ~whole & own.one_sided(starts, side)
        found = forest(*own.near_within(starts, together), joined)
        for start, n in zip(starts[~whole & ~together].tolist(), sizes[~whole & ~together].tolist(), strict=True):
            for i, j, far in own.pairs(start, start + n, side):
                found += forest(i, j, far, joined)
        a, b = (np.array([x[k] for x in found], dtype=np.int64) for k in (0, 1))
        yield _links(u[a], u[b], pa.array(cell[a]))

    return _streamed(_blocked(members, "n", block), [*GROUP, "_p"], compared, "cell long, a long, b long", ROWS)


def _links(a: np.ndarray, b: np.ndarray, cell: pa.Array | None = None) -> pa.RecordBatch:
    ends = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]
    return pa.RecordBatch.from_arrays(ends if cell is None else [cell, *ends], ["a", "b"] if cell is None else ["cell", "a", "b"])


def _own_details(x: pa.Array) -> Callable[[int], object]:
    return (lambda k: x[k].values.to_numpy()) if pa.types.is_list(x.type) else (lambda k: x[k].as_py())


def _linked_apart(rows: DataFrame, known: DataFrame, nearness: Nearness, similar: Callable[[object, object], bool], block: int) -> DataFrame:
    """(a, b), different roots that links connect: of cells (cell, n, u, root, size, s) all pairs are looked at that may be links between roots.

    Members without such a pair leave by their numbers alone; the others'
    details go to their cells. What links have joined in a task isn't looked
    at again there, and a pair that shares several cells is looked at in the
    first of them.
    """
    kind = rows.select("cell", "u", "root", "size", "s").schema

    def met(table: pa.Table) -> Iterator[pa.RecordBatch]:
        own = Members(table, nearness)
        root, side = table.column("root").to_numpy(), table.column("_p").to_numpy()
        starts = _starts(table.to_batches(), GROUP)
        near = np.zeros(len(root), dtype=bool)
        for i, j, _ in own.all_pairs(starts, side):
            apart = root[i] != root[j]
            near[i[apart]] = near[j[apart]] = True
        yield from table.select(kind.names).filter(pa.array(near)).combine_chunks().to_batches()

    some = _streamed(_blocked(rows, "n", block), [*GROUP, "_p"], met, kind, ROWS).dropDuplicates(["cell", "u"])
    some = some.withColumns({"n": F.count("*").over(Window.partitionBy("cell")), "cells": F.collect_list("cell").over(Window.partitionBy("u"))})
    dealt = _blocked(some, "n", min(block, LINKED)).join(known.select("u", "x"), "u")

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        own = Members(table, nearness)
        of = _own_details(table.column("x").combine_chunks())
        root, side, cell = (table.column(c).to_numpy() for c in ("root", "_p", "cell"))
        lists = table.column("cells").combine_chunks()
        lengths = lists.value_lengths().to_numpy()
        known_by = np.arange(lengths.max(initial=1))[None, :] < lengths[:, None]
        cells = np.zeros(known_by.shape, dtype=np.int64)
        cells[known_by] = lists.flatten().to_numpy()
        starts = _starts(table.to_batches(), GROUP)
        a, b = [], []
        joined = Joined(np.unique(root, return_inverse=True)[1])
        for i, j, far in own.all_pairs(starts, side):
            apart = root[i] != root[j]
            order = np.argsort(far[apart], kind="stable")
            i, j = i[apart][order], j[apart][order]
            for at in range(0, len(i), 10_000):
                p, q = i[at : at + 10_000], j[at : at + 10_000]
                still = joined.labels[p] != joined.labels[q]
                p, q = p[still], q[still]
                shared = ((cells[p][:, :, None] == cells[q][:, None, :]) & known_by[q][:, None, :]).any(axis=2) & known_by[p]
                here = np.where(shared, cells[p], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max) == cell[p]
                for x, y in zip(p[here].tolist(), q[here].tolist(), strict=True):
                    if joined.of(x) != joined.of(y) and similar(of(x), of(y)):
                        joined.join(x, y)
                        a.append(x)
                        b.append(y)
                joined.settle()
        yield _links(root[np.array(a, dtype=np.int64)], root[np.array(b, dtype=np.int64)])

    return _streamed(dealt, [*GROUP, "_p"], compared, "a long, b long").distinct()


def verified(pairs: DataFrame, known: DataFrame, similar: Callable[[object, object], bool]) -> DataFrame:
    """The pairs (a, b), which are read several times, whose details (u, x, bytes) are similar.

    Pairs that hang together are dealt to one group, in which a node's details
    are sent once, however many pairs it has there. The group is told by the
    node with the least hash among a node and its partners; large groups are cut
    into blocks of nodes by another hash, and pairs into those of two blocks.
    """
    ends = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = F.min(F.struct(F.xxhash64("b").alias("h"), "b"))
    own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"))
    heads = durable(ends.groupBy("a").agg(first.alias("m"), F.count("*").alias("k")).select("a", F.least("m", own)["b"].alias("g"), "k"))
    sizes = known.select("u", "bytes")
    with_group = join_hot(pairs, heads, "a", "k").join(light(heads.select(F.col("a").alias("b"), F.col("g").alias("h")), heads.count()), "b")
    dealt = durable(with_group.select(F.least("g", "h").alias("g"), "a", "b"))
    members = dealt.select("g", F.explode(F.array("a", "b")).alias("u")).distinct()
    held = members.join(sizes, "u").groupBy("g").agg(F.sum("bytes").alias("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / HELD)).cast("int")
    groups = durable(held.select("g", parts.alias("parts")).join(dealt.groupBy("g").agg(F.count("*").alias("k")), "g"))
    at = lambda c: F.pmod(F.xxhash64(c, F.lit(11)), F.col("parts")).cast("int")
    cut = durable(join_hot(dealt, groups, "g", "k").select("g", at("a").alias("_i"), at("b").alias("_j"), "a", "b"))
    places = durable(cut.select("g", "_i", "_j", F.explode(F.array("a", "b")).alias("u")).distinct())
    kind = known.schema["x"].dataType.simpleString()
    texts = known.select("u", "x").join(light(places, places.count()), "u").select("g", "_i", "_j", F.lit(0).alias("_side"), "u", F.lit(None).cast("long").alias("b"), "x")
    asked = cut.select("g", "_i", "_j", F.lit(1).alias("_side"), F.col("a").alias("u"), "b", F.lit(None).cast(kind).alias("x"))

    def judged(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        side, u, b = (rows.column(c).fill_null(0).to_numpy() for c in ("_side", "u", "b"))  # as doubles, which nulls would make them, ids lose digits
        of = _own_details(rows.column("x").combine_chunks())
        starts = set(_starts(rows.to_batches(), ["g", "_i", "_j"]).tolist())
        good: list[int] = []
        own: dict[int, object] = {}
        for k, (asks, p, q) in enumerate(zip(side.tolist(), u.tolist(), b.tolist(), strict=True)):
            if k in starts:
                own = {}
            if not asks:
                own[p] = of(k)
            elif similar(own[p], own[q]):
                good.append(k)
        yield pa.RecordBatch.from_arrays([pa.array(u[good]), pa.array(b[good])], ["a", "b"])

    return stored(_streamed(texts.unionAll(asked), ["g", "_i", "_j", "_side"], judged, "a long, b long"))


def linked_in_cells(
    cells: DataFrame, info: DataFrame, nearness: Nearness, details: Callable[[DataFrame], DataFrame], similar: Callable[[object, object], bool]
) -> DataFrame:
    """(node, root) of the nodes that links between members of a cell connect; nodes are longs.

    cells: (cell, u), rows may be repeated, or what ``shared_cells`` gives; info: (u, size, s), a row or equal
    rows for each u, s being a sketch of 64-bit words, a list or a binary; nearness: what every
    link fulfils; details: (u, x, bytes) of some nodes (u), x an array or a
    string of about so many bytes; similar: whether two x, an array as NumPy's,
    make a link.

    Sizes and sketches tell which pairs in a cell may be links. In a small cell
    all of these are looked at; in a large one as many as connect what all
    would, the nearest first. If all that these connect is linked, as it mostly
    is, nothing else in the cell can change the result. In the cells in which
    some isn't, all pairs that may be links between different components are
    looked at then. So no link between two members of a cell is left out.
    """
    about = info.select("u", "size", "s").dropDuplicates(["u"])
    members = stored((cells if "n" in cells.columns else _shared(cells)).join(about, "u"))
    candidates = stored(_near_pairs(members, nearness, PAIRED, BLOCK))
    pairs = stored(candidates.select("a", "b").distinct())
    needed = durable(pairs.select(F.explode(F.array("a", "b")).alias("u")).distinct())
    known = stored(details(needed))
    links = verified(pairs, known, similar)
    roots = durable(components(links).toDF("u", "root"))
    n = roots.count()

    def rooted(rows: DataFrame, node: str, root: str) -> DataFrame:
        return rows.join(light(roots.toDF(node, root), n), node, "left").withColumn(root, F.coalesce(root, node))

    large = rooted(rooted(candidates.filter("cell is not null"), "a", "p"), "b", "q")
    unsettled = durable(large.filter("p <> q").select("cell").distinct())
    k = unsettled.count()
    if k:
        rows = rooted(members.join(light(unsettled, k), "cell", "left_semi"), "u", "root")
        more = stored(_linked_apart(rows, known, nearness, similar, BLOCK))
        if not more.isEmpty():
            moved = durable(components(more).toDF("root", "to"))
            m = moved.count()
            alone = moved.toDF("u", "root").join(roots, "u", "left_anti")
            roots = roots.join(light(moved, m), "root", "left").select("u", F.coalesce("to", "root").alias("root")).unionAll(alone)
    return roots.toDF("node", "root")
