"""Factor expressions as a graph of operators, and its compilation to stages of columns.

Equal expressions are one node. Every window operator becomes a named column;
those that need only columns of earlier stages make up a stage: one ``select``,
so Spark sorts once for all operators over the same window, and one pass through
Arrow for all that need their window's values in order. Nested operators never
end up inside each other's expressions, which would make plans grow with a power
of the depth.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.columns import BY_ASSET, BY_DATE, BY_ROW, Frame
from factorloom.functions.rolled import RUNNING, Roll, in_order, ranked, rolled

Number = int | float

#: Ranks of a date, each of which is a sort of its own as a window; from so many in a stage on they are made in one pass.
RANKS, MANY_RANKS = ("cs_rank", "cs_rank_raw"), 3


@dataclass(frozen=True)
class Node:
    """An operator with its arguments and numbers; ``field`` and ``const`` are the leaves."""

    op: str
    args: tuple[Node, ...] = ()
    numbers: tuple[Number | str, ...] = ()

    def __post_init__(self) -> None:
        object.__setattr__(self, "_hash", hash((self.op, self.args, self.numbers)))

    def __hash__(self) -> int:
        return self._hash

    def __add__(self, other: Node | Number) -> Node:
        return Node("add", (self, node(other)))

    def __radd__(self, other: Number) -> Node:
        return Node("add", (node(other), self))

    def __sub__(self, other: Node | Number) -> Node:
        return Node("sub", (self, node(other)))

    def __rsub__(self, other: Number) -> Node:
        return Node("sub", (node(other), self))

    def __mul__(self, other: Node | Number) -> Node:
        return Node("mul", (self, node(other)))

    def __rmul__(self, other: Number) -> Node:
        return Node("mul", (node(other), self))

    def __truediv__(self, other: Node | Number) -> Node:
        return Node("div", (self, node(other)))

    def __rtruediv__(self, other: Number) -> Node:
        return Node("div", (node(other), self))

    def __neg__(self) -> Node:
        return Node("neg", (self,))

    def __lt__(self, other: Node | Number) -> Node:
        return Node("less", (self, node(other)))

    def __gt__(self, other: Node | Number) -> Node:
        return Node("greater", (self, node(other)))

    def __abs__(self) -> Node:
        return Node("abs", (self,))

    def size(self) -> int:
        """How many operators and leaves, repeated ones each time."""
        return 1 + sum(a.size() for a in self.args)

    def depth(self) -> int:
        """How many operators and leaves from here to the deepest leaf, both ends included."""
        return 1 + max((a.depth() for a in self.args), default=0)


def node(x: Node | Number) -> Node:
    """A number as a constant."""
    return x if isinstance(x, Node) else Node("const", (), (float(x),))


def field(name: str) -> Node:
    """A column."""
    return Node("field", (), (name,))


def call(op: str, *args: Node | Number, n: tuple[Number, ...] = ()) -> Node:
    """An operator by its name. A rank of a rank is that rank."""
    nodes = tuple(node(a) for a in args)
    if op == "cs_rank" and nodes[0].op == "cs_rank":
        return nodes[0]
    return Node(op, nodes, tuple(n))


def walk(roots: list[Node]) -> list[Node]:
    """Every distinct node once, arguments first."""
    found: dict[Node, None] = {}
    stack = [(r, False) for r in reversed(roots)]
    while stack:
        x, ready = stack.pop()
        if x in found:
            continue
        if ready:
            found[x] = None
        else:
            stack.append((x, True))
            stack.extend((a, False) for a in reversed(x.args))
    return list(found)


def is_window(x: Node) -> bool:
    """Whether an operator looks at other rows."""
    return x.op in BY_ASSET or x.op in BY_DATE


def levels(nodes: list[Node]) -> dict[Node, int]:
    """The stage of each node: what it needs at most, and one more for a window operator."""
    found: dict[Node, int] = {}
    for x in nodes:
        found[x] = max((found[a] for a in x.args), default=0) + is_window(x)
    return found


def substituted(roots: list[Node], known: Mapping[Node, Node]) -> list[Node]:
    """The roots with some nodes replaced, wherever they stand."""
    made: dict[Node, Node] = {}
    for x in walk(roots):
        made[x] = known[x] if x in known else Node(x.op, tuple(made[a] for a in x.args), x.numbers)
    return [made[r] for r in roots]


#: How many rows of its asset a node looks back at or ahead, in parts between which it looks at whole dates; the root's part first.
Reach = tuple[tuple[float, float], ...]


def reaches(nodes: list[Node]) -> dict[Node, Reach]:
    """The reach of each of some nodes, which come in the order of ``walk``."""
    found: dict[Node, Reach] = {}
    for x in nodes:
        own: list[tuple[float, float]] = [(0, 0)]
        for a in x.args:
            other = found[a]
            longest = range(max(len(own), len(other)))
            at = lambda parts, k: parts[k] if k < len(parts) else (0, 0)
            own = [(max(at(own, k)[0], at(other, k)[0]), max(at(own, k)[1], at(other, k)[1])) for k in longest]
        if x.op in BY_DATE:
            own = [(0, 0), *own]
        elif x.op in RUNNING:
            own[0] = (float("inf"), own[0][1])
        elif x.op in BY_ASSET:
            n = int(x.numbers[0])
            back, ahead = (max(n, 0), max(-n, 0)) if x.op in ("ts_delay", "ts_delta") else (n - 1, 0)
            own[0] = (own[0][0] + back, own[0][1] + ahead)
        found[x] = tuple(own)
    return found


def _bound(df: DataFrame, reach: Reach, start: object, end: object, earlier: bool, asset: str, date: str) -> object:
    """How far from ``start`` (or from ``end``) rows matter to what stands between the two; None for all. A job for each part."""
    rows, bound = df.select(asset, date), start if earlier else end
    for back, ahead in reach:
        n = back if earlier else ahead
        if bound is None or n == float("inf"):
            return None
        if not n:
            continue
        inside = F.lit(True)
        for edge, is_low in ((bound if earlier else start, True), (end if earlier else bound, False)):
            if edge is not None:
                inside = inside & ((F.col(date) >= F.lit(edge)) if is_low else (F.col(date) <= F.lit(edge)))
        outside = rows.filter(F.col(date) < F.lit(bound) if earlier else F.col(date) > F.lit(bound))
        outside = outside.join(rows.filter(inside).select(asset).distinct(), asset, "left_semi")
        order = Window.partitionBy(asset).orderBy(F.desc(date) if earlier else F.col(date))
        nearest = outside.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= int(n))
        bound = nearest.agg((F.min if earlier else F.max)(date)).first()[0] or bound
    return bound


def compile_between(
    df: DataFrame, factors: Mapping[str, Node], low: object = None, high: object = None, asset: str = "asset", date: str = "date"
) -> DataFrame:
    """``compile_factors`` for the dates from ``low`` to ``high``, both included; None is no bound.

    Only the rows that these dates' values take are read: the dates before
    ``low`` and after ``high`` as far as the expressions look back and ahead
    along any asset, whole dates each, since cross-sections take all assets.
    """
    nodes = walk(list(factors.values()))
    found = reaches(nodes)
    reach: Reach = ((0, 0),)
    for x in factors.values():
        both = range(max(len(reach), len(found[x])))
        at = lambda parts, k: parts[k] if k < len(parts) else (0, 0)
        reach = tuple((max(at(reach, k)[0], at(found[x], k)[0]), max(at(reach, k)[1], at(found[x], k)[1])) for k in both)
    rows, own = df, F.lit(True)
    if low is not None:
        own = own & (F.col(date) >= F.lit(low))
        start = _bound(df, reach, low, high, True, asset, date)
        rows = rows if start is None else rows.filter(F.col(date) >= F.lit(start))
    if high is not None:
        own = own & (F.col(date) <= F.lit(high))
        end = _bound(df, reach, low, high, False, asset, date)
        rows = rows if end is None else rows.filter(F.col(date) <= F.lit(end))
    return compile_factors(rows, factors, asset, date).filter(own)


def shared_nodes(parts: list[list[Node]]) -> list[Node]:
    """The window operators that several of some groups of expressions have; of one inside another that is as widely shared only the outer."""
    groups: dict[Node, set[int]] = {}
    for k, roots in enumerate(parts):
        for x in walk(roots):
            if is_window(x):
                groups.setdefault(x, set()).add(k)
    shared = {x: own for x, own in groups.items() if len(own) > 1}
    covered: set[Node] = set()
    for x, own in shared.items():
        for y in walk(list(x.args)):
            if y in shared and shared[y] == own:
                covered.add(y)
    return [x for x in shared if x not in covered]


def compile_factors(df: DataFrame, factors: Mapping[str, Node], asset: str = "asset", date: str = "date") -> DataFrame:
    """``df`` with a column for each factor; one that has a column's name replaces it."""
    frame = Frame(asset, date)
    roots = list(factors.values())
    nodes = walk(roots)
    own = {asset, date, *[c for c in df.columns if c not in factors]}
    level = levels(nodes)
    names: dict[Node, str] = {}
    taken = {c.lower() for c in df.columns}

    def fresh() -> str:
        k = len(names)
        while f"_n{k}" in taken:
            k += 1
        taken.add(f"_n{k}")
        return f"_n{k}"

    def column(x: Node) -> Column:
        if x in names:
            return F.col(names[x])
        if x.op == "field":
            return F.col(f"`{x.numbers[0]}`")
        if x.op == "const":
            return F.lit(x.numbers[0])
        return BY_ROW[x.op](*[column(a) for a in x.args], *x.numbers)

    def pruned(out: DataFrame) -> DataFrame:
        """``out`` without the columns that nothing takes from here on, as Spark leaves none out in front of Python."""
        later = {a for x in nodes if x not in names for a in x.args} | set(roots)
        held = {names.get(x) or str(x.numbers[0]) for x in later if x in names or x.op == "field"} | own
        return out.select(*[F.col(f"`{c}`") for c in out.columns if c in held])

    out = df
    for stage in range(1, max(level.values(), default=0) + 1):
        windows = [x for x in nodes if level[x] == stage and is_window(x)]
        inner: list[Column] = []
        for x in windows:  # arguments that are not columns yet
            for a in x.args:
                if a not in names and a.op != "field":
                    c, names[a] = column(a), fresh()
                    inner.append(c.alias(names[a]))
        if inner:
            out = out.select("*", *inner)
        ranks = [x for x in windows if x.op in RANKS]
        ranks = ranks if len(ranks) >= MANY_RANKS else []
        by_date = [x for x in windows if x.op in BY_DATE and x not in ranks]
        by_asset = [x for x in windows if x.op in BY_ASSET and not in_order(x.op, x.numbers)]
        passed = [x for x in windows if in_order(x.op, x.numbers)]
        for some in (by_date, ranks, by_asset):  # by asset last, as the pass goes through rows in that order
            if ranks and some is ranks:
                whole, made = pruned(out), []
                for x in ranks:
                    (arg,) = x.args
                    source, names[x] = names.get(arg) or str(arg.numbers[0]), fresh()
                    made.append((source, names[x], x.op == "cs_rank"))
                out = ranked(whole, made, date)
                continue
            outer: list[Column] = []
            for x in some:
                build = BY_ASSET.get(x.op) or BY_DATE[x.op]
                c, names[x] = build(frame, *[column(a) for a in x.args], *x.numbers), fresh()
                outer.append(c.alias(names[x]))
            if outer:
                out = out.select("*", *outer)
        rolls: list[Roll] = []
        whole = pruned(out) if passed else out
        for x in passed:
            source, *other = [names.get(a) or str(a.numbers[0]) for a in x.args]
            names[x] = fresh()
            rolls.append(Roll(x.op, source, x.numbers, names[x], *other))
        if rolls:
            out = rolled(whole, rolls, frame)
    keep = [F.col(f"`{c}`") for c in df.columns if c not in factors]
    return out.select(*keep, *[column(x).cast("double").alias(name) for name, x in factors.items()])
