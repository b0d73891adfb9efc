"""An evolutionary search for factor expressions.

The population lives on the driver; a generation is judged in batches of two
jobs: the expressions of a batch are compiled together, so what they share is
computed once, and every IC comes from one aggregation. A first pass over a
sample of dates (after the windows, which see all dates) spares expressions
without promise the full one. The values of window operators that several
batches take are stored by node and kept from generation to generation, so a
generation computes what is new in it; what wasn't used for longest goes when
the store is full.
"""

from __future__ import annotations

import random
from collections import Counter
from dataclasses import dataclass, field as dataclass_field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.operators.evaluate import finite, pooled_matrix, rank_ic
from factorloom.plans.graph import Node, compile_factors, field, node, shared_nodes, substituted, walk
from factorloom.plans.text import BINARY, DAILY, FIELDS, ROLLING, ROLLING_PAIR, TEMPLATES, UNARY, loose, parse, to_text
from factorloom.sources.panel import complete
from factorloom.sources.stored import Tables

#: The windows and constants of the search.
WINDOWS = (5, 10, 20, 40, 60)
CONSTANTS = (-1.0, 0.5, 1.0, 2.0, 5.0, 10.0)
_BY_GRAPH = {"loose_range": "ts_rank", "loose_decay": "ts_decay_linear", "loose_corr": "ts_corr", "cs_rank_raw": "cs_rank"}


@dataclass(frozen=True)
class Parameters:
    """Sizes and rates of the search; min_obs names make an IC, min_dates ICs a mean, min_rows rows a correlation."""

    population: int = 500
    generations: int = 100
    max_depth: int = 5
    tournament: int = 5
    crossover: float = 0.7
    threshold: float = 0.03
    redundancy: float = 0.7
    stale: int = 20
    coarse_share: float = 0.1
    checked: int = 20
    min_obs: int = 20
    min_dates: int = 5
    min_rows: int = 100
    seed: int = 42
    #: Bytes of stored values, of eight for each row and node; 0 stores none.
    stored_bytes: int = 1 << 31


class Values:
    """A panel with columns for the values of some nodes, in one stored table."""

    def __init__(self, rows: DataFrame, room: int):
        self.tables = Tables(rows.sparkSession)
        self.table = self.tables.store(rows)
        self.base, self.room = rows.columns, room // (8 * max(1, self.table.count()))
        self.names: dict[Node, str] = {}
        self.used: dict[Node, int] = {}
        self.made = self.turn = 0

    def prepare(self, trees: list[Node], most: int = 100) -> None:
        """Store what several expressions take and isn't there yet, the ``most`` that most take, in place of what wasn't used for longest."""
        self.turn += 1
        count = Counter(x for t in trees for x in walk([t]))
        for x in count.keys() & self.names.keys():
            self.used[x] = self.turn
        new = [x for x in shared_nodes([[t] for t in trees]) if x not in self.names]
        new = sorted(new, key=lambda x: (-count[x], to_text(x)))[: min(most, self.room)]
        if not new:
            return
        stay = sorted(self.names, key=lambda x: -self.used[x])[: max(0, self.room - len(new))]
        columns = {}
        for x in new:
            columns[x] = f"_v{self.made}"
            self.made += 1
        made = dict(zip(columns.values(), self.by_columns(new), strict=True))
        table = compile_factors(self.table, made)
        self.names = {x: c for x, c in self.names.items() if x in set(stay)} | columns
        self.used = {x: self.used.get(x, self.turn) for x in self.names}
        self.table = self.tables.store(table.select(*self.base, *self.names.values()))
        self.tables.keep_last()

    def by_columns(self, trees: list[Node]) -> list[Node]:
        """Expressions with what is stored in place of the operators."""
        return substituted(trees, {x: field(c) for x, c in self.names.items()})


@dataclass
class Found:
    """An expression of the pool with what it was judged by."""

    expression: Node
    ic: float
    icir: float

    @property
    def text(self) -> str:
        return to_text(self.expression)


class Grower:
    """Random expressions and changes to them."""

    def __init__(self, seed: int, fields: tuple[str, ...] = FIELDS, max_depth: int = 5):
        self.rng, self.fields, self.max_depth = random.Random(seed), fields, max_depth

    def leaf(self) -> Node:
        """A column, or a constant three times in ten."""
        return field(self.rng.choice(self.fields)) if self.rng.random() < 0.7 else node(self.rng.choice(CONSTANTS))

    def apply(self, op: str, args: list[Node]) -> Node:
        """An operator of the text language with a random window."""
        return loose(op, args, self.rng.choice(WINDOWS))

    def tree(self, depth: int, full: bool = False) -> Node:
        """A random expression of ``depth`` at most; all branches as deep if ``full``."""
        if depth <= 1 or not full and self.rng.random() < 0.3:
            return self.leaf()
        op = self.rng.choice([*BINARY, *UNARY, *ROLLING, *ROLLING_PAIR, *DAILY])
        count = 2 if op in BINARY + ROLLING_PAIR else 1
        return self.apply(op, [self.tree(depth - 1, full) for _ in range(count)])

    def ramped(self, n: int) -> list[Node]:
        """Random expressions of depths from 2 to the largest, every other one full."""
        return [self.tree(2 + k % (self.max_depth - 1), bool(k % 2)) for k in range(n)]

    def places(self, x: Node, path: tuple[int, ...] = ()) -> list[tuple[int, ...]]:
        """The paths to all nodes."""
        return [path, *[p for k, a in enumerate(x.args) for p in self.places(a, (*path, k))]]

    @staticmethod
    def at(x: Node, path: tuple[int, ...]) -> Node:
        for k in path:
            x = x.args[k]
        return x

    def replaced(self, x: Node, path: tuple[int, ...], new: Node) -> Node:
        """``x`` with another node at a path."""
        if not path:
            return new
        args = list(x.args)
        args[path[0]] = self.replaced(args[path[0]], path[1:], new)
        return Node(x.op, tuple(args), x.numbers)

    def crossed(self, a: Node, b: Node) -> Node:
        """``a`` with a part of ``b`` somewhere; ``a`` if that gets too deep."""
        new = self.replaced(a, self.rng.choice(self.places(a)), self.at(b, self.rng.choice(self.places(b))))
        return new if new.depth() <= self.max_depth + 2 else a

    def mutated(self, x: Node) -> Node:
        """Another operator of a kind (4 in 10), another part (4 in 10) or another window."""
        path = self.rng.choice(self.places(x))
        old, dice = self.at(x, path), self.rng.random()
        if dice < 0.4:
            new = self.another(old)
        elif dice < 0.8:
            new = self.tree(3)
        else:
            rolling = [p for p in self.places(x) if _BY_GRAPH.get(self.at(x, p).op, self.at(x, p).op) in ROLLING + ROLLING_PAIR]
            if not rolling:
                return self.replaced(x, path, self.another(old))
            path = self.rng.choice(rolling)
            old = self.at(x, path)
            new = loose(_BY_GRAPH.get(old.op, old.op), list(old.args), self.rng.choice(WINDOWS))
        made = self.replaced(x, path, new)
        return made if made.depth() <= self.max_depth + 2 else x

    def another(self, x: Node) -> Node:
        """A node with the same arguments and another operator of the kind, or another leaf."""
        name = _BY_GRAPH.get(x.op, x.op)
        if not x.args:
            return self.leaf()
        for kind in (BINARY, UNARY, ROLLING, ROLLING_PAIR, DAILY):
            if name in kind:
                window = int(x.numbers[0]) if kind in (ROLLING, ROLLING_PAIR) else 10
                return loose(self.rng.choice(kind), list(x.args), window)
        return x

    def started(self, n: int, templates: tuple[str, ...] = TEMPLATES) -> list[Node]:
        """Templates, their mutants (one to three changes) and random expressions."""
        found = [parse(t) for t in templates][:n]
        mutants = []
        for k in range(max(0, min(n // 2, n - len(found)))):
            x = found[k % len(found)] if found else self.tree(self.max_depth)
            for _ in range(self.rng.randint(1, 3)):
                x = self.mutated(x)
            mutants.append(x)
        return (found + mutants + self.ramped(n))[:n]


@dataclass
class Miner:
    """The search over one panel (asset, date, prices) with forward returns."""

    panel: DataFrame
    forward: str = "fwd_return"
    parameters: Parameters = dataclass_field(default_factory=Parameters)

    def __post_init__(self) -> None:
        rows = complete(self.panel).filter(F.col("close").isNotNull())
        self.values = Values(rows, self.parameters.stored_bytes)
        self.grower = Grower(self.parameters.seed, max_depth=self.parameters.max_depth)
        self.judged: dict[Node, tuple[float, float]] = {}

    def ics(self, trees: list[Node], coarse: bool) -> dict[Node, tuple[float, float]]:
        """The mean daily IC and ICIR of expressions, of those that have enough dates, in one job.

        If Spark can't run them, each half is tried by itself, so an expression
        that fails is missing and the others aren't.
        """
        try:
            return self._ics(trees, coarse)
        except PySparkException:
            if len(trees) == 1:
                return {}
            half = len(trees) // 2
            return self.ics(trees[:half], coarse) | self.ics(trees[half:], coarse)

    def _ics(self, trees: list[Node], coarse: bool) -> dict[Node, tuple[float, float]]:
        p = self.parameters
        names = {f"x{k}": t for k, t in enumerate(trees)}
        rows = self.compiled(names).select("date", "asset", self.forward, *names)
        if coarse:
            share = max(1, round(1 / max(p.coarse_share, 1e-9)))
            rows = rows.filter(F.pmod(F.xxhash64(F.lit(p.seed), "date"), F.lit(share)) == 0)
        daily = rank_ic(rows, list(names), self.forward, pairwise=True, min_obs=p.min_obs, finite_only=True)
        found = (
            daily.filter(finite(F.col("ic")))
            .groupBy("factor")
            .agg(F.count("ic").alias("n"), F.avg("ic").alias("m"), F.stddev_samp("ic").alias("s"))
            .collect()
        )
        least = 1 if coarse else p.min_dates
        return {
            names[r["factor"]]: (r["m"], r["m"] / r["s"] if r["s"] and r["s"] >= 1e-10 else 0.0) for r in found if r["n"] >= least
        }

    def compiled(self, names: dict[str, Node]) -> DataFrame:
        """The panel with columns for some expressions, from what is stored."""
        return compile_factors(self.values.table, dict(zip(names, self.values.by_columns(list(names.values())), strict=True)))

    def close(self) -> None:
        """Delete what is stored."""
        self.values.tables.drop()

    def judge(self, trees: list[Node], batch: int = 60) -> None:
        """Fitness of those not seen before; what has no promise on the sample of dates has none."""
        new = [t for t in dict.fromkeys(trees) if t not in self.judged and any(x.op == "field" for x in _walk(t))]
        for t in set(trees) - set(new) - self.judged.keys():
            self.judged[t] = (-1.0, 0.0)
        parts = [new[k : k + batch] for k in range(0, len(new), batch)]
        try:
            self.values.prepare(new)
        except PySparkException:
            pass  # a node that fails is met again in its batch, where it costs only its own expressions
        for part in parts:
            rough = self.ics(part, True) if self.parameters.coarse_share < 1 else dict.fromkeys(part, (1.0, 0.0))
            hopeful = [t for t in part if abs(rough.get(t, (0.0, 0.0))[0]) >= 0.5 * self.parameters.threshold]
            full = self.ics(hopeful, False) if hopeful else {}
            for t in part:
                self.judged[t] = full.get(t, (abs(rough[t][0]) * 0.5 if t in rough else -1.0, 0.0))

    def fitness(self, x: Node) -> float:
        """The size of the mean IC; -1 for what couldn't be judged."""
        ic = self.judged[x][0]
        return -1.0 if ic == -1.0 else abs(ic)

    def alike(self, trees: list[Node]) -> set[frozenset[Node]]:
        """The pairs of expressions that are too much like each other, over all rows; all pairs in one job."""
        names = {f"x{k}": t for k, t in enumerate(trees)}
        found = pooled_matrix(self.compiled(names).select(*names), list(names), self.parameters.min_rows)
        return {frozenset((names[a], names[b])) for (a, b), c in found.items() if abs(c) >= self.parameters.redundancy}

    def redundant(self, x: Node, pool: list[Found]) -> bool:
        """Whether an expression is one of the pool or too much like one."""
        others = [f.expression for f in pool]
        return x in others or bool(others) and any(x in pair for pair in self.alike([x, *others]))

    def run(self) -> list[Found]:
        """The pool of expressions over the threshold that aren't alike, the strongest first."""
        p, g = self.parameters, self.grower
        people, pool, tried, stale = g.started(p.population), [], set(), 0
        for _ in range(p.generations):
            self.judge(people)
            ranked = sorted(dict.fromkeys(people), key=lambda t: (-self.fitness(t), to_text(t)))
            before = len(pool)
            new = [t for t in ranked[: p.checked] if t not in tried and self.fitness(t) >= p.threshold]
            alike = self.alike([*new, *(f.expression for f in pool)]) if new and len(new) + len(pool) > 1 else set()
            tried.update(new)
            for t in new:
                if not any(frozenset((t, f.expression)) in alike for f in pool):
                    pool.append(Found(t, *self.judged[t]))
            stale = 0 if len(pool) > before else stale + 1
            if stale >= p.stale:
                break
            pick = lambda: max(g.rng.choices(people, k=p.tournament), key=self.fitness)
            children = ranked[: max(2, p.population // 20)]
            while len(children) < p.population:
                children.append(g.crossed(pick(), pick()) if g.rng.random() < p.crossover else g.mutated(pick()))
            people = children
        return sorted(pool, key=lambda f: (-abs(f.ic), f.text))


def _walk(x: Node) -> list[Node]:
    return [x, *[y for a in x.args for y in _walk(a)]]


def mine_factors(panel: DataFrame, forward: str = "fwd_return", parameters: Parameters | None = None) -> list[Found]:
    """The pool that a search over ``panel`` finds."""
    miner = Miner(panel, forward, parameters or Parameters())
    try:
        return miner.run()
    finally:
        miner.close()


def pool_table(panel: DataFrame, pool: list[Found]) -> DataFrame:
    """(expression, ic, icir, depth, size), a row for each expression of a pool; empty for an empty one."""
    rows = [(f.text, float(f.ic), float(f.icir), f.expression.depth(), f.expression.size()) for f in pool]
    return panel.sparkSession.createDataFrame(rows, "expression string, ic double, icir double, depth int, size int")
