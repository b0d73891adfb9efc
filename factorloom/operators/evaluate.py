"""Factor evaluation: rank information coefficients, their summaries, filters, redundancy and quantile reports."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.columns import TIE_DIGITS, average_rank, ratio, safe_correlation
from factorloom.functions.rolled import average_ranks
from factorloom.sources.stored import shared_folder


def finite(x: Column) -> Column:
    """Whether a number is there and neither NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def long_factors(panel: DataFrame, factors: list[str], forward: str = "fwd_return") -> DataFrame:
    """(date, asset, factor, value, forward), a row for each factor."""
    pairs = F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f"`{f}`").cast("double").alias("value")) for f in factors])
    rows = panel.select("date", "asset", F.col(forward).alias("forward"), F.explode(pairs).alias("p"))
    return rows.select("date", "asset", "p.factor", "p.value", "forward")


def rank_ic(
    panel: DataFrame,
    factors: list[str],
    forward: str = "fwd_return",
    pairwise: bool = False,
    min_obs: int = 1,
    finite_only: bool = False,
    keep_empty: bool = False,
    spread: bool = False,
) -> DataFrame:
    """(date, factor, n, ic): of each date the correlation of a factor's ranks with the forward return's.

    Rows without a forward return don't count. By default a factor is ranked
    among its own values and the return among all returns of the date; with
    ``pairwise`` both are ranked among the rows that have both. Dates with fewer
    than ``min_obs`` pairs are left out, or have a NULL if ``keep_empty``.
    All factors go through one shuffle by date and run of ``AT_ONCE`` factors,
    a row of an asset for each run and not for each factor; a task holds a date's
    values of one run. With ``spread``, for dates of so many names that none
    could, a row for each factor is ranked by ``spread_rank``.
    """
    if spread:
        rows = long_factors(panel, factors, forward).filter(F.col("forward").isNotNull())
        if finite_only:
            rows = rows.filter(finite(F.col("forward")) & (F.col("value").isNull() | finite(F.col("value"))))
        if pairwise:
            rows = rows.filter(F.col("value").isNotNull())
        both = ["date", "factor"]
        known = spread_rank(rows.filter(F.col("value").isNotNull()), both, "value", "x").select(*both, "asset", "x")
        ranked = spread_rank(rows, both, "forward", "y").join(known, [*both, "asset"], "left").select(*both, "x", "y")
        found = ranked.groupBy(*both).agg(F.count("x").alias("n"), safe_correlation(F.col("x"), F.col("y")).alias("ic"))
    else:
        found = _day_ics(panel, factors, forward, pairwise, finite_only)
    found = found.withColumn("ic", F.round("ic", TIE_DIGITS))
    if keep_empty:
        return found.withColumn("ic", F.when(F.col("n") >= min_obs, F.col("ic")))
    return found.filter(F.col("n") >= min_obs)


#: Factors of which a task holds a date's values together.
AT_ONCE = 16


def _correlation(x: np.ndarray, y: np.ndarray) -> float | None:
    """Pearson's correlation; None over a constant or a single pair."""
    if len(x) < 2:
        return None
    a, b = x - x.mean(), y - y.mean()
    below = math.sqrt(a @ a) * math.sqrt(b @ b)
    return float(a @ b) / below if below > 0 else None


def _day_ics(panel: DataFrame, factors: list[str], forward: str, pairwise: bool, finite_only: bool) -> DataFrame:
    """(date, factor, n, ic) of ``rank_ic``, unrounded, of every date and factor that has rows."""
    runs = [factors[i : i + AT_ONCE] for i in range(0, len(factors), AT_ONCE)]
    columns = [f"v{k}" for k in range(min(AT_ONCE, len(factors)))]
    own = lambda run, k: F.col(f"`{run[k]}`").cast("double") if k < len(run) else F.lit(None).cast("double")
    blocks = [F.struct(F.lit(i).alias("run"), *[own(run, k).alias(c) for k, c in enumerate(columns)]) for i, run in enumerate(runs)]
    rows = panel.select("date", F.col(f"`{forward}`").cast("double").alias("forward"), F.explode(F.array(*blocks)).alias("b"))
    rows = rows.filter(F.col("forward").isNotNull()).select("date", "forward", "b.*")
    if finite_only:
        rows = rows.filter(finite(F.col("forward")))
    kind = pa.schema([("run", pa.int32()), ("k", pa.int32()), ("n", pa.int64()), ("ic", pa.float64())])

    def day_ics(key: tuple, day: pa.Table) -> pa.Table:
        y, run = day["forward"].to_numpy(), key[1].as_py()
        ranks: dict[bytes, np.ndarray] = {}  # of the forward return among the rows that a factor takes
        made = []
        for k in range(len(runs[run])):
            there = day[f"v{k}"].is_valid().to_numpy(zero_copy_only=False)
            value = day[f"v{k}"].to_numpy()
            taken = (~there | np.isfinite(value)) if finite_only else np.ones(len(y), dtype=bool)
            if pairwise:
                taken = taken & there
            if not taken.any():
                continue
            same = np.packbits(taken).tobytes()
            if same not in ranks:
                ranks[same] = average_ranks(y[taken])
            both = there[taken]
            made.append((run, k, int(both.sum()), _correlation(average_ranks(value[taken][both]), ranks[same][both])))
        found = pa.Table.from_pylist([dict(zip(kind.names, r, strict=True)) for r in made], schema=kind)
        return found.add_column(0, "date", pa.array([key[0].as_py()] * len(found), type=day.schema.field("date").type))

    names = F.array(*[F.array(*[F.lit(f) for f in run]) for run in runs])
    date = panel.select("date").schema["date"].dataType.simpleString()
    found = rows.groupBy("date", "run").applyInArrow(day_ics, f"date {date}, run int, k int, n long, ic double")
    return found.select("date", F.get(F.get(names, F.col("run")), F.col("k")).alias("factor"), "n", "ic")


def ic_summary(ics: DataFrame, population: bool = False) -> DataFrame:
    """(factor, n_dates, ic_mean, ic_std, icir, abs_ic, positive, strong, t_stat) of (factor, ic); undefined ICs don't count."""
    deviation = F.stddev_pop("ic") if population else F.stddev_samp("ic")
    known = ics.filter(finite(F.col("ic"))).groupBy("factor")
    found = known.agg(
        F.count("ic").alias("n_dates"),
        F.avg("ic").alias("ic_mean"),
        deviation.alias("ic_std"),
        F.avg(F.abs("ic")).alias("abs_ic"),
        F.avg((F.col("ic") > 0).cast("double")).alias("positive"),
        F.avg((F.abs("ic") > 0.02).cast("double")).alias("strong"),
    )
    return found.withColumns(
        {
            "icir": F.col("ic_mean") / (F.col("ic_std") + 1e-12),
            "t_stat": ratio(F.col("ic_mean"), F.col("ic_std") / F.sqrt("n_dates")),
        }
    )


def mean_ic(panel: DataFrame, factors: list[str], forward: str = "fwd_return", min_obs: int = 2) -> dict[str, float]:
    """The mean daily rank IC of each factor, pairwise; factors without any are missing. One row a factor comes to the driver."""
    ics = rank_ic(panel, factors, forward, pairwise=True, min_obs=min_obs)
    rows = ics.groupBy("factor").agg(F.avg("ic").alias("m")).collect()
    return {r["factor"]: r["m"] for r in rows if r["m"] is not None}


def top_factors(panel: DataFrame, factors: list[str], forward: str = "fwd_return", min_obs: int = 30, min_dates: int = 10, k: int = 20) -> DataFrame:
    """The summaries (population deviation) of the ``k`` factors with the highest ICIR, of those with over ``min_dates`` ICs."""
    ics = rank_ic(panel, factors, forward, pairwise=True, min_obs=min_obs)
    found = ic_summary(ics, population=True).filter(F.col("n_dates") > min_dates)
    return found.orderBy(F.desc_nulls_last("icir"), "factor").limit(k)


def filter_by_ic(panel: DataFrame, factors: list[str], forward: str = "fwd_return", threshold: float = 0.02) -> list[str]:
    """The factors whose mean absolute IC is at least ``threshold``, in the given order."""
    rows = ic_summary(rank_ic(panel, factors, forward)).select("factor", "abs_ic").collect()
    strong = {r["factor"] for r in rows if r["abs_ic"] is not None and r["abs_ic"] >= threshold}
    return [f for f in factors if f in strong]


def gate_by_first_dates(panel: DataFrame, factors: list[str], forward: str = "fwd_return", dates: int = 100, min_obs: int = 20, min_dates: int = 10, threshold: float = 0.01) -> DataFrame:
    """(factor, n_dates, ic_mean) of the factors whose mean IC over the panel's first ``dates`` dates is large enough in size."""
    early = panel.select("date").distinct().orderBy("date").limit(dates)  # one row a date
    return gate_by_ic(panel.join(F.broadcast(early), "date", "left_semi"), factors, forward, min_obs, min_dates, threshold)


def gate_by_ic(panel: DataFrame, factors: list[str], forward: str = "fwd_return", min_obs: int = 20, min_dates: int = 10, threshold: float = 0.01) -> DataFrame:
    """(factor, n_dates, ic_mean) of the factors whose mean IC over all dates with ``min_obs`` names is large enough in size."""
    ics = rank_ic(panel, factors, forward, pairwise=True, min_obs=min_obs).filter(finite(F.col("ic")))
    found = ics.groupBy("factor").agg(F.count("ic").alias("n_dates"), F.avg("ic").alias("ic_mean"))
    return found.filter((F.col("n_dates") >= min_dates) & (F.abs("ic_mean") >= threshold))


def coverage(panel: DataFrame, factors: list[str]) -> DataFrame:
    """(factor, coverage): the share of rows with a value."""
    shares = [ratio(F.count(F.col(f"`{f}`")), F.count(F.lit(1))).alias(f) for f in factors]
    return panel.agg(*shares).unpivot([], factors, "factor", "coverage")


def redundancy(panel: DataFrame, factors: list[str], min_names: int = 10, min_pairs: int = 5) -> DataFrame:
    """(a, b, n_dates, correlation): the mean over dates of the correlation of two factors' ranks.

    A factor is ranked on a date with at least ``min_names`` rows and
    ``min_pairs`` values of its own; a pair counts on a date with at least
    ``min_pairs`` rows that have both. A date's cross-section is one group, in
    which products of its rank matrix give all pairs at once, so hundreds of
    factors are no larger a plan than two; pairs are summed over dates by Spark.
    """
    kind = "a int, b int, c double"
    names = F.array(*[F.lit(f) for f in factors])
    columns = [f"x{k}" for k in range(len(factors))]

    def pairs(day: pd.DataFrame) -> pd.DataFrame:
        whole = day[columns].notna().to_numpy()
        ranked = (whole.sum(axis=0) >= min_pairs) & (len(day) >= min_names)
        there = (whole & ranked).astype(float)
        ranks = np.where(there > 0, day[columns].rank().to_numpy() - (len(day) + 1) / 2, 0.0)
        n, sums, squares = there.T @ there, ranks.T @ there, (ranks * ranks).T @ there
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = squares - sums * sums / n
            c = (ranks.T @ ranks - sums * sums.T / n) / np.sqrt(spread * spread.T)
        known = np.triu((n >= min_pairs) & (spread > 1e-9) & (spread.T > 1e-9), 1)
        a, b = np.nonzero(known)
        return pd.DataFrame({"a": a.astype(np.int32), "b": b.astype(np.int32), "c": c[a, b]})

    rows = panel.select("date", *[F.col(f"`{f}`").cast("double").alias(c) for f, c in zip(factors, columns, strict=True)])
    found = rows.groupBy("date").applyInPandas(pairs, kind).groupBy("a", "b").agg(F.count("c").alias("n_dates"), F.avg("c").alias("correlation"))
    # pairs that never count are in the result too
    every = [(i, j) for i in range(len(factors)) for j in range(i + 1, len(factors))]
    grid = panel.sparkSession.createDataFrame(every, "a int, b int")
    name = lambda c: F.get(names, F.col(c))
    return grid.join(found, ["a", "b"], "left").select(name("a").alias("a"), name("b").alias("b"), F.coalesce("n_dates", F.lit(0).cast("long")).alias("n_dates"), "correlation")


def remove_redundant(
    panel: DataFrame,
    factors: list[str],
    forward: str = "fwd_return",
    threshold: float = 0.7,
    by_ic: bool = True,
) -> list[str]:
    """The factors that stay, in the given order: from the strongest (or the first) on, those not too much like one that stays.

    Two factors are alike if their mean rank correlation is ``threshold`` or
    more in size. A table of a row for each pair of factors comes to the driver.
    """
    rows = redundancy(panel, factors).collect()
    alike: dict[tuple[str, str], float] = {}
    for r in rows:
        alike[r["a"], r["b"]] = alike[r["b"], r["a"]] = abs(r["correlation"] or 0.0)
    order = list(factors)
    if by_ic:
        strength = {r["factor"]: r["abs_ic"] or 0.0 for r in ic_summary(rank_ic(panel, factors, forward)).collect()}
        order.sort(key=lambda f: -strength.get(f, 0.0))
    kept: list[str] = []
    for f in order:
        if all(alike.get((f, k), 0.0) < threshold for k in kept):
            kept.append(f)
    return [f for f in factors if f in kept]


def pooled_correlations(panel: DataFrame, pairs: list[tuple[str, str]], min_rows: int = 100) -> DataFrame:
    """(a, b, n, correlation) over all rows that have both, NULL under ``min_rows``; every pair in one aggregation."""
    values = []
    for a, b in pairs:
        x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
        n = F.count(F.when(finite(x) & finite(y), 1))
        c = safe_correlation(F.when(finite(x) & finite(y), x), F.when(finite(x) & finite(y), y))
        values.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), n.alias("n"), F.when(n >= min_rows, c).alias("correlation")))
    return panel.agg(F.array(*values).alias("v")).select(F.explode("v").alias("p")).select("p.*")


def pooled_matrix(panel: DataFrame, names: list[str], min_rows: int = 100) -> dict[tuple[str, str], float]:
    """The correlation of each two columns over all rows that have both, of those with ``min_rows`` and a deviation.

    Each task sums the products of its rows, so a row for each pair is all that
    is shuffled, or comes to the driver. Columns are taken off their means first.
    """
    columns = [F.col(f"`{n}`").cast("double") for n in names]
    means = panel.agg(*[F.avg(F.when(finite(c), c)).alias(f"m{k}") for k, c in enumerate(columns)]).first()
    rows = panel.select(*[F.when(finite(c), c - F.lit(means[k] or 0.0)).alias(f"x{k}") for k, c in enumerate(columns)])
    a, b = np.triu_indices(len(names), 1)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            x = batch.to_numpy(float)
            there = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            own, squares = x.T @ there, (x * x).T @ there
            part = np.stack([(there.T @ there)[a, b], own[a, b], own.T[a, b], squares[a, b], squares.T[a, b], (x.T @ x)[a, b]])
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"k": np.arange(len(a), dtype=np.int32)} | {c: v for c, v in zip("nxyuvw", total, strict=True)})

    if not len(a):
        return {}
    made = rows.mapInPandas(sums, "k int, n double, x double, y double, u double, v double, w double")
    found = made.groupBy("k").agg(*[F.sum(c).alias(c) for c in "nxyuvw"]).filter(F.col("n") >= min_rows).collect()
    out = {}
    for r in found:
        below = (r["u"] - r["x"] ** 2 / r["n"]) * (r["v"] - r["y"] ** 2 / r["n"])
        if below > 0:
            out[names[a[r["k"]]], names[b[r["k"]]]] = (r["w"] - r["x"] * r["y"] / r["n"]) / below**0.5
    return out


def factor_report(panel: DataFrame, factors: list[str], forward: str = "fwd_return", buckets: int = 5) -> DataFrame:
    """One row a factor: its IC summary, coverage, the mean forward return of its lowest and highest bucket and their difference.

    Buckets are by rank over the date's count, pooled over all dates. Strongest first.
    """
    rows = long_factors(panel, factors, forward).filter(F.col("value").isNotNull() & F.col("forward").isNotNull())
    day = Window.partitionBy("date", "factor")
    place = F.floor(average_rank(F.col("value"), day) / F.count("value").over(day) * buckets)
    ranked = rows.select("factor", "forward", F.least(place, F.lit(buckets - 1)).alias("bucket"))
    ends = ranked.groupBy("factor").agg(
        F.avg(F.when(F.col("bucket") == 0, F.col("forward"))).alias("q1_return"),
        F.avg(F.when(F.col("bucket") == buckets - 1, F.col("forward"))).alias(f"q{buckets}_return"),
    )
    ends = ends.withColumn("long_short", F.col(f"q{buckets}_return") - F.col("q1_return"))
    summary = ic_summary(rank_ic(panel, factors, forward)).select("factor", "ic_mean", "ic_std", "icir", "abs_ic", "positive")
    parts = [coverage(panel, factors), summary, ends]
    found = reduce(lambda a, b: a.join(b, "factor", "left"), parts)
    return found.orderBy(F.desc_nulls_last("abs_ic"), "factor")


def spearman(rows: DataFrame, x: str, y: str, min_rows: int = 10) -> float | None:
    """The rank correlation over all rows; None under ``min_rows`` of them."""
    found = spearman_by(rows.withColumn("_all", F.lit(0)), ["_all"], x, y, min_rows).first()
    return found["ic"] if found is not None else None


def spearman_by(rows: DataFrame, keys: list[str], x: str, y: str, min_rows: int = 10) -> DataFrame:
    """(keys, n, ic): the rank correlation of each group, NULL under ``min_rows`` rows; a group may hold any share of all rows."""
    pairs = rows.filter(finite(F.col(x)) & finite(F.col(y))).select(*keys, F.col(x).alias("_x"), F.col(y).alias("_y"))
    ranked = spread_rank(spread_rank(pairs, keys, "_x", "_rx"), keys, "_y", "_ry")
    found = ranked.groupBy(*keys).agg(F.count("*").alias("n"), safe_correlation(F.col("_rx"), F.col("_ry")).alias("ic"))
    return found.withColumn("ic", F.when(F.col("n") >= min_rows, F.col("ic")))


def spread_rank(rows: DataFrame, keys: list[str], column: str, name: str) -> DataFrame:
    """``rows`` whose keys and column are known, with the average rank of the column in its group, no matter how large groups are.

    A window over a group would take all its rows to one task. Here the counts
    of distinct values are ranged over partitions by group and value, and
    running totals go from one partition to the next as a number for each group
    that both hold.
    """
    whole = F.lit(True)
    for c in [*keys, column]:
        whole = whole & F.col(c).isNotNull()
    counts = rows.filter(whole).groupBy(*keys, column).agg(F.count("*").alias("_n"))
    shared_folder(rows.sparkSession)
    parts = counts.repartitionByRange(*[F.col(c) for c in (*keys, column)]).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = parts.groupBy(*keys, "_part").agg(F.sum("_n").alias("_size"))  # as many as groups and partitions together
    order = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_size").over(order), F.lit(0))).drop("_size")
    inside = Window.partitionBy("_part", *keys).orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(inside), F.lit(0))
    ranks = parts.withColumn("_before", before).join(starts, [*keys, "_part"])
    ranks = ranks.select(*keys, column, (F.col("_start") + F.col("_before") + (F.col("_n") + 1) / 2).alias(name))
    return rows.join(ranks, [*keys, column])


def correlation_matrix(pairs: DataFrame, factors: list[str]) -> np.ndarray:
    """The table of ``redundancy`` as a matrix, pairs that never counted as 0."""
    at = {f: k for k, f in enumerate(factors)}
    m = np.eye(len(factors))
    for r in pairs.collect():
        m[at[r["a"]], at[r["b"]]] = m[at[r["b"]], at[r["a"]]] = r["correlation"] or 0.0
    return m
