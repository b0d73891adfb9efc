"""Rolling operators that need a window's values in their order, for a series at a time in one pass.

A window function of Spark would make a list of the window anew for every row.
Here rows come sorted by asset and date, as Spark's windows leave them, and go
through Python in Arrow batches: all operators of a stage are computed from
numpy views of the batch, with only the rows of the last window, or the running
sums, carried from one batch to the next. So a long series is never held whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.functions.columns import TIE_DIGITS, Frame

#: Numbers in a view of windows that are looked at together.
TOGETHER = 2_000_000


def _rank(windows: np.ndarray, n: int) -> np.ndarray:
    """Average rank of the newest value, over n."""
    newest = windows[:, -1:]
    return ((windows < newest).sum(axis=1) + ((windows == newest).sum(axis=1) + 1) / 2) / n


def _quantile(windows: np.ndarray, n: int, q: float) -> np.ndarray:
    """The value at the place nearest to the quantile."""
    k = int((n - 1) * q + 0.5)
    return np.partition(windows, k, axis=1)[:, k]


def _weighted(windows: np.ndarray, n: int) -> np.ndarray:
    """Mean with weights 1 to n, the newest n."""
    return windows @ np.arange(1.0, n + 1) / (n * (n + 1) / 2)


def _from_first(windows: np.ndarray) -> np.ndarray:
    """Deviations from the window's mean, which are exactly 0 over a constant."""
    d = windows - windows[:, :1]
    return d - d.mean(axis=1, keepdims=True)


def _variance(windows: np.ndarray, n: int) -> np.ndarray:
    """Sample variance."""
    d = _from_first(windows)
    return np.einsum("ij,ij->i", d, d) / (n - 1) if n > 1 else np.full(len(windows), np.nan)


def _zscore(windows: np.ndarray, n: int) -> np.ndarray:
    """How many deviations the newest value is above the mean."""
    return _from_first(windows)[:, -1] / (np.sqrt(_variance(windows, n)) + 1e-12)


def _covariance(windows: np.ndarray, others: np.ndarray, n: int) -> np.ndarray:
    """Sample covariance, rounded so that equal ones tie."""
    return np.round(np.einsum("ij,ij->i", _from_first(windows), _from_first(others)) / (n - 1), TIE_DIGITS)


def _correlation(windows: np.ndarray, others: np.ndarray, n: int) -> np.ndarray:
    """Pearson's correlation, rounded so that equal ones tie; NaN over a constant."""
    a, b = _from_first(windows), _from_first(others)
    below = np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.round(np.where(below > 0, np.einsum("ij,ij->i", a, b) / below, np.nan), TIE_DIGITS)


#: Operators over whole windows, oldest value first: (windows, numbers); those of two columns take the windows of both.
WINDOWED: dict[str, Callable[..., np.ndarray]] = {
    "ts_rank": _rank,
    "ts_argmax": lambda windows, n: windows.argmax(axis=1).astype(float),
    "ts_argmin": lambda windows, n: windows.argmin(axis=1).astype(float),
    "ts_quantile": _quantile,
    "ts_decay_linear": _weighted,
    "ts_mean": lambda windows, n: windows.mean(axis=1),
    "ts_sum": lambda windows, n: windows.sum(axis=1),
    "ts_std": lambda windows, n: np.sqrt(_variance(windows, n)),
    "ts_var": _variance,
    "ts_min": lambda windows, n: windows.min(axis=1),
    "ts_max": lambda windows, n: windows.max(axis=1),
    "ts_zscore": _zscore,
    "ts_cov": _covariance,
    "ts_corr": _correlation,
}
#: Of those, the ones that Spark's windows compute too, anew for every row: they go through the pass only from so many rows on.
LONG = 20
EITHER = ("ts_mean", "ts_sum", "ts_std", "ts_var", "ts_min", "ts_max", "ts_zscore", "ts_cov", "ts_corr")
#: Operators that go on from row to row.
RUNNING = ("loose_decay",)
ROLLED = (*WINDOWED, *RUNNING)


def in_order(op: str, numbers: Sequence[float]) -> bool:
    """Whether an operator goes through the pass; those of ``EITHER`` only with a long window that must be whole."""
    return op in ROLLED and (op not in EITHER or len(numbers) == 1 and numbers[0] >= LONG)


def windowed(values: np.ndarray, place: np.ndarray, op: str, n: int, *numbers: float, others: np.ndarray | None = None) -> np.ndarray:
    """An operator over the last n values at each row; NaN where they aren't all there. place: how many rows of its series a row is from the start, from 1."""
    out = np.full(len(values), np.nan)
    if len(values) < n:
        return out
    gone = np.cumsum(np.isnan(values) if others is None else np.isnan(values) | np.isnan(others))
    whole = place[n - 1 :] >= n
    whole &= gone[n - 1 :] - np.append(0, gone[: len(gone) - n]) == 0
    rows = np.flatnonzero(whole)
    views = np.lib.stride_tricks.sliding_window_view(values, n)
    beside = [] if others is None else [np.lib.stride_tricks.sliding_window_view(others, n)]
    step = max(1, TOGETHER // n)
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        out[some + n - 1] = WINDOWED[op](views[some], *[v[some] for v in beside], n, *numbers)
    return out


@dataclass
class Fading:
    """Exponentially weighted mean whose weights halve every n // 2 rows, from n // 2 values on; what it has summed up so far.

    Rows without a value age the others. Sums are scaled so that a block of
    rows is one running sum; with each block the scale starts anew.
    """

    n: int
    total: float = 0.0
    weight: float = 0.0
    count: int = 0

    def go_on(self, values: np.ndarray) -> np.ndarray:
        """The mean at each of the next rows."""
        half = max(1, self.n // 2)
        out = np.full(len(values), np.nan)
        for at in range(0, len(values), 32 * half):
            x = values[at : at + 32 * half]
            there = ~np.isnan(x)
            up = 2.0 ** (np.arange(1, len(x) + 1) / half)
            total = self.total + np.cumsum(np.where(there, x, 0.0) * up)
            weight = self.weight + np.cumsum(there * up)
            count = self.count + np.cumsum(there)
            enough = (count >= half) & (weight > 0)
            out[at : at + len(x)][enough] = total[enough] / weight[enough]
            self.total, self.weight, self.count = total[-1] / up[-1], weight[-1] / up[-1], int(count[-1])
        return out


@dataclass(frozen=True)
class Roll:
    """An operator over a column, with its numbers, what the result is called, and the second column of those that take two."""

    op: str
    column: str
    numbers: tuple[float, ...]
    name: str
    other: str | None = None

    @property
    def columns(self) -> list[str]:
        return [self.column] if self.other is None else [self.column, self.other]


class Series:
    """What is carried from batch to batch: the last rows of each column, and running sums."""

    def __init__(self, rolls: Sequence[Roll]):
        self.rolls = rolls
        self.reach = max((int(r.numbers[0]) for r in rolls if r.op in WINDOWED), default=1) - 1
        self.tails: dict[str, np.ndarray] = {c: np.zeros(0) for r in rolls for c in r.columns}
        self.places = np.zeros(0, dtype=np.int64)
        self.fading: dict[str, Fading] = {}

    def go_on(self, columns: dict[str, np.ndarray], place: np.ndarray) -> list[np.ndarray]:
        """The operators at the rows of a batch."""
        last = self.places[-1] if len(self.places) else 0
        before = np.append(last, place[:-1])
        if not ((place == 1) | (place == before + 1)).all():
            raise RuntimeError("rows are not in the order of their series")
        places = np.concatenate([self.places, place])
        starts = np.flatnonzero(place == 1)
        out = []
        for r in self.rolls:
            values = columns[r.column]
            if r.op in WINDOWED:
                every, *others = [np.concatenate([self.tails[c], columns[c]]) for c in r.columns]
                n = int(r.numbers[0])
                skip = max(0, len(every) - len(values) - (n - 1))  # what is carried may be more than this window takes
                beside = others[0][skip:] if others else None
                found = windowed(every[skip:], places[skip:], r.op, n, *r.numbers[1:], others=beside)
                out.append(found[len(found) - len(values) :])
                continue
            parts, at = [], 0
            for end in [*starts.tolist(), len(values)]:
                if end > at:
                    parts.append(self.fading.setdefault(r.name, Fading(int(r.numbers[0]))).go_on(values[at:end]))
                if end < len(values):
                    self.fading[r.name] = Fading(int(r.numbers[0]))
                at = end
            out.append(np.concatenate(parts) if parts else np.zeros(0))
        keep = max(1, self.reach)
        for c in self.tails:
            self.tails[c] = np.concatenate([self.tails[c], columns[c]])[-keep:]
        self.places = places[-keep:]
        return out


def rolled(df: DataFrame, rolls: Sequence[Roll], frame: Frame) -> DataFrame:
    """``df`` with a column for each of the rolls, of columns of doubles; undefined is NULL."""
    (place,) = [p for p in ("_place", "_place_") if p not in df.columns][:1]
    # the window sorts by asset and date, and its rows go to Python as they are; each task checks their places
    placed = df.select("*", F.row_number().over(frame.series).alias(place))
    names = df.columns
    taken = sorted({c for r in rolls for c in r.columns})
    schema = df.select("*", *[F.lit(None).cast("double").alias(r.name) for r in rolls]).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        series = Series(rolls)
        for batch in batches:
            if not len(batch):
                continue
            at = {c: k for k, c in enumerate(batch.schema.names)}
            columns = {c: batch.column(at[c]).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in taken}
            found = series.go_on(columns, batch.column(at[place]).to_numpy().astype(np.int64))
            own = [batch.column(at[c]) for c in names]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(x, pa.float64(), from_pandas=True) for x in found]], schema=None, names=[*names, *[r.name for r in rolls]])

    return placed.mapInArrow(run, schema)


def average_ranks(x: np.ndarray) -> np.ndarray:
    """Ranks from 1, ties at their average; NaN is the largest value, as in Spark."""
    if not len(x):
        return np.zeros(0)
    order = np.argsort(x)
    s = x[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (s[1:] != s[:-1]) & ~(np.isnan(s[1:]) & np.isnan(s[:-1]))
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(x))
    out = np.empty(len(x))
    out[order] = ((starts + ends + 1) / 2)[np.cumsum(new) - 1]
    return out


def ranked(df: DataFrame, ranks: Sequence[tuple[str, str, bool]], date: str) -> DataFrame:
    """``df`` with average ranks of its date: (column, name, whether over how many values there are).

    A window would sort whole rows anew for each column; here a date's rows are
    a group, and of each column only its numbers are sorted.
    """
    schema = df.select("*", *[F.lit(None).cast("double").alias(name) for _, name, _ in ranks]).schema

    def run(day: pa.Table) -> pa.Table:
        for source, name, share in ranks:
            there = day[source].is_valid().to_numpy(zero_copy_only=False)
            found = average_ranks(day[source].cast(pa.float64()).to_numpy()[there])
            out = np.full(len(there), np.nan)
            out[there] = found / len(found) if share and len(found) else found
            day = day.append_column(name, pa.array(out, pa.float64(), from_pandas=True))
        return day

    return df.groupBy(date).applyInArrow(run, schema)
