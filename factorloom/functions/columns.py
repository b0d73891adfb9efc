"""Column builders for every operator, over a by-asset or a by-date window.

Undefined is NULL: a statistic over too few values, over a constant, or over
something undefined. Nothing divides by zero. A builder only takes plain columns
(names), as arguments are mentioned several times.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


#: Rolling correlations and covariances are rounded to so many places, so that equal ones tie when they are ranked.
TIE_DIGITS = 10
#: So are logs, so that equal ratios have equal differences of logs.
LOG_DIGITS = 12


class Frame:
    """The windows of a panel: rows of one asset in date order, rows of one date."""

    def __init__(self, asset: str = "asset", date: str = "date"):
        self.asset, self.date = asset, date
        self.series = Window.partitionBy(asset).orderBy(date)
        self.day = Window.partitionBy(date)

    def last(self, n: int) -> WindowSpec:
        """The last n rows of the asset, this one included."""
        return self.series.rowsBetween(-(n - 1), 0)


def nan_to_null(x: Column) -> Column:
    """NaN and infinities as NULL."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def clip(x: Column, low: Column, high: Column) -> Column:
    """x within bounds; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def average_rank(x: Column, day: WindowSpec) -> Column:
    """Rank of x among the values of its partition, from 1, ties at their average; NULL for NULL."""
    order = day.orderBy(x.asc_nulls_last())
    peers = F.count(F.lit(1)).over(order.rangeBetween(0, 0))
    return F.when(x.isNotNull(), F.rank().over(order) + (peers - 1) / 2)


def safe_correlation(x: Column, y: Column, window: WindowSpec | None = None) -> Column:
    """Pearson's correlation over pairs without a NULL; NULL over a constant. As an aggregate if there's no window."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    parts = [F.covar_samp(a, b), F.stddev_samp(a), F.stddev_samp(b)]
    c, s, t = [p.over(window) for p in parts] if window is not None else parts
    return F.try_divide(c, s * t)


def _gated(agg: Callable[[Column], Column]) -> Callable[..., Column]:
    """A rolling aggregate that needs ``least`` values (all of the window's unless told)."""

    def build(f: Frame, x: Column, n: int, least: int | None = None) -> Column:
        w = f.last(n)
        return F.when(F.count(x).over(w) >= (n if least is None else least), agg(x).over(w))

    return build


def _values(f: Frame, x: Column, n: int) -> Column:
    """The window's values as an array, oldest first; NULL unless there are n."""
    v = F.collect_list(x).over(f.last(n))
    return F.when(F.size(v) == n, v)


def ts_rank(f: Frame, x: Column, n: int) -> Column:
    """Average rank of the newest value among the last n, over n."""
    v = _values(f, x, n)
    below = F.size(F.filter(v, lambda e: e < x))
    equal = F.size(F.filter(v, lambda e: e == x))
    return F.when(v.isNotNull() & x.isNotNull(), (below + (equal + 1) / 2) / n)


def ts_argmax(f: Frame, x: Column, n: int) -> Column:
    """How many rows after the oldest one the first largest value stands."""
    v = _values(f, x, n)
    return (F.array_position(v, F.array_max(v)) - 1).cast("double")


def ts_argmin(f: Frame, x: Column, n: int) -> Column:
    """How many rows after the oldest one the first smallest value stands."""
    v = _values(f, x, n)
    return (F.array_position(v, F.array_min(v)) - 1).cast("double")


def ts_quantile(f: Frame, x: Column, n: int, q: float) -> Column:
    """The value at the place nearest to the quantile."""
    return F.get(F.sort_array(_values(f, x, n)), F.lit(int((n - 1) * q + 0.5)))


def ts_correlation(f: Frame, x: Column, y: Column, n: int) -> Column:
    """Correlation of the last n pairs, all of which must be whole."""
    w = f.last(n)
    both = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(w)
    return F.when(both >= n, F.round(safe_correlation(x, y, w), TIE_DIGITS))


def ts_covariance(f: Frame, x: Column, y: Column, n: int) -> Column:
    """Sample covariance of the last n pairs."""
    w = f.last(n)
    both = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(w)
    return F.when(both >= n, F.round(F.covar_samp(x, y).over(w), TIE_DIGITS))


def ts_decay(f: Frame, x: Column, n: int) -> Column:
    """Mean of the last n values with weights 1 to n, the newest n."""
    v = _values(f, x, n)
    weighted = F.zip_with(v, F.sequence(F.lit(1), F.lit(n)), lambda a, k: a * k)
    return F.aggregate(weighted, F.lit(0.0), lambda s, e: s + e) / (n * (n + 1) / 2)


def ts_product(f: Frame, x: Column, n: int) -> Column:
    """Product of the last n values, which must be positive."""
    w = f.last(n)
    logs = F.when(x > 0, F.log(x))
    return F.when(F.count(logs).over(w) >= n, F.exp(F.sum(logs).over(w)))


def ts_zscore(f: Frame, x: Column, n: int) -> Column:
    """How many standard deviations the newest value is above the mean of the last n."""
    w = f.last(n)
    z = (x - F.avg(x).over(w)) / (F.stddev_samp(x).over(w) + 1e-12)
    return F.when(F.count(x).over(w) >= n, z)


def ts_delay(f: Frame, x: Column, n: int) -> Column:
    """The value n rows before, or after for a negative n."""
    return F.lag(x, n).over(f.series)


def ts_delta(f: Frame, x: Column, n: int) -> Column:
    """The change from n rows before."""
    return x - F.lag(x, n).over(f.series)


def loose_range(f: Frame, x: Column, n: int) -> Column:
    """Where the newest value stands between the least and the largest of the window, a half if that is open."""
    w = f.last(n)
    enough = F.count(x).over(w) >= max(1, n // 2)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return F.coalesce(F.when(enough & (high - low > 1e-10), (x - low) / (high - low)), F.lit(0.5))


def loose_correlation(f: Frame, x: Column, y: Column, n: int) -> Column:
    """(E[xy] - E[x]E[y]) over the sample deviations, within -1 and 1; 0 if it's undefined."""
    w, least = f.last(n), max(2, n // 2)
    xy = x * y
    mean = lambda c: F.when(F.count(c).over(w) >= least, F.avg(c).over(w))
    deviation = lambda c: F.when(F.count(c).over(w) >= least, F.stddev_samp(c).over(w))
    below = deviation(x) * deviation(y)
    value = F.when(below > 1e-10, (mean(xy) - mean(x) * mean(y)) / below)
    return F.coalesce(clip(value, F.lit(-1.0), F.lit(1.0)), F.lit(0.0))


def loose_decay(f: Frame, x: Column, n: int) -> Column:
    """Exponentially weighted mean, whose weights halve every n // 2 rows; needs n // 2 values.

    Rows without a value still age the others. Weights under 2^-54 of the
    newest don't count, so the window is finite.
    """
    half, least = max(1, n // 2), max(1, n // 2)
    w = f.last(54 * half)
    pairs = F.collect_list(F.struct(x.alias("x"))).over(w)
    aged = F.transform(
        pairs, lambda e, k: F.when(e["x"].isNotNull(), F.struct(F.pow(F.lit(2.0), (k + 1 - F.size(pairs)) / half).alias("g"), e["x"].alias("x")))
    )
    total = F.aggregate(
        aged,
        F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("g")),
        lambda s, e: F.when(e.isNull(), s).otherwise(F.struct((s["s"] + e["g"] * e["x"]).alias("s"), (s["g"] + e["g"]).alias("g"))),
        lambda s: F.try_divide(s["s"], s["g"]),
    )
    return F.when(F.count(x).over(f.series.rowsBetween(Window.unboundedPreceding, 0)) >= least, total)


def cs_rank(f: Frame, x: Column) -> Column:
    """Average rank of the date over how many values it has."""
    return ratio(average_rank(x, f.day), F.count(x).over(f.day))


def cs_rank_raw(f: Frame, x: Column) -> Column:
    """Average rank of the date, from 1."""
    return average_rank(x, f.day)


def cs_zscore(f: Frame, x: Column) -> Column:
    """Deviations from the date's mean in standard deviations, which get 1e-10 added."""
    return (x - F.avg(x).over(f.day)) / (F.stddev_samp(x).over(f.day) + 1e-10)


def cs_standard(f: Frame, x: Column) -> Column:
    """Deviations from the date's mean in standard deviations; NULL on a constant date."""
    return ratio(x - F.avg(x).over(f.day), F.stddev_samp(x).over(f.day))


def cs_scale(f: Frame, x: Column, a: float = 1.0) -> Column:
    """x times a over the date's sum of absolute values."""
    return ratio(F.lit(a) * x, F.sum(F.abs(x)).over(f.day))


def cs_winsorize(f: Frame, x: Column, low: float = 0.01, high: float = 0.99) -> Column:
    """x within the date's quantiles (linear)."""
    bounds = F.percentile(x, F.array(F.lit(low), F.lit(high))).over(f.day)
    return clip(x, F.get(bounds, F.lit(0)), F.get(bounds, F.lit(1)))


def cs_neutralize(f: Frame, x: Column, group: Column, least: int = 10) -> Column:
    """x without the mean of its group on the date, on dates with at least ``least`` values."""
    own = F.avg(x).over(Window.partitionBy(f.date, group))
    return F.when(F.count(x).over(f.day) < least, x).otherwise(x - own)


def cs_mean(f: Frame, x: Column) -> Column:
    """The date's mean."""
    return F.avg(x).over(f.day)


#: Operators over the rows of one asset: (frame, arguments, numbers).
BY_ASSET: dict[str, Callable[..., Column]] = {
    "ts_delay": ts_delay,
    "ts_delta": ts_delta,
    "ts_mean": _gated(F.avg),
    "ts_sum": _gated(F.sum),
    "ts_std": _gated(F.stddev_samp),
    "ts_var": _gated(F.var_samp),
    "ts_min": _gated(F.min),
    "ts_max": _gated(F.max),
    "ts_rank": ts_rank,
    "ts_argmax": ts_argmax,
    "ts_argmin": ts_argmin,
    "ts_quantile": ts_quantile,
    "ts_corr": ts_correlation,
    "ts_cov": ts_covariance,
    "ts_decay_linear": ts_decay,
    "ts_product": ts_product,
    "ts_zscore": ts_zscore,
    "loose_range": loose_range,
    "loose_corr": loose_correlation,
    "loose_decay": loose_decay,
}
#: Operators over the rows of one date.
BY_DATE: dict[str, Callable[..., Column]] = {
    "cs_rank": cs_rank,
    "cs_rank_raw": cs_rank_raw,
    "cs_zscore": cs_zscore,
    "cs_standard": cs_standard,
    "cs_scale": cs_scale,
    "cs_winsorize": cs_winsorize,
    "cs_neutralize": cs_neutralize,
    "cs_mean": cs_mean,
}


def signed_log(x: Column) -> Column:
    """ln(1 + |x|) with x's sign."""
    return F.log1p(F.abs(x)) * F.signum(x)


def signed_root(x: Column) -> Column:
    """The root of |x| with x's sign."""
    return F.sqrt(F.abs(x)) * F.signum(x)


def signed_power(x: Column, p: float) -> Column:
    """|x| to the power p with x's sign."""
    return F.signum(x) * F.pow(F.abs(x), F.lit(float(p)))


#: Operators over the values of one row: (arguments, numbers).
BY_ROW: dict[str, Callable[..., Column]] = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": ratio,
    "safe_div": lambda a, b: F.when(F.abs(b) > 1e-10, a / b).otherwise(0.0),
    "neg": lambda a: -a,
    "abs": lambda a: F.abs(a),
    "sign": lambda a: F.signum(a),
    "log": lambda a: F.when(a > 0, F.round(F.log(a), LOG_DIGITS)),
    "sqrt": lambda a: F.when(a >= 0, F.sqrt(a)),
    "log1p": signed_log,
    "sqrt_abs": signed_root,
    "power": signed_power,
    "lower": lambda a, b: F.least(a, b),
    "upper": lambda a, b: F.greatest(a, b),
    "less": lambda a, b: a < b,
    "greater": lambda a, b: a > b,
    "where": lambda c, a, b: F.when(c, a).otherwise(b),
    "flag": lambda c: F.when(c.isNull(), None).when(c, 1.0).otherwise(0.0),
    "known": lambda a, b: F.coalesce(a, b),
}
