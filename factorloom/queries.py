"""Queries over the test tables, one or more for each operator, each with SQL for an independent engine where SQL can say it.

Doubles are rounded in both, to ``DIGITS`` places, so that the order of sums doesn't show.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.functions.columns import TIE_DIGITS
from factorloom.miner import search
from factorloom.models import ensemble, rolling
from factorloom.operators import alphas, backtest, combine, costs, evaluate, expand, lagged, risk, style, technical
from factorloom.plans import oracle, text
from factorloom.plans.graph import Node, call, compile_factors, field, walk
from factorloom.sources import panel as sources
from factorloom.sources import universe as universes
from factorloom.sources.stored import Tables

DIGITS = 5
Query = Callable[[SparkSession, str], DataFrame]

_PANEL = """
(SELECT *, close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY date), 0) - 1 AS returns FROM (
    SELECT asset, date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close,
           sum(n) AS volume, sum(p * n) / nullif(sum(n), 0) AS vwap
    FROM (SELECT l_suppkey AS asset,
                 CAST(CAST(l_shipdate AS DATE) + CAST((12 - isodow(l_shipdate)) % 7 AS INT) AS DATE) AS date,
                 l_extendedprice / nullif(l_quantity, 0) AS p, l_quantity AS n,
                 row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS k
          FROM lineitem)
    WHERE p IS NOT NULL GROUP BY asset, date))
"""
_FORWARD = f"(SELECT *, lead(returns) OVER (PARTITION BY asset ORDER BY date) AS fwd_return FROM {_PANEL})"
_UNIVERSE = f"""
(SELECT p.*, s_nationkey AS industry,
        close * sum(volume) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS market_cap,
        s_acctbal / nullif(close, 0) AS book_to_price,
        CASE WHEN count(returns) OVER y >= 20 THEN avg(returns) OVER y END AS roe,
        CASE WHEN count(returns) OVER h >= 20 THEN stddev_samp(returns) OVER h * sqrt(52.0) END AS volatility
 FROM {_PANEL} p JOIN supplier ON asset = s_suppkey
 WINDOW y AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW),
        h AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW))
"""
_EVENTS = """
(SELECT *, close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY date), 0) - 1 AS returns FROM (
    SELECT asset, date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close,
           CAST(count(*) AS DOUBLE) AS volume, avg(p) AS vwap
    FROM (SELECT user_id AS asset, CAST(ts AS DATE) AS date, value AS p, row(ts, event_id) AS k FROM events)
    WHERE p IS NOT NULL GROUP BY asset, date))
"""
_KEYS = ["asset", "date"]


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """``df`` with its doubles rounded; a last digit of 5 goes down, away from where noise would decide."""
    to = lambda c: F.floor(F.col(f"`{c}`") * 10.0**digits + 0.49) / 10.0**digits
    return df.select(*[to(c).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def rounded_sql(sql: str, doubles: list[str], others: list[str], digits: int = DIGITS) -> str:
    """SQL for some SQL's columns, the doubles rounded."""
    made = [f"{oracle.rounded(c, digits)} AS {c}" for c in doubles]
    return f"SELECT {', '.join([*others, *made])} FROM ({sql})"


def _factor_query(factors: Mapping[str, Node], source: str = "panel") -> tuple[Query, str]:
    """The query of some expressions over a panel, and its SQL."""
    made = {"panel": (sources.weekly_panel, _PANEL), "universe": (sources.weekly_universe, _UNIVERSE), "events": (sources.daily_event_panel, _EVENTS)}
    build, base = made[source]

    def query(spark: SparkSession, folder: str) -> DataFrame:
        used = {str(x.numbers[0]) for x in walk(list(factors.values())) if x.op == "field"} - {*_KEYS}
        return rounded(compile_factors(build(spark, folder).select(*_KEYS, *sorted(used)), factors).select(*_KEYS, *factors))

    return query, oracle.factor_sql(base, _KEYS, factors, DIGITS)


def _operator_queries() -> dict[str, tuple[Query, str | None]]:
    c, v, o, h, low, r = (field(x) for x in ("close", "volume", "open", "high", "low", "returns"))
    each = lambda op, *numbers: {f"{op}_{n if not isinstance(n, tuple) else n[0]}": call(op, c, n=n if isinstance(n, tuple) else (n,)) for n in numbers}
    made: dict[str, dict[str, Node]] = {
        "ts_delay": each("ts_delay", 1, 5),
        "ts_delta": each("ts_delta", 1, 5),
        "ts_mean": each("ts_mean", 5, 20),
        "ts_sum": each("ts_sum", 5, 20),
        "ts_std": each("ts_std", 5, 20),
        "ts_var": {f"var_{n}": call("ts_var", call("log", c), n=(n,)) for n in (5, 20)},
        "ts_minmax": each("ts_min", 5, 20) | each("ts_max", 5, 20),
        "ts_rank": each("ts_rank", 5, 20),
        "ts_argmax_argmin": each("ts_argmax", 5, 20) | each("ts_argmin", 5, 20),
        "ts_quantile_nearest": {f"q{int(q * 100)}_{n}": call("ts_quantile", c, n=(n, q)) for n in (5, 20) for q in (0.2, 0.8)},
        "ts_corr": {f"corr_{n}": call("ts_corr", c, v, n=(n,)) for n in (5, 20)},
        "ts_cov": {f"cov_{n}": call("ts_cov", c, v, n=(n,)) for n in (5, 20)},
        "ts_product": {"product_5": call("ts_product", c / call("ts_delay", c, n=(1,)), n=(5,))},
        "decay_linear": each("ts_decay_linear", 5, 20),
        "ts_zscore": each("ts_zscore", 5, 20),
        "ewm_decay": each("loose_decay", 5, 20),
        "loose_ts_mean": each("ts_mean", (5, 2), (20, 10)),
        "loose_ts_std": each("ts_std", (5, 2), (20, 10)),
        "loose_ts_minmax": each("ts_min", (5, 2), (20, 10)) | each("ts_max", (5, 2), (20, 10)),
        "loose_ts_rank_minmax": each("loose_range", 5, 20),
        "loose_ts_corr": {f"corr_{n}": call("loose_corr", c, v, n=(n,)) for n in (5, 20)},
        "cs_rank": {"rank_close": call("cs_rank", c), "rank_volume": call("cs_rank", v)},
        "cs_rank_raw": {"rank_close": call("cs_rank_raw", c), "rank_volume": call("cs_rank_raw", v)},
        "cs_zscore": {"z_close": call("cs_zscore", c), "z_standard": call("cs_standard", v)},
        "cs_scale": {"scaled": call("cs_scale", r)},
        "winsorize_zscore": {"treated": call("cs_standard", call("cs_winsorize", r, n=(0.01, 0.99)))},
        "market_return": {"market": call("cs_mean", r)},
        "safe_div_signed_ops": {
            "safe": call("safe_div", c - o, r),
            "signed_log": call("log1p", r),
            "signed_root": call("sqrt_abs", r),
            "squared": call("power", r, n=(2,)),
            "range_over_body": (h - low) / (c - o),
        },
    }
    found: dict[str, tuple[Query, str | None]] = {k: _factor_query(x) for k, x in made.items()}
    neutral = {"neutral": Node("cs_neutralize", (r, field("industry")), (10,))}
    found["industry_neutralize"] = _factor_query(neutral, "universe")
    groups = {
        "kline_features": ["KMID", "KLEN", "KMID2", "KUP", "KUP2", "KLOW", "KLOW2"],
        "roc_ma_std": ["ROC", "MA", "STD"],
        "beta_rsqr_resi": ["BETA", "RSQR", "RESI"],
        "max_min_rsv": ["MAX", "MIN", "RSV"],
        "quantile_rank": ["QTLU", "QTLD", "RANK"],
        "imax_imin_imxd": ["IMAX", "IMIN", "IMXD"],
        "corr_cord": ["CORR", "CORD"],
        "count_features": ["CNTP", "CNTN", "CNTD"],
        "sum_features": ["SUMP", "SUMN", "SUMD"],
        "volume_features": ["VMA", "VSTD", "WVMA"],
        "volume_direction": ["VSUMP", "VSUMN", "VSUMD"],
    }
    for name, families in groups.items():
        found[name] = _factor_query(technical.technical_factors(families))
    found["lag_price_ratios"] = _factor_query(lagged.lagged_factors(kinds=tuple(lagged.PRICES)))
    found["lag_volume_ratios"] = _factor_query(lagged.lagged_factors(kinds=("VOL",)))
    found["expand_factors"] = _factor_query(expand.expanded_factors(["close", "volume"]))
    found["cross_features"] = _factor_query(expand.crossed_factors(["returns", "close", "volume", "vwap"]))
    for name, members in {
        "alpha_row_level": "041",
        "alpha_asset_only": "006 007 009 012 021 023 024 026 035 043 046 049 051 053",
        "alpha_date_only": "033 042",
        "alpha_asset_then_date": "001 008 014 017 018 020 022 028 032 034 037 038 040 045 052",
        "alpha_date_then_asset": "003 004 044",
        "alpha_deep": "002 013 016 029 031",
    }.items():
        found[name] = _factor_query({f"alpha{k}": alphas.ALPHAS[f"alpha{k}"] for k in members.split()})
    parsed = {f"t{k:02d}": text.parse(x) for k, x in enumerate(text.TEMPLATES)}
    found["dsl_templates"] = _factor_query(parsed)
    found["events_dsl_templates"] = _factor_query({k: parsed[k] for k in ("t00", "t07", "t13", "t16", "t22", "t28")}, "events")
    for name in style.STYLES:
        node = call("cs_standard", Node("cs_neutralize", (style.STYLES[name], field("industry")), (10,)))
        found[f"style_{name}"] = _factor_query({name: node}, "universe")
    return found


#: Factors that the evaluation queries are about.
SUBJECTS: dict[str, Node] = {
    "reversal": -field("returns"),
    "turn": field("volume") / call("ts_mean", field("volume"), n=(20,)),
    "calm": -call("ts_std", field("returns"), n=(10,)),
    "range": (field("high") - field("low")) / field("close"),
}


def subjects(spark: SparkSession, folder: str) -> DataFrame:
    """The weekly panel with forward returns and the factors that evaluation is about."""
    return compile_factors(sources.forward_returns(sources.weekly_panel(spark, folder)), SUBJECTS)


_SUBJECTS = "(" + oracle.factor_sql(_FORWARD, ["asset", "date", "close", "volume", "returns", "fwd_return"], SUBJECTS) + ")"
_LONG = "(" + " UNION ALL ".join(
    f"SELECT date, asset, '{f}' AS factor, {f} AS value, fwd_return AS forward FROM {_SUBJECTS}" for f in SUBJECTS
) + ")"


def _ic_sql(pairwise: bool = False, min_obs: int = 1, keep_empty: bool = False, source: str = _LONG) -> str:
    where = "forward IS NOT NULL" + (" AND value IS NOT NULL" if pairwise else "")
    ranks = (
        f"SELECT date, factor, {oracle.average_rank('value', 'date, factor')} AS x,"
        f" {oracle.average_rank('forward', 'date, factor')} AS y FROM {source} WHERE {where}"
    )
    a, b = "CASE WHEN y IS NOT NULL THEN x END", "CASE WHEN x IS NOT NULL THEN y END"
    ic = f"round(covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0), {TIE_DIGITS})"
    if keep_empty:
        return f"SELECT date, factor, count(x) AS n, CASE WHEN count(x) >= {min_obs} THEN {ic} END AS ic FROM ({ranks}) GROUP BY date, factor"
    return f"SELECT date, factor, count(x) AS n, {ic} AS ic FROM ({ranks}) GROUP BY date, factor HAVING count(x) >= {min_obs}"


def _summary_sql(ics: str, population: bool = False) -> str:
    return f"""
    SELECT *, ic_mean / (ic_std + 1e-12) AS icir, ic_mean / nullif(ic_std / sqrt(n_dates), 0) AS t_stat FROM (
        SELECT factor, count(ic) AS n_dates, avg(ic) AS ic_mean, stddev_{'pop' if population else 'samp'}(ic) AS ic_std,
               avg(abs(ic)) AS abs_ic, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS positive,
               avg(CASE WHEN abs(ic) > 0.02 THEN 1.0 ELSE 0.0 END) AS strong
        FROM ({ics}) WHERE ic IS NOT NULL GROUP BY factor)
    """


_STATS = ["ic_mean", "ic_std", "abs_ic", "positive", "strong", "icir", "t_stat"]
_GROUPED_BY = f"""
(SELECT date, asset, factor, forward, 1 + {' + '.join(f"CASE WHEN share > {i} * ((hi - lo) / 5) + lo THEN 1 ELSE 0 END" for i in range(1, 5))} AS grp
 FROM (SELECT *, min(share) OVER d AS lo, max(share) OVER d AS hi, count(*) OVER d AS n
       FROM (SELECT *, ({oracle.average_rank('value', 'date, factor')}) / count(value) OVER (PARTITION BY date, factor) AS share
             FROM {_LONG} WHERE value IS NOT NULL AND KNOWN)
       WINDOW d AS (PARTITION BY date, factor)) WHERE n >= 25)
"""
_GROUPED, _HELD = _GROUPED_BY.replace("KNOWN", "forward IS NOT NULL"), _GROUPED_BY.replace("KNOWN", "true")
_GROUP_RETURNS = f"""
(SELECT *, coalesce(G5 - G1, 0) AS LS FROM (
    SELECT factor, date, {', '.join(f"avg(forward) FILTER (grp = {g}) AS G{g}" for g in range(1, 6))}
    FROM {_GROUPED} GROUP BY factor, date))
"""
_LAYERS = ["G1", "G2", "G3", "G4", "G5", "LS"]


def _evaluation_queries() -> dict[str, tuple[Query, str | None]]:
    names = list(SUBJECTS)
    ic = rounded_sql(_ic_sql(), ["ic"], ["date", "factor", "n"])
    found: dict[str, tuple[Query, str | None]] = {
        "rank_ic_daily": (lambda s, d: rounded(evaluate.rank_ic(subjects(s, d), names)), ic),
        "rank_ic_pairwise": (
            lambda s, d: rounded(evaluate.rank_ic(subjects(s, d), names, pairwise=True, min_obs=30, keep_empty=True)),
            rounded_sql(_ic_sql(True, 30, True), ["ic"], ["date", "factor", "n"]),
        ),
        "ic_summary": (
            lambda s, d: rounded(evaluate.ic_summary(evaluate.rank_ic(subjects(s, d), names))),
            rounded_sql(_summary_sql(_ic_sql()), _STATS, ["factor", "n_dates"]),
        ),
        "top_factors": (
            lambda s, d: rounded(evaluate.top_factors(subjects(s, d), names)),
            rounded_sql(_summary_sql(_ic_sql(True, 30), True), _STATS, ["factor", "n_dates"]) + " WHERE n_dates > 10",
        ),
        "ic_filter": (
            lambda s, d: s.createDataFrame([(f,) for f in evaluate.filter_by_ic(subjects(s, d), names, threshold=0.1)], "factor string"),
            f"SELECT factor FROM ({_summary_sql(_ic_sql())}) WHERE abs_ic >= 0.1",
        ),
        "ic_gate_first100": (
            lambda s, d: rounded(evaluate.gate_by_first_dates(subjects(s, d), names)),
            rounded_sql(
                f"SELECT factor, count(ic) AS n_dates, avg(ic) AS ic_mean FROM ({_ic_sql(True, 20)}) WHERE ic IS NOT NULL AND date IN"
                f" (SELECT date FROM (SELECT DISTINCT date FROM {_PANEL}) ORDER BY date LIMIT 100) GROUP BY factor"
                " HAVING count(ic) >= 10 AND abs(avg(ic)) >= 0.01",
                ["ic_mean"],
                ["factor", "n_dates"],
            ),
        ),
        "coverage": (
            lambda s, d: rounded(evaluate.coverage(subjects(s, d), names)),
            rounded_sql(f"SELECT factor, count(value) / count(*) AS coverage FROM {_LONG} GROUP BY factor", ["coverage"], ["factor"]),
        ),
        "group_returns": (
            lambda s, d: rounded(backtest.group_returns(subjects(s, d), names)),
            rounded_sql(f"SELECT * FROM {_GROUP_RETURNS}", _LAYERS, ["factor", "date"]),
        ),
        "group_performance": (
            lambda s, d: rounded(backtest.performance(backtest.group_returns(subjects(s, d), names), _LAYERS)),
            rounded_sql(
                "SELECT *, coalesce(annual_return / nullif(annual_vol, 0), 0) AS sharpe FROM (SELECT factor, grp, count(r) AS n_dates,"
                " avg(r) * 52 AS annual_return, stddev_samp(r) * sqrt(52.0) AS annual_vol FROM ("
                + " UNION ALL ".join(f"SELECT factor, '{g}' AS grp, {g} AS r FROM {_GROUP_RETURNS}" for g in _LAYERS)
                + ") GROUP BY factor, grp)",
                ["annual_return", "annual_vol", "sharpe"],
                ["factor", "grp", "n_dates"],
            ),
        ),
        "group_nav": (
            lambda s, d: rounded(backtest.group_values(_scaled(backtest.group_returns(subjects(s, d), names)), _LAYERS)),
            rounded_sql(
                "SELECT factor, date, "
                + ", ".join(f"CASE WHEN {g} IS NOT NULL THEN exp(sum(ln(1 + {g} / 10000)) OVER (PARTITION BY factor ORDER BY date)) END AS {g}" for g in _LAYERS)
                + f" FROM {_GROUP_RETURNS}",
                _LAYERS,
                ["factor", "date"],
            ),
        ),
        "factor_report": (lambda s, d: rounded(evaluate.factor_report(subjects(s, d), names)), _report_sql()),
        "backtest_comparison": (lambda s, d: backtest.comparison(subjects(s, d), names), None),
        "redundancy_pairs": (lambda s, d: rounded(evaluate.redundancy(subjects(s, d), names)), _redundancy_sql(names)),
        "pooled_redundancy": (
            lambda s, d: rounded(evaluate.pooled_correlations(subjects(s, d), [("reversal", "turn"), ("turn", "range")])),
            rounded_sql(
                " UNION ALL ".join(
                    f"SELECT '{a}' AS a, '{b}' AS b, count(*) AS n, covar_samp({a}, {b}) / (stddev_samp({a}) * stddev_samp({b})) AS correlation"
                    f" FROM {_SUBJECTS} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
                    for a, b in [("reversal", "turn"), ("turn", "range")]
                ),
                ["correlation"],
                ["a", "b", "n"],
            ),
        ),
        "dedup_kept": (
            lambda s, d: s.createDataFrame([(f,) for f in evaluate.remove_redundant(subjects(s, d), names, threshold=0.5)], "factor string"),
            None,
        ),
        "pooled_spearman": (
            lambda s, d: rounded(_one(s, evaluate.spearman(subjects(s, d), "reversal", "fwd_return"))),
            rounded_sql(
                "SELECT covar_samp(x, y) / (stddev_samp(x) * stddev_samp(y)) AS ic FROM (SELECT"
                " rank() OVER (ORDER BY reversal) + (count(*) OVER (PARTITION BY reversal) - 1) / 2.0 AS x,"
                " rank() OVER (ORDER BY fwd_return) + (count(*) OVER (PARTITION BY fwd_return) - 1) / 2.0 AS y"
                f" FROM {_SUBJECTS} WHERE reversal IS NOT NULL AND fwd_return IS NOT NULL)",
                ["ic"],
                [],
            ),
        ),
        "cross_selected": (
            lambda s, d: rounded(expand.cross_factors(subjects(s, d), names, threshold=0.1).drop("open", "high", "low", "vwap")),
            None,
        ),
    }
    return found


def _one(spark: SparkSession, value: float | None) -> DataFrame:
    return spark.createDataFrame([(value,)], "ic double")


def _scaled(returns: DataFrame) -> DataFrame:
    """Group returns by ten thousand: prices of order lines jump too much for a value that one can follow."""
    return returns.select("factor", "date", *[(F.col(c) / 10000).alias(c) for c in _LAYERS])


def _report_sql() -> str:
    buckets = (
        f"SELECT factor, forward, least(floor(({oracle.average_rank('value', 'date, factor')}) / count(value) OVER (PARTITION BY date, factor) * 5), 4) AS b"
        f" FROM {_LONG} WHERE value IS NOT NULL AND forward IS NOT NULL"
    )
    sql = f"""
    SELECT c.factor, coverage, ic_mean, ic_std, icir, abs_ic, positive, q1_return, q5_return, q5_return - q1_return AS long_short
    FROM (SELECT factor, count(value) / count(*) AS coverage FROM {_LONG} GROUP BY factor) c
    LEFT JOIN ({_summary_sql(_ic_sql())}) s ON c.factor = s.factor
    LEFT JOIN (SELECT factor, avg(forward) FILTER (b = 0) AS q1_return, avg(forward) FILTER (b = 4) AS q5_return FROM ({buckets}) GROUP BY factor) q
           ON c.factor = q.factor
    """
    doubles = ["coverage", "ic_mean", "ic_std", "icir", "abs_ic", "positive", "q1_return", "q5_return", "long_short"]
    return rounded_sql(sql, doubles, ["factor"])


def _redundancy_sql(names: list[str]) -> str:
    ranks = ", ".join(
        f"CASE WHEN count(*) OVER (PARTITION BY date) >= 10 AND count({f}) OVER (PARTITION BY date) >= 5"
        f" THEN {oracle.average_rank(f, 'date')} END AS {f}"
        for f in names
    )
    parts = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
            c = f"CASE WHEN count({x}) >= 5 THEN covar_samp({x}, {y}) / nullif(stddev_samp({x}) * stddev_samp({y}), 0) END"
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, {c} AS c FROM (SELECT date, {ranks} FROM {_SUBJECTS}) GROUP BY date")
    sql = f"SELECT a, b, count(c) AS n_dates, avg(c) AS correlation FROM ({' UNION ALL '.join(parts)}) GROUP BY a, b"
    return rounded_sql(sql, ["correlation"], ["a", "b", "n_dates"])


def _weights_sql(method: str) -> str:
    """Weights of each date from the ICs up to it, dates of a factor without one taking its last."""
    raw = "mean" if method == "ic" else "CASE WHEN dev > 1e-8 THEN mean / dev ELSE 0 END"
    return f"""
    (WITH ics AS ({_ic_sql(True, 30, True)}), known AS (
        SELECT factor, date, ic, row_number() OVER (PARTITION BY factor ORDER BY date) AS k FROM ics WHERE ic IS NOT NULL
    ), grid AS (
        SELECT d.date, f.factor, (SELECT max(k) FROM known x WHERE x.factor = f.factor AND x.date <= d.date) AS last
        FROM (SELECT DISTINCT date FROM ics) d, (SELECT DISTINCT factor FROM {_LONG}) f
    ), tails AS (
        SELECT g.date, g.factor, coalesce(last, 0) AS last, k.ic, pow(0.5, (last - k) / 26.0) AS w
        FROM grid g LEFT JOIN known k ON k.factor = g.factor AND k.k > g.last - 52 AND k.k <= g.last
    ), means AS (SELECT *, sum(ic * w) OVER x / nullif(sum(w) OVER x, 0) AS mean FROM tails WINDOW x AS (PARTITION BY date, factor)),
    sums AS (
        SELECT date, factor, min(last) AS n, any_value(mean) AS mean, sqrt(sum(w * (ic - mean) * (ic - mean)) / nullif(sum(w), 0)) AS dev
        FROM means GROUP BY date, factor
    ), raws AS (SELECT date, factor, CASE WHEN n < 10 THEN 1.0 / {len(SUBJECTS)} ELSE {raw} END AS raw FROM sums)
    SELECT date, factor, CASE WHEN sum(abs(raw)) OVER (PARTITION BY date) > 1e-12
           THEN raw / sum(abs(raw)) OVER (PARTITION BY date) ELSE 1.0 / {len(SUBJECTS)} END AS weight FROM raws)
    """


_TURNOVER = f"""
(WITH groups_ AS (SELECT factor, grp, date, asset, 1.0 / count(*) OVER (PARTITION BY factor, grp, date) AS w FROM {_HELD}),
 held AS (SELECT * FROM groups_ UNION ALL SELECT factor, 0 AS grp, date, asset, CASE WHEN grp = 5 THEN w ELSE -w END FROM groups_ WHERE grp IN (1, 5)),
 days AS (SELECT factor, date, lag(date) OVER (PARTITION BY factor ORDER BY date) AS prev FROM (SELECT DISTINCT factor, date FROM held)),
 moves AS (
    SELECT h.factor, grp, h.date, asset, w FROM held h
    UNION ALL SELECT h.factor, grp, d.date, asset, -w FROM held h JOIN days d ON d.factor = h.factor AND d.prev = h.date
 ), sums AS (
    SELECT m.factor, grp, m.date, sum(abs(w)) / 2 AS turnover, sum(greatest(w, 0)) * 1e8 AS buys, sum(greatest(-w, 0)) * 1e8 AS sells
    FROM (SELECT factor, grp, date, asset, sum(w) AS w FROM moves GROUP BY ALL) m
    JOIN days d ON d.factor = m.factor AND d.date = m.date AND prev IS NOT NULL GROUP BY m.factor, grp, m.date
 )
 SELECT *, cost / 1e8 * 1e4 AS cost_bps FROM (
    SELECT *, buys * (0.0003 + 0.1 * sqrt(least(buys / 1e8, 1))) + sells * (0.0003 + 0.0005 + 0.1 * sqrt(least(sells / 1e8, 1))) AS cost FROM sums))
"""


def _portfolio_queries() -> dict[str, tuple[Query, str | None]]:
    names = list(SUBJECTS)
    known = f"coalesce({', '.join(names)})"
    total = " + ".join(f"coalesce({f}, 0)" for f in names)
    days = f"(SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS d FROM (SELECT DISTINCT date FROM {_PANEL})) WHERE d > 62)"

    def combined(method: str) -> str:
        return rounded_sql(
            f"SELECT l.date, asset, sum(weight * coalesce(value, 0)) AS combined FROM {_LONG} l JOIN {_weights_sql(method)} w"
            f" ON w.date = l.date AND w.factor = l.factor WHERE l.date IN {days} GROUP BY l.date, asset",
            ["combined"],
            ["date", "asset"],
        )

    return {
        "combine_equal": (
            lambda s, d: rounded(combine.equal_weight(subjects(s, d), names)),
            rounded_sql(f"SELECT date, asset, CASE WHEN {known} IS NOT NULL THEN ({total}) / {len(names)} END AS combined FROM {_SUBJECTS}", ["combined"], ["date", "asset"]),
        ),
        "combine_ic": (lambda s, d: rounded(combine.combine(subjects(s, d), names, "ic")[0]), combined("ic")),
        "combine_ic_weights": (
            lambda s, d: rounded(combine.ic_weights(combine.rolling_ic(subjects(s, d), names), names, "ic")),
            rounded_sql(f"SELECT * FROM {_weights_sql('ic')}", ["weight"], ["date", "factor"]),
        ),
        "combine_icir_weights": (
            lambda s, d: rounded(combine.ic_weights(combine.rolling_ic(subjects(s, d), names), names, "icir")),
            rounded_sql(f"SELECT * FROM {_weights_sql('icir')}", ["weight"], ["date", "factor"]),
        ),
        "combine_mean_weights": (
            lambda s, d: rounded(combine.mean_weights(combine.combine(subjects(s, d), names, "icir")[1])),
            rounded_sql(f"SELECT factor, avg(weight) AS weight FROM {_weights_sql('icir')} WHERE date IN {days} GROUP BY factor", ["weight"], ["factor"]),
        ),
        "combine_max_icir": (lambda s, d: rounded(combine.combine(subjects(s, d), names, "max_icir")[0]), None),
        "trade_cost": (
            lambda s, d: rounded(
                sources.read(s, d, "orders").select(
                    "o_orderkey",
                    costs.trade_cost(F.col("o_totalprice"), F.lit(1e8), F.lit(True)).alias("buy"),
                    costs.trade_cost(F.col("o_totalprice"), F.lit(1e8), F.lit(False)).alias("sell"),
                ),
                8,
            ),
            rounded_sql(
                "SELECT o_orderkey, 0.0003::DOUBLE + 0.1::DOUBLE * sqrt(least(abs(o_totalprice) / 1e8, 1)) AS buy,"
                " 0.0003::DOUBLE + 0.0005::DOUBLE + 0.1::DOUBLE * sqrt(least(abs(o_totalprice) / 1e8, 1)) AS sell FROM orders",
                ["buy", "sell"],
                ["o_orderkey"],
                8,
            ),
        ),
        "group_turnover": (
            lambda s, d: rounded(costs.group_turnover(subjects(s, d), names), 4),
            rounded_sql(f"SELECT * FROM {_TURNOVER}", ["turnover", "buys", "sells", "cost", "cost_bps"], ["factor", "grp", "date"], 4),
        ),
        "turnover_summary": (
            lambda s, d: rounded(costs.turnover_summary(costs.group_turnover(subjects(s, d), names)), 4),
            rounded_sql(
                "SELECT factor, grp, avg(turnover) AS mean_turnover, avg(cost_bps) AS mean_cost_bps, avg(cost_bps) * 52 / 1e4 AS annual_cost"
                f" FROM {_TURNOVER} GROUP BY factor, grp",
                ["mean_turnover", "mean_cost_bps", "annual_cost"],
                ["factor", "grp"],
                4,
            ),
        ),
        "net_returns": (_net_returns, rounded_sql(
            f"SELECT g.factor, g.date, G5 AS gross, G5 - coalesce(cost_bps, 0) / 1e4 AS net FROM {_GROUP_RETURNS} g"
            f" LEFT JOIN (SELECT * FROM {_TURNOVER} WHERE grp = 5) t ON t.factor = g.factor AND t.date = g.date",
            ["gross", "net"],
            ["factor", "date"],
        )),
        "industry_cap_weights": (
            lambda s, d: rounded(risk.industry_weights(sources.weekly_universe(s, d))),
            rounded_sql(
                "SELECT date, industry, cap / sum(cap) OVER (PARTITION BY date) AS weight FROM"
                f" (SELECT date, industry, sum(market_cap) AS cap FROM {_UNIVERSE} GROUP BY date, industry)",
                ["weight"],
                ["date", "industry"],
            ),
        ),
        "factor_returns_wls": (lambda s, d: rounded(risk.factor_returns(styled(s, d), RISK)), None),
        "factor_cov": (_factor_cov, None),
        "specific_risk": (_specific_risk, None),
        "pure_portfolio": (lambda s, d: rounded(risk.pure_portfolio(styled(s, d), RISK, "size")), None),
        "risk_decomposition": (_risk_decomposition, None),
    }


def _net_returns(spark: SparkSession, folder: str) -> DataFrame:
    rows, names = subjects(spark, folder), list(SUBJECTS)
    return rounded(costs.net_returns(backtest.group_returns(rows, names), costs.group_turnover(rows, names), "G5", 5))


RISK = risk.RiskModel(styles=("size", "value", "low_vol"))


def styled(spark: SparkSession, folder: str) -> DataFrame:
    """The weekly universe with the risk model's styles."""
    return style.add_styles(sources.weekly_universe(spark, folder), list(RISK.styles), neutralize=False)


def _factor_cov(spark: SparkSession, folder: str) -> DataFrame:
    cov = risk.factor_covariance(risk.returns_table(risk.factor_returns(styled(spark, folder), RISK)), RISK)
    rows = [(a, b, float(cov.loc[a, b])) for a in cov.index for b in cov.columns]
    return rounded(spark.createDataFrame(rows, "a string, b string, covariance double"), 8)


def _specific_risk(spark: SparkSession, folder: str) -> DataFrame:
    universe = styled(spark, folder)
    return rounded(risk.specific_risk(universe, risk.factor_returns(universe, RISK), RISK))


def decomposed(spark: SparkSession, folder: str, model: risk.RiskModel) -> tuple[list[str], dict[str, object]]:
    """The factors of the covariance and the decomposition of equal weights on the last date.

    The universe and its factor returns are stored, so that none of the jobs
    that take them makes the panel anew.
    """
    with Tables(spark) as tables:
        universe = tables.store(styled(spark, folder).select("date", "asset", model.industry, "market_cap", "returns", *model.styles))
        returns = tables.store(risk.factor_returns(universe, model))
        date = universe.agg(F.max("date")).first()[0]
        weights = universe.filter(F.col("date") == F.lit(date)).select("asset", (1 / F.count("*").over(Window.partitionBy("date"))).alias("weight"))
        cov = risk.factor_covariance(risk.returns_table(returns), model)
        specific = tables.store(risk.specific_risk(universe, returns, model))
        return list(cov.columns), risk.decompose(universe, weights, cov, specific, model, date)


def _risk_decomposition(spark: SparkSession, folder: str) -> DataFrame:
    factors, found = decomposed(spark, folder, RISK)
    rows = [(f, float(found["exposure"][f]), float(found["marginal"][f]), float(found["share"][f])) for f in factors]
    rows.append(("specific", 0.0, 0.0, found["specific_variance"] / max(found["total_risk"] ** 2, 1e-30)))
    return rounded(spark.createDataFrame(rows, "factor string, exposure double, marginal double, share double"))


def _source_queries() -> dict[str, tuple[Query, str | None]]:
    prices = ["open", "high", "low", "close", "volume", "vwap", "returns"]
    weekly = (
        "SELECT asset, CAST(date + CAST((12 - isodow(date)) % 7 AS INT) AS DATE) AS date, arg_max(close, date) AS value"
        f" FROM {_EVENTS} WHERE close IS NOT NULL GROUP BY 1, 2"
    )
    return {
        "panel_ohlcv": (lambda s, d: rounded(sources.weekly_panel(s, d)), rounded_sql(f"SELECT * FROM {_PANEL}", prices, _KEYS)),
        "panel_events": (lambda s, d: rounded(sources.daily_event_panel(s, d)), rounded_sql(f"SELECT * FROM {_EVENTS}", prices, _KEYS)),
        "returns_fwd": (
            lambda s, d: rounded(sources.forward_returns(sources.weekly_panel(s, d)).select(*_KEYS, "returns", "fwd_return")),
            rounded_sql(f"SELECT * FROM {_FORWARD}", ["returns", "fwd_return"], _KEYS),
        ),
        "returns_fwd_dense": (
            lambda s, d: rounded(sources.forward_returns(sources.weekly_panel(s, d), 2, dense=True).select(*_KEYS, "fwd_return")),
            rounded_sql(
                f"WITH p AS (SELECT * FROM {_PANEL}), d AS (SELECT date, lead(date, 2) OVER (ORDER BY date) AS ahead FROM (SELECT DISTINCT date FROM p))"
                " SELECT p.asset, p.date, q.returns AS fwd_return FROM p JOIN d ON d.date = p.date LEFT JOIN p q ON q.asset = p.asset AND q.date = d.ahead",
                ["fwd_return"],
                _KEYS,
            ),
        ),
        "universe": (
            lambda s, d: rounded(sources.weekly_universe(s, d).select(*_KEYS, "industry", "market_cap", "book_to_price", "roe", "volatility"), 4),
            rounded_sql(f"SELECT * FROM {_UNIVERSE}", ["market_cap", "book_to_price", "roe", "volatility"], [*_KEYS, "industry"], 4),
        ),
        "weekly_resample": (
            lambda s, d: rounded(sources.resample_weekly(sources.daily_event_panel(s, d), "close")),
            rounded_sql(weekly, ["value"], _KEYS),
        ),
        "synthetic_universe": (lambda s, d: rounded(universes.synthetic_universe(s, 50)), None),
        "ohlcv_from_returns": (lambda s, d: rounded(universes.ohlcv_from_returns(universes.synthetic_universe(s, 50))), None),
        "universe_from_bars": (lambda s, d: rounded(universes.universe_from_bars(sources.weekly_panel(s, d).select("asset", "date", "close"), 50)), None),
        "wide_export": (lambda s, d: rounded(sources.wide(sources.weekly_panel(s, d), "close", [1, 2, 3])), rounded_sql(
            "SELECT date, " + ", ".join(f'max(close) FILTER (asset = {k}) AS "{k}"' for k in (1, 2, 3)) + f" FROM {_PANEL} GROUP BY date",
            ['"1"', '"2"', '"3"'],
            ["date"],
        )),
        "wide_export_all": (lambda s, d: sources.wide(rounded(sources.weekly_panel(s, d, returns=False).select(*_KEYS, "close")), "close"), None),
    }


_FEATURES = ["reversal", "turn", "calm", "range"]
_CUT = "1999-01-01"


def _model_query(name: str, **parameters: object) -> Query:
    """A model fitted on the panel until a date and its predictions from there on."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = rolling.feature_matrix(subjects(spark, folder), _FEATURES, min_names=5)
        model = ensemble.get_model(name, _FEATURES, **parameters).fit(rows.filter(F.col("date") < _CUT))
        return rounded(model.predict(rows.filter(F.col("date") >= _CUT)).select(*_KEYS, "prediction"))

    return query


def _ensemble_query(kind: type) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = rolling.feature_matrix(subjects(spark, folder), _FEATURES, min_names=5).cache()
        makers = [lambda: ensemble.get_model("ridge", _FEATURES), lambda: ensemble.get_model("elastic_net", _FEATURES)]
        held = rows.filter((F.col("date") >= "1998-01-01") & (F.col("date") < _CUT))
        model = kind(makers).fit(rows.filter(F.col("date") < "1998-01-01"), held)
        return rounded(model.predict(rows.filter(F.col("date") >= _CUT)).select(*_KEYS, "prediction"))

    return query


def _rolling_splits(spark: SparkSession, folder: str) -> DataFrame:
    n = sources.weekly_panel(spark, folder).select("date").distinct().count()
    return spark.createDataFrame(rolling.splits(n), "start int, train_end int, validation_end int, test_end int")


def _model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    makers = {k: (lambda f, t, k=k: ensemble.get_model(k, f, t)) for k in ("ridge", "elastic_net")}
    found = rolling.compare(subjects(spark, folder), makers, _FEATURES, min_names=5)
    return rounded(found.drop("seconds"))


def _gp_pool(spark: SparkSession, folder: str) -> DataFrame:
    panel = sources.forward_returns(sources.weekly_panel(spark, folder))
    small = search.Parameters(population=16, generations=2, checked=4, threshold=0.05, min_obs=3)
    return rounded(search.pool_table(panel, search.mine_factors(panel, parameters=small)))


def _model_queries() -> dict[str, tuple[Query, str | None]]:
    sql = (
        "WITH n AS (SELECT count(DISTINCT date) AS n FROM " + _PANEL + "), k AS (SELECT n, range AS k FROM n, range(3))"
        " SELECT DISTINCT CAST(k * ((n - 260) // 2) AS INT) AS start, CAST(k * ((n - 260) // 2) + 156 AS INT) AS train_end,"
        " CAST(k * ((n - 260) // 2) + 208 AS INT) AS validation_end, CAST(k * ((n - 260) // 2) + 260 AS INT) AS test_end FROM k"
    )
    return {
        "rolling_splits": (_rolling_splits, sql),
        "ridge": (_model_query("ridge"), None),
        "elastic_net": (_model_query("elastic_net"), None),
        "gbt": (_model_query("boosted", rounds=20), None),
        "gbt_levels": (_model_query("boosted_levels", rounds=20), None),
        "gbt_symmetric": (_model_query("boosted_symmetric", rounds=20), None),
        "double_ensemble": (_model_query("double_ensemble", models=3, rounds=10), None),
        "stacking": (_ensemble_query(ensemble.StackingEnsemble), None),
        "blending": (_ensemble_query(ensemble.BlendingEnsemble), None),
        "model_comparison": (_model_comparison, None),
        "gp_pool": (_gp_pool, None),
    }


def _all() -> dict[str, tuple[Query, str | None]]:
    from factorloom import solved

    return _source_queries() | _operator_queries() | _evaluation_queries() | _portfolio_queries() | _model_queries() | solved.queries()


def queries() -> dict[str, Query]:
    """Every query by its name."""
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    return {k: s for k, (_, s) in _all().items() if s is not None}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The weekly panel with three factors and their ranks; also where a date has few names."""
    panel = sources.forward_returns(sources.weekly_panel(spark, folder))
    made = {k: SUBJECTS[k] for k in ("reversal", "range")}
    ranks = {f"{k}_rank": call("cs_rank", x) for k, x in made.items()}
    return rounded(compile_factors(panel, made | ranks))
