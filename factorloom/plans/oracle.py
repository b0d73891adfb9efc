"""The same expressions as plain SQL, for an independent engine to check results with.

Each stage is a common table expression; formulas are written out from sums and
counts, in the dialect of DuckDB.
"""

from __future__ import annotations

from collections.abc import Mapping

from factorloom.functions.columns import BY_ASSET, BY_DATE, LOG_DIGITS, TIE_DIGITS
from factorloom.plans.graph import Node, is_window, levels, walk

_SERIES = "PARTITION BY asset ORDER BY date"


def _over(n: int) -> str:
    return f"OVER ({_SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _gate(agg: str):
    def sql(x: str, n: int, least: int | None = None) -> str:
        return f"CASE WHEN count({x}) {_over(n)} >= {n if least is None else least} THEN {agg}({x}) {_over(n)} END"

    return sql


def _list(x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) {_over(n)} = {n} THEN array_agg({x}) {_over(n)} END)"


def _pair(x: str, y: str, n: int, what: str) -> str:
    a, b = f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    c = f"covar_samp({a}, {b}) {_over(n)}"
    if what == "corr":
        c = f"{c} / nullif(stddev_samp({a}) {_over(n)} * stddev_samp({b}) {_over(n)}, 0)"
    return f"CASE WHEN count({a}) {_over(n)} >= {n} THEN round({c}, {TIE_DIGITS}) END"


def rounded(x: str, digits: int) -> str:
    """SQL for x rounded to some digits, a last digit of 5 down."""
    scale = f"{10.0**digits!r}::DOUBLE"
    return f"floor({x} * {scale} + 0.49::DOUBLE) / {scale}"


def average_rank(x: str, partition: str) -> str:
    """SQL for the average rank of x in a partition."""
    return (
        f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {partition} ORDER BY {x} NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY {partition}, {x}) - 1) / 2.0 END"
    )


def _loose_range(x: str, n: int) -> str:
    low, high = f"min({x}) {_over(n)}", f"max({x}) {_over(n)}"
    return (
        f"coalesce(CASE WHEN count({x}) {_over(n)} >= {max(1, n // 2)} AND {high} - {low} > 1e-10"
        f" THEN ({x} - {low}) / ({high} - {low}) END, 0.5)"
    )


def _loose_corr(x: str, y: str, n: int) -> str:
    least = max(2, n // 2)
    mean = lambda c: f"(CASE WHEN count({c}) {_over(n)} >= {least} THEN avg({c}) {_over(n)} END)"
    dev = lambda c: f"(CASE WHEN count({c}) {_over(n)} >= {least} THEN stddev_samp({c}) {_over(n)} END)"
    below = f"({dev(x)} * {dev(y)})"
    value = f"({mean(f'({x} * {y})')} - {mean(x)} * {mean(y)}) / {below}"
    return f"coalesce(CASE WHEN {below} > 1e-10 THEN least(greatest({value}, -1.0), 1.0) END, 0.0)"


def _loose_decay(x: str, n: int) -> str:
    half = max(1, n // 2)
    w = f"OVER ({_SERIES} ROWS BETWEEN {54 * half - 1} PRECEDING AND CURRENT ROW)"
    pairs = f"array_agg({{'x': {x}}}) {w}"
    weight = f"pow(2.0, (i - len({pairs})) / {half}.0)"
    total = lambda e: f"list_sum(list_transform({pairs}, lambda e, i: CASE WHEN e.x IS NOT NULL THEN {weight}{e} END))"
    first = f"count({x}) OVER ({_SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN {first} >= {half} THEN {total(' * e.x')} / nullif({total('')}, 0) END"


def _decay(x: str, n: int) -> str:
    return f"list_sum(list_transform({_list(x, n)}, lambda e, i: e * i)) / {n * (n + 1) / 2}"


def _rank(x: str, n: int) -> str:
    v = _list(x, n)
    count = lambda c: f"len(list_filter({v}, lambda e: e {c} {x}))"
    return f"CASE WHEN {v} IS NOT NULL AND {x} IS NOT NULL THEN ({count('<')} + ({count('=')} + 1) / 2.0) / {n} END"


def _place(x: str, n: int, of: str) -> str:
    return f"CAST(list_position({_list(x, n)}, list_{of}({_list(x, n)})) - 1 AS DOUBLE)"


_DAY = "OVER (PARTITION BY date)"
SQL = {
    "ts_delay": lambda x, n: f"lag({x}, {n}) OVER ({_SERIES})",
    "ts_delta": lambda x, n: f"{x} - lag({x}, {n}) OVER ({_SERIES})",
    "ts_mean": _gate("avg"),
    "ts_sum": _gate("sum"),
    "ts_std": _gate("stddev_samp"),
    "ts_var": _gate("var_samp"),
    "ts_min": _gate("min"),
    "ts_max": _gate("max"),
    "ts_rank": _rank,
    "ts_argmax": lambda x, n: _place(x, n, "max"),
    "ts_argmin": lambda x, n: _place(x, n, "min"),
    "ts_quantile": lambda x, n, q: f"list_sort({_list(x, n)})[{int((n - 1) * q + 0.5) + 1}]",
    "ts_corr": lambda x, y, n: _pair(x, y, n, "corr"),
    "ts_cov": lambda x, y, n: _pair(x, y, n, "cov"),
    "ts_decay_linear": _decay,
    "ts_product": lambda x, n: f"exp({_gate('sum')(f'(CASE WHEN {x} > 0 THEN ln({x}) END)', n)})",
    "ts_zscore": lambda x, n: f"CASE WHEN count({x}) {_over(n)} >= {n} THEN ({x} - avg({x}) {_over(n)}) / (stddev_samp({x}) {_over(n)} + 1e-12) END",
    "loose_range": _loose_range,
    "loose_corr": _loose_corr,
    "loose_decay": _loose_decay,
    "cs_rank": lambda x: f"({average_rank(x, 'date')}) / nullif(count({x}) {_DAY}, 0)",
    "cs_rank_raw": lambda x: average_rank(x, "date"),
    "cs_zscore": lambda x: f"({x} - avg({x}) {_DAY}) / (stddev_samp({x}) {_DAY} + 1e-10)",
    "cs_standard": lambda x: f"({x} - avg({x}) {_DAY}) / nullif(stddev_samp({x}) {_DAY}, 0)",
    "cs_scale": lambda x, a=1.0: f"{a} * {x} / nullif(sum(abs({x})) {_DAY}, 0)",
    "cs_winsorize": lambda x, low=0.01, high=0.99: (
        f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, quantile_cont({x}, {low}) {_DAY}), quantile_cont({x}, {high}) {_DAY}) END"
    ),
    "cs_neutralize": lambda x, g, least=10: (
        f"CASE WHEN count({x}) {_DAY} < {least} THEN {x} ELSE {x} - avg({x}) OVER (PARTITION BY date, {g}) END"
    ),
    "cs_mean": lambda x: f"avg({x}) {_DAY}",
    "add": lambda a, b: f"({a} + {b})",
    "sub": lambda a, b: f"({a} - {b})",
    "mul": lambda a, b: f"({a} * {b})",
    "div": lambda a, b: f"({a} / nullif({b}, 0))",
    "safe_div": lambda a, b: f"(CASE WHEN abs({b}) > 1e-10 THEN {a} / {b} ELSE 0.0 END)",
    "neg": lambda a: f"(-({a}))",
    "abs": lambda a: f"abs({a})",
    "sign": lambda a: f"CAST(sign({a}) AS DOUBLE)",
    "log": lambda a: f"(CASE WHEN {a} > 0 THEN round(ln({a}), {LOG_DIGITS}) END)",
    "sqrt": lambda a: f"(CASE WHEN {a} >= 0 THEN sqrt({a}) END)",
    "log1p": lambda a: f"(ln(1 + abs({a})) * sign({a}))",
    "sqrt_abs": lambda a: f"(sqrt(abs({a})) * sign({a}))",
    "power": lambda a, p: f"(sign({a}) * pow(abs({a}), {float(p)}))",
    "lower": lambda a, b: f"least({a}, {b})",
    "upper": lambda a, b: f"greatest({a}, {b})",
    "less": lambda a, b: f"({a} < {b})",
    "greater": lambda a, b: f"({a} > {b})",
    "where": lambda c, a, b: f"(CASE WHEN {c} THEN {a} ELSE {b} END)",
    "flag": lambda c: f"(CASE WHEN {c} THEN 1.0 WHEN NOT ({c}) THEN 0.0 END)",
}
assert SQL.keys() >= BY_ASSET.keys() | BY_DATE.keys()


def factor_sql(base: str, columns: list[str], factors: Mapping[str, Node], digits: int | None = None) -> str:
    """SQL for ``columns`` of the table ``base`` (SQL in parentheses or a name) and the factors, rounded if asked."""
    nodes = walk(list(factors.values()))
    level = levels(nodes)
    names: dict[Node, str] = {}

    def column(x: Node) -> str:
        if x in names:
            return names[x]
        if x.op == "field":
            return f'"{x.numbers[0]}"'
        if x.op == "const":
            return f"({x.numbers[0]!r})"
        return SQL[x.op](*[column(a) for a in x.args], *x.numbers)

    parts = [f"s0 AS (SELECT * FROM {base})"]

    def stage(items: list[str]) -> None:
        parts.append(f"s{len(parts)} AS (SELECT *, {', '.join(items)} FROM s{len(parts) - 1})")

    for k in range(1, max(level.values(), default=0) + 1):
        windows = [x for x in nodes if level[x] == k and is_window(x)]
        inner = []
        for x in windows:
            for a in x.args:
                if a not in names and a.op != "field":
                    sql, names[a] = column(a), f"n{len(names)}"
                    inner.append(f"CAST({sql} AS DOUBLE) AS {names[a]}")
        if inner:
            stage(inner)
        outer = []
        for x in windows:
            sql, names[x] = column(x), f"n{len(names)}"
            outer.append(f"{sql} AS {names[x]}")
        stage(outer)
    made = [f"CAST({column(x)} AS DOUBLE)" for x in factors.values()]
    if digits is not None:
        made = [rounded(x, digits) for x in made]
    found = [*[f'"{c}"' for c in columns], *[f'{x} AS "{n}"' for n, x in zip(factors, made, strict=True)]]
    return f"WITH {', '.join(parts)} SELECT {', '.join(found)} FROM s{len(parts) - 1}"
