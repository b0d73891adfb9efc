"""New factors from old ones: rolling operators over each, and arithmetic of pairs."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import DataFrame

from factorloom.plans.graph import Node, call, compile_factors, field

WINDOWS = (5, 10, 20, 40, 60)
#: The expander's operators by the names they have in columns.
ROLLING = {
    "tsrank": "ts_rank",
    "tszscore": "ts_zscore",
    "tsdelta": "ts_delta",
    "tsdecay": "ts_decay_linear",
    "tsmax": "ts_max",
    "tsmin": "ts_min",
    "tsstd": "ts_std",
}
PAIRS = {
    "mul": lambda a, b: a * b,
    "div": lambda a, b: a / (abs(b) + 1e-12) * call("sign", b),
    "sub": lambda a, b: a - b,
}


def _known(operators: Iterable[str] | None, table: dict) -> list[str]:
    unknown = set(operators or ()) - table.keys()
    if unknown:
        raise ValueError(f"no such operators: {sorted(unknown)}; there are {sorted(table)}")
    return list(operators or table)


def expanded_factors(
    columns: list[str], windows: Iterable[int] = WINDOWS, operators: Iterable[str] | None = None
) -> dict[str, Node]:
    """{column}_{operator}_{window} for every column, operator and window."""
    windows = list(windows)
    return {
        f"{c}_{op}_{w}": call(ROLLING[op], field(c), n=(w,)) for c in columns for op in _known(operators, ROLLING) for w in windows
    }


def expand_factors(
    panel: DataFrame, columns: list[str], windows: Iterable[int] = WINDOWS, operators: Iterable[str] | None = None
) -> DataFrame:
    """``panel`` with the expanded factors of its columns."""
    return compile_factors(panel, expanded_factors(columns, windows, operators))


def crossed_factors(columns: list[str], operators: Iterable[str] | None = None) -> dict[str, Node]:
    """{a}_X_{b}_{operator} for every unordered pair of columns."""
    return {
        f"{a}_X_{b}_{op}": PAIRS[op](field(a), field(b))
        for a, b in combinations(columns, 2)
        for op in _known(operators, PAIRS)
    }


def cross_all(panel: DataFrame, columns: list[str], operators: Iterable[str] | None = None) -> DataFrame:
    """``panel`` with all crosses of its columns."""
    return compile_factors(panel, crossed_factors(columns, operators))


def cross_factors(
    panel: DataFrame,
    columns: list[str],
    forward: str = "fwd_return",
    threshold: float = 0.02,
    operators: Iterable[str] | None = None,
    most: int = 500,
) -> DataFrame:
    """``panel`` with the first ``most`` crosses whose mean rank IC is over ``threshold`` in size; all if ``forward`` is missing.

    The ICs of all candidates come from one job; only their names are decided
    on the driver.
    """
    from factorloom.operators.evaluate import mean_ic

    made = crossed_factors(columns, operators)
    if forward not in panel.columns:
        names = list(made)[:most]
    else:
        ics = mean_ic(compile_factors(panel, made), list(made), forward)
        names = [n for n in made if abs(ics.get(n) or 0.0) > threshold][:most]
    return compile_factors(panel, {n: made[n] for n in names})
