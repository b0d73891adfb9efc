"""Five classic style factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.plans.graph import Node, call, compile_factors, field, node


def _treated(x: Node) -> Node:
    """Winsorized, then standardised, by date."""
    return call("cs_standard", call("cs_winsorize", x, n=(0.01, 0.99)))


def _momentum() -> Node:
    r = field("returns")
    return call("ts_sum", r, n=(52, 40)) - call("ts_sum", r, n=(4, 3))


STYLES: dict[str, Node] = {
    "momentum": _treated(_momentum()),
    "value": _treated(field("book_to_price")),
    "quality": _treated(field("roe")),
    "low_vol": _treated(-field("volatility")),
    "size": _treated(-call("log", field("market_cap"))),
}


def add_styles(universe: DataFrame, names: list[str] | None = None, neutralize: bool = True, least: int = 10) -> DataFrame:
    """``universe`` with style factors: winsorized, standardised and, if asked, without their industry's mean and standardised again.

    Dates with fewer than ``least`` values are not neutralised. Needs returns,
    book_to_price, roe, volatility, market_cap and industry.
    """
    chosen = {n: STYLES[n] for n in (names or STYLES)}
    if not neutralize:
        return compile_factors(universe, chosen)
    given = universe.withColumn("_industry", F.col("industry"))
    neutral = {n: call("cs_standard", Node("cs_neutralize", (x, field("_industry")), (least,))) for n, x in chosen.items()}
    return compile_factors(given, {n: node(x) for n, x in neutral.items()}).drop("_industry")
