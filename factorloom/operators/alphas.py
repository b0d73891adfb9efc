"""The forty formulaic alphas, as expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factorloom.plans.graph import Node, call, compile_factors, field

O, H, L, C, V, VW, R = (field(c) for c in ("open", "high", "low", "close", "volume", "vwap", "returns"))


def rank(x):
    """Average rank of the date over its values."""
    return call("cs_rank", x)


def scale(x):
    """Over the date's sum of absolute values."""
    return call("cs_scale", x)


def sign(x):
    """-1, 0 or 1."""
    return call("sign", x)


def delay(x, n):
    """n rows before."""
    return call("ts_delay", x, n=(n,))


def delta(x, n):
    """The change over n rows."""
    return call("ts_delta", x, n=(n,))


def _rolling(op):
    return lambda *a: call(op, *a[:-1], n=(a[-1],))


mean, total, deviation = _rolling("ts_mean"), _rolling("ts_sum"), _rolling("ts_std")
lowest, highest, place = _rolling("ts_min"), _rolling("ts_max"), _rolling("ts_argmax")
series_rank, correlation, covariance = _rolling("ts_rank"), _rolling("ts_corr"), _rolling("ts_cov")
decay = _rolling("ts_decay_linear")


def where(condition, yes, no):
    """One of two, ``no`` where the condition is unknown."""
    return call("where", condition, yes, no)


ADV20 = mean(V, 20)
TURN = (delay(C, 20) - delay(C, 10)) / 10 - (delay(C, 10) - C) / 10
_D1, _D7 = delta(C, 1), delta(C, 7)
_SUMS = total(O, 5) * total(R, 5)
_LOW5 = lowest(L, 5)

ALPHAS: dict[str, Node] = {
    "alpha001": rank(place(call("power", where(R < 0, deviation(R, 20), C), n=(2,)), 5)) - 0.5,
    "alpha002": -correlation(rank(delta(call("log", V), 2)), rank((C - O) / O), 6),
    "alpha003": -correlation(rank(O), rank(V), 10),
    "alpha004": -series_rank(rank(L), 9),
    "alpha006": -correlation(O, V, 10),
    "alpha007": where(ADV20 < V, -series_rank(abs(_D7), 60) * sign(_D7), -1),
    "alpha008": -rank(_SUMS - delay(_SUMS, 10)),
    "alpha009": where(lowest(_D1, 5) > 0, _D1, where(highest(_D1, 5) < 0, _D1, -_D1)),
    "alpha012": sign(delta(V, 1)) * -_D1,
    "alpha013": -rank(covariance(rank(C), rank(V), 5)),
    "alpha014": -rank(delta(R, 3)) * correlation(O, V, 10),
    "alpha016": -rank(covariance(rank(H), rank(V), 5)),
    "alpha017": -rank(series_rank(C, 10)) * rank(delta(_D1, 1)) * rank(series_rank(V / ADV20, 5)),
    "alpha018": -rank(deviation(abs(C - O), 5) + (C - O) + correlation(C, O, 10)),
    "alpha020": -rank(O - delay(H, 1)) * rank(O - delay(C, 1)) * rank(O - delay(L, 1)),
    "alpha021": where(
        mean(C, 8) + deviation(C, 8) < mean(C, 2),
        -1,
        where(mean(C, 2) < mean(C, 8) - deviation(C, 8), 1, where(V / ADV20 < 1, -1, 1)),
    ),
    "alpha022": -delta(correlation(H, V, 5), 5) * rank(deviation(C, 20)),
    "alpha023": where(mean(H, 20) < H, -delta(H, 2), 0),
    "alpha024": where(delta(mean(C, 100), 100) / delay(C, 100) < 0.05, -(C - lowest(C, 100)), -delta(C, 3)),
    "alpha026": -highest(correlation(series_rank(V, 5), series_rank(H, 5), 5), 3),
    "alpha028": scale(correlation(ADV20, L, 5) + (H + L) / 2 - C),
    "alpha029": series_rank(delay(-R, 6), 5)
    + lowest(rank(scale(call("log", total(lowest(rank(-rank(delta(C - 1, 5))), 2), 1)))), 5),
    "alpha031": rank(decay(-rank(delta(C, 10)), 10)) + rank(-delta(C, 3)) + sign(scale(correlation(ADV20, L, 12))),
    "alpha032": scale(mean(C, 7) - C) + 20 * scale(correlation(VW, delay(C, 5), 230)),
    "alpha033": rank(-(1 - O / C)),
    "alpha034": rank((1 - rank(deviation(R, 2) / deviation(R, 5))) + (1 - rank(_D1))),
    "alpha035": series_rank(V, 32) * (1 - series_rank(C + H - L, 16)) * (1 - series_rank(R, 32)),
    "alpha037": rank(correlation(delay(O - C, 1), C, 200)) + rank(O - C),
    "alpha038": -rank(series_rank(C, 10)) * rank(C / O),
    "alpha040": -rank(deviation(H, 10)) * correlation(H, V, 10),
    "alpha041": call("sqrt", H * L) - VW,
    "alpha042": rank(VW - C) / rank(VW + C),
    "alpha043": series_rank(V / ADV20, 20) * series_rank(-_D7, 8),
    "alpha044": -correlation(H, rank(V), 5),
    "alpha045": -rank(total(delay(C, 5), 20) / 20) * correlation(C, V, 2) * rank(correlation(total(C, 5), total(C, 20), 2)),
    "alpha046": where(TURN > 0.25, -_D1, where(TURN < 0, _D1, -_D1)),
    "alpha049": where(TURN < -0.1, 1, -_D1),
    "alpha051": where(TURN < -0.05, 1, -_D1),
    "alpha052": (-_LOW5 + delay(_LOW5, 5)) * rank((total(R, 240) - total(R, 20)) / 220) * series_rank(V, 5),
    "alpha053": -delta(((C - L) - (H - C)) / (C - L + 1e-8), 9),
}


def add_alphas(panel: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``panel`` with the named alphas (all of them unless told)."""
    unknown = set(names or ()) - ALPHAS.keys()
    if unknown:
        raise ValueError(f"no such alphas: {sorted(unknown)}")
    return compile_factors(panel, {n: ALPHAS[n] for n in (names or ALPHAS)})
