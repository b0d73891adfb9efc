"""The multi-factor risk model: factor returns, their covariance, specific risk, pure portfolios and decompositions.

What is per asset and date stays in Spark; a cross-section is one group. What
comes to the driver is a table of factor returns: the looked-back dates times
the factors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom.operators.evaluate import finite
from factorloom.sources.stored import shared_folder

COUNTRY = "country"


@dataclass(frozen=True)
class RiskModel:
    """Names of the style columns and of the industry, and the model's parameters.

    half_life: of the weights of covariances and specific risks; regime_half_life:
    of the weights by which recent volatility is measured; caution: what corrected
    roots of eigenvalues are multiplied by.
    """

    styles: tuple[str, ...]
    industry: str = "industry"
    lookback: int = 52
    half_life: float = 52.0
    lags: int = 2
    simulations: int = 100
    seed: int = 42
    regime_half_life: float = 26.0
    caution: float = 1.2


def exponential_weights(n: int, half_life: float) -> np.ndarray:
    """Weights that halve every ``half_life`` places back from the newest, summing to 1."""
    w = 0.5 ** (np.arange(n - 1, -1, -1) / half_life)
    return w / w.sum()


def exposures(universe: DataFrame, model: RiskModel) -> DataFrame:
    """(date, asset, industry, market_cap, returns, styles …) of rows with all styles and an industry."""
    whole = F.lit(True)
    for s in model.styles:
        whole = whole & finite(F.col(s))
    rows = universe.filter(whole & F.col(model.industry).isNotNull())
    return rows.select("date", "asset", F.col(model.industry).cast("string").alias("industry"), "market_cap", "returns", *model.styles)


def lagged_pairs(universe: DataFrame, model: RiskModel, dates: int | None = None) -> DataFrame:
    """Exposures and caps of the panel's date before, with the returns of the date, for the last ``dates`` dates (the lookback's)."""
    days = universe.select("date").distinct()  # one row a date
    order = Window.orderBy("date")
    days = days.withColumn("prev", F.lag("date").over(order)).withColumn("back", F.row_number().over(Window.orderBy(F.desc("date"))))
    days = days.filter((F.col("back") < (dates or model.lookback)) & F.col("prev").isNotNull()).drop("back")
    before = exposures(universe, model).drop("returns").withColumnRenamed("date", "prev")
    now = universe.select("date", "asset", "returns").filter(finite(F.col("returns"))).join(F.broadcast(days), "date")
    return now.join(before, ["prev", "asset"]).drop("prev")


def _design(day: pd.DataFrame, model: RiskModel) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Design matrix, its factors' names and the industries' dummies."""
    industries = sorted(day["industry"].unique())
    dummies = (day["industry"].to_numpy()[:, None] == np.array(industries)[None, :]).astype(float)
    x = np.column_stack([np.ones(len(day)), day[list(model.styles)].to_numpy(float), dummies])
    return x, [COUNTRY, *model.styles, *[f"industry:{i}" for i in industries]], dummies


def industry_weights(universe: DataFrame, industry: str = "industry") -> DataFrame:
    """(date, industry, weight): an industry's share of the date's capitalisation, equal shares without any."""
    sums = universe.filter(F.col(industry).isNotNull()).groupBy("date", F.col(industry).alias("industry")).agg(
        F.sum(F.coalesce("market_cap", F.lit(0.0))).alias("cap")
    )
    day = Window.partitionBy("date")
    total = F.sum("cap").over(day)
    return sums.select("date", "industry", F.when(total > 0, F.col("cap") / total).otherwise(1 / F.count("*").over(day)).alias("weight"))


def factor_returns(universe: DataFrame, model: RiskModel) -> DataFrame:
    """(date, factor, ret): of each date a least-squares regression weighted by the root of the cap.

    Industry returns, weighted by the industries' caps, sum to 0. A date needs
    ten rows more than factors, all of the universe's industries counted; an
    industry without rows on a date has no return there. A date whose equations
    have no single solution, with or without that rule, is left out. Each
    cross-section is one task's small matrix.
    """
    least = 1 + len(model.styles) + universe.select(F.col(model.industry)).dropna().distinct().count() + 10

    def regress(day: pd.DataFrame) -> pd.DataFrame:
        x, names, dummies = _design(day, model)
        empty = pd.DataFrame({"date": day["date"].iloc[:0], "factor": pd.Series(dtype=str), "ret": pd.Series(dtype=float)})
        if len(day) < least:
            return empty
        cap = day["market_cap"].fillna(0).to_numpy(float)
        w = np.maximum(np.sqrt(cap), 1e-10)
        w = w / w.sum()
        shares = cap @ dummies
        rule = np.zeros(len(names))
        rule[-dummies.shape[1] :] = shares / shares.sum() if shares.sum() > 0 else 1 / len(shares)
        xw = x.T * w
        r = day["returns"].to_numpy(float)
        system = np.block([[xw @ x, rule[:, None]], [rule[None, :], np.zeros((1, 1))]])
        try:
            f = np.linalg.solve(system, np.append(xw @ r, 0.0))[:-1]
        except np.linalg.LinAlgError:
            try:
                f = np.linalg.solve(xw @ x, xw @ r)
            except np.linalg.LinAlgError:
                return empty
        return pd.DataFrame({"date": day["date"].iloc[0], "factor": names, "ret": f}) if np.isfinite(f).all() else empty

    kind = universe.schema["date"].dataType.simpleString()
    return lagged_pairs(universe, model).groupBy("date").applyInPandas(regress, f"date {kind}, factor string, ret double")


def returns_table(returns: DataFrame) -> pd.DataFrame:
    """Factor returns as a table, dates by factors, missing ones 0; a lookback's dates are few."""
    rows = returns.toPandas()
    return rows.pivot(index="date", columns="factor", values="ret").sort_index().fillna(0.0)


def newey_west(table: np.ndarray, weights: np.ndarray, lags: int) -> np.ndarray:
    """Weighted covariance of demeaned rows, with lagged products under Bartlett's weights; a product has the weight of its later row."""
    weighted = table * weights[:, None]
    cov = weighted.T @ table
    for lag in range(1, min(lags, len(table) - 1) + 1):
        cross = weighted[lag:].T @ table[:-lag]
        cov = cov + (1 - lag / (lags + 1)) * (cross + cross.T)
    return cov


def eigenvalue_bias(values: np.ndarray, n_dates: int, simulations: int, seed: int) -> np.ndarray:
    """Of eigenvalues in descending order the mean root of what samples of ``n_dates`` rows show over what is true.

    Sample eigenvalues don't change when all rows are turned, so samples are
    drawn along the eigenvectors: a row of normal numbers for each date, each
    number scaled by the root of its eigenvalue.
    """
    rng = np.random.default_rng(seed)
    total = np.zeros(len(values))
    for _ in range(simulations):
        sample = rng.standard_normal((n_dates, len(values))) * np.sqrt(values)
        shown = np.linalg.eigvalsh(np.atleast_2d(np.cov(sample, rowvar=False)))[::-1]
        total += np.sqrt(np.maximum(shown, 1e-12) / values)
    return total / simulations


def eigen_adjusted(cov: np.ndarray, n_dates: int, simulations: int, seed: int, caution: float = 1.2) -> np.ndarray:
    """Eigenvalues corrected by the bias that simulated samples of the same length show.

    Large eigenvalues come out too large in samples and small ones too small, so
    each is divided by the square of its bias (0.1 at least) and multiplied by
    that of ``caution``. Without simulations, or with under five dates more than
    factors, eigenvalues are only kept above 1e-12.
    """
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 1e-12), vectors[:, ::-1]
    if simulations > 0 and n_dates >= len(cov) + 5:
        values = values * (caution / np.maximum(eigenvalue_bias(values, n_dates, simulations, seed), 0.1)) ** 2
    made = (vectors * values) @ vectors.T
    return (made + made.T) / 2


def regime_scaled(cov: np.ndarray, table: np.ndarray, half_life: float) -> np.ndarray:
    """``cov`` times the recent mean of squared standardised returns."""
    sigma = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    w = exponential_weights(len(table), half_life)
    return cov * float(w @ ((table / sigma) ** 2).mean(axis=1))


def factor_covariance(table: pd.DataFrame, model: RiskModel) -> pd.DataFrame:
    """The covariance of factor returns: exponentially weighted, Newey-West, eigenvalues, volatility regime (of returns as they are, not less their mean)."""
    x = table.to_numpy()
    w = exponential_weights(len(x), model.half_life)
    own = x - w @ x
    cov = newey_west(own, w, model.lags)
    cov = eigen_adjusted(cov, len(x), model.simulations, model.seed, model.caution)
    return pd.DataFrame(regime_scaled(cov, x, model.regime_half_life), index=table.columns, columns=table.columns)


def specific_risk(universe: DataFrame, returns: DataFrame, model: RiskModel, annual: bool = True, min_names: int = 30) -> DataFrame:
    """(asset, raw, structural, risk): an asset's deviation that the factors don't explain, a year's unless told.

    raw: the exponentially weighted deviation of its residuals, missing ones as
    0, over the dates with ``min_names`` of them; 1e-6 at least. structural: from
    a regression of its log on the log cap of the last date, a million where
    that's missing (the median up to 30 assets). The risk is drawn towards the
    structural one by how far off raw is; raw and structural are a date's.
    """
    pairs = lagged_pairs(universe, model)
    # exposure times return, one factor a row: country and styles are columns, the industry its own name
    values = F.array(
        F.struct(F.lit(COUNTRY).alias("factor"), F.lit(1.0).alias("x")),
        F.struct(F.concat(F.lit("industry:"), F.col("industry")).alias("factor"), F.lit(1.0).alias("x")),
        *[F.struct(F.lit(s).alias("factor"), F.col(s).cast("double").alias("x")) for s in model.styles],
    )
    rows = pairs.select("date", "asset", "returns", F.explode(values).alias("e")).select("*", "e.factor", "e.x")
    explained = rows.join(F.broadcast(returns), ["date", "factor"]).groupBy("date", "asset").agg(
        (F.first("returns") - F.sum(F.col("x") * F.col("ret"))).alias("residual")
    )
    enough = explained.groupBy("date").agg(F.count("*").alias("_n")).filter(F.col("_n") >= min_names).select("date")  # one row a date
    shared_folder(universe.sparkSession)
    explained = explained.join(F.broadcast(enough), "date").checkpoint()  # the regressions stand below it, and it is used several times
    last = universe.agg(F.max("date")).first()[0]
    caps = universe.filter(F.col("date") == F.lit(last)).groupBy("asset").agg(F.max("market_cap").cast("double").alias("cap"))
    age = F.dense_rank().over(Window.orderBy(F.desc("date"))) - 1
    ages = explained.select("date").distinct().withColumn("g", F.pow(F.lit(0.5), age / model.half_life))
    dated = explained.join(F.broadcast(ages), "date")
    own = dated.groupBy("asset").agg(F.sum(F.col("g") * F.pow("residual", F.lit(2.0))).alias("_s"))
    total = ages.agg(F.sum("g").alias("_g"))
    deviation = F.sqrt(F.greatest(F.col("_s") / F.col("_g"), F.lit(1e-12)))
    own = own.join(F.broadcast(total)).join(caps, "asset", "left")
    raw = own.select("asset", F.coalesce("cap", F.lit(1e6)).alias("cap"), deviation.alias("raw"))
    fit = raw.filter((F.col("raw") > 0) & (F.col("cap") > 0)).agg(
        F.count("*").alias("n"),
        F.covar_samp(F.log("raw"), F.log("cap")).alias("c"),
        F.var_samp(F.log("cap")).alias("v"),
        F.avg(F.log("raw")).alias("my"),
        F.avg(F.log("cap")).alias("mx"),
        F.percentile("raw", F.lit(0.5)).alias("median"),
    )
    slope = F.coalesce(F.try_divide(F.col("c"), F.col("v")), F.lit(0.0))
    line = F.exp(F.col("my") + slope * (F.log("cap") - F.col("mx")))
    structural = F.when((F.col("n") > 30) & (F.col("cap") > 0), line).otherwise(F.col("median"))
    found = raw.join(F.broadcast(fit)).withColumn("structural", structural)
    pull = F.least(F.greatest(F.abs(F.try_divide(F.col("raw") - F.col("structural"), F.col("structural"))), F.lit(0.0)), F.lit(1.0))
    risk = (1 - pull) * F.col("raw") + pull * F.col("structural")
    return found.select("asset", "raw", "structural", (risk * (52**0.5 if annual else 1.0)).alias("risk"))


def distribution(specific: DataFrame, column: str = "risk") -> DataFrame:
    """(mean, median, p10, p90) of the assets' specific risks."""
    at = lambda q: F.percentile(column, F.lit(q))
    return specific.agg(F.avg(column).alias("mean"), at(0.5).alias("median"), at(0.1).alias("p10"), at(0.9).alias("p90"))


def largest_weights(weights: DataFrame, k: int = 3, by: tuple[str, ...] = ("date",), least: float = 1e-10) -> DataFrame:
    """(by, asset, weight, place, n_long, n_short): the ``k`` largest weights of each portfolio, equal ones by asset, and its numbers of longs and shorts.

    Weights up to ``least`` in size are none: they are what rounding leaves of 0.
    """
    own = Window.partitionBy(*by)
    rows = weights.withColumns(
        {
            "place": F.row_number().over(own.orderBy(F.desc("weight"), "asset")),
            "n_long": F.count_if(F.col("weight") > least).over(own),
            "n_short": F.count_if(F.col("weight") < -least).over(own),
        }
    )
    return rows.filter(F.col("place") <= k).select(*by, "asset", "weight", "place", "n_long", "n_short")


def pure_portfolio(universe: DataFrame, model: RiskModel, target: str) -> DataFrame:
    """(date, asset, weight): of each date the portfolio with exposure to ``target`` alone, longs and shorts 2 together."""

    def solve(day: pd.DataFrame) -> pd.DataFrame:
        x, names, _ = _design(day, model)
        if target not in names:
            return day.iloc[:0][["date", "asset"]].assign(weight=pd.Series(dtype=float))
        w = x @ np.linalg.pinv(x.T @ x)[:, names.index(target)]
        gross = np.abs(w).sum()
        return pd.DataFrame({"date": day["date"], "asset": day["asset"], "weight": 2 * w / gross if gross > 1e-12 else w})

    kinds = {c: universe.schema[c].dataType.simpleString() for c in ("date", "asset")}
    return exposures(universe, model).groupBy("date").applyInPandas(solve, f"date {kinds['date']}, asset {kinds['asset']}, weight double")


def decompose(
    universe: DataFrame, weights: DataFrame, covariance: pd.DataFrame, specific: DataFrame, model: RiskModel, date: object
) -> dict[str, object]:
    """Variance of a portfolio (asset, weight) on a date: by factors, specific, total, contributions and shares.

    Exposures are one aggregation; a row a factor comes to the driver.
    """
    day = exposures(universe, model).filter(F.col("date") == F.lit(date)).join(weights, "asset").join(specific.select("asset", "risk"), "asset", "left")
    sums = [F.sum("weight").alias(COUNTRY), F.sum(F.pow(F.col("weight") * F.coalesce("risk", F.lit(0.0)), F.lit(2.0))).alias("_specific")]
    sums += [F.sum(F.col("weight") * F.col(s)).alias(s) for s in model.styles]
    first = day.agg(*sums).first().asDict()
    own = {r["industry"]: r["h"] for r in day.groupBy("industry").agg(F.sum("weight").alias("h")).collect()}
    h = np.array([(first.get(f) if not f.startswith("industry:") else own.get(f.removeprefix("industry:"))) or 0.0 for f in covariance.columns])
    marginal = covariance.to_numpy() @ h
    part = h * marginal
    by_factor, alone = float(part.sum()), float(first["_specific"] or 0.0)
    total = by_factor + alone
    share = {f: (float(p) / total if total > 0 else 0.0) for f, p in zip(covariance.columns, part, strict=True)}
    return {
        "factor_variance": by_factor,
        "specific_variance": alone,
        "total_risk": max(total, 0.0) ** 0.5,
        "exposure": dict(zip(covariance.columns, map(float, h), strict=True)),
        "marginal": dict(zip(covariance.columns, map(float, marginal), strict=True)),
        "share": share,
        "style_share": sum(share.get(s, 0.0) for s in model.styles),
    }
