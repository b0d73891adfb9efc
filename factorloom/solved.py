"""Queries over the test tables whose SQL solves small systems of equations: risk model, combination, ridge and reports.

The SQL doesn't follow the library's formulas: regressions with industries are
solved within industries, systems by Cramer's rule, greedy choices by recursion.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom import queries as base
from factorloom.operators import backtest, combine, costs, evaluate, expand, risk, style
from factorloom.plans import library, oracle, runs
from factorloom.plans.graph import compile_factors, field
from factorloom.sources import panel as sources
from factorloom.sources import universe as universes

Query = Callable[[SparkSession, str], DataFrame]
rounded, rounded_sql = base.rounded, base.rounded_sql


def determinant(a: list[list[str]]) -> str:
    """SQL for the determinant of a matrix of SQL expressions."""
    if len(a) == 1:
        return a[0][0]
    parts = []
    for k, x in enumerate(a[0]):
        minor = determinant([[y for j, y in enumerate(row) if j != k] for row in a[1:]])
        parts.append(f"{'-' if k % 2 else '+'} ({x}) * ({minor})")
    return " ".join(parts)


def solutions(a: list[list[str]], b: list[str]) -> list[str]:
    """SQL for each unknown of a * x = b, by Cramer's rule."""
    whole = determinant(a)
    found = []
    for k in range(len(b)):
        other = [[b[i] if j == k else x for j, x in enumerate(row)] for i, row in enumerate(a)]
        found.append(f"(({determinant(other)}) / ({whole}))")
    return found


STYLES = list(base.RISK.styles)
N = len(STYLES)
PLAIN = replace(base.RISK, simulations=0)
_STYLED = oracle.factor_sql(base._UNIVERSE, ["asset", "date", "industry", "market_cap", "returns"], {s: style.STYLES[s] for s in STYLES})
_KNOWN = " AND ".join(f"{s} IS NOT NULL" for s in STYLES) + " AND industry IS NOT NULL"

_ROWS = f"""
styled AS MATERIALIZED ({_STYLED}),
days AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev, row_number() OVER (ORDER BY date DESC) AS back FROM (SELECT DISTINCT date FROM styled)),
pairs AS MATERIALIZED (
    SELECT d.date, n.asset, n.returns AS r, CAST(b.industry AS VARCHAR) AS industry, coalesce(b.market_cap, 0) AS cap,
           greatest(sqrt(coalesce(b.market_cap, 0)), 1e-10) AS w0, {', '.join(f'b.{s} AS s{k}' for k, s in enumerate(STYLES))},
           count(*) OVER (PARTITION BY d.date) AS n
    FROM days d JOIN styled n ON n.date = d.date AND n.returns IS NOT NULL
    JOIN (SELECT * FROM styled WHERE {_KNOWN}) b ON b.date = d.prev AND b.asset = n.asset WHERE d.back < {base.RISK.lookback}
),
scaled AS (SELECT *, w0 / sum(w0) OVER (PARTITION BY date) AS w FROM pairs WHERE n >= (SELECT {1 + N + 10} + count(DISTINCT industry) FROM styled)),
within_ AS (
    SELECT *, sum(w * r) OVER i / sum(w) OVER i AS mr, {', '.join(f'sum(w * s{k}) OVER i / sum(w) OVER i AS m{k}' for k in range(N))}
    FROM scaled WINDOW i AS (PARTITION BY date, industry)
),
normal AS (
    SELECT date, {', '.join(f'sum(w * (s{j} - m{j}) * (s{k} - m{k})) AS a{j}{k}' for j in range(N) for k in range(N))},
           {', '.join(f'sum(w * (s{k} - m{k}) * (r - mr)) AS b{k}' for k in range(N))} FROM within_ GROUP BY date
),
slopes AS (SELECT date, {', '.join(f'{x} AS f{k}' for k, x in enumerate(solutions([[f'a{j}{k}' for k in range(N)] for j in range(N)], [f'b{k}' for k in range(N)])))} FROM normal),
levels AS (
    SELECT x.date, x.industry, any_value(mr - {' - '.join(f'f{k} * m{k}' for k in range(N))}) AS a, sum(cap) AS cap
    FROM within_ x JOIN slopes f ON f.date = x.date GROUP BY x.date, x.industry
),
country AS (SELECT date, sum(a * cap) / sum(cap) AS c FROM levels GROUP BY date),
factor_returns AS MATERIALIZED (
    SELECT date, 'country' AS factor, c AS ret FROM country
    UNION ALL SELECT l.date, 'industry:' || industry, a - c FROM levels l JOIN country c ON c.date = l.date
    {' '.join(f"UNION ALL SELECT date, '{s}', f{k} FROM slopes" for k, s in enumerate(STYLES))}
)
"""
_COVARIANCE = f"""
names AS (SELECT DISTINCT factor FROM factor_returns),
moments AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM factor_returns)),
filled AS (
    SELECT t, n, m.date, names.factor, coalesce(ret, 0) AS x, pow(0.5, (n - 1 - t) / {base.RISK.half_life}) AS g
    FROM moments m CROSS JOIN names LEFT JOIN factor_returns f ON f.date = m.date AND f.factor = names.factor
),
demeaned AS MATERIALIZED (
    SELECT t, n, factor, g / sum(g) OVER f AS g, x - sum(g * x) OVER f / sum(g) OVER f AS x, x AS ret, pow(0.5, (n - 1 - t) / {base.RISK.regime_half_life}) AS recent
    FROM filled WINDOW f AS (PARTITION BY factor)
),
lagged AS (
    SELECT a.factor AS a, b.factor AS b, a.t - b.t AS lag, sum(a.g * a.x * b.x) AS c
    FROM demeaned a JOIN demeaned b ON b.t BETWEEN a.t - {base.RISK.lags} AND a.t GROUP BY ALL
),
newey AS (
    SELECT p.a, p.b, sum(CASE WHEN p.lag = 0 THEN p.c ELSE (1 - p.lag / {base.RISK.lags + 1}.0) * (p.c + q.c) END) AS c
    FROM lagged p JOIN lagged q ON q.a = p.b AND q.b = p.a AND q.lag = p.lag GROUP BY p.a, p.b
),
spread AS (SELECT a AS factor, greatest(c, 1e-12) AS v FROM newey WHERE a = b),
regime AS (SELECT sum(g * m) / sum(g) AS k FROM (SELECT t, any_value(recent) AS g, avg(ret * ret / v) AS m FROM demeaned d JOIN spread s ON s.factor = d.factor GROUP BY t)),
covariance AS MATERIALIZED (SELECT a, b, c * k AS covariance FROM newey, regime)
"""
_SPECIFIC = f"""
residuals AS (
    SELECT x.date, x.asset, r - l.a - {' - '.join(f'f{k} * s{k}' for k in range(N))} AS e, count(*) OVER (PARTITION BY x.date) AS m
    FROM scaled x JOIN levels l ON l.date = x.date AND l.industry = x.industry JOIN slopes f ON f.date = x.date
),
ages AS (SELECT date, pow(0.5, (row_number() OVER (ORDER BY date DESC) - 1) / {base.RISK.half_life}) AS g FROM (SELECT DISTINCT date FROM residuals WHERE m >= 30)),
own AS (
    SELECT asset, sqrt(greatest(sum(g * e * e) / (SELECT sum(g) FROM ages), 1e-12)) AS raw
    FROM residuals r JOIN ages a ON a.date = r.date GROUP BY asset
),
capped AS (
    SELECT o.asset, raw, coalesce(market_cap, 1e6) AS cap FROM own o
    LEFT JOIN (SELECT asset, market_cap FROM styled WHERE date = (SELECT max(date) FROM styled)) u ON u.asset = o.asset
),
line AS (
    SELECT count(*) AS n, regr_slope(ln(raw), ln(cap)) AS slope, regr_intercept(ln(raw), ln(cap)) AS level, median(raw) AS mid
    FROM capped WHERE cap > 0 AND raw > 0
),
risks AS (
    SELECT asset, raw, structural, pull * structural + (1 - pull) * raw AS daily FROM (
        SELECT *, least(abs(raw - structural) / structural, 1) AS pull FROM (
            SELECT asset, raw, CASE WHEN n > 30 AND cap > 0 THEN exp(level + slope * ln(cap)) ELSE mid END AS structural FROM capped, line))
)
"""
_PURE = f"""
styled AS MATERIALIZED ({_STYLED}),
last_ AS (SELECT max(date) AS date FROM styled),
rows_ AS (
    SELECT *, {', '.join(f'{s} - avg({s}) OVER (PARTITION BY industry) AS d{k}' for k, s in enumerate(STYLES))}
    FROM styled WHERE date = (SELECT date FROM last_) AND {_KNOWN}
),
"""


def _pure_sql() -> str:
    parts = []
    for k, s in enumerate(STYLES):
        others = [j for j in range(N) if j != k]
        a = [[f"(SELECT sum(d{i} * d{j}) FROM rows_)" for j in others] for i in others]
        found = solutions(a, [f"(SELECT sum(d{i} * d{k}) FROM rows_)" for i in others])
        parts.append(f"SELECT '{s}' AS factor, date, asset, d{k} - {' - '.join(f'{x} * d{j}' for x, j in zip(found, others, strict=True))} AS e FROM rows_")
    return f"WITH {_PURE} alone AS ({' UNION ALL '.join(parts)}) SELECT factor, date, asset, 2 * e / sum(abs(e)) OVER (PARTITION BY factor) AS weight FROM alone"


def _pure_last(spark: SparkSession, folder: str) -> DataFrame:
    universe = base.styled(spark, folder)
    date = universe.agg(F.max("date")).first()[0]
    rows = universe.filter(F.col("date") == F.lit(date))
    parts = [risk.pure_portfolio(rows, base.RISK, s).select(F.lit(s).alias("factor"), "date", "asset", "weight") for s in STYLES]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def _specific(spark: SparkSession, folder: str) -> DataFrame:
    universe = base.styled(spark, folder)
    return risk.specific_risk(universe, risk.factor_returns(universe, base.RISK), base.RISK)


def _covariance(spark: SparkSession, folder: str) -> DataFrame:
    cov = risk.factor_covariance(risk.returns_table(risk.factor_returns(base.styled(spark, folder), PLAIN)), PLAIN)
    rows = [(a, b, float(cov.loc[a, b])) for a in cov.index for b in cov.columns]
    return rounded(spark.createDataFrame(rows, "a string, b string, covariance double"), 3)


def _decomposition(spark: SparkSession, folder: str) -> DataFrame:
    factors, found = base.decomposed(spark, folder, PLAIN)
    rows = [(f, float(found["exposure"][f]), float(found["share"][f])) for f in factors]
    rows.append(("specific", 0.0, found["specific_variance"] / found["total_risk"] ** 2))
    return rounded(spark.createDataFrame(rows, "factor string, exposure double, share double"), 4)


_DECOMPOSITION = f"""
WITH {_ROWS}, {_COVARIANCE}, {_SPECIFIC},
day AS (SELECT *, 1.0 / (SELECT count(*) FROM styled WHERE date = (SELECT max(date) FROM styled)) AS h FROM styled WHERE date = (SELECT max(date) FROM styled) AND {_KNOWN}),
held AS (
    SELECT 'country' AS factor, sum(h) AS h FROM day
    {' '.join(f"UNION ALL SELECT '{s}', sum(h * {s}) FROM day" for s in STYLES)}
    UNION ALL SELECT 'industry:' || CAST(industry AS VARCHAR), sum(h) FROM day GROUP BY industry
),
exposed AS (SELECT n.factor, coalesce(h, 0) AS h FROM names n LEFT JOIN held ON held.factor = n.factor),
parts AS (SELECT x.factor, x.h, x.h * sum(c.covariance * y.h) AS part FROM exposed x JOIN covariance c ON c.a = x.factor JOIN exposed y ON y.factor = c.b GROUP BY x.factor, x.h),
alone AS (SELECT sum(pow(h * coalesce(daily * sqrt(52.0), 0), 2)) AS v FROM day d LEFT JOIN risks r ON r.asset = d.asset),
total AS (SELECT (SELECT sum(part) FROM parts) + (SELECT v FROM alone) AS v)
SELECT factor, h AS exposure, part / (SELECT v FROM total) AS share FROM parts
UNION ALL SELECT 'specific', 0.0, (SELECT v FROM alone) / (SELECT v FROM total)
"""


def _max_icir_sql() -> str:
    names, k = list(base.SUBJECTS), len(base.SUBJECTS)
    cov = [[f"covar_samp(x{min(i, j)}, x{max(i, j)})" + (" + 1e-6" if i == j else "") for j in range(k)] for i in range(k)]
    made = ", ".join(f"{cov[i][j]} AS c{i}{j}" for i in range(k) for j in range(k))
    found = solutions([[f"c{i}{j}" for j in range(k)] for i in range(k)], [f"m{i}" for i in range(k)])
    size = " + ".join(f"abs(w{i})" for i in range(k))
    weights = " UNION ALL ".join(f"SELECT date, '{f}' AS factor, CASE WHEN least >= 10 AND {size} > 1e-12 THEN w{i} / ({size}) ELSE {1 / k} END AS weight FROM solved" for i, f in enumerate(names))
    return f"""
    (WITH ics AS MATERIALIZED ({base._ic_sql(True, 30, True)}), known AS MATERIALIZED (
        SELECT factor, date, ic, row_number() OVER (PARTITION BY factor ORDER BY date) AS k FROM ics WHERE ic IS NOT NULL
    ), grid AS (
        SELECT d.date, f.factor, coalesce((SELECT max(k) FROM known x WHERE x.factor = f.factor AND x.date <= d.date), 0) AS last
        FROM (SELECT DISTINCT date FROM ics) d, (SELECT DISTINCT factor FROM ics) f
    ), tails AS (SELECT *, min(least(last, {combine.WINDOW})) OVER (PARTITION BY date) AS least FROM grid),
    placed AS (
        SELECT t.date, least, k.k - (t.last - least) AS j, {', '.join(f"max(CASE WHEN t.factor = '{f}' THEN ic END) AS x{i}" for i, f in enumerate(names))}
        FROM tails t LEFT JOIN known k ON k.factor = t.factor AND k.k > t.last - least AND k.k <= t.last GROUP BY ALL
    ), sums AS (
        SELECT date, any_value(least) AS least, {made},
               {', '.join(f"sum(x{i} * pow(0.5, (least - j) / {combine.HALF_LIFE}.0)) / sum(pow(0.5, (least - j) / {combine.HALF_LIFE}.0)) AS m{i}" for i in range(k))}
        FROM placed GROUP BY date
    ), solved AS (SELECT date, least, {', '.join(f'{x} AS w{i}' for i, x in enumerate(found))} FROM sums)
    {weights})
    """


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(combine.summary(base.subjects(spark, folder), list(base.SUBJECTS), "icir")[0])


def _summary_sql() -> str:
    days = f"(SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS d FROM (SELECT DISTINCT date FROM {base._PANEL})) WHERE d > 62)"
    combined = (
        f"(SELECT l.date, asset, 'combined' AS factor, sum(weight * coalesce(value, 0)) AS value, any_value(forward) AS forward FROM {base._LONG} l"
        f" JOIN {base._weights_sql('icir')} w ON w.date = l.date AND w.factor = l.factor WHERE l.date IN {days} GROUP BY l.date, asset)"
    )
    return (
        "SELECT *, CASE WHEN ic_std > 0 THEN ic_mean / ic_std ELSE 0 END AS icir FROM (SELECT count(ic) AS n_dates, avg(ic) AS ic_mean,"
        " stddev_samp(ic) AS ic_std, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS positive"
        f" FROM ({base._ic_sql(True, 30, source=combined)}) WHERE ic IS NOT NULL)"
    )


def _ridge_sql() -> str:
    x, k = base._FEATURES, len(base._FEATURES)
    rows = " AND ".join(f"{f} IS NOT NULL" for f in [*x, "fwd_return"])
    a = [[f"(c{min(i, j)}{max(i, j)} * n" + (" + 1)" if i == j else ")") for j in range(k)] for i in range(k)]
    found = solutions(a, [f"(d{i} * n)" for i in range(k)])
    corr = lambda p, q: f"covar_pop({p}, {q}) / (stddev_pop({p}) * stddev_pop({q}))"
    return f"""
    WITH whole AS MATERIALIZED (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY date) AS names FROM {base._SUBJECTS} WHERE {rows}) WHERE names >= 5),
    sums AS (
        SELECT count(*) AS n, avg(fwd_return) AS my, stddev_pop(fwd_return) AS sy,
               {', '.join(f'avg({f}) AS m{i}, stddev_pop({f}) AS s{i}, {corr(f, "fwd_return")} AS d{i}' for i, f in enumerate(x))},
               {', '.join(f'{corr(x[i], x[j])} AS c{i}{j}' for i in range(k) for j in range(i, k))}
        FROM whole WHERE date < DATE '{base._CUT}'
    ), solved AS (SELECT *, {', '.join(f'{w} AS w{i}' for i, w in enumerate(found))} FROM sums)
    SELECT asset, date, my + sy * ({' + '.join(f'w{i} * ({f} - m{i}) / s{i}' for i, f in enumerate(x))}) AS prediction
    FROM whole, solved WHERE date >= DATE '{base._CUT}'
    """


def _kept_sql(threshold: float = 0.5) -> str:
    names = list(base.SUBJECTS)
    alike = f"SELECT a, b FROM ({base._redundancy_sql(names)}) WHERE abs(correlation) >= {threshold}"
    place = " ".join(f"WHEN '{f}' THEN {i}" for i, f in enumerate(names))
    return f"""
    WITH RECURSIVE alike AS MATERIALIZED ({alike}), both_ AS (SELECT a, b FROM alike UNION ALL SELECT b, a FROM alike),
    ordered AS MATERIALIZED (
        SELECT s.factor, row_number() OVER (ORDER BY abs_ic DESC, CASE s.factor {place} END) AS k,
               coalesce((SELECT list(b) FROM both_ WHERE a = s.factor), []) AS likes
        FROM ({base._summary_sql(base._ic_sql())}) s
    ), chosen AS (
        SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS kept
        UNION ALL
        SELECT o.k, CASE WHEN len(list_intersect(c.kept, o.likes)) = 0 THEN list_append(c.kept, o.factor) ELSE c.kept END
        FROM chosen c JOIN ordered o ON o.k = c.k + 1
    )
    SELECT unnest(kept) AS factor FROM (SELECT kept FROM chosen ORDER BY k DESC LIMIT 1)
    """


_COMPARISON = f"""
SELECT s.factor, printf('%.4f', ic_mean) AS ic_mean, printf('%.4f', icir) AS icir, printf('%.1f%%', positive * 100) AS positive,
       printf('%.2f%%', annual_return * 100) AS annual_return, printf('%.2f', coalesce(annual_return / nullif(annual_vol, 0), 0)) AS sharpe
FROM ({base._summary_sql(base._ic_sql(True, 30))}) s
JOIN (SELECT factor, avg(LS) * 52 AS annual_return, stddev_samp(LS) * sqrt(52.0) AS annual_vol FROM {base._GROUP_RETURNS} GROUP BY factor) g ON g.factor = s.factor
"""


def _crossed(spark: SparkSession, folder: str) -> DataFrame:
    rows = base.subjects(spark, folder)
    found = expand.cross_factors(rows, list(base.SUBJECTS), threshold=0.1)
    made = [c for c in found.columns if "_X_" in c]
    return rounded(found.unpivot(["asset", "date"], made, "factor", "value").filter(F.col("value").isNotNull()))


def _long_sql(source: str, columns: list[str], factors: list[str]) -> str:
    return "(" + " UNION ALL ".join(f"SELECT asset, date, '{f}' AS factor, \"{f}\" AS value, fwd_return AS forward FROM ({source})" for f in factors) + ")"


def _crossed_sql() -> str:
    made = expand.crossed_factors(list(base.SUBJECTS))
    rows = _long_sql(oracle.factor_sql(base._SUBJECTS, ["asset", "date", "fwd_return"], made), [], list(made))
    sql = (
        f"WITH crossed AS MATERIALIZED (SELECT * FROM {rows}), strong AS (SELECT factor FROM ({base._ic_sql(True, 2, source='crossed')}) GROUP BY factor HAVING abs(avg(ic)) > 0.1)"
        " SELECT asset, date, factor, value FROM crossed WHERE value IS NOT NULL AND factor IN (SELECT factor FROM strong)"
    )
    return rounded_sql(sql, ["value"], ["asset", "date", "factor"])


def _library_gate(layers: list[str]) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        bars = sources.weekly_panel(spark, folder, returns=False)
        return rounded(library.gate(bars, library.library(layers)))

    return query


def _library_sql(layers: list[str], at_once: int = 64) -> str:
    """The gate over the panel's first hundred dates; each run of factors is a table of its own, unpivoted."""
    made = library.library(layers)
    names = list(made)
    parts = [{n: made[n] for n in names[i : i + at_once]} for i in range(0, len(names), at_once)]
    keys = ["asset", "date", "fwd_return"]
    tables = [f"part{k} AS MATERIALIZED ({oracle.factor_sql('early', keys, part)})" for k, part in enumerate(parts)]
    rows = " UNION ALL ".join(
        f"SELECT asset, date, factor, value, fwd_return AS forward FROM (UNPIVOT part{k} ON COLUMNS(* EXCLUDE (asset, date, fwd_return)) INTO NAME factor VALUE value)"
        for k in range(len(parts))
    )
    sql = (
        f"WITH early AS MATERIALIZED (SELECT * FROM {base._FORWARD} WHERE date IN (SELECT date FROM (SELECT DISTINCT date FROM {base._PANEL}) ORDER BY date LIMIT 100)),"
        f" {', '.join(tables)}, made AS MATERIALIZED ({rows})"
        f" SELECT factor, count(ic) AS n_dates, avg(ic) AS ic_mean FROM ({base._ic_sql(True, 20, source='made')})"
        " WHERE ic IS NOT NULL GROUP BY factor HAVING count(ic) >= 10 AND abs(avg(ic)) >= 0.02"
    )
    return rounded_sql(sql, ["ic_mean"], ["factor", "n_dates"])


#: The layers of the research queries; ``library_gate`` has all five.
RESEARCHED = ("alphas", "expanded", "crossed")


def _research(models: bool) -> Query:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        bars = sources.weekly_panel(spark, folder, returns=False)
        with runs.research_run(bars, RESEARCHED, models=None if models else {}, min_names=5) as run:
            if models:
                return rounded(run.steps["models"].drop("seconds"))
            rows = [tuple(r) for r in run.steps["top"].collect()]  # as many as the table has places
            return rounded(spark.createDataFrame(rows, run.steps["top"].schema))

    return query


def _research_sql(at_once: int = 64, most: int = 500, k: int = 20) -> str:
    """The factors that the gate lets through, the first so many in the library's order, and of those the highest ICIRs over all dates."""
    made = library.library(RESEARCHED)
    names = list(made)
    parts = [{n: made[n] for n in names[i : i + at_once]} for i in range(0, len(names), at_once)]
    keys = ["asset", "date", "fwd_return"]
    tables = [f"part{i} AS MATERIALIZED ({oracle.factor_sql('whole', keys, part)})" for i, part in enumerate(parts)]
    rows = " UNION ALL ".join(
        f"SELECT asset, date, factor, value, fwd_return AS forward FROM (UNPIVOT part{i} ON COLUMNS(* EXCLUDE (asset, date, fwd_return)) INTO NAME factor VALUE value)"
        for i in range(len(parts))
    )
    places = ", ".join(f"('{n}', {i})" for i, n in enumerate(names))
    early = f"(SELECT date FROM (SELECT DISTINCT date FROM {base._PANEL}) ORDER BY date LIMIT 100)"
    sql = f"""
    WITH whole AS MATERIALIZED (SELECT * FROM {base._FORWARD}), {', '.join(tables)}, made AS MATERIALIZED ({rows}),
    ics AS MATERIALIZED ({base._ic_sql(True, 20, source='made')}),
    strong AS (
        SELECT factor FROM ics JOIN (VALUES {places}) v(name, place) ON name = factor WHERE ic IS NOT NULL AND date IN {early}
        GROUP BY factor, place HAVING count(ic) >= 10 AND abs(avg(ic)) >= 0.02 ORDER BY place LIMIT {most}
    )
    SELECT * FROM ({base._summary_sql('SELECT * FROM ics WHERE n >= 30 AND factor IN (SELECT factor FROM strong)', True)}) WHERE n_dates > 10
    ORDER BY icir DESC NULLS LAST, factor LIMIT {k}
    """
    return rounded_sql(sql, base._STATS, ["factor", "n_dates"])


def _backtest(spark: SparkSession, folder: str) -> DataFrame:
    with runs.backtest_run(base.subjects(spark, folder), list(base.SUBJECTS)) as run:
        rows = [tuple(r) for r in run.table().collect()]  # a row for each factor, group or method and measure
    return rounded(spark.createDataFrame(rows, "step string, item string, measure string, value double"), 4)


def _backtest_sql() -> str:
    names = list(base.SUBJECTS)
    days = f"(SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS d FROM (SELECT DISTINCT date FROM {base._PANEL})) WHERE d > 62)"
    weights = {"ic": base._weights_sql("ic"), "icir": base._weights_sql("icir"), "max_icir": _max_icir_sql()}
    combined = {
        "equal": f"SELECT date, asset, sum(coalesce(value, 0)) / {len(names)} AS value, any_value(forward) AS forward FROM {base._LONG} GROUP BY date, asset HAVING count(value) > 0"
    }
    for m, w in weights.items():
        combined[m] = (
            f"SELECT l.date, asset, sum(weight * coalesce(value, 0)) AS value, any_value(forward) AS forward FROM {base._LONG} l JOIN {w} w"
            f" ON w.date = l.date AND w.factor = l.factor WHERE l.date IN {days} GROUP BY l.date, asset"
        )
    rows = " UNION ALL ".join(f"SELECT date, asset, '{m}' AS factor, value, forward FROM ({q})" for m, q in combined.items())
    mean = [f"SELECT 'equal' AS method, unnest({names}) AS factor, {1 / len(names)} AS weight"]
    mean += [f"SELECT '{m}', factor, avg(weight) FROM {w} WHERE date IN {days} GROUP BY factor" for m, w in weights.items()]
    ends = " UNION ALL ".join(f"SELECT factor, '{g}' AS grp, {g} AS r FROM returns_" for g in base._LAYERS)
    long = lambda step, item, measures, source: " UNION ALL ".join(
        f"SELECT '{step}' AS step, {item} AS item, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM {source}" for m in measures
    )
    sql = f"""
    WITH returns_ AS MATERIALIZED (SELECT * FROM {base._GROUP_RETURNS}),
    performance AS MATERIALIZED (
        SELECT *, coalesce(annual_return / nullif(annual_vol, 0), 0) AS sharpe FROM (
            SELECT factor, grp, count(r) AS n_dates, avg(r) * 52 AS annual_return, stddev_samp(r) * sqrt(52.0) AS annual_vol FROM ({ends}) GROUP BY factor, grp)
    ),
    turnover AS MATERIALIZED (
        SELECT factor, grp, avg(turnover) AS mean_turnover, avg(cost_bps) AS mean_cost_bps, avg(cost_bps) * 52 / 1e4 AS annual_cost FROM {base._TURNOVER} GROUP BY factor, grp
    ),
    stats AS MATERIALIZED ({base._summary_sql(base._ic_sql(True, 30))}),
    mixed AS MATERIALIZED ({rows}),
    combinations AS MATERIALIZED (
        SELECT *, CASE WHEN ic_std > 0 THEN ic_mean / ic_std ELSE 0 END AS icir FROM (
            SELECT factor AS method, count(ic) AS n_dates, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) AS positive
            FROM ({base._ic_sql(True, 30, source='mixed')}) WHERE ic IS NOT NULL GROUP BY factor)
    ),
    coverages AS (SELECT factor, count(value) / count(*) AS coverage FROM {base._LONG} GROUP BY factor),
    best AS (SELECT * FROM ({' UNION ALL '.join(mean)}) WHERE method = (SELECT method FROM combinations ORDER BY abs(icir) DESC LIMIT 1)),
    net AS (
        SELECT p.factor, annual_return AS gross, annual_cost, annual_return - coalesce(annual_cost, 0) AS net
        FROM (SELECT * FROM performance WHERE grp = 'LS') p LEFT JOIN (SELECT * FROM turnover WHERE grp = 0) t ON t.factor = p.factor
    )
    {long('coverage', 'factor', ['coverage'], 'coverages')}
    UNION ALL {long('ics', 'factor', ['n_dates', *base._STATS], 'stats')}
    UNION ALL {long('groups', "factor || ' ' || grp", ['n_dates', 'annual_return', 'annual_vol', 'sharpe'], 'performance')}
    UNION ALL {long('combinations', 'method', ['n_dates', 'ic_mean', 'ic_std', 'positive', 'icir'], 'combinations')}
    UNION ALL {long('weights', "method || ' ' || factor", ['weight'], 'best')}
    UNION ALL {long('turnover', "factor || ' ' || grp", ['mean_turnover', 'mean_cost_bps', 'annual_cost'], 'turnover')}
    UNION ALL {long('net', 'factor', ['gross', 'annual_cost', 'net'], 'net')}
    """
    return rounded_sql(sql, ["value"], ["step", "item", "measure"], 4)


def _risk(spark: SparkSession, folder: str) -> DataFrame:
    with runs.risk_run(base.styled(spark, folder), base.RISK) as run:
        rows = [tuple(r) for r in run.table().collect()]
    return rounded(spark.createDataFrame(rows, "step string, item string, measure string, value double"), 4)


def _turnover(spark: SparkSession, folder: str) -> DataFrame:
    """From each date's weights by capitalisation to the next date's."""
    rows = sources.weekly_universe(spark, folder).filter(F.col("market_cap").isNotNull())
    weights = rows.select("date", "asset", (F.col("market_cap") / F.sum("market_cap").over(Window.partitionBy("date"))).alias("weight"))
    days = weights.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date")))
    old = weights.join(F.broadcast(days), "date").filter("next is not null").select(F.col("next").alias("date"), "asset", "weight")
    new = weights.join(F.broadcast(days.select(F.col("next").alias("date")).dropna()), "date")
    return rounded(costs.turnover(old, new, keys=("date",)), 4)


_TURNOVER = f"""
WITH w AS MATERIALIZED (SELECT date, asset, market_cap / sum(market_cap) OVER (PARTITION BY date) AS w FROM {base._UNIVERSE} WHERE market_cap IS NOT NULL),
days AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM w)),
moves AS (
    SELECT d.date, coalesce(n.w, 0) - coalesce(o.w, 0) AS m FROM days d JOIN (SELECT date, asset, w FROM w) n ON n.date = d.date
    LEFT JOIN w o ON o.date = d.prev AND o.asset = n.asset WHERE d.prev IS NOT NULL
    UNION ALL SELECT d.date, -o.w FROM days d JOIN w o ON o.date = d.prev WHERE NOT EXISTS (SELECT 1 FROM w n WHERE n.date = d.date AND n.asset = o.asset)
), sums AS (SELECT date, sum(abs(m)) / 2 AS turnover, sum(greatest(m, 0)) * 1e8 AS buys, sum(greatest(-m, 0)) * 1e8 AS sells FROM moves GROUP BY date)
SELECT *, cost / 1e8 * 1e4 AS cost_bps FROM (
    SELECT *, buys * (0.0003 + 0.1 * sqrt(least(buys / 1e8, 1))) + sells * (0.0003 + 0.0005 + 0.1 * sqrt(least(sells / 1e8, 1))) AS cost FROM sums)
"""
_BARS = f"""
WITH bars AS MATERIALIZED (SELECT asset, date, close FROM {base._PANEL} WHERE close IS NOT NULL), many AS (SELECT asset FROM bars GROUP BY asset HAVING count(*) >= 50),
stepped AS (SELECT b.asset, date, close, close / nullif(lag(close) OVER (PARTITION BY b.asset ORDER BY date), 0) - 1 AS r FROM bars b JOIN many m ON m.asset = b.asset),
weeks AS (
    SELECT asset, CAST(date + CAST((12 - isodow(date)) % 7 AS INT) AS DATE) AS week, arg_max(close, date) AS close, avg(r) AS m, stddev_samp(r) AS s FROM stepped GROUP BY 1, 2
), back AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY asset ORDER BY week), 0) - 1 AS returns FROM weeks)
SELECT asset, week AS date, close, returns, close * 1e6 AS market_cap, 1 / greatest(close, 1.0) AS book_to_price,
       CASE WHEN count(m) OVER y >= 20 THEN avg(m) OVER y * 252 END AS roe,
       CASE WHEN count(returns) OVER y >= 40 THEN sum(returns) OVER y END AS momentum_12m, s * sqrt(252.0) AS volatility
FROM back WINDOW y AS (PARTITION BY asset ORDER BY week ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)
"""


def _weekly_sql(agg: str) -> str:
    return f"SELECT asset, CAST(date + CAST((12 - isodow(date)) % 7 AS INT) AS DATE) AS date, {agg}(close) AS value FROM {base._EVENTS} WHERE close IS NOT NULL GROUP BY 1, 2"


def queries() -> dict[str, tuple[Query, str | None]]:
    """Each query and its SQL by name."""
    names = list(base.SUBJECTS)
    known = f"{_ROWS}, {_SPECIFIC}"
    days = f"(SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) AS d FROM (SELECT DISTINCT date FROM {base._PANEL})) WHERE d > 62)"
    numbers = ["close", "returns", "market_cap", "book_to_price", "roe", "momentum_12m", "volatility"]
    return {
        "factor_returns_wls": (
            lambda s, d: rounded(risk.factor_returns(base.styled(s, d), base.RISK)),
            rounded_sql(f"WITH {_ROWS} SELECT * FROM factor_returns", ["ret"], ["date", "factor"]),
        ),
        "factor_cov_plain": (_covariance, rounded_sql(f"WITH {_ROWS}, {_COVARIANCE} SELECT * FROM covariance", ["covariance"], ["a", "b"], 3)),
        "specific_risk": (
            lambda s, d: rounded(_specific(s, d), 4),
            rounded_sql(f"WITH {known} SELECT asset, raw, structural, daily * sqrt(52.0) AS risk FROM risks", ["raw", "structural", "risk"], ["asset"], 4),
        ),
        "specific_risk_distribution": (
            lambda s, d: rounded(risk.distribution(_specific(s, d)), 4),
            rounded_sql(
                f"WITH {known} SELECT avg(x) AS mean, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.1) AS p10, quantile_cont(x, 0.9) AS p90"
                " FROM (SELECT daily * sqrt(52.0) AS x FROM risks)",
                ["mean", "median", "p10", "p90"],
                [],
                4,
            ),
        ),
        "pure_portfolio_last": (lambda s, d: rounded(_pure_last(s, d)), rounded_sql(_pure_sql(), ["weight"], ["factor", "date", "asset"])),
        "pure_portfolio_largest": (
            lambda s, d: rounded(risk.largest_weights(_pure_last(s, d), 3, ("factor", "date"))),
            rounded_sql(
                "SELECT *, CAST(k AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY factor, date ORDER BY weight DESC, asset) AS k,"
                " count(*) FILTER (weight > 1e-10) OVER (PARTITION BY factor, date) AS n_long, count(*) FILTER (weight < -1e-10) OVER (PARTITION BY factor, date) AS n_short"
                f" FROM ({_pure_sql()})) WHERE k <= 3",
                ["weight"],
                ["factor", "date", "asset", "place", "n_long", "n_short"],
            ),
        ),
        "risk_decomposition_plain": (_decomposition, rounded_sql(_DECOMPOSITION, ["exposure", "share"], ["factor"], 4)),
        "combine_max_icir": (
            lambda s, d: rounded(combine.combine(base.subjects(s, d), names, "max_icir")[0]),
            rounded_sql(
                f"SELECT l.date, asset, sum(weight * coalesce(value, 0)) AS combined FROM {base._LONG} l JOIN {_max_icir_sql()} w"
                f" ON w.date = l.date AND w.factor = l.factor WHERE l.date IN {days} GROUP BY l.date, asset",
                ["combined"],
                ["date", "asset"],
            ),
        ),
        "combine_summary": (_summary, rounded_sql(_summary_sql(), ["ic_mean", "ic_std", "positive", "icir"], ["n_dates"])),
        "ridge": (base._model_query("ridge"), rounded_sql(_ridge_sql(), ["prediction"], ["asset", "date"])),
        "dedup_kept": (
            lambda s, d: s.createDataFrame([(f,) for f in evaluate.remove_redundant(base.subjects(s, d), names, threshold=0.5)], "factor string"),
            _kept_sql(),
        ),
        "backtest_comparison": (lambda s, d: backtest.comparison(base.subjects(s, d), names), _COMPARISON),
        "cross_selected_long": (_crossed, _crossed_sql()),
        "library_crosses": (_library_gate(["crossed"]), _library_sql(["crossed"])),
        "research_top": (_research(False), _research_sql()),
        "research_models": (_research(True), None),
        "backtest_run": (_backtest, _backtest_sql()),
        "risk_run": (_risk, None),
        "library_gate": (_library_gate(list(library.LAYERS)), _library_sql(list(library.LAYERS))),
        "cap_turnover": (_turnover, rounded_sql(_TURNOVER, ["turnover", "buys", "sells", "cost", "cost_bps"], ["date"], 4)),
        "weekly_resample_mean": (
            lambda s, d: rounded(sources.resample_weekly(sources.daily_event_panel(s, d), "close", "mean")),
            rounded_sql(_weekly_sql("avg"), ["value"], ["asset", "date"]),
        ),
        "weekly_resample_std": (
            lambda s, d: rounded(sources.resample_weekly(sources.daily_event_panel(s, d), "close", "std")),
            rounded_sql(_weekly_sql("stddev_samp"), ["value"], ["asset", "date"]),
        ),
        "universe_from_bars_numbers": (
            lambda s, d: rounded(universes.universe_from_bars(sources.weekly_panel(s, d).select("asset", "date", "close"), 50).drop("industry")),
            rounded_sql(_BARS, numbers, ["asset", "date"]),
        ),
    }
