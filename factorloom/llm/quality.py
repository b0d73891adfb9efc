"""Quality rules whose cutoffs come with a guarantee on false rejections.

A rule is a measure of a text and a cutoff over which the text is rejected. For
each stratum of documents the labelled ones are split. On one part each rule
gets, for each of a few tolerances, the most lenient cutoff that rejects nearly
as many bad texts as the best one. On the other part, the holdout, the rules of
each tolerance together are put to the test: how many good texts do they
reject? The exact (Clopper-Pearson) upper bound of that share must not be over
the allowed risk. Sets of cutoffs are tested one after the other until one
fails; the order, and which sets are worth a test, follow from the other part.

The allowed error is divided among strata (Bonferroni). A stratum all of whose
sets pass hands its part on to the next one (a sequence of tests of which the
first failure ends it needs no correction, and error that wasn't used up may be
handed on), so with the stated confidence no stratum's false rejections are over
the risk. Among the sets that pass, the one that does most on the holdout is
taken; a stratum where none passes rejects nothing.

Measures are taken in one Arrow pass. Counts of labelled documents over the
grids of cutoffs are aggregated by Spark over all of them; only those small
tables come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm.common import durable, fresh, light, quoted, slices, worker_memory

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_BASE_TYPE = ", ".join(f"{c} long" for c in BASE)

#: Each rule's measure (SQL over the base columns) and the grid of its cutoffs, all over which is rejected.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": (
        "n_symbols / word_chars",
        (0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5),
    ),
    "long_words": ("word_chars / n_words", (6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0)),
    "short_words": ("-word_chars / n_words", (-4.25, -4.0, -3.75, -3.5, -3.25, -3.0, -2.75, -2.5, -2.0, -1.5)),
    "repeated_lines": ("n_dup_lines / n_words", (0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.07, 0.1, 0.15, 0.2)),
    "repeated_words": ("n_repeat_words / n_words", (0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.14, 0.16, 0.18)),
}
#: Shares of the bad texts that a more lenient cutoff may miss beside the best one.
TOLERANCES = (0.0, 0.02, 0.05, 0.1)
#: What a good text that is rejected counts against bad ones that are.
GOOD_WEIGHT = 20.0


def measure_texts(texts: list[str]) -> np.ndarray:
    """The base columns of some texts, a row for each."""
    out = np.zeros((len(texts), len(BASE)), dtype=np.int64)
    words: list[str] = []
    for k, text in enumerate(texts):
        plain, blank = text, text.count(" ")
        for c in SPACES:
            if n := text.count(c):
                blank += n
                plain = plain.replace(c, " ")
        own = plain.split(" ")
        if "" in own:
            own = [w for w in own if w]
        words += own
        out[k, 0] = len(own)
        out[k, 1] = len(text) - blank
        out[k, 2] = sum(map(text.count, SYMBOLS))
        if "\n" in text:
            lines = text.split("\n")
            if len(set(lines)) < len(lines):
                full = [x for x in lines if x.strip(" " + SPACES)]
                out[k, 3] = len(full) - len(set(full))
    out[:, 4] = _repeated(words, out[:, 0])
    return out


def _repeated(words: list[str], sizes: np.ndarray, width: int = 5) -> np.ndarray:
    """Of each text, whose words stand one behind the other, how many are in windows that it has twice or more."""
    if len(words) < width:
        return np.zeros(len(sizes), dtype=np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    codes = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
    n = len(codes) - width + 1
    key = codes[:n]
    for k in range(1, width):  # numbers for longer and longer windows
        key = pd.factorize(key * (codes.max() + 1) + codes[k : k + n])[0]
    inside = text[:n] == text[width - 1 :]
    where = np.flatnonzero(inside)
    key = pd.factorize(key[where] * len(sizes) + text[where])[0]
    again = where[np.bincount(key)[key] > 1] if len(key) else where
    marks = np.zeros(len(codes) + 1, dtype=np.int64)
    np.add.at(marks, again, 1)
    np.add.at(marks, again + width, -1)
    covered = np.cumsum(marks)[:-1] > 0
    return np.bincount(text[covered], minlength=len(sizes))


def measures(text: Column) -> Column:
    """The base columns of whole texts as a struct; null texts as empty ones.

    Words are what stands between U+0020 and U+0009 to U+000D. n_symbols
    counts characters of ``#*$%&|<>``, n_dup_lines the lines with a word that
    are equal to an earlier line, n_repeat_words the words in 5-word windows
    that the text has twice or more.
    """

    @F.pandas_udf(_BASE_TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        worker_memory("measures", lambda: None)
        for batch in batches:
            texts = [t or "" for t in batch]
            parts = [measure_texts(part) for part in slices(texts)] or [np.zeros((0, len(BASE)), dtype=np.int64)]
            yield pd.DataFrame(np.concatenate(parts), columns=list(BASE))

    return run(text)


def base_failed() -> Column:
    """Under ten words, or over a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_upper(k: int, n: int, delta: float) -> float:
    """The exact upper confidence bound (Clopper-Pearson) of a share that was found k times in n, at confidence 1 - delta."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def tail(p: float) -> float:
        return sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(logs))

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if tail(mid) > delta:
            low = mid
        else:
            high = mid
    return high


@dataclass(frozen=True)
class Cutoffs:
    """Of each stratum the cutoff of each rule; strata without an entry take ``other``. A rule without a cutoff rejects nothing."""

    strata: dict[str, dict[str, float]] = field(default_factory=dict)
    other: dict[str, float] = field(default_factory=dict)


def _choose(counts: dict[tuple[str, float], tuple[int, int]], good: int, bad: int, tolerance: float) -> dict[str, float]:
    """Of each rule the most lenient cutoff that is within the tolerance of its best, from (good, bad) texts over each cutoff."""
    found = {}
    for rule, (_, grid) in RULES.items():
        worth = {}
        for cutoff in grid:
            g, b = counts.get((rule, cutoff), (0, 0))
            worth[cutoff] = b / max(1, bad) - GOOD_WEIGHT * g / max(1, good)
        best = max(worth.values())
        if best > 0.01:
            found[rule] = max(c for c, x in worth.items() if x >= max(best - tolerance, 0.005))
    return found


def rejects(cutoffs: Column) -> Column:
    """Whether a text with the base columns is over any cutoff of a struct with one for each rule; a null one rejects nothing."""
    out = F.lit(False)
    for rule, (sql, _) in RULES.items():
        a, b = sql.split(" / ")
        out = out | F.coalesce(F.expr(f"try_divide({a}, {b})") > cutoffs[rule], F.lit(False))
    return out


def _sets(spark: SparkSession, sets: dict[str, list[dict[str, float]]]) -> DataFrame:
    """(stratum, sets): of each stratum some sets of cutoffs."""
    kind = ", ".join(f"{r}: double" for r in RULES)
    rows = [(s, [tuple(x.get(r) for r in RULES) for x in own]) for s, own in sets.items()]
    return light(spark.createDataFrame(rows, f"stratum string, sets array<struct<{kind}>>"), len(rows))


def least_good(risk: float, delta: float) -> float:
    """Of how many good texts a test needs at least, as with fewer it fails even if none is rejected."""
    return math.log(delta) / math.log1p(-risk) - 1e-6 if 0 < risk < 1 else math.inf if risk <= 0 else 1.0


def fit(labelled: DataFrame, risk: float = 0.02, delta: float = 0.05) -> Cutoffs:
    """Cutoffs from documents with base columns, ``stratum``, ``good`` (boolean) and ``holdout`` (boolean).

    With confidence 1 - ``delta`` no stratum's share of good documents that
    the cutoffs reject is over ``risk``. The stratum's own cutoffs and those of
    all strata together are tested on its own holdout, those first that reject
    the fewest good documents of its other part, until one fails; sets that
    reject more than half the risk there aren't tested. Strata go by size. A
    stratum in which none passes gets the base rules alone; so does one whose
    holdout has too few good documents for any test to pass, which takes no part
    of the error (a row for each other stratum comes to the driver). Rows that fail the base rules, or with a null among
    ``good`` and ``holdout``, aren't used. A null stratum is the empty one.
    """
    rows = labelled.filter(~base_failed() & F.col("good").isNotNull() & F.col("holdout").isNotNull()).withColumn(
        "stratum", F.coalesce("stratum", F.lit(""))
    )
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(F.col("good") & F.col("holdout")).alias("good"))
    strata = [r["stratum"] for r in sizes.filter(F.col("good") >= least_good(risk, delta)).orderBy(F.desc("n"), "stratum").collect()]
    if not strata:
        return Cutoffs()
    levels = []
    for rule, (sql, grid) in RULES.items():
        a, b = sql.split(" / ")
        steps = ", ".join(f"{c!r}D" for c in grid)
        levels.append(f"struct('{rule}' AS rule, size(filter(array({steps}), c -> try_divide({a}, {b}) > c)) AS passed)")
    testable = _sets(rows.sparkSession, {s: [] for s in strata}).select("stratum", F.col("stratum").alias("own"))
    table = (
        rows.filter("not holdout")
        .join(testable, "stratum", "left")
        .select(F.col("own").alias("stratum"), "good", F.explode(F.expr(f"array({', '.join(levels)})")).alias("x"))
        .groupBy("stratum", "good", "x.rule", "x.passed")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    over: dict[str | None, dict[tuple[str, float], list[int]]] = {}
    totals: dict[str | None, list[int]] = {}
    for r in table:
        for stratum in {r["stratum"], None}:
            if r["rule"] == "symbols":
                totals.setdefault(stratum, [0, 0])[0 if r["good"] else 1] += r["n"]
            for cutoff in RULES[r["rule"]][1][: r["passed"]]:
                over.setdefault(stratum, {}).setdefault((r["rule"], cutoff), [0, 0])[0 if r["good"] else 1] += r["n"]
    plans: dict[tuple[str | None, float], dict[str, float]] = {}
    for stratum in [*strata, None]:
        good, bad = totals.get(stratum, [0, 0])
        counts = {k: (v[0], v[1]) for k, v in over.get(stratum, {}).items()}
        for tolerance in TOLERANCES:
            plans[stratum, tolerance] = _choose(counts, good, bad, tolerance)
    tried = [("own", k) for k in range(len(TOLERANCES))] + [("all", k) for k in range(len(TOLERANCES))]
    sets = {s: [plans[s if name == "own" else None, TOLERANCES[k]] for name, k in tried] for s in strata}
    sums = []
    for at, (name, k) in enumerate(tried):
        x = rejects(F.get("sets", F.lit(at)))
        sums += [F.count_if(x & F.col("good")).alias(f"{name}{k}_good"), F.count_if(x & ~F.col("good")).alias(f"{name}{k}_bad")]
    sums += [F.count_if(F.col("good")).alias("good"), F.count_if(~F.col("good")).alias("bad")]
    tested = rows.join(_sets(rows.sparkSession, sets), "stratum").groupBy("stratum", "holdout").agg(*sums).collect()
    known = {(r["stratum"], r["holdout"]): r for r in tested}
    handed_on = 0.0
    found = {}
    for stratum in strata:
        level, handed_on = delta / len(strata) + handed_on, 0.0
        held, other = known.get((stratum, True)), known.get((stratum, False))
        if held is None or not held["good"] or other is None or not other["good"]:
            continue
        names = [(name, k) for name in ("all", "own") for k in range(len(TOLERANCES))]
        names = [x for x in names if other[f"{x[0]}{x[1]}_good"] <= risk / 2 * other["good"]]
        names.sort(key=lambda x: other[f"{x[0]}{x[1]}_good"])
        worth = []
        for name, k in names:
            g, b = held[f"{name}{k}_good"], held[f"{name}{k}_bad"]
            if binomial_upper(g, held["good"], level) > risk:
                break
            worth.append((round(b / max(1, held["bad"]) - GOOD_WEIGHT * g / held["good"], 3), TOLERANCES[k], name))
        else:
            handed_on = level
        if worth:
            _, tolerance, name = max(worth)
            found[stratum] = plans[stratum if name == "own" else None, tolerance]
    return Cutoffs(found)


def verdicts(measured: DataFrame, cutoffs: Cutoffs, stratum: Column) -> DataFrame:
    """``measured`` (with the base columns) and base_failed and kept; columns that are called so are replaced."""
    own, cuts = fresh(measured, "_stratum", "_cutoffs")
    known = _sets(measured.sparkSession, {s: [x] for s, x in cutoffs.strata.items()} or {"": [cutoffs.other]})
    found = measured.withColumn(own, F.coalesce(stratum, F.lit("")))
    found = found.join(known.select(F.col("stratum").alias(own), F.get("sets", F.lit(0)).alias(cuts)), own, "left")
    other = F.struct(*[F.lit(cutoffs.other.get(r)).cast("double").alias(r) for r in RULES])
    rejected = rejects(F.coalesce(F.col(cuts), other))
    return found.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~rejected}).drop(own, cuts)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    stratum_col: str = "lang",
    good_col: str = "quality",
    risk: float = 0.02,
    delta: float = 0.05,
    with_text: bool = True,
) -> DataFrame:
    """``docs`` with the base columns, base_failed and kept, by cutoffs that are fitted on ``labels`` (id, 1 if good).

    Three quarters of the labelled documents, by a hash of their ids, are the
    holdout: cutoffs come from coarse grids, so they need fewer than their test.
    A document with differing labels counts as good. Null texts are empty and
    fail the base rules; null ids have no label but are judged; repeated rows
    are judged each and count each where they are labelled. Without labels, or
    too few for the guarantee, only the base rules reject. Columns of ``docs``
    that are called like a new one are replaced. Texts are measured once and
    only the measures are kept; with the text asked for they are measured once
    more on the way to the result, rather than written.
    """
    m, own = fresh(docs, "_measures", "_stratum")
    names = [c for c in docs.columns if c.lower() not in {*BASE, "base_failed", "kept"}]
    given = docs.select(*map(quoted, names), quoted(stratum_col).cast("string").alias(own))
    plain = [c for c in [*names, own] if c != text_col]
    rows = given.select(*map(quoted, plain), measures(quoted(text_col)).alias(m))
    rows = durable(rows.select(*map(quoted, plain), f"{m}.*"))
    marks = (
        labels.select(quoted(id_col).alias("id"), (quoted(good_col) > 0).alias("good"))
        .dropna()
        .groupBy("id")
        .agg(F.max("good").alias("good"))
    )
    labelled = (
        rows.select(quoted(id_col).alias("id"), F.col(own).alias("stratum"), *BASE)
        .join(marks, "id")
        .withColumn("holdout", F.pmod(F.xxhash64("id"), F.lit(4)) > 0)
    )
    cutoffs = fit(labelled, risk, delta)
    if with_text:
        rows = given.withColumn(m, measures(quoted(text_col))).select(*map(quoted, [*names, own]), f"{m}.*")
    return verdicts(rows, cutoffs, quoted(own)).drop(own)
