"""The quality rules' guarantee in strata that are unlike the others."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.llm import quality


def test_cutoffs_of_others_are_tested_in_each_stratum(spark):
    rows = []
    for k in range(6000):  # symbols mark the bad texts of one language and stand in all good ones of a small one
        good = k % 5 > 0
        rows.append(("en", good, k % 2 == 0, 100, 500, 0 if good else 150, 0, 0))
    rows += [("xx", True, k % 2 == 0, 100, 500, 150, 0, 0) for k in range(60)]
    rows += [("yy", True, k % 2 == 0, 100, 500, 0, 0, 0) for k in range(700)]
    kinds = "stratum string, good boolean, holdout boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    df = spark.createDataFrame(rows, kinds)
    out = quality.verdicts(df, quality.fit(df), F.col("stratum")).collect()
    assert all(r["kept"] == r["good"] for r in out)


def test_every_stratum_with_enough_labels_has_cutoffs(spark):
    n, each = 150, 1000  # no stratum is left out for there being many
    rows = spark.range(n * each).select(
        F.concat(F.lit("s"), (F.col("id") % n).cast("string")).alias("stratum"),
        (F.floor(F.col("id") / n) % 5 > 0).alias("good"),
        (F.floor(F.col("id") / n) % 4 > 0).alias("holdout"),
    )
    rows = rows.withColumns({"n_words": F.lit(100), "word_chars": F.lit(500), "n_symbols": F.when(F.col("good"), 0).otherwise(150), "n_dup_lines": F.lit(0), "n_repeat_words": F.lit(0)})
    few = rows.filter("stratum = 's0'").limit(100).withColumn("stratum", F.lit("few"))
    cutoffs = quality.fit(rows.unionByName(few))
    assert set(cutoffs.strata) == {f"s{k}" for k in range(n)}
    out = quality.verdicts(rows.unionByName(few), cutoffs, F.col("stratum"))
    assert out.filter("stratum != 'few' and kept != good").count() == 0
    assert out.filter("stratum = 'few' and not kept").count() == 0 and out.count() == n * each + 100
    assert quality.binomial_upper(0, 149, 0.05) <= 0.02 < quality.binomial_upper(0, 148, 0.05) and 148 < quality.least_good(0.02, 0.05) < 149
