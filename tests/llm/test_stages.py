"""The pipeline's dedup stages against brute force, on few enough documents that it always runs."""

from __future__ import annotations

from conftest import DATA
from test_lines import brute
from test_similar import brute_kept


def test_dedup_stages(spark):
    import corpus_pipeline as pipeline

    folder = str(DATA / "sf0.001")
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id % 2 = 0")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    want = [(i, t) for i, t, n in brute(rows) if not n or t.strip()]
    assert 0 < len(rows) < 400 and want != rows
    found = pipeline.dedup_lines(spark, docs, folder)
    assert sorted((r["doc_id"], r["text"]) for r in found.collect()) == want
    kept = pipeline.drop_near_copies(spark, docs, folder)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == brute_kept(rows)


def test_stages_of_odd_tables(spark, tmp_path):
    """Nulls in all columns, empty texts, repeated rows, further columns and empty tables, through all stages."""
    import corpus_pipeline as pipeline

    good = " ".join(f"word{k} of sentence number {k}," for k in range(40))
    rows = [(1, good, "en", 7, "a"), (1, good, "en", 7, "a"), (None, good + " and more", None, None, None), (2, None, "en", 0, "b"), (3, "", None, None, None), (4, " \n\t", "de", 3, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int, Row string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for given in (docs, docs.limit(0)):
        out = given
        for k, (_, stage) in enumerate(pipeline.STAGES):
            out = pipeline.stored(stage(spark, out, str(tmp_path)))
            if k < 4:
                assert out.columns == docs.columns
        # the repeated row and the near copy without an id lose their line to the first row
        assert [r["doc_id"] for r in out.filter("start = 0").collect()] == ([1] if given is docs else [])
