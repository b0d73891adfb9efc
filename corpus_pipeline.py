"""A training corpus from documents: five stages, each on all that the one before kept.

``STAGES`` are (name, function) pairs; a function takes (spark, docs, sf_dir)
and returns what its successor gets. Each stage's result is written as Parquet
and read again, so a lost executor costs no more than the stage at hand.

docs has doc_id, text and lang, and any further columns, which all but the last
stage keep as they are; n_chars, if there, follows the text where lines go.
Null texts are empty ones, which fail the quality rules. A document without an
id has no label and stays, if it is good, behind those with one where copies
are chosen among. Repeated rows are documents of their own: line dedup empties
all but one of them. Of an empty table each stage makes an empty one. Columns
that are called like ones the operators add (kept, base_failed, the measures,
n_removed) are not for this pipeline, as they would be lost between stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import lines, packing, quality, simhash, toxicity
from factorloom.llm.common import quoted, read_table, stored
from factorloom.llm.queries import END_ID, TOXIC_FROM, held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on labels that aren't held out, doesn't reject."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out())
    model = toxicity.fit(docs, labels)
    return docs.filter(toxicity.scores(F.col("text"), model) < TOXIC_FROM)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.judge(docs, labels).filter("kept").select(*map(quoted, docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere already; those that lose all their words go, n_chars follows the text."""
    found = lines.dedup_lines(docs).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text"))
        found = found.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return found.select(*map(quoted, docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles with Jaccard similarity of 0.8 or more."""
    return simhash.one_of_similar(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their token ids, each a sequence of its own."""
    return packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("packing", pack),
]

#: No SQL can express these stages; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
