"""A pipeline over documents: quality rules, line dedup, near-dedup, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; run() writes each stage's rows
as a table in the shared folder and reads them back. All stages but the last return the columns of documents; n_chars
follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazette.llm import line_dedup, near_dedup, packing, quality_rules, secret_scans
from gazette.llm.shared import cut, cuts, remove, table
from gazette.llm.tokens import vocabulary
from gazette.session import importable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    importable(spark)
    return quality_rules.filtered(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated three-line windows are removed from the texts."""
    importable(spark)
    return _recounted(line_dedup.deduped(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the least doc_id."""
    importable(spark)
    return near_dedup.deduped(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    importable(spark)
    return _recounted(secret_scans.masked(docs.select(*COLUMNS)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece, with its sequence and its place there."""
    importable(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("secret_scans", secrets), ("best_fit_packing", pack)]

#: Near-dedup by signatures and packing can't be written in SQL; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    outside = cuts(spark)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
        remove(spark, [p for p in cuts(spark)[:-1] if p not in outside])  # the stage's rows hold all that later ones read
    return STAGES[-1][1](spark, docs, sf_dir)
