"""From raw documents to packed training batches, one operator a stage.

Every stage takes what its predecessor kept; between stages the documents are
written to the shared folder, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import line_dedup, packing, quality_classifier, simhash_dedup, suffix_dedup
from tideline.llm.common import save, table


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows a text that was cut."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.accepted(docs, quality_classifier.learn(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go from the texts."""
    return _recounted(line_dedup.dedup_lines(docs))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash_dedup.one_per_group(docs, shingle=simhash_dedup.SHINGLE, radius=simhash_dedup.RADIUS)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occur earlier in the corpus go from the texts."""
    return _recounted(suffix_dedup.dedup_texts(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts in length buckets and token-budget batches."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_dedup", simhash_stage),
    ("suffix_dedup", suffix_stage),
    ("packing", packing_stage),
]

#: The classifier is trained and the fingerprints hash with XXH64, which DuckDB's SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = save(docs, f"stage-{name}")
    return docs
