"""From raw documents to packed sequences: toxicity, quality rules, near duplicates, packing.

A stage takes all rows that the one before it kept.  The first three drop rows
and return the columns of their input; the last returns the pieces of the
packed sequences.  Rows are told apart by id and text, so null and repeated ids
are no obstacle; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lanelytics.llm import packing, quality, simhash, toxicity
from lanelytics.llm.common import removed, ship, table, written_to
from lanelytics.llm.queries import BYTE_JSON, BYTE_RANKS, PATTERN


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, does not call toxic."""
    ship(spark)
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source."""
    return quality.without_rejected(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship(spark)
    return simhash.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences and offsets."""
    ship(spark)
    return packing.pack_documents(docs, BYTE_JSON, BYTE_RANKS, PATTERN)


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_poor), ("near_duplicates", drop_copies), ("packing", pack)]
#: A trained classifier and a tokenizer decide, which SQL does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; the documents of a stage are removed once the next one has written its own."""
    docs, folder = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before, folder = folder, written_to(stage(spark, docs, sf_dir), name)
        docs = spark.read.parquet(folder)
        if before is not None:
            removed(spark, before)
    return docs
