"""Corpus pipeline: quality rules, language, line dedup, near-duplicates, packing.

Each stage takes the rows that its predecessor kept, as ``docs``, and is written before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorline.llm import langid, linededup, packing, quality, simhash
from anchorline.llm.common import bounded_batches, materialize, table
from anchorline.llm.queries import vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the isolation forest reject go, null and empty texts among them; an empty table stays empty."""
    bounded_batches(spark)
    return quality.kept_rows(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go, null texts and texts without letters among them; an empty table stays empty."""
    bounded_batches(spark)
    return langid.kept_rows(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose template recurs across documents, and passages, go, but for their first place; all rows stay, with ``n_chars`` as it is then, null for null texts."""
    bounded_batches(spark)
    return linededup.without_recurring(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal or similar texts (five words, similarity 0.8) stays, the one with the smallest id; different texts under one id are rows of their own."""
    bounded_batches(spark)
    return simhash.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences. A null or empty text is one piece of one token; repeated rows are packed each; an empty table gives no pieces."""
    bounded_batches(spark)
    return packing.query(docs, vocabulary_path())


STAGES = [("quality_rules", quality_rules), ("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", packing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
