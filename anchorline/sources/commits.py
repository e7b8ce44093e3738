"""Commit logs with separator characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import js_trim

#: Separators of records and of fields.
RECORD, FIELD = "\x1e", "\x1f"


def commit_fields(records: DataFrame, col: str = "value") -> DataFrame:
    """``hash, subject, author, email`` of log records, beside their other columns; blank records go, missing fields are empty."""
    fields = F.split(js_trim(F.col(col)), FIELD)
    named = {n: F.coalesce(F.get(fields, F.lit(k)), F.lit("")) for k, n in enumerate(("hash", "subject", "author", "email"))}
    return records.where(js_trim(F.col(col)) != "").withColumns(named).drop(col)


def read_commit_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of log files, with the file they are in as ``repo`` and an increasing ``pos``."""
    lines = spark.read.option("lineSep", RECORD).text(path)
    return commit_fields(lines.select("value", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("repo"), F.monotonically_increasing_id().alias("pos")))
