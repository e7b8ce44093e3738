"""The table of cached answers: generations in folders of their own, and a manifest of those that are whole."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import CACHE_VERSION
from ..operators.vision import retain_cache

SCHEMA = "key string, mode string, model string, base_url string, query string, text string, html string, ts timestamp"
MANIFEST = "generation string, version int, written_at timestamp"


def write_rows(df: DataFrame, path: str) -> str:
    """The rows of a new generation, which no reader takes before it is published; its name comes back."""
    name = f"v{CACHE_VERSION}-{uuid.uuid4().hex}"
    df.select(*(f"`{c.split()[0]}`" for c in SCHEMA.split(", "))).withColumn("written_at", F.current_timestamp()).withColumn("version", F.lit(CACHE_VERSION)).write.parquet(f"{path}/generation={name}")
    return name


def publish(spark: SparkSession, path: str, generation: str) -> None:
    """Name a generation that is whole in the manifest: one file, which appears at once."""
    row = spark.range(1).select(F.lit(generation).alias("generation"), F.lit(CACHE_VERSION).cast("int").alias("version"), F.current_timestamp().alias("written_at"))
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def write_cache(df: DataFrame, path: str) -> str:
    """Write a new generation beside the ones before it, never over the one that ``df`` may be read from, and publish it; its name comes back."""
    name = write_rows(df, path)
    publish(df.sparkSession, path, name)
    return name


def newest(spark: SparkSession, path: str) -> str | None:
    """The generation of this format's version that was published last; none where there is no manifest."""
    try:
        manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException:
        return None
    found = manifest.where(F.col("version") == CACHE_VERSION).agg(F.max_by("generation", F.struct("written_at", "generation"))).first()
    return found[0]


def read_cache(spark: SparkSession, path: str, generation: str | None = None) -> DataFrame:
    """Entries that have a key, of a generation or of the newest whole one; none where nothing was published."""
    name = generation or newest(spark, path)
    if name is None:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA + ", version int").parquet(f"{path}/generation={name}")
    return rows.where((F.col("version") == CACHE_VERSION) & F.col("key").isNotNull()).drop("version")


def upsert_cache(new: DataFrame, path: str, k: int = 40) -> str:
    """Publish a generation of the newest entry of each key in the last one and in ``new``, at most the ``k`` newest. A writer that dies leaves the last one as it was."""
    spark = new.sparkSession
    return write_cache(retain_cache(read_cache(spark, path).unionByName(new.select(*(c.split()[0] for c in SCHEMA.split(", ")))), k), path)
