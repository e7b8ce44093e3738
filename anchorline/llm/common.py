"""Pieces shared by the training-data operators."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes handled at a time inside a task, so that one Arrow batch of long texts never becomes one list of words.
SLICE_ROWS, SLICE_BYTES = 256, 2 << 20
#: Bytes of a batch that Spark hands to Python, where a stage is one of many.
BATCH_BYTES = 4 << 20
#: Bits of a bitmap of hashed values; keys that hold more than this share of a table's rows are joined apart.
SIEVE_BITS, HOT_SHARE, HOT_ROWS = 1 << 26, 1e-3, 1 << 12
#: Bits of a bitmap that is broadcast as rows.
ROW_BITS = 1 << 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """From now on a session hands :data:`BATCH_BYTES` to a Python task at a time, or less if it is set so, as two copies of a batch lie beside the heap of each task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)([kmgt]?)b?", spark.conf.get(key).lower()).groups()
    if not 0 < int(number) << 10 * " kmgt".index(unit or " ") <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); a temporary one where none is named and all runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share: intermediate tables are written there")
    return named or own_dir()


@functools.cache
def own_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-shared-")


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder, apart by the values of ``by``, and read it back, so lineage is cut and lost executors cost nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of at most so many rows and, but for single rows, so many bytes."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            waiting = [batch.slice(at, rows)]
            while waiting:
                part = waiting.pop()
                if part.num_rows > 1 and part.get_total_buffer_size() > size and part.nbytes > size:
                    half = part.num_rows // 2
                    waiting += [part.slice(half), part.slice(0, half)]
                else:
                    yield part


def sieve(df: DataFrame, column: str, bits: int = SIEVE_BITS) -> np.ndarray:
    """A bitmap of fixed size of a column of hashes, made of partial sums in the tasks. It lets all of them through and few others, which an exact join sorts out later."""
    words = df.groupBy(F.shiftright(F.pmod(column, F.lit(bits)), 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(`{column}`, 64) as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    return out


def let_through(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned hashes the bitmap lets through."""
    return (bitmap[(hashes & np.uint64(64 * len(bitmap) - 1)) >> np.uint64(6)] >> (hashes & np.uint64(63)) & np.uint64(1)).astype(bool)


def with_hits(df: DataFrame, hashed: str, keys: DataFrame, bits: int = ROW_BITS) -> DataFrame:
    """``df`` with a boolean column ``hit``: true if its column ``hashed`` is in the same column of ``keys``, and for few others. A bitmap of ``bits`` bits, a row a word, is broadcast."""
    bucket = F.pmod(hashed, F.lit(bits))
    words = keys.select(bucket.alias("bucket")).groupBy(F.shiftright("bucket", 6).alias("hit_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bucket % 64 as int))")).alias("hit_bits"))
    words = materialize(words, "hits")
    marked = df.join(F.broadcast(words), F.shiftright(bucket, 6) == F.col("hit_word"), "left")
    return marked.withColumn("hit", F.coalesce(F.getbit("hit_bits", bucket % 64) == 1, F.lit(False))).drop("hit_word", "hit_bits")


def hot_join(rows: DataFrame, named: DataFrame, key: str, how: str = "inner", share: float = HOT_SHARE) -> DataFrame:
    """``rows.join(named, key, how)`` for ``named`` with one row a key and ``how`` inner, left or left_semi.

    Keys with more than HOT_ROWS rows and more than ``share`` of all, of which there are fewer than ``1 / share``, are
    joined by a broadcast, so that no key's rows meet in one task; all others are joined by a shuffle. ``rows`` are files.
    """
    hot = materialize(rows.groupBy(key).count().where(F.col("count") > HOT_ROWS), "hot-keys")
    if hot.isEmpty():
        return rows.join(named, key, how)
    hot = hot.where(F.col("count") > share * rows.count()).select(key)
    few = F.broadcast(named.join(F.broadcast(hot), key, "left_semi"))
    marked = rows.join(F.broadcast(hot.withColumn("hot_key", F.lit(True))), key, "left")
    apart, rest = marked.where("hot_key").drop("hot_key"), marked.where("hot_key is null").drop("hot_key")
    return apart.join(few, key, how).unionByName(rest.join(named, key, how))


def fold(column, mod: int):
    """crc32 of the id as text, modulo ``mod``: the fixed split into learning and held-out rows."""
    return F.crc32(column.cast("string").cast("binary")) % F.lit(mod)


def connected_components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` links of long ids -> ``(node, root)``, root the smallest node of its component.

    Alternating large-star and small-star rounds; each round is two aggregations and two
    equi-joins, is written to the shared folder, and stops when the link set no longer
    changes. Nothing but two numbers a round reaches the driver. Only nodes with links appear.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = materialize(small, "links")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """The columns of exactly these names, whatever other columns ``df`` has (names that differ in case only among them)."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).select(*(F.col(f"c{df.columns.index(name)}").alias(name) for name in names))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` with ``place``, from 0 in the order of ``order`` (nulls first) within each value of ``group``, and ``places``, their number.

    Rows are dealt by ranges of group and order, so a group of any size lies over many tasks; each range is numbered
    alone and moved on by the rows of the ranges before it. Rows that are equal in ``order`` take any of their places.
    """
    dealt = materialize(rows.repartitionByRange(group, *order).withColumn("range_no", F.spark_partition_id()), "ranges")
    whole = Window.partitionBy(group)
    counts = dealt.groupBy(group, "range_no").agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(whole.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(group, "range_no", before.alias("before"), F.sum("rows").over(whole).alias("places"))
    own = F.row_number().over(Window.partitionBy(group, "range_no").orderBy(*order))
    return dealt.withColumn("own", own).join(counts, [group, "range_no"]).withColumn("place", F.col("before") + F.col("own") - 1).drop("range_no", "own", "before")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a text of ASCII characters."""
    codes = f"list_transform(range(length({text})), lambda i: ascii(({text})[i + 1])::BIGINT)"
    bits = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: {bits}), 4294967295::BIGINT)"
