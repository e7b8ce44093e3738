"""The same jobs on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.blocks import extract_corpus
from ..operators.messages import expand_messages
from ..operators.references import TTL_MS, attachment_cards
from ..sources.files import read_listed

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def stream_extract(spark: SparkSession, path: str, sink: Callable[[DataFrame, DataFrame, DataFrame, int], None]):
    """New files to blocks: ``sink(docs, blocks, errors, batch)`` for each micro-batch. Returns the writer, to be given a checkpoint and started."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).load(path)
    named = files.select(F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.lit("").alias("mime"), "length", "content")

    def each(batch: DataFrame, number: int) -> None:
        sink(*extract_corpus(batch), number)

    return named.writeStream.foreachBatch(each)


def stream_listed(spark: SparkSession, lists: str, sink: Callable[[DataFrame, DataFrame, DataFrame, int], None]):
    """As :func:`stream_extract`, for files that are announced by new files of a table ``lists(path)`` (:func:`write_files`).

    A stream of files keeps several kilobytes a file in the driver; here it knows the lists alone, however many files they name.
    A file that is listed again in a later batch is read again, under the same id.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(*extract_corpus(read_listed(batch).withColumn("mime", F.lit(""))), number)

    return spark.readStream.schema("path string").parquet(lists).writeStream.foreachBatch(each)


def batch_sink(path: str) -> Callable[[DataFrame, DataFrame, DataFrame, int], None]:
    """A sink of :func:`stream_extract` that keeps each batch under its number: a batch that is run again replaces itself, so every block is there once."""

    def sink(docs: DataFrame, blocks: DataFrame, errors: DataFrame, number: int) -> None:
        for name, rows in (("docs", docs), ("blocks", blocks), ("errors", errors)):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return sink


def read_batches(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """What :func:`batch_sink` has kept of ``docs``, ``blocks`` or ``errors``."""
    return spark.read.schema(schema + ", batch long").parquet(f"{path}/{name}")


def stream_expand_messages(blocks: DataFrame, resolve: Callable[[DataFrame], DataFrame], contexts: DataFrame, sink: Callable[[DataFrame, int], None]):
    """Message blocks of a stream, expanded with a table of contexts; ``resolve`` gives a batch's segments with their ``doc_id``."""

    def each(batch: DataFrame, number: int) -> None:
        sink(expand_messages(batch, resolve(batch), contexts), number)

    return blocks.writeStream.foreachBatch(each)


class Liveness(StatefulProcessor):
    """Uses of a token wait until the watermark has passed them, so they are judged in order of time; the last judged use and verdict are kept.
    A token has one timer for its earliest waiting use: all uses that are due then are judged together, and the next one sets the timer anew."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long")
        self.last = handle.getValueState("last", "ts long, alive boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        come = [t for batch in rows for t in batch["ts"].astype("datetime64[us]").astype("int64").tolist()]
        self.waiting.appendList([(t,) for t in come])
        self.handle.registerTimer(min(come) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted(x[0] for x in self.waiting.get())
        due = [t for t in held if t < now]
        if not due:
            return
        last, alive = (self.last.get() if self.last.exists() else (None, True))
        out = []
        for t in due:
            alive = alive and (last is None or t // 1000 - last // 1000 <= self.ttl_ms)
            last = t
            out.append((key[0], pd.Timestamp(t, unit="us"), alive))
        self.last.update((last, alive))
        if rest := held[len(due) :]:
            self.waiting.put([(t,) for t in rest])
            self.handle.registerTimer(rest[0] // 1000 + 1)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=["token", "ts", "alive"])

    def close(self) -> None:
        pass


def stream_reference_liveness(uses: DataFrame, ttl_ms: int = TTL_MS, watermark: str = "10 minutes") -> DataFrame:
    """``token, ts, alive`` of uses ``(token, ts)``, as :func:`reference_liveness` gives them on a table; uses later than the watermark are dropped.
    Needs the RocksDB state store."""
    keyed = uses.select("token", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark).groupBy("token")
    return keyed.transformWithStateInPandas(Liveness(ttl_ms), outputStructType="token string, ts timestamp, alive boolean", outputMode="Append", timeMode="EventTime")


def stream_dedup_requests(requests: DataFrame, watermark: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """The first request of each key within the watermark goes on."""
    return requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["cache_key"])


def stream_fan_out(requests: DataFrame, results: DataFrame, within: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Every asker ``requests(cache_key, ts, ...)`` with the ``results(cache_key, result_ts, ...)`` of its key that came at most ``within`` before or after it.

    A request that comes while its key is being answered, or soon after, has the answer that others asked for. Both sides are
    kept until the watermarks have passed ``within``, so the state is bounded by the rows of that time. A result stands in the
    span of time (as long as ``within``, a fixed length) that it came in and in both beside it, so an asker is compared with the
    results of its own span alone and not with all that are kept of its key.
    """
    span = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {within}"))
    number = lambda ts: F.floor(F.unix_micros(ts) / span)
    asked = requests.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).withColumn("_span", number("ts"))
    told = results.withColumn("result_ts", F.col("result_ts").cast("timestamp")).withWatermark("result_ts", watermark).withColumnRenamed("cache_key", "_key")
    told = told.withColumn("_near", F.explode(F.array(*(number("result_ts") + k for k in (-1, 0, 1)))))
    near = F.expr(f"result_ts between ts - interval {within} and ts + interval {within}")
    return asked.join(told, (F.col("cache_key") == F.col("_key")) & (F.col("_span") == F.col("_near")) & near).drop("_key", "_span", "_near")


def stream_attachment_cards(events: DataFrame) -> DataFrame:
    return attachment_cards(events)
