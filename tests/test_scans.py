"""Running values of keys that hold most rows, over many ranges."""

import datetime
import random

from pyspark.sql import functions as F

from anchorline.operators import references

UTC = datetime.timezone.utc
START = datetime.datetime(2024, 1, 1, tzinfo=UTC)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


def tasks_of(spark, df):
    """Rows of each partition of the window that ``df`` ends with."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_names_of_any_size(spark):
    r = random.Random(1)
    store = [("t", "hot" if r.random() < 0.9 else f"n{r.randrange(5)}", k, 1, at(r.randrange(4000) / 4)) for k in range(400)]
    refs = [(k, None, "hot " if r.random() < 0.9 else f"n{r.randrange(6)}", at(r.randrange(4400) / 4)) for k in range(3000)] + [(3000, None, " ", at(1)), (3001, None, None, at(1))]
    stored = spark.createDataFrame(store, "token string, name string, doc_id long, n_bytes long, created_at timestamp").withColumn("last_used_at", F.when(F.col("doc_id") % 3 == 0, F.col("created_at") + F.expr("interval 20 minutes")))
    found = references.resolve_by_name(spark.createDataFrame(refs, "id long, token string, name string, msg_ts timestamp").repartition(4), stored)
    want = {}
    for k, _, name, ts in refs:
        best = max(((s[4], s[2]) for s in store if name and s[1] == name.strip() and s[4] <= ts), default=None)
        if best:
            used = max(best[0], min(best[0] + datetime.timedelta(minutes=20 if best[1] % 3 == 0 else 0), ts))
            best = best if ts - used <= datetime.timedelta(milliseconds=references.TTL_MS) else None
        want[k] = best[1] if best else None
    assert {x["id"]: x["doc_id"] for x in found.collect()} == want


def test_one_hot_name_lies_over_many_tasks(spark):
    refs = spark.range(20_000).select("id", F.lit(None).cast("string").alias("token"), F.lit("hot").alias("name"), F.timestamp_seconds("id").alias("msg_ts"))
    stored = spark.createDataFrame([("t", "hot", 1, 1, at(0))], "token string, name string, doc_id long, n_bytes long, created_at timestamp").withColumn("last_used_at", F.col("created_at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = tasks_of(spark, references.ranged(refs, "name", "msg_ts"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(rows) == 20_000 and max(rows) < 8_000
    assert references.resolve_by_name(refs, stored).count() == 20_000


def test_owners_and_tokens_of_any_size(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.9 else f"o{r.randrange(3)}", f"{k:04}", r.randrange(100), at(r.randrange(500))) for k in range(1500)]
    stored = spark.createDataFrame(rows, "owner string, token string, n_bytes long, created_at timestamp").withColumn("last_used_at", F.lit(None).cast("timestamp"))
    kept = references.retain_references(stored, F.lit(at(520)), "owner", 400 * 60_000, 300, 12_000)
    want = set()
    for owner in {o for o, *_ in rows}:
        items = size = 0
        for o, token, n, ts in sorted((x for x in rows if x[0] == owner and at(520) - x[3] <= datetime.timedelta(minutes=400)), key=lambda x: (x[3], x[1]), reverse=True):
            items, size = items + 1, size + n
            if items <= 300 and size <= 12_000:
                want.add((o, token))
    assert {(x["owner"], x["token"]) for x in kept.collect()} == want and kept.columns == stored.columns
    uses = [("hot" if r.random() < 0.9 else f"t{r.randrange(4)}", at(r.choice([k, k, k + 40]) + 5 * (k > 900) * (k % 7))) for k in range(1200)]
    for ttl in (60_000, 600_000, 1_800_000):
        alive, last, want = {}, {}, []
        for token, ts in sorted(uses):
            alive[token] = alive.get(token, True) and (token not in last or ts - last[token] <= datetime.timedelta(milliseconds=ttl))
            last[token] = ts
            want.append((token, ts, alive[token]))
        got = references.reference_liveness(spark.createDataFrame(uses, "token string, ts timestamp").repartition(3), ttl)
        assert sorted((x["token"], x["ts"].replace(tzinfo=UTC), x["alive"]) for x in got.collect()) == sorted(want)
