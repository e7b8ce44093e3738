"""Prefix trie of conversations by fixed-length blocks of turns.

A conversation is cut into blocks of :data:`BLOCK` turns. Every block has the digest of all
turns up to its end, so conversations are first grouped by whole blocks: equal ones collapse
into one row a block, whatever their number. Only where the same turns are followed by
different blocks are these cut into turns and grouped again, to find at which turn siblings
part; everywhere else the turns of a block are nodes as they are.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, crc32_sql, hot_join, materialize

#: Turns of a block; turns of a base that may come first.
BLOCK, SHARED = 4, 9
ROOT = bytes(16)


def id_crc32(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary"))


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, turn_key, n_bytes``: place from 1 in the order of turn, null first, and of the turn's digest among equal ones; texts stay behind."""
    rows = columns_of(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(key).alias("turn_key"), F.octet_length(text).cast("long").alias("n_bytes"))
    place = F.expr("row_number() over (partition by conv_id order by turn nulls first, turn_key)")
    return rows.select("conv_id", place.alias("place"), "turn_key", "n_bytes")


def rebuilt(own: DataFrame) -> DataFrame:
    """Turns of the conversations rebuilt from ``own``: the first ones of the base, ``conv_id - conv_id % 5``, then what follows their own first ones."""
    base, taken = F.expr("conv_id - conv_id % 5"), id_crc32(F.col("conv_id")) % SHARED
    convs = materialize(own.groupBy("conv_id").agg(F.max("place").alias("length")), "conversations")
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    got = convs.select("conv_id", base.alias("base"), taken.alias("taken")).join(lengths, "base", "left")
    got = materialize(got.withColumn("got", F.least("taken", F.coalesce("base_length", F.lit(0)))).select("conv_id", "base", "taken", "got"), "bases")
    first = own.where(F.col("place") < SHARED).withColumnRenamed("conv_id", "base")
    shared = got.join(first, "base").where("place <= taken").select("conv_id", "place", "turn_key", "n_bytes")
    rest = hot_join(own, got.select("conv_id", "taken", "got"), "conv_id").where("place > taken")
    return shared.unionByName(rest.withColumn("place", F.expr("cast(place - taken + got as int)")).select(*shared.columns))


def chained(rows: DataFrame) -> DataFrame:
    """``conv_id, block, start, tip, keys, sizes, last`` for each block of each conversation: digests of all turns before it, up to its end and up to each of its turns.

    Turns are read in order and only the digest so far and one block are held, so a conversation of any length takes little memory.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("start", pa.binary()), ("tip", pa.binary()), ("keys", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("last", pa.bool_())])

    def run(batches):
        now, so_far, block, start, keys, sizes = None, ROOT, 0, ROOT, [], []
        for batch in batches:
            out = []
            for conv_id, turn_key, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn_key", "n_bytes")), strict=True):
                if keys and (conv_id != now or len(keys) == BLOCK):
                    out.append((now, block, start, keys[-1], keys, sizes, conv_id != now))
                    block, start, keys, sizes = block + 1, so_far, [], []
                if conv_id != now:
                    now, so_far, block, start = conv_id, ROOT, 0, ROOT
                so_far = hashlib.sha256(so_far + turn_key).digest()[:16]
                keys.append(so_far)
                sizes.append(size)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((now, block, start, keys[-1], keys, sizes, True), schema, strict=True)], schema=schema)

    dealt = rows.select("conv_id", "place", "turn_key", "n_bytes").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.mapInArrow(run, "conv_id long, block long, start binary, tip binary, keys array<binary>, sizes array<long>, last boolean")


def ends(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """``node, ends_sha256``: hash of the ids, ascending and joined by commas, of the conversations that end at a node. Ids are read in order and none is held, so a node may have any number of them."""
    tips = blocks.where("last").select(F.col("tip").alias("node"), "conv_id")
    turnless = convs.join(tips, "conv_id", "left_anti").select(F.lit(bytearray(ROOT)).alias("node"), "conv_id")

    def run(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for node, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if node != now:
                    if state:
                        out.append((now, state.hexdigest()))
                    now, state = node, hashlib.sha256(str(conv_id).encode())
                else:
                    state.update(b",%d" % conv_id)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], ["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])

    return tips.unionByName(turnless).repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(run, "node binary, ends_sha256 string")


def nodes_of(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """``node, parent, start, up, depth, n_convs, conv_id, n_bytes``: one row a distinct prefix; ``up``: itself and the nodes above it in its block."""
    first = [F.first(c).alias(c) for c in ("start", "block", "keys", "sizes")]
    groups = materialize(blocks.groupBy("tip").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), *first).drop("tip"), "block-groups")
    ways = materialize(groups.groupBy("start").agg((F.count(F.lit(1)) > 1).alias("parts")), "ways")
    places = F.posexplode(F.arrays_zip("keys", "sizes")).alias("at", "here")
    single = hot_join(groups, ways, "start").select("start", "block", "keys", "n_convs", "conv_id", "parts", places)
    single = single.select(
        F.col("here.keys").alias("node"), F.when(F.col("at") > 0, F.expr("keys[at - 1]")).otherwise(F.col("start")).alias("parent"), "start", F.expr("slice(keys, 1, at + 1)").alias("up"),
        (F.col("block") * BLOCK + F.col("at") + 1).alias("depth"), "n_convs", "conv_id", F.col("here.sizes").alias("n_bytes"), "parts",
    )
    same = [F.first(c).alias(c) for c in ("parent", "start", "up", "depth")]
    refined = single.where("parts").groupBy("node").agg(*same, F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("n_bytes").alias("n_bytes"))
    nothing = F.lit(None).cast("binary")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.lit(bytearray(ROOT)).alias("node"), nothing.alias("parent"), nothing.alias("start"), F.array().cast("array<binary>").alias("up"), F.lit(0).cast("long").alias("depth"), "n_convs", "conv_id", F.lit(0).cast("long").alias("n_bytes"))
    return single.where("not parts").drop("parts").unionByName(refined).unionByName(root)


def below(nodes: DataFrame) -> DataFrame:
    """``node, leaves, saved``: sums over all nodes below each node at the end of a block that has any.

    First those of the block that starts there. Then, in rounds, each adds what the nodes a step below have and takes a
    step twice as long, so the rounds are as many as the bits of the number of blocks of the longest conversation.
    """
    sums = nodes.where("start is not null").groupBy(F.col("start").alias("node")).agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    found = materialize(sums.join(nodes.select("node", F.col("start").alias("above")), "node"), "below")
    while not found.where("above is not null").isEmpty():
        under = found.where("above is not null").groupBy(F.col("above").alias("node")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        further = found.select(F.col("node").alias("above"), F.col("above").alias("next"))
        found = hot_join(found, further, "above", "left").join(under, "node", "left")
        added = [(F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("leaves", "saved")]
        found = materialize(found.select("node", *added, F.col("next").alias("above")), "below")
    return found.select("node", "leaves", "saved")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: ``node, parent, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Null roles and texts are empty. Turns of equal ``turn`` stand in the order of their digests; repeated rows are turns
    of their own. Rows without conv_id belong to no conversation and are left out. Further columns do not matter. A
    conversation whose base is absent and whose own turns are all cut off ends at the root. An empty table has no nodes.
    """
    own = materialize(turns(conversations), "turns")
    convs = materialize(own.select("conv_id").distinct(), "conversations")
    blocks = materialize(chained(rebuilt(own)), "blocks")
    nodes = materialize(nodes_of(blocks, convs), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialize(nodes.withColumn("leaf", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")), "nodes")
    rest = below(nodes).toDF("node", "more_leaves", "more_saved")
    whole = nodes.join(rest, "node", "left").select(F.expr("if(depth = 0, array(node), up)").alias("up"), *((F.col(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("leaf", "more_leaves"), ("saved", "more_saved"))))
    sums = whole.withColumn("node", F.explode("up")).groupBy("node").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = ["node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = hot_join(nodes, parents, "parent", "left").join(sums, "node").join(ends(blocks, convs), "node", "left")
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).select(*named)


def query(conversations: DataFrame) -> DataFrame:
    """The nodes under the contract's names."""
    return trie(conversations).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


ORACLE = f"""
WITH own AS (
  SELECT conv_id, sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_key, octet_length(encode(coalesce(text, ''))) AS n_bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, turn_key) AS place FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32_sql("conv_id::VARCHAR")} % 9 AS taken FROM own GROUP BY conv_id),
rows_of AS (
  SELECT c.conv_id, 0 AS part, b.place, b.turn_key, b.n_bytes FROM convs c JOIN own b ON b.conv_id = c.base AND b.place <= c.taken
  UNION ALL
  SELECT c.conv_id, 1, o.place, o.turn_key, o.n_bytes FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.place > c.taken
),
prefixes AS (
  SELECT conv_id, n_bytes, row_number() OVER w AS depth, string_agg(turn_key, '') OVER w AS path, count(*) OVER (PARTITION BY conv_id) AS length
  FROM rows_of WINDOW w AS (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING)
),
all_prefixes AS (
  SELECT conv_id, n_bytes, depth, path, depth = length AS ends_here FROM prefixes
  UNION ALL
  SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM rows_of) FROM convs
),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n_bytes) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends_here), '')) AS ends_sha256 FROM all_prefixes GROUP BY path, depth
),
children AS (SELECT path[:64 * (depth - 1)] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
told AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (path)),
up AS (SELECT path[:64 * d] AS path, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS d FROM told) GROUP BY 1)
SELECT t.conv_id, t.depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children, u.n_leaves, u.saved_tokens, t.ends_sha256
FROM told t JOIN up u USING (path) LEFT JOIN told p ON t.depth > 0 AND p.path = t.path[:64 * (t.depth - 1)]
"""
