"""Merkle manifest of a table: a root that stands for every row, and a proof for each.

Leaves are rows in the order of their ids within each source. A tree has three children a
node. :data:`FAN` nodes that stand side by side are a block, and a block keeps each of its
levels as one string of digests: parents are hashes of substrings of 192 hex digits, and the
siblings of a node are the substrings that flank it. The blocks' own digests are the nodes of
the next round, so a tree over any number of rows takes few rounds and no group is larger
than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, crc32_sql, materialize, numbered

#: Children of a node, levels of a block, nodes of a block, hex digits of a digest.
ARITY, LEVELS, HEX = 3, 5, 64
FAN = ARITY**LEVELS


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as it goes into a leaf: byte count, colon and value, or a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, origin, leaf, tampered_leaf``: sources as non-null strings in their order (null first), the second leaf null where nothing changes."""
    docs = columns_of(docs, "doc_id", "source", "lang", "n_chars", "text")
    head = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text").cast("string")
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & text.contains("\n")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("origin"),
        digest(*head, field(text)).alias("leaf"), F.when(tampered, digest(*head, field(F.translate(text, "\n", "")))).alias("tampered_leaf"),
    )


def parents(level: Column) -> Column:
    """The level above one: a hash of every three digests, the last of those that are left."""
    wide = ARITY * HEX
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / wide).cast("int"))
    return F.array_join(F.transform(runs, lambda r: F.sha2(F.substring(level, r * wide + 1, F.lit(wide)), 256)), "").cast("binary")


def blocks(nodes: DataFrame) -> DataFrame:
    """``tree, block, places, members, level_0 ..., top`` of ``nodes(tree, place, places, node, ...)``: the levels of each block, and the digest that is left of it."""
    held = [c for c in nodes.columns if c not in ("tree", "place", "places")]
    members = F.array_sort(F.collect_list(F.struct((F.col("place") % FAN).cast("int").alias("at"), *held)))
    out = nodes.groupBy("tree", F.expr(f"place div {FAN}").alias("block"), "places").agg(members.alias("members"))
    out = out.withColumn("level_0", F.array_join(F.transform("members", lambda m: m["node"]), "").cast("binary"))
    for k in range(LEVELS):
        level = F.col(f"level_{k}")
        out = out.withColumn(f"level_{k + 1}", F.when(F.col("places") > ARITY**k, parents(level)).otherwise(level))
    return out.withColumnRenamed(f"level_{LEVELS}", "top").withColumn("top", F.col("top").cast("string"))


def rounds_of(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of blocks from ``nodes`` up to one block a tree; each is written. One number reaches the driver."""
    most, rounds = nodes.agg(F.max("places")).first()[0] or 0, []
    while True:
        rounds.append(materialize(blocks(nodes), "merkle"))
        most = -(-most // FAN)
        if most <= 1:
            return rounds
        nodes = rounds[-1].select("tree", F.col("block").alias("place"), F.ceil(F.col("places") / FAN).cast("long").alias("places"), F.col("top").alias("node"))


def opened(made: DataFrame, upper: DataFrame) -> DataFrame:
    """The members of each block with ``path``: left and right siblings of every level, those of ``upper(tree, block, path, ...)`` last; other columns of ``upper`` stay."""
    rows = made.join(upper, ["tree", "block"]).withColumn("m", F.explode("members"))
    at, flanks = F.col("m.at"), []
    for k in range(LEVELS):
        level, own = F.col(f"level_{k}"), F.floor(at / ARITY**k).cast("int")
        first = F.floor(at / ARITY ** (k + 1)).cast("int") * ARITY
        left = F.substring(level, first * HEX + 1, (own - first) * HEX)
        right = F.substring(level, (own + 1) * HEX + 1, (first + ARITY - 1 - own) * HEX)
        flanks.append(F.when(F.col("places") > ARITY**k, F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))))
    path = F.concat(F.filter(F.array(*flanks), lambda x: x.isNotNull()), F.col("path"))
    kept = [c for c in upper.columns if c not in ("tree", "block", "path")]
    return rows.select("tree", F.expr(f"block * {FAN} + m.at").alias("place"), "m", path.alias("path"), *kept)


def down(rounds: list[DataFrame], upper: DataFrame) -> DataFrame:
    """The members of the first round with their whole path, of ``upper(tree, block, path, ...)`` for the only block of each tree."""
    for made in reversed(rounds[1:]):
        upper = opened(made, upper).drop("m").withColumnRenamed("place", "block")
    return opened(rounds[0], upper)


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, tampered_leaf, subroot, root, path`` for every row of ``docs``, whatever further columns it has.

    A tree a source, and one over the sources' roots in the order of their names (null first, then bytewise). Within a
    source rows stand in the order of doc_id, null first, equal ids in the order of their leaves; rows that are equal
    whole are leaves of their own side by side. A lone leaf is its subroot, a lone subroot the root. ``path`` is an array
    of left and right siblings, from the leaf up. An empty table gives an empty result.
    """
    found = materialize(leaves(docs), "leaves")
    nodes = numbered(found.withColumnRenamed("origin", "tree"), "tree", "doc_id", "leaf")
    rows = rounds_of(nodes.withColumnRenamed("leaf", "node"))
    origins = rows[-1].select(F.lit("").alias("tree"), F.col("tree").alias("origin"), F.col("top").alias("node"))
    above = rounds_of(numbered(origins, "tree", "origin"))
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    root = above[-1].select("tree", "block", no_path.alias("path"), F.col("top").alias("root"))
    subroots = down(above, root).select(F.col("m.origin").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("m.node").alias("subroot"), "root")
    return down(rows, subroots).select("m.doc_id", F.col("m.node").alias("leaf"), "m.tampered_leaf", "subroot", "root", "path")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))


def query(docs: DataFrame) -> DataFrame:
    """The manifest with each proof as a digest, and the root that a row gives after line feeds were deleted from half of the texts."""
    proof = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    out = manifest(docs).select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), folded(F.coalesce("tampered_leaf", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def field_sql(value: str) -> str:
    text = f"{value}::VARCHAR"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def tree_sql(name: str, start: str) -> str:
    """Nodes of all levels of trees, and their siblings."""
    return f"""
{name}(tree, place, node, n, level) AS (
  SELECT tree, place, node, n, 0 FROM {start}
  UNION ALL
  SELECT tree, place // 3, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 2) // 3, any_value(level) + 1 FROM {name} WHERE n > 1 GROUP BY tree, place // 3
),
{name}_siblings AS (
  SELECT a.tree, a.place, a.level, coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (WHERE b.place < a.place), '') || '|' || coalesce(string_agg(b.node, '' ORDER BY b.place) FILTER (WHERE b.place > a.place), '') AS flanks
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.place // 3 = b.place // 3 WHERE a.n > 1 GROUP BY ALL
),
{name}_paths AS (
  SELECT s.tree, s.place, coalesce(list(f.flanks ORDER BY f.level) FILTER (WHERE f.flanks IS NOT NULL), []) AS path
  FROM {start} s LEFT JOIN {name}_siblings f ON s.tree = f.tree AND f.place = s.place // (3 ** f.level)::BIGINT GROUP BY ALL
)"""


ORACLE = f"""
WITH RECURSIVE found AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {" || ".join(map(field_sql, ("doc_id", "source", "lang", "n_chars")))} AS head, text,
    CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS cut FROM documents
),
hashed AS (SELECT doc_id, tree, sha256(head || {field_sql("text")}) AS node, sha256(head || {field_sql("cut")}) AS tampered FROM found),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM hashed),
{tree_sql("own", "leaves")},
tops AS (SELECT '' AS tree, tree AS origin, node, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM own WHERE n = 1),
{tree_sql("above", "tops")},
proofs AS (
  SELECT l.doc_id, l.node AS leaf, l.tampered, t.node AS subroot, (SELECT node FROM above WHERE n = 1) AS root, list_concat(p.path, q.path) AS path
  FROM leaves l JOIN own_paths p ON l.tree = p.tree AND l.place = p.place JOIN tops t ON t.origin = l.tree JOIN above_paths q ON q.place = t.place
),
done AS (
  SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
    list_reduce(list_prepend(tampered, path), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root FROM proofs
)
SELECT *, folded_root = root AS verified FROM done
"""
