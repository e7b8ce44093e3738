"""SimHash near-duplicates by one-wildcard segment variants.

A 64-bit fingerprint is cut into two 32-bit segments. If two fingerprints differ in at
most two bits, either their high segments differ in at most one bit, or the low segments
are equal. So every distinct fingerprint is indexed under its 32 high-segment variants
(one bit position wildcarded) and its whole low segment; an equality join on those 33
keys finds every link, and the join condition verifies the distance and lets each pair
through under exactly one key.

Two bits of 64 reach few pairs of texts whose shingles have a Jaccard similarity of 0.8; they
lie up to 11 bits apart, and segments short enough for that would pair any two texts. So
:func:`similar_texts` adds a search by leading shingles.
"""

from __future__ import annotations

import itertools
import math
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, hot_join, let_through, materialize, sieve, slices, with_hits
from .wordhash import Words, mixed, parts, runs, summed

#: Words of a shingle and least Jaccard similarity of texts that are similar.
WIDTH, SIMILARITY = 5, 0.8
#: Pairs of texts that lie further apart than FAR bits of 128 are not verified: texts of a similarity of 0.8 lie 20 to 24 bits apart, the most for 5 and 4 shingles, with a deviation of 4; others 64.
FAR = 42
#: Turns in which texts are compared with one of their bucket. After that all that are still apart are compared: in a join in buckets of at most WHOLE rows, in blocks of about ROWS rows and at most about MANY shingles in larger ones.
TURNS, WHOLE, ROWS, MANY = 5, 256, 2048, 1 << 20
#: Shingle hashes turned into bits at a time: bounds a task's memory for a text of any length.
BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit SimHash of ``width``-word shingles; zero for a text without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    rows = zip(*(islice(words, k, None) for k in range(width))) if len(words) >= width else iter([words])
    hashes = map(xxh64_intdigest, map(b" ".join, rows), repeat(42))
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        some = np.fromiter(islice(hashes, BLOCK), np.uint64, min(BLOCK, n - at))
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp`` for every row of ``docs(doc_id, text)``; a null text has no words."""

    def run(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([fingerprint(t, width) for t in part.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """Pairs ``u < v`` of distinct fingerprints (column ``fp``, already distinct) that differ in at most two bits, each once.

    Spark sizes the keys as the fingerprints that they are exploded from, a 33rd of what they are, so it is told to join them by a shuffle.
    """
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    keys = [high.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << i))).bitwiseOR(F.lit(i << 32)) for i in range(32)] + [low.bitwiseOR(F.lit(32 << 32))]
    indexed = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    a, b = indexed.select(F.col("fp").alias("u"), "key"), indexed.select(F.col("fp").alias("v"), "key")
    differ = F.col("u").bitwiseXOR(F.col("v"))
    high_bits, variant = F.bit_count(F.shiftrightunsigned(differ, 32)), F.shiftright(a["key"], 32)
    once = F.when(high_bits == 0, variant == 0).when(high_bits == 1, variant < 32).otherwise(variant == 32)
    return a.join(b.hint("merge"), (a["key"] == b["key"]) & (F.col("u") < F.col("v")) & (F.bit_count(differ) <= 2) & once).select("u", "v")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id`` (smallest doc_id reachable over links).

    Equal fingerprints collapse before the search, so a group of copies of any size costs one
    index entry. Null texts and texts without words have fingerprint zero and link like any other;
    repeated rows come back repeated; rows with a null doc_id get the least id of their component,
    null where it has none. An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, width), "fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = connected_components(links(nodes.select("fp"))).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def ranked(words: Words, width: int) -> list[np.ndarray]:
    """The distinct ``width``-word shingles of each text as hashes, longest shingles first: a fixed order in which rare ones tend to come early.

    A text of fewer words is one shingle; one without words has the shingle zero.
    """
    n = np.where(words.counts >= width, words.counts - width + 1, np.minimum(words.counts, 1))
    start = parts(words.first[:-1], n)
    end = np.minimum(start + width, np.repeat(words.first[1:], n))
    letters = np.append(0, np.cumsum(words.end - words.start))
    length = np.minimum(letters[end] - letters[start], 255).astype(np.uint64)
    rank = (np.uint64(255) - length) << np.uint64(56) | runs(summed(words.hashes), start, end) >> np.uint64(8)
    at = np.append(0, np.cumsum(n)).tolist()
    return [np.unique(rank[a:b]) if a < b else np.zeros(1, np.uint64) for a, b in itertools.pairwise(at)]


def of_shingles(shingles: np.ndarray) -> tuple[int, int]:
    """128-bit SimHash of distinct shingles, as two signed halves."""
    ones = np.zeros(128, np.int64)
    for at in range(0, len(shingles), BLOCK):
        hashes = mixed(shingles[at : at + BLOCK])
        both = np.stack([hashes, mixed(hashes)], axis=1)
        ones += np.unpackbits(both.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return tuple(np.packbits(2 * ones > len(shingles), bitorder="little").view(np.int64).tolist())


def leading(shingles: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles, of which two texts of that similarity must share one."""
    return shingles[: len(shingles) - math.ceil(similarity * len(shingles) - 1e-9) + 1]


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(F.xxhash64("text").alias("text_key"), F.lower("text").alias("text"))


def bucketed(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """``text_key, fp, more, n, keys``: two halves of the fingerprint, number of shingles, and those leading shingles that are in two texts; copies collapse."""

    def shingles_of(part):
        return part.column(0), ranked(Words(part.column(1)), width)

    def first(batches):
        for part in slices(batches):
            keys, sets = shingles_of(part)
            heads = [leading(s, similarity) for s in sets]
            of = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(of)), pa.array(np.concatenate(heads).view(np.int64))], ["text_key", "key"])

    twice = texts.mapInArrow(first, "text_key long, key long").groupBy("key").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a <> b").select("key")
    bits = texts.sparkSession.sparkContext.broadcast(sieve(twice, "key"))

    def second(batches):
        for part in slices(batches):
            keys, sets = shingles_of(part)
            heads = [h[let_through(bits.value, h)] for h in (leading(s, similarity) for s in sets)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, heads)]), pa.int32()), pa.array(np.concatenate(heads).view(np.int64)))
            low, high = zip(*map(of_shingles, sets), strict=True)
            yield pa.RecordBatch.from_arrays([keys, pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), lists], ["text_key", "fp", "more", "n", "keys"])

    return texts.mapInArrow(second, "text_key long, fp long, more long, n int, keys array<long>").groupBy("text_key").agg(*(F.first(c).alias(c) for c in ("fp", "more", "n", "keys")))


def shingle_sets(texts: DataFrame, named: DataFrame, width: int) -> DataFrame:
    """``text_key, shingles``: the distinct shingles of the texts whose key is in ``named``, and of few others."""

    def run(batches):
        for part in slices(batches):
            sets = ranked(Words(part.column(1)), width)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["text_key", "shingles"])

    some = with_hits(texts, "text_key", named).where("hit").select("text_key", "text").mapInArrow(run, "text_key long, shingles array<long>")
    return materialize(some.groupBy("text_key").agg(F.first("shingles").alias("shingles")), "shingles")


def verified(texts: DataFrame, pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of distinct ``pairs(u, v)`` of text keys whose shingles have at least that Jaccard similarity."""
    pairs = materialize(pairs, "pairs")
    sets = shingle_sets(texts, pairs.select(F.explode(F.array("u", "v")).alias("text_key")).distinct(), width)
    both = hot_join(pairs, sets.toDF("u", "a"), "u")
    both = materialize(both, "pairs")
    both = hot_join(both, sets.toDF("v", "b"), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(shared >= similarity * (F.size("a") + F.size("b") - shared) - 1e-9).select("u", "v")


class Postings:
    """Which of some sets hold a value; the sets lie one after the other in ``values``."""

    def __init__(self, values: np.ndarray, lengths: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.values, first = np.unique(values[order], return_index=True)
        self.first, self.of, self.sets = np.append(first, len(values)), np.repeat(np.arange(len(lengths)), lengths)[order], len(lengths)

    def shared(self, values: np.ndarray) -> np.ndarray:
        """How many of distinct ``values`` each set holds."""
        at = np.searchsorted(self.values, values)
        inside = at < len(self.values)
        at = at[inside][self.values[at[inside]] == values[inside]]
        return np.bincount(self.of[parts(self.first[at], self.first[at + 1] - self.first[at])], minlength=self.sets)


def sets_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists, and the length of each list."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def halves(table: pa.Table, lists: str) -> tuple[dict, list[np.ndarray], dict, Postings]:
    """Of the rows of a pair of blocks: columns and lists of the few, columns and postings of the others."""
    few, many = table.filter(table["few"]), table.filter(pc.invert(table["few"]))
    values, lengths = sets_of(few[lists])
    columns = ({c: t[c].to_numpy() for c in t.column_names if c not in (lists, "few")} for t in (few, many))
    own = [values[x:y] for x, y in itertools.pairwise([0, *np.cumsum(lengths).tolist()])]
    return next(columns), own, next(columns), Postings(*sets_of(many[lists]))


def across_blocks(mixed_rows: DataFrame, found: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links ``u, v`` that join all similar texts of each bucket that are still apart, at most one a text and pair of blocks.

    The rows outside of a bucket's largest component are dealt into blocks, and so are all its rows; each pair of blocks
    is compared in a task of its own, which holds two blocks. First by fingerprints, under the least key that two
    texts share, which leaves texts that are near another one; then by all shingles of those.
    """
    cell = ["key", "i", "j"]

    def blocks(of):
        return F.greatest(F.ceil(F.count(of) / ROWS), F.ceil(F.sum(F.when(of.isNotNull(), F.col("n"))) / MANY)).cast("long")

    sizes = mixed_rows.groupBy("key").agg(blocks(F.when(F.col("root") != F.col("most"), 1)).alias("few_blocks"), blocks(F.col("n")).alias("all_blocks"))
    dealt = hot_join(mixed_rows, materialize(sizes, "blocks"), "key").join(found.select("text_key", "keys").hint("merge"), "text_key")
    dealt = materialize(dealt.withColumn("before", F.filter("keys", lambda k: k < F.col("key"))).drop("keys"), "dealt")
    i, j = (F.pmod(F.xxhash64("text_key"), F.col(n)) for n in ("few_blocks", "all_blocks"))
    every_i, every_j = (F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)) for n in ("few_blocks", "all_blocks"))
    named = ["key", "text_key", "root", "most", "fp", "more", "n", "before"]
    cells = dealt.where("root <> most").select(*named, F.lit(True).alias("few"), i.alias("i"), every_j.alias("j"))
    cells = cells.unionByName(dealt.select(*named, F.lit(False).alias("few"), every_i.alias("i"), j.alias("j")))

    def near(table: pa.Table) -> pa.Table:
        a, before, b, earlier = halves(table, "before")
        hit_a, hit_b = np.zeros(len(before), bool), np.zeros(earlier.sets, bool)
        for k, own_before in enumerate(before):
            apart = np.bitwise_count((b["fp"] ^ a["fp"][k]).view(np.uint64)).astype(int) + np.bitwise_count((b["more"] ^ a["more"][k]).view(np.uint64))
            ok = (b["root"] != a["root"][k]) & ((b["root"] == b["most"]) | (b["text_key"] > a["text_key"][k])) & (apart <= FAR)
            ok &= np.minimum(b["n"], a["n"][k]) >= similarity * np.maximum(b["n"], a["n"][k]) - 1e-9
            if ok.any():
                ok &= earlier.shared(own_before) == 0
                hit_a[k], hit_b = ok.any(), hit_b | ok
        out = [pa.concat_arrays([pa.array(a[c][hit_a]), pa.array(b[c][hit_b])]) for c in (*cell, "text_key", "root")]
        return pa.Table.from_arrays([*out, pa.array(np.arange(hit_a.sum() + hit_b.sum()) < hit_a.sum())], [*cell, "text_key", "root", "few"])

    def linked(table: pa.Table) -> pa.Table:
        a, own_sets, b, others = halves(table, "shingles")
        n, top, out = np.bincount(others.of, minlength=others.sets), {}, []

        def root(x):
            while (up := top.get(x, x)) != x:
                x = up
            return x

        for k, own_set in enumerate(own_sets):
            shared = others.shared(own_set)
            for m in np.flatnonzero((b["root"] != a["root"][k]) & (shared >= similarity * (len(own_set) + n - shared) - 1e-9)):
                if (x := root(a["root"][k])) != (y := root(b["root"][m])):
                    top[x] = y
                    out.append((a["text_key"][k], b["text_key"][m]))
        return pa.Table.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["u", "v"])

    hits = materialize(cells.groupBy(*cell).applyInArrow(near, "key long, i long, j long, text_key long, root long, few boolean"), "near-blocks")
    sets = shingle_sets(texts, hits.select("text_key").distinct(), width)
    return hits.join(sets, "text_key").groupBy(*cell).applyInArrow(linked, "u long, v long")


def similar_texts(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``text_key, root`` of all texts that are linked to another one: pairs of distinct texts whose ``width``-word shingles have at least that Jaccard similarity.

    Pairs to be verified come from the fingerprints that differ in at most two bits, and from leading shingles (the
    first ``(1 - similarity) * n + 1`` in a fixed order, of which such a pair shares one): in some turns each text with
    one of its bucket in another component, a different one each turn, then all that are still in different components
    (:func:`across_blocks` in large buckets). So a group of similar texts costs a few pairs a member and bucket, and no
    pair is left out. Before their shingles are compared, pairs are sieved by their fingerprints.
    """
    texts = keyed(docs)
    found = materialize(bucketed(texts, width, similarity), "buckets")
    nodes = found.groupBy("fp").agg(F.min("text_key").alias("u"))
    close = links(nodes.select("fp")).toDF("fp", "other").join(nodes, "fp").join(nodes.toDF("other", "v"), "other").select("u", "v")
    same = found.select("fp", F.col("text_key").alias("v")).join(nodes, "fp").select("u", "v")
    rows = materialize(found.select("text_key", "fp", "more", "n", F.explode("keys").alias("key")), "bucket-rows")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other_fp"))) + F.bit_count(F.col("more").bitwiseXOR(F.col("other_more")))
    near = (F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9) & (apart <= FAR)

    def star(rooted: DataFrame, turn: int) -> DataFrame:
        """Pairs of each text of a bucket with one text of it that is in another component, a different one each turn."""
        first = F.xxhash64("text_key", F.lit(turn))
        heads = rooted.groupBy("key").agg(F.min_by("text_key", first).alias("u"), F.min_by("root", first).alias("of"), F.min_by("fp", first).alias("other_fp"), F.min_by("more", first).alias("other_more"), F.min_by("n", first).alias("m"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
        found = hot_join(rooted, heads, "key").where((F.col("root") != F.col("of")) & near)
        return materialize(found.select(F.least("u", "text_key").alias("u"), F.greatest("u", "text_key").alias("v")).distinct(), "star")

    pairs = close.unionByName(same).where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    pairs = materialize(pairs.unionByName(star(rows.withColumn("root", F.col("text_key")), 0)).distinct(), "star")
    linked = materialize(verified(texts, pairs, width, similarity), "links")
    for turn in range(1, TURNS + 1):
        roots = materialize(connected_components(linked), "roots")
        rooted = materialize(hot_join(rows, roots.withColumnRenamed("node", "text_key"), "text_key", "left").withColumn("root", F.coalesce("root", "text_key")), "rooted")
        parts_of = rooted.groupBy("key", "root").count()
        most = parts_of.groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.count(F.lit(1)).alias("roots"), F.sum("count").alias("rows")).where("roots > 1").select("key", "most", "rows")
        mixed_rows = materialize(hot_join(rooted, materialize(most, "most"), "key"), "mixed-buckets")
        if turn < TURNS:
            tried = star(mixed_rows.drop("most", "rows"), turn).join(pairs, ["u", "v"], "left_anti")
            tried = materialize(tried, "star")
            if tried.isEmpty():
                break
            pairs = pairs.unionByName(tried)
            linked = materialize(linked.unionByName(verified(texts, tried, width, similarity)), "links")
    large = across_blocks(mixed_rows.where(F.col("rows") > WHOLE), found, texts, width, similarity)
    mixed_rows = mixed_rows.where(F.col("rows") <= WHOLE)
    few = mixed_rows.where("root <> most").select("key", F.col("text_key").alias("u"), F.col("fp").alias("other_fp"), F.col("more").alias("other_more"), F.col("n").alias("m"), F.col("root").alias("of"))
    across = mixed_rows.join(few, "key").where((F.col("root") != F.col("of")) & near).select(F.least("u", "text_key").alias("u"), F.greatest("u", "text_key").alias("v")).distinct()
    late = verified(texts, across.join(pairs, ["u", "v"], "left_anti"), width, similarity)
    return connected_components(linked.unionByName(late).unionByName(large)).select(F.col("node").alias("text_key"), "root")


def one_of_each(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of equal or similar texts: that with the smallest doc_id, and of those the one whose row has the smallest hash.

    A null doc_id comes after all others. Null texts count as empty. Rows that are equal whole are one. Other columns
    stay, whatever their names; an empty table gives an empty one. Only rows that may go are shuffled with their texts.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    rows = docs.toDF(*names)
    rows = rows.withColumn("row_key", F.xxhash64(*names)).withColumn("doc_id", doc_id.cast("long")).withColumn("text_key", F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))))
    keys = materialize(rows.select("row_key", "doc_id", "text_key"), "rows")
    roots = materialize(similar_texts(docs, width, similarity), "similar")
    rooted = materialize(hot_join(keys, roots, "text_key", "left").select("row_key", "doc_id", F.coalesce("root", "text_key").alias("root")), "rooted-rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    first = rooted.groupBy("root").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("root", "first")
    group = materialize(hot_join(rooted, first, "root"), "groups")
    gone = group.where(F.col("row_key") != F.col("first.row_key")).select("row_key").distinct()
    again = group.where(F.col("row_key") == F.col("first.row_key")).groupBy("row_key").count().where("count > 1").select("row_key")
    marked = with_hits(rows, "row_key", gone.unionByName(again))
    left = marked.where("hit").join(gone, "row_key", "left_anti")
    repeated = left.join(again, "row_key", "left_semi").dropDuplicates(names)
    return marked.where("not hit").select(*names).unionByName(left.join(again, "row_key", "left_anti").select(*names)).unionByName(repeated.select(*names)).toDF(*docs.columns)


def query(docs: DataFrame) -> DataFrame:
    """The digest of :func:`near_duplicates` under its contract."""
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
