"""b-bit MinHash near-duplicates.

A text is its set of distinct five-word shingles. Of :data:`LANES` minima of the set, groups of
:data:`DEPTH` make a band key, and two bits of each minimum are packed into a signature. Texts that
share a band key lie in one bucket; within it signatures are compared by bit counts, corrected
for bits that are equal by chance, and what is likely to be similar is confirmed on the full
sets. Two texts of a similarity of 0.85 share no band once in a million pairs, and their
estimate lies under :data:`LEAST` about as rarely.

Equal sets are one before the search. In a bucket a set is first linked to the nearest of those
before it, so a group of near copies costs a pair a member; after that only sets of a bucket that
are still in different components are compared, in pairs of blocks, and confirmed where they
were compared. So no pairs leave a task but links that join components.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, connected_components, hot_join, let_through, materialize, sieve, slices
from .simhash import Postings
from .wordhash import BLOCK, mixed, parts, runs, summed

#: Words of a shingle, and least similarity of linked texts in percent.
WIDTH, PERCENT = 5, 85
#: Minima, bands and minima of a band, bits kept of each minimum, least estimate (5 deviations under 0.85) of pairs that are confirmed.
LANES, BANDS, DEPTH, BITS, LEAST = 256, 36, 7, 2, 0.72
#: Bits a key and at most of the bitmap of rows whose sets are read again: what it lets through beside them costs time alone.
KEY_BITS, MOST_BITS = 16, 1 << 28
#: Shingles whose minima are taken at a time; bytes of text read at a time; sets of a block, and shingles of its sets.
SOME, BYTES, ROWS, MANY = 256, 2 << 20, 2048, 1 << 20

_GAPS, _LOWER = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_GAPS[[9, 10, 11, 12, 13, 32]] = True
_LOWER[65:91] += 32
_SEEDS = mixed(np.arange(1, 2 * LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES, _FLIP = (_SEEDS[:LANES] >> np.uint64(32)).astype(np.uint32)[:, None] | np.uint32(1), (_SEEDS[LANES:] >> np.uint64(32)).astype(np.uint32)[:, None]
_PLACE, _BAND = mixed(np.arange(1, DEPTH + 1, dtype=np.uint64)), mixed(np.arange(101, BANDS + 101, dtype=np.uint64))


def shingles_of(column: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted hashes: a text of fewer words is one shingle, one without words or null has none. A-Z count as small letters, words end at space and the control characters 9 to 13."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = _LOWER[np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]]
    at = at - at[0]
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~_GAPS[data]
    begins, ends = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    first, last = at[:-1][at[:-1] < len(data)], at[1:][at[1:] > 0] - 1
    begins[first], ends[last] = solid[first + 1], solid[last + 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    words, k = np.empty(len(start), np.uint64), 0
    while k < len(start):
        low = start[k]
        upto = max(k + 1, int(np.searchsorted(end, low + BLOCK, side="right")))
        sums = summed(data[low : end[upto - 1]].astype(np.uint64) + np.uint64(1))
        words[k:upto] = runs(sums, start[k:upto] - low, end[k:upto] - low)
        k = upto
    of = np.searchsorted(start, at)
    counts = np.diff(of)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    low = parts(of[:-1], n)
    hashes = runs(summed(words), low, np.minimum(low + width, np.repeat(of[1:], n)))
    return [np.unique(hashes[a:b]) for a, b in itertools.pairwise(np.append(0, np.cumsum(n)).tolist())]


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of the shingles under each of the hash functions."""
    short, out = (shingles >> np.uint64(32)).astype(np.uint32), np.full(LANES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), SOME):
        np.minimum(out, ((short[at : at + SOME] ^ _FLIP) * _TIMES).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    return mixed((mixed(least[: BANDS * DEPTH].reshape(BANDS, DEPTH).astype(np.uint64) + _PLACE)).sum(axis=1) + _BAND).view(np.int64)


def signature(least: np.ndarray) -> np.ndarray:
    """The last bits of the minima, well mixed, as planes of one bit a minimum."""
    low = (least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return np.concatenate([np.packbits((low >> np.uint32(k) & np.uint32(1)).astype(bool)).view(np.int64) for k in range(BITS)])


def estimates(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity of a signature with others: the share of minima whose bits are all equal, corrected for those that are so by chance."""
    differ = (one ^ others).view(np.uint64).reshape(len(others), BITS, LANES // 64)
    unlike = np.bitwise_count(np.bitwise_or.reduce(differ, axis=1)).sum(axis=1)
    return (1 - unlike / LANES - 0.5**BITS) / (1 - 0.5**BITS)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def packed(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def unpacked(value: pa.Scalar, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(value.as_buffer() or b"", kind)


def signed(rows: DataFrame) -> DataFrame:
    """``doc_id, row_key, set_key, n, bits, bands`` of ``rows(doc_id, row_key, text)``."""

    def run(batches):
        for part in slices(batches, size=BYTES):
            sets = shingles_of(part.column(2))
            least = [minima(s) for s in sets]
            bands = pa.array([band_keys(m) if len(s) else [] for m, s in zip(least, sets, strict=True)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(map(set_key, sets), pa.binary()), pa.array(map(len, sets), pa.int64()), packed(map(signature, least)), bands], ["doc_id", "row_key", "set_key", "n", "bits", "bands"])

    return rows.mapInArrow(run, "doc_id long, row_key long, set_key binary, n long, bits binary, bands array<long>")


def bitmap(keys: DataFrame, column: str) -> Broadcast:
    """A bitmap of a column of hashes, sized by their number up to :data:`MOST_BITS`. It lets few others through, more where they are very many; an exact step follows."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(16, (KEY_BITS * keys.count()).bit_length()))
    return keys.sparkSession.sparkContext.broadcast(sieve(keys, column, bits))


def full_sets(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``set_key, shingles`` of the rows whose key is in ``named(row_key)``, and of few others, each set once; shingles are packed as 64-bit numbers."""
    wanted = bitmap(named, "row_key")

    def run(batches):
        for part in slices(batches, size=BYTES):
            part = part.filter(pa.array(let_through(wanted.value, part.column(0).to_numpy().view(np.uint64))))
            sets = shingles_of(part.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(map(set_key, sets), pa.binary()), packed(sets)], ["set_key", "shingles"])

    found = materialize(rows.select("row_key", "text").mapInArrow(run, "set_key binary, shingles binary"), "shingles")
    # Sets are dealt by their keys only if rows that are equal whole, ids included, gave one of them twice.
    if found.groupBy("set_key").count().where("count > 1").isEmpty():
        return found
    return materialize(found.dropDuplicates(["set_key"]), "shingles")


def members_of(classes: DataFrame, buckets: DataFrame) -> DataFrame:
    """``key, rows, set_key`` of the sets in ``buckets(key, rows)``: only band keys that may be in a bucket leave their tasks."""
    wanted = bitmap(buckets, "key")

    def run(batches):
        for batch in batches:
            bands = batch.column(1)
            keys, of = bands.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(bands)), bands.value_lengths().to_numpy(zero_copy_only=False))
            ok = let_through(wanted.value, keys.view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[ok])), pa.array(keys[ok])], ["set_key", "key"])

    return classes.select("set_key", "bands").mapInArrow(run, "set_key binary, key long").join(buckets, "key").select("key", "rows", "set_key")


def cells(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each value of a column by which the rows are sorted; one value's rows are held at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        if held and held[-1].column(column)[-1].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        for a, b in itertools.pairwise(cuts):
            held.append(batch.slice(a, b - a))
            if b < len(values):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def by_cell(rows: DataFrame, each: Callable[[pa.Table], pa.Table | None], schema: str, *order: str) -> DataFrame:
    """``each`` for the rows of each ``cell``, dealt by cells and read in order."""

    def run(batches):
        for held in cells(batches, "cell"):
            out = each(held)
            if out is not None and out.num_rows:
                yield from out.to_batches()

    return rows.repartition("cell").sortWithinPartitions("cell", *order).mapInArrow(run, schema)


def matrix(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["bits"].to_pylist()), np.int64).reshape(table.num_rows, -1)


def values_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all sets of some rows, and the length of each set."""
    sets = [unpacked(x) for x in table["shingles"]]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.array([len(x) for x in sets], np.int64)


def alike_in_size(n: int, others: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n, others) >= PERCENT * np.maximum(n, others)


def similar(shared: np.ndarray, n: int, others: np.ndarray) -> np.ndarray:
    return 100 * shared >= PERCENT * (n + others - shared)


def nearest(table: pa.Table) -> pa.Table:
    """For each set of a cell that of those before it with the greatest estimate, if that is at least :data:`LEAST`."""
    bits, n, us, vs, found = matrix(table), table["n"].to_numpy(), [], [], []
    for k in range(1, table.num_rows):
        value = np.where(alike_in_size(n[k], n[:k]), estimates(bits[k], bits[:k]), 0)
        if value[best := int(value.argmax())] >= LEAST:
            us.append(k), vs.append(best), found.append(float(value[best]))
    keys = table["set_key"]
    return pa.table({"u": keys.take(pa.array(us, pa.int64())), "v": keys.take(pa.array(vs, pa.int64())), "estimate": pa.array(found, pa.float64())})


def with_sets(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` with the ``shingles`` of their ``set_key``. Neither side has a bounded size, so the join is a merge at every size and nothing is broadcast."""
    return rows.join(sets.hint("merge"), "set_key")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(u, v)``, one a ``u``, whose full sets are similar. The set of a ``v`` is sent once a block of about :data:`ROWS` pairs."""
    most = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("long").alias("blocks"))
    dealt = materialize(hot_join(pairs, most, "v").withColumn("cell", F.xxhash64("v", F.pmod(F.xxhash64("u"), "blocks"))), "pairs")
    own = dealt.select("cell", "v", F.col("u").alias("set_key"), F.lit(False).alias("leads"))
    lead = dealt.select("cell", "v").distinct().select("cell", "v", F.col("v").alias("set_key"), F.lit(True).alias("leads"))
    both = with_sets(own.unionByName(lead), sets)

    def run(batches):
        head, head_set = None, None
        for batch in batches:
            for part in slices([batch]):
                us, vs = [], []
                leads, keys, shingles = part.column("leads").to_pylist(), part.column("set_key").to_pylist(), part.column("shingles")
                for k, (is_lead, key) in enumerate(zip(leads, keys, strict=True)):
                    values = unpacked(shingles[k])
                    if is_lead:
                        head, head_set = key, values
                        continue
                    shared = np.isin(values, head_set, assume_unique=True).sum()
                    if similar(shared, len(values), len(head_set)):
                        us.append(key), vs.append(head)
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])

    return both.repartition("cell").sortWithinPartitions("cell", "v", F.desc("leads")).mapInArrow(run, "u binary, v binary")


def near_across(table: pa.Table) -> pa.Table:
    """The sets of a cell that are near one of another component which shares no bucket of a lesser key with them."""
    few = table["few"].to_numpy(zero_copy_only=False)
    bits, n, before = matrix(table), table["n"].to_numpy(), table["before"].to_pylist()
    root, most, key = (np.array(table[c].to_pylist(), object) for c in ("root", "most", "set_key"))
    others, hit = np.flatnonzero(~few), np.zeros(len(few), bool)
    bits_b, n_b, root_b, key_b = bits[others], n[others], root[others], key[others]
    ordinary = root_b != most[others]
    lengths = np.array([len(before[k]) for k in others], np.int64)
    earlier = Postings(np.array([x for k in others for x in before[k]], np.int64), lengths)
    for k in np.flatnonzero(few):
        ok = (root_b != root[k]) & alike_in_size(n[k], n_b)
        ok[ok] = ~ordinary[ok] | (key_b[ok] > key[k])
        at = np.flatnonzero(ok)
        at = at[estimates(bits[k], bits_b[at]) >= LEAST]
        if len(at):
            at = at[earlier.shared(np.array(before[k], np.int64))[at] == 0]
        hit[k] |= len(at) > 0
        hit[others[at]] = True
    return table.filter(pa.array(hit)).select(["cell", "set_key", "root", "few"])


def links_across(table: pa.Table) -> pa.Table:
    """Links that join components among the sets of a cell, confirmed on the full sets."""
    few, many = table.filter(table["few"]), table.filter(pc.invert(table["few"]))
    values, lengths = values_of(few)
    all_values, n = values_of(many)
    others = Postings(all_values, n)
    roots, keys = (np.array(many[c].to_pylist(), object) for c in ("root", "set_key"))
    top, us, vs = {}, [], []

    def found(x):
        while (up := top.get(x, x)) != x:
            x = up
        return x

    for root, key, (a, b) in zip(few["root"].to_pylist(), few["set_key"].to_pylist(), itertools.pairwise([0, *np.cumsum(lengths).tolist()]), strict=True):
        for m in np.flatnonzero(similar(others.shared(values[a:b]), b - a, n) & (roots != root)):
            if (x := found(root)) != (y := found(roots[m])):
                top[x] = y
                us.append(key), vs.append(keys[m])
    return pa.table({"u": pa.array(us, pa.binary()), "v": pa.array(vs, pa.binary())})


def across(members: DataFrame, classes: DataFrame, links: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between sets of a bucket that ``links`` leave in different components, all that join components.

    The sets outside of a bucket's largest component are dealt into blocks, and so are all its sets; a pair of blocks is a cell.
    """
    roots = materialize(connected_components(links).withColumnRenamed("node", "set_key"), "roots")
    rooted = materialize(members.join(roots, "set_key", "left").select("key", "set_key", F.coalesce("root", "set_key").alias("root")), "rooted")
    most = rooted.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.count(F.lit(1)).alias("roots"))
    in_mixed = materialize(rooted.join(most.where("roots > 1").select("key", "most"), "key"), "mixed-buckets")
    of_set = in_mixed.groupBy("set_key").agg(F.collect_list("key").alias("keys")).join(classes.select("set_key", "n", "bits"), "set_key")
    before = F.filter("keys", lambda k: k < F.col("key"))
    mixed_rows = materialize(in_mixed.join(of_set, "set_key").withColumns({"before": before, "few": F.col("root") != F.col("most")}).drop("keys"), "mixed-buckets")

    def blocks(of):
        return F.greatest(F.ceil(F.count(F.when(of, 1)) / ROWS), F.ceil(F.sum(F.when(of, F.col("n"))) / MANY)).cast("long")

    sizes = mixed_rows.groupBy("key").agg(blocks(F.col("few")).alias("few_blocks"), blocks(F.lit(True)).alias("all_blocks"))
    dealt = hot_join(mixed_rows, materialize(sizes, "blocks"), "key")
    i, j = (F.pmod(F.xxhash64("set_key"), F.col(c)) for c in ("few_blocks", "all_blocks"))
    every_i, every_j = (F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1)) for c in ("few_blocks", "all_blocks"))
    named = ["key", "set_key", "root", "most", "n", "bits", "before"]
    both = dealt.where("few").select(*named, F.lit(True).alias("few"), i.alias("i"), every_j.alias("j")).unionByName(dealt.select(*named, F.lit(False).alias("few"), every_i.alias("i"), j.alias("j")))
    both = both.withColumn("cell", F.xxhash64("key", "i", "j")).drop("key", "i", "j")
    hits = materialize(by_cell(both, near_across, "cell long, set_key binary, root binary, few boolean"), "near-blocks")
    return by_cell(with_sets(hits, sets), links_across, "u binary, v binary")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``; component_id is the smallest doc_id that links reach.

    Null texts and texts without words have no shingles and link with nothing, so their component is their own doc_id.
    Repeated rows come back repeated. Rows with a null doc_id get the least id of their component, null where it has
    none. Different texts under one doc_id are rows of their own. Further columns do not matter. An empty table gives an empty result.
    """
    rows = columns_of(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    found = materialize(signed(rows), "signatures")
    same = [F.first(c).alias(c) for c in ("n", "bits", "bands")]
    classes = materialize(found.where("n > 0").groupBy("set_key").agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("least_id"), *same), "sets")
    keys = classes.select("set_key", F.explode("bands").alias("key"))
    content = [F.expr(f"bit_xor(xxhash64(set_key, {k}))").alias(f"content_{k}") for k in range(2)]
    buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), *content).where("rows > 1").groupBy("rows", "content_0", "content_1").agg(F.min("key").alias("key"))
    members = materialize(members_of(classes, materialize(buckets.select("key", "rows"), "buckets")), "members")
    sets = full_sets(rows, materialize(members.select("set_key").distinct().join(classes, "set_key").select("row_key"), "rows-of-sets"))
    blocks = F.ceil(F.col("rows") / ROWS).cast("long")
    cell = members.select("set_key", F.xxhash64("key", F.pmod(F.xxhash64("set_key"), blocks)).alias("cell"))
    heads = members.where(F.col("rows") > ROWS).groupBy("key", "rows").agg(F.min("set_key").alias("set_key")).select("key", "set_key", "rows", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("i"))
    heads = heads.where(F.col("i") != F.pmod(F.xxhash64("set_key"), blocks)).select("set_key", F.xxhash64("key", "i").alias("cell"))
    near = by_cell(cell.unionByName(heads).join(classes.select("set_key", "n", "bits"), "set_key"), nearest, "u binary, v binary, estimate double", "set_key")
    pairs = materialize(near.groupBy("u").agg(F.max_by("v", F.struct("estimate", "v")).alias("v")), "near")
    links = materialize(confirmed(pairs, sets), "links")
    links = materialize(links.unionByName(across(members, classes, links, sets)), "links")
    roots = classes.select("set_key", "least_id").join(connected_components(links).withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    roots = materialize(roots, "roots")
    least = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_sets = materialize(hot_join(roots, least, "root").select("set_key", "component_id"), "components")
    out = hot_join(found.select("doc_id", "set_key", F.col("n").alias("n_shingles")), of_sets, "set_key", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def query(docs: DataFrame) -> DataFrame:
    """The components with ``kept``: true for the row that has the smallest id of its component; a null id without another one is kept."""
    return near_duplicates(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


_LETTERS = "".join(map(chr, range(65, 91)))
ORACLE = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WIDTH} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(len(w) - {WIDTH - 1}), lambda i: array_to_string(w[i + 1 : i + {WIDTH}], ' '))) END AS s FROM words
),
one AS (SELECT doc_id, len(s) AS n, unnest(list_transform(s, lambda x: hash(x))) AS shingle FROM sets),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM one a JOIN one b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= {PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))
),
reach(u, v) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON r.v = p.u)
SELECT s.doc_id, any_value(len(s.s))::BIGINT AS n_shingles, min(r.v) AS component_id, s.doc_id = min(r.v) AS kept FROM sets s JOIN reach r ON r.u = s.doc_id GROUP BY s.doc_id
"""
