"""MinHash near-duplicates, the prefix trie of conversations and the Merkle manifest, against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from anchorline.llm import merkle, minhash, prefixtrie
from anchorline.llm.common import numbered

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TURNS = "conv_id long, turn long, role string, text string"


def collected(df, *order):
    return sorted((tuple(r[c] for c in df.columns) for r in df.collect()), key=lambda r: tuple((x is not None, x) for x in r[: len(order) or None]))


def sets_of(texts):
    out = []
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        out.append({" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or ({" ".join(words)} if words else set()))
    return out


def components(ids, sets):
    top = list(range(len(sets)))

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                top[find(a)] = find(b)
    least = {}
    for k in range(len(sets)):
        if ids[k] is not None:
            least[find(k)] = min(least.get(find(k), ids[k]), ids[k])
    return [ids[k] if not sets[k] else least.get(find(k)) for k in range(len(sets))]


def varied(r, words, changes):
    words = list(words)
    for _ in range(changes):
        k = r.randrange(len(words))
        words[k] = f"w{r.randrange(10**6)}"
    return " ".join(words)


def texts_of(r):
    """Clusters of near copies at similarities around the threshold, exact copies, and odd texts."""
    texts = []
    for _ in range(12):
        base = [f"v{r.randrange(3000)}" for _ in range(r.choice([8, 40, 150, 400]))]
        texts += [varied(r, base, r.choice([0, 0, 1, 1, 2, 3, 5])) for _ in range(r.randrange(1, 14))]
    passage = [f"p{k}" for k in range(60)]
    texts += [" ".join(passage + [f"q{r.randrange(10**6)}" for _ in range(r.randrange(5, 40))]) for _ in range(40)]
    return texts + [None, "", " \n", "one", "ONE", "a b c d", "A b\tc d", "a b c d e", "é\x1f🙂 x", "é\x1f🙂 x", "\x85 a"]


@pytest.mark.parametrize(("rows", "many"), [(2048, 1 << 20), (3, 50)])
def test_minhash_finds_all_links(spark, monkeypatch, rows, many):
    monkeypatch.setattr(minhash, "ROWS", rows)
    monkeypatch.setattr(minhash, "MANY", many)
    r = random.Random(rows)
    texts = texts_of(r)
    ids = list(range(100, 100 + len(texts)))
    r.shuffle(ids)
    ids[3] = ids[4] = None
    frame = spark.createDataFrame([(i, t, 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, set_key int").repartition(3)
    found = collected(minhash.query(frame))
    sets = sets_of(texts)
    want = [(i, len(s), c, i == c) for i, s, c in zip(ids, sets, components(ids, sets), strict=True)]
    assert found == sorted(want, key=lambda r: tuple((x is not None, x) for x in r))


def test_minhash_of_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a b c d e f")] * 3 + [(2, "a b c d e f"), (3, None), (None, None)]
    assert collected(minhash.query(spark.createDataFrame(rows, "doc_id long, text string"))) == [(None, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
    assert minhash.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates_are_corrected_for_chance():
    r = np.random.default_rng(3)
    for share in (0.0, 0.5, 0.85):
        values = []
        for _ in range(60):
            n = 300
            both, a, b = (r.integers(0, 1 << 63, k, dtype=np.uint64) for k in (round(n * share), (n - round(n * share)) // 2, (n - round(n * share)) // 2))
            one, other = (minhash.signature(minhash.minima(np.unique(np.concatenate([both, x])))) for x in (a, b))
            values.append(minhash.estimates(one, other[None])[0])
        assert abs(np.mean(values) - share) < 0.02 and np.std(values) < 0.06


def test_shingles_of_long_texts_do_not_depend_on_the_batch():
    texts = ["Aé b  c\td e f g " * 40_000, None, "x", " ", "A b c d e f"]
    whole = minhash.shingles_of(pa.array(texts))
    for k, text in enumerate(texts):
        assert np.array_equal(whole[k], minhash.shingles_of(pa.array([text], pa.string()))[0])
    assert [len(s) for s in whole] == [len(s) for s in sets_of(texts)]


def trie(rows):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            by[c].append(((turn is not None, turn or 0, key), (role or "", text or "")))
    own = {c: [t for _, t in sorted(v)] for c, v in by.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        made[c] = own.get(base, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = []
    for path, members in nodes.items():
        under = [p for p in nodes if p[: len(path)] == path]
        children = [p for p in under if len(p) == len(path) + 1]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p in under)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in under if p)
        ends = ",".join(map(str, sorted(c for c in members if len(made[c]) == len(path))))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_prefix_trie(spark):
    r = random.Random(7)
    rows = []
    for c in [*range(-12, 60), 10**12]:
        for turn in range(r.choice([0, 1, 3, 4, 5, 8, 9, 13])):
            rows.append((c, r.choice([turn, turn, None, 3]), r.choice(["user", "assistant", None]), r.choice(["a", "b é", None, ""])))
    rows += [(70, t, "user", "same") for t in range(70)] + [(71, t, "user", "same") for t in range(75)] + rows[5:9] + [(None, 0, "user", "x")]
    found = prefixtrie.query(spark.createDataFrame(rows, TURNS).withColumn("node", F.lit(1)).repartition(3))
    assert sorted((tuple(x) for x in found.collect()), key=str) == trie(rows)
    one = [(c, t, "u", "same text") for c in range(1, 400) for t in range(6)]
    assert sorted((tuple(x) for x in prefixtrie.query(spark.createDataFrame(one, TURNS)).collect()), key=str) == trie(one)
    assert prefixtrie.query(spark.createDataFrame([], TURNS)).count() == 0


def manifest(rows):
    digest = lambda *p: hashlib.sha256("".join(p).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: digest(*map(field, (r[0], r[3], r[2], r[4], t)))

    def tree(nodes):
        paths, groups = [[] for _ in nodes], [[k] for k in range(len(nodes))]
        while len(nodes) > 1:
            above, joined = [], []
            for a in range(0, len(nodes), 3):
                run = nodes[a : a + 3]
                for j in range(len(run)):
                    for k in groups[a + j]:
                        paths[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
                above.append(digest(*run))
                joined.append(sum(groups[a : a + 3], []))
            nodes, groups = above, joined
        return nodes[0], paths

    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    made = []
    for name in names:
        own = sorted(by[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        made.append((own, *tree([leaf(r, r[1]) for r in own])))
    root, tops = tree([sub for _, sub, _ in made])
    out = []
    for (own, sub, paths), top in zip(made, tops, strict=True):
        for r, path in zip(own, paths, strict=True):
            cut = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf(r, r[1].replace("\n", "") if cut else r[1])
            for left, right in path + top:
                node = digest(left, node, right)
            out.append((r[0], leaf(r, r[1]), sub, root, digest(*(a + b for a, b in path + top)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [5, 1])
def test_merkle_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "FAN", 3**levels)
    r = random.Random(levels)
    rows = [(k * 7 % 4001, r.choice(["a\nb", "é🙂", "", None, "x"]), r.choice(["en", None]), r.choice(["hot"] * 9 + ["b"]), r.choice([None, k])) for k in range(900)]
    rows += [(1, "t", "en", None, 1), (5, "t", "en", "one", 1), (6, "t\n", None, "é", 1), (7, "t", None, "Z", 1), *rows[:3], (None, "x\n", "en", "b", 1), (-3, "y\n", "en", "three", 2), (-2, "y", "en", "three", 2), (4, "y", "en", "three", 2)]
    frame = spark.createDataFrame(rows, DOCS).withColumn("level_0", F.lit(1)).withColumn("tree", F.lit("x"))
    assert sorted((tuple(x) for x in merkle.query(frame.repartition(5)).collect()), key=str) == manifest(rows)


def test_merkle_of_one_row_and_none(spark):
    rows = [(1, "a\n", "en", "s", 2)]
    assert [tuple(x) for x in merkle.query(spark.createDataFrame(rows, DOCS)).collect()] == manifest(rows)
    assert merkle.query(spark.createDataFrame([], DOCS)).count() == 0


def test_places_in_groups_of_any_size(spark):
    rows = [("hot" if k % 10 else "cold", k * 37 % 1000) for k in range(1000)]
    got = numbered(spark.createDataFrame(rows, "g string, k long").repartition(4), "g", "k").collect()
    for group in ("hot", "cold"):
        own = sorted(k for g, k in rows if g == group)
        assert [(x["k"], x["places"]) for x in sorted((x for x in got if x["g"] == group), key=lambda x: x["place"])] == [(k, len(own)) for k in own]


def test_queries_equal_their_sql(spark, tmp_path):
    """The registered SQL on a table with nulls, which the smoke tables have not."""
    docs = [(k, "word\n" * (k % 5) + f"a b c d {k % 3}", "en", None if k % 4 == 0 else f"s{k % 3}", None) for k in range(40)]
    convs = [(k % 6, None if k % 5 == 0 else k // 6, None if k % 7 == 0 else "user", f"t{k % 3}") for k in range(40)]
    con = duckdb.connect()
    for name, rows, schema in (("documents", docs, DOCS), ("conversations", convs, TURNS)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    for query, sql, name in ((minhash.query, minhash.ORACLE, "documents"), (merkle.query, merkle.ORACLE, "documents"), (prefixtrie.query, prefixtrie.ORACLE, "conversations")):
        found, want = query(spark.read.parquet(f"{tmp_path}/{name}")), con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in found.collect()))) == sorted(map(str, want.fetchall()))
