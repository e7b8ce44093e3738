"""Small tables, brute force, and the cases that a table of documents can hold."""

import hashlib
import itertools
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorline.llm import bpe, chat, htmltext, langid, linededup, mpegts, packing, passages, quality, simhash, toxicity, wordhash
from anchorline.llm.queries import vocabulary_path

PATH = vocabulary_path()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(k if ids is None else ids[k], t, "en", "s", len(t or "")) for k, t in enumerate(texts)], SCHEMA)


#: Null, empty, blank, repeated and long texts, and ones that are no ASCII.
ODD = [None, "", " \n\t ", "one", "one", "é🙂 漢字  x", "a" * 30_000, "word " * 20_000, "x\r\ny z", "<|endoftext|> [INST] </s>"]


def rows_of(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key], str(r)))


@pytest.mark.parametrize("run", [lambda d: bpe.query(d, PATH), lambda d: packing.query(d, PATH), mpegts.query, linededup.query, simhash.query])
def test_empty_tables(spark, run):
    assert run(frame(spark, [])).count() == 0


def test_packing_covers_every_token_once(spark, library):
    texts = ODD + ["some words here " * n for n in range(1, 400, 7)]
    rows = rows_of(packing.pack_documents(frame(spark, texts).coalesce(1), PATH, pool_rows=16))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for k, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[k], key=lambda r: r["start"])
        assert [i for r in own for i in np.frombuffer(r["ids"], "<u4").tolist()] == ids
        assert all(r["doc_tokens"] == len(ids) for r in own)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    tiers = Counter((own[0]["tier"], own[0]["step_group"]) for own in by_sequence.values() if own[0]["tier"] == 1024)
    assert max(tiers.values()) - min(tiers.values()) <= 1


def test_packing_encodes_as_the_library(library):
    rng = random.Random(1)
    letters = " \n\tabc THE 's're 012.,!?#éßÀǿ×漢字のア한…—“ΩП\u0085\u001c²🙂"
    for k in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(60))) + "<|endoftext|>" * (k % 9 == 0)
        assert packing.token_array(text, PATH)[:-1].tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_round_trip_as_the_library(spark, library):
    rng = random.Random(2)
    letters = " \n\taeiouthrn019.,'!éßñ漢字🙂\u0085 \u3000\u001c²Ⅷ"
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(300)] + ["ab" * 5000, "=" * 3000, "thethe" * 900, "é" * 2500]
    for r in rows_of(bpe.query(frame(spark, texts), PATH)):
        text = texts[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = rows_of(bpe.decode_ids(bpe.encode_texts(frame(spark, texts), PATH), PATH))
    assert [r["text"] for r in back] == [t or "" for t in texts]


def test_transducer_emits_early_and_forgets():
    v = bpe.codec(PATH).v
    machine, data = bpe.Transducer(v), "abehtions".encode() * 9000
    early = machine.push(data)
    assert len(machine.last) <= 2 * v.lookahead + v.longest
    ids = early + machine.finish()
    assert b"".join(v.texts[i] for i in ids) == data
    assert all(v.neighbours(a, b) for a, b in itertools.pairwise(ids))
    assert all(v.merged(t) == [t] for t in list(v.ids)[:: len(v.ids) // 500])


def small_vocabulary(path, rng, letters="abc", merges=9):
    tokens, made = list(letters), []
    while len(made) < merges:
        left, right = rng.choice(tokens), rng.choice(tokens)
        if left + right not in tokens:
            made.append(f"{left} {right}")
            tokens.append(left + right)
    path.write_text(json.dumps({"added_tokens": [], "model": {"vocab": {t: k for k, t in enumerate(tokens)}, "merges": made}}))
    return bpe.Vocabulary(str(path))


def test_lookahead_suffices_by_brute_force(tmp_path):
    rng = random.Random(5)
    for k in range(40):
        v = small_vocabulary(tmp_path / f"{k}.json", rng)
        for _ in range(25):
            data = "".join(rng.choices("abc", k=rng.randrange(1, 3 * v.lookahead))).encode()
            more = "".join(rng.choices("abc", k=rng.randrange(1, 12))).encode()
            now, later = v.merged(data), v.merged(data + more)
            ends = list(itertools.accumulate(map(len, now)))
            sure = [t for t, end in zip(now, ends, strict=True) if end <= len(data) - v.lookahead]
            assert later[: len(sure)] == sure
            machine, out = bpe.Transducer(v), []
            for at in range(0, len(data), 3):
                out += machine.push(data[at : at + 3])
                assert len(machine.last) <= v.lookahead + 3
            out += machine.finish()
            assert [v.texts[i] for i in out] == now


def test_long_white_space(library):
    for text in (" " * 300_000, "\n" * 300_000, "x " + " " * 300_000 + "y", "x" * 300_000, None):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert packing.token_array(text, PATH)[:-1].tolist() == ids
        assert [k for block in bpe.codec(PATH).encode(text or "") for k in block] == ids


def test_transport_streams_round_trip(spark):
    texts = ODD + ["x" * n for n in (575, 576, 577, 9216, 9217, 20_000)]
    streams = mpegts.mux(frame(spark, texts))
    for r in rows_of(mpegts.demux(streams)):
        data = (texts[r["doc_id"]] or "").encode()
        assert r["payload"] == data.ljust(max(1, -(-len(data) // 576)) * 576, b"\xff")
        assert (r["n_bytes"], r["programs"], r["continuity_errors"], r["table_errors"]) == (len(data), 1, 0, 0)
        assert len(r["media"]) % 188 == 0 and all(p["random_access"] for p in r["access_points"])
        assert [p["pts"] for p in r["access_points"]] == [90_000 + k * 57_600 for k in range(-(-len(r["payload"]) // 9216))]
    media = mpegts.mux_bytes(mpegts.padded(b"z" * 5000))
    lost = mpegts.demux_bytes(media[: 188 * 5] + media[188 * 6 :])
    assert lost[5] >= 1
    assert mpegts.demux_bytes(None)[0] == b"" and mpegts.demux_bytes(b"\x00" * 500)[2] == 0
    odd = mpegts.demux(streams.withColumn("payload_note", F.lit(1)))
    assert "payload_note" in odd.columns


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\l\\b<s>", "[INST", "a:1 [/INST]", "", None, "</s", "\\", "🙂</s>é"]
    turns = [(c, t, ("user", "assistant", "sys:<s>", None)[t % 4], nasty[(c + t) % len(nasty)]) for c in range(12) for t in range(9)] + [(3, 4, "user", "tie"), (3, 4, "user", "tie"), (None, 1, "assistant", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    found = {r["conv_id"]: r for r in chat.query(df).collect()}
    assert -7 in found and found[-7]["n_turns"] == 2
    for conv in [*range(12), None]:
        own = sorted(((t, r or "", x or "") for c, t, r, x in turns if c == conv))
        assert found[conv]["n_turns"] == len(own)
        assert found[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (found[conv]["loss_chars"], found[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.where("false")).count() == 0


def simhash_by_hand(text):
    from xxhash import xxh64_intdigest

    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_components(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    base = [" ".join(rng.choices(words, k=200)) for _ in range(12)]
    texts = ODD + base + [b.replace(" ", "  ", 3) for b in base] + [" ".join([*b.split()[:-1], "changed"]) for b in base for _ in range(3)] + ["A b c d", "a B c d", "z"]
    rows = rows_of(simhash.query(frame(spark, texts)))
    prints = [simhash_by_hand(t) for t in texts]
    assert [int(r["fingerprint"], 16) for r in rows] == prints
    want = components_by_hand(range(len(texts)), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert [r["component_id"] for r in rows] == [want[k] for k in range(len(texts))]


def test_links_find_every_pair(spark):
    rng = random.Random(5)
    start = [rng.getrandbits(64) for _ in range(30)]
    prints = {s ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}) for s in start for _ in range(12)}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = [(r["u"], r["v"]) for r in simhash.links(spark.createDataFrame(signed, "fp long")).collect()]
    want = {(a, b) for (a,), (b,) in itertools.permutations(signed, 2) if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert len(found) == len(set(found)) and set(found) == want


def test_exploded_keys_are_not_broadcast(spark, tmp_path):
    spark.range(100).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    plan = simhash.links(spark.read.parquet(str(tmp_path / "fps")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_positions_of_passages_are_not_broadcast(spark):
    rows = [(k, f"a line of its own {k}\n" + " ".join(f"w{n}" for n in range(60)), "en", "x", 1) for k in range(4)]
    plan = linededup.without_recurring(spark.createDataFrame(rows, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[coalesce\(doc_id", plan)


def test_quality_statistics_and_verdicts(spark):
    def by_hand(text):
        import re

        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        windows, inside, seen, dup = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)), set(), set(), 0
        for k in range(len(w) - 4):
            if windows[tuple(w[k : k + 5])] > 1:
                inside.update(range(k, k + 5))
        for line in (text or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        return [len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside)]

    rng = random.Random(6)
    good = [" ".join(rng.choices([f"word{k}" for k in range(500)], k=120)) for _ in range(300)]
    bad = [" | ".join(rng.choices(["ab", "cd#", "$x"], k=3) + [str(rng.random())] * 1 + rng.choices([f"q{k}%" for k in range(400)], k=60)) for _ in range(60)]
    texts = ODD + ["a b c d e f\n" * 3 + "x"] + good + bad
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(k, int(texts[k] in good)) for k in range(len(ODD) + 1, len(texts), 2)], "doc_id long, quality int")
    rows = rows_of(quality.query(docs, labels))
    for r, t in zip(rows, texts, strict=True):
        counts = by_hand(t)
        assert [r[c] for c in quality.BASE] == counts
        assert r["base_failed"] == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"] for r in rows if r["kept"]}
    g, b = range(len(ODD) + 1, len(ODD) + 301), range(len(ODD) + 301, len(texts))
    assert sum(k in kept for k in g) >= 295 and sum(k in kept for k in b) <= 5
    assert {r["doc_id"] for r in quality.kept_rows(docs, labels).collect()} == kept
    assert quality.query(docs, labels.where("false")).where("kept").count() > 0
    assert quality.query(docs.where("false"), labels).count() == 0


@pytest.mark.parametrize("trees", [quality.TREES, 8])
def test_quality_is_fitted_on_all_labelled_rows(spark, monkeypatch, trees):
    """The row that sets an end of the box has the last hash of 12,000, and the threshold counts every labelled row."""
    monkeypatch.setattr(quality, "TREES", trees)
    ids = [r[0] for r in spark.range(12000).orderBy(F.xxhash64("id"), "id").collect()]
    plain, odd = [0.1] * len(quality.FEATURES), [0.1] * (len(quality.FEATURES) - 1) + [9.0]
    late = set(ids[-40:])
    measured = spark.createDataFrame([(k, [100, 500, 0, 0, 0], odd if k in late else [v + k % 97 / 1000 for v in plain]) for k in range(12000)], "doc_id long, counts array<long>, features array<double>")
    labels = spark.createDataFrame([(k, int(k not in late)) for k in range(12000)], "doc_id long, quality int")
    forest = quality.fit(measured, labels)
    found = {r["doc_id"]: r["kept"] for r in quality.verdicts(measured, forest).collect()}
    assert np.isfinite(forest.threshold) and not any(found[k] for k in late) and all(found[k] for k in ids[:-40])
    rng = np.random.default_rng(1)
    scores, good = rng.random(5000), rng.random(5000) < 0.97
    good[scores > 0.99] = False
    step = np.ceil(scores * quality.STEPS).astype(int) - 1
    at = np.unique(step)
    t = quality.calibrate(at, np.array([good[step == k].sum() for k in at]), np.array([(~good[step == k]).sum() for k in at]))
    assert (good & (scores > t)).sum() <= quality.GOOD_LOSS * good.sum() and not (scores[~good] > t).sum() < (scores > 0.99).sum()


def test_language_counts_by_hand(monkeypatch):
    def by_hand(text):
        text, out = f" {text.lower()} ", np.zeros(langid.BUCKETS, int)
        for n in (1, 2, 3):
            for at in range(len(text) - n + 1):
                g = 0
                for c in text[at : at + n]:
                    g = (g ^ ord(c)) * 0x9E3779B1 & 0xFFFFFFFF
                out[(g ^ g >> 15) % langid.BUCKETS] += 1
        return out

    for block in (1 << 16, 16):
        monkeypatch.setattr(langid, "BLOCK", block)
        for text in ["", "a", "Ab", "héé 🙂 x" * 9, "z" * 64]:
            assert (langid.counts(text) == by_hand(text)).all()


def test_language_prediction(spark):
    rng = random.Random(8)
    parts = {"aa": ["tho", "ing", "the"], "bb": ["ción", "que", "ñar"], "cc": ["schl", "ung", "der"]}
    texts, langs = [], []
    for lang, syllables in parts.items():
        for _ in range(120):
            texts.append(" ".join("".join(rng.choices(syllables, k=2)) for _ in range(30)))
            langs.append(lang)
    docs = spark.createDataFrame([(k, t, l, "s", 1) for k, (t, l) in enumerate(zip(texts, langs, strict=True))] + [(1000, None, None, "s", 0), (1001, "123 !", "aa", "s", 5), (1002, "", "bb", "s", 0), (None, "thething", None, "s", 8)], SCHEMA)
    rows = {r["doc_id"]: r for r in langid.query(docs).collect()}
    assert all(rows[k]["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(len(texts)))
    assert sum(rows[k]["lang_pred"] == langs[k] for k in range(len(texts)) if rows[k]["held_out"]) >= 0.95 * sum(rows[k]["held_out"] for k in range(len(texts)))
    assert [(rows[k]["lang_pred"], rows[k]["score"]) for k in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert langid.query(docs.where("false")).count() == 0
    assert {r["lang_pred"] for r in langid.query(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_marginals_by_hand():
    rng = np.random.default_rng(0)
    odds = [np.exp(rng.normal(size=n)) for n in (3, 0, 6, 1, 6)]
    ct, tc, tt, start = 0.5, 2.0, 3.0, 0.7
    shape = toxicity.Ragged(np.array([len(o) for o in odds]))
    x = np.empty(shape.at[-1])
    for k, s in enumerate(shape.order):
        x[shape.places(k)] = odds[s]
    forward, backward, _ = shape.marginals(x, np.array([ct, tc, tt]), start)
    p = forward * backward / (1 + forward * backward)
    for k, s in enumerate(shape.order):
        total, marked = 0.0, np.zeros(len(odds[s]))
        for y in itertools.product((0, 1), repeat=len(odds[s])):
            v = np.prod([o for o, on in zip(odds[s], y, strict=True) if on]) * (start if y and y[0] else 1)
            for a, b in itertools.pairwise(y):
                v *= {(0, 0): 1, (0, 1): ct, (1, 0): tc, (1, 1): tt}[a, b]
            total += v
            marked += v * np.array(y)
        assert np.allclose(p[shape.places(k)], marked / total)


def test_toxicity_finds_words_and_stems(spark):
    rng = random.Random(9)
    clean = [f"w{k}x" for k in range(400)]
    docs, labels = [], []
    for k in range(900):
        words = rng.choices(clean, k=60)
        toxic = k % 5 == 0
        for _ in range(3 * toxic):
            words[rng.randrange(60)] = rng.choice(["Grumph!", f"blark{rng.choice('abcdefg')}er"])
        docs.append(" ".join(words))
        labels.append((k, int(toxic)))
    texts = docs + ODD
    df = frame(spark, texts)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.query(df, lab).collect()}
    held = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(rows[k]["held_out"] for k in held)
    assert sum(rows[k]["predicted"] == dict(labels)[k] for k in held) >= 0.98 * len(held)
    assert all(rows[len(docs) + k]["predicted"] == 0 for k in range(len(ODD)))
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    spans = toxicity.tag(df.where("doc_id = 0"), toxicity.fit(df, lab)).first()["spans"]
    assert {texts[0][s["start"] : s["end"]].strip("!").lower()[:5] for s in spans} <= {"grump", "blark"} and spans
    assert toxicity.query(df, lab.where("false")).where("predicted = 1").count() == 0
    assert toxicity.query(df.where("false"), lab).count() == 0


def test_line_dedup_keeps_the_first_place(spark):
    passage = " ".join(f"p{'abcdefghij'[k % 10]}{'xyz'[k % 3]}" for k in range(55))
    texts = ["alpha beta gamma delta own\nuser 17 logged in from here today", "user 23 logged in from here today\nsecond text of its own kind", f"user 99 logged in from here today\n{passage}", f"{passage}\nother words only here stay", None, "", "short line", "short line\nshort line", "same copy of a text that stays\nline two of the copy", "same copy of a text that stays\nline two of the copy"]
    rows = {r["doc_id"]: r for r in linededup.query(frame(spark, texts)).collect()}
    assert rows[0]["text"] == texts[0] and rows[1]["text"] == "second text of its own kind" and rows[2]["text"] == passage
    assert rows[3]["text"] == "other words only here stay" and rows[4]["text"] is None
    assert all(rows[k]["text"] == texts[k] for k in range(5, 10))
    assert (rows[1]["n_dropped_lines"], rows[1]["n_dropped_chars"]) == (1, len("user 23 logged in from here today"))
    extra = frame(spark, texts).withColumn("positions", F.lit(1)).withColumn("template", F.lit("x"))
    assert linededup.without_recurring(extra).columns == [*extra.columns, "dropped_lines"]


def test_line_templates_generalise(spark):
    lines = [f"the quick brown fox jumps over {w} small dogs" for w in ("one", "two", "three", "four")] + ["the quick brown cat sat on some mat there", "a b c d e f"]
    rows = linededup.query(frame(spark, [f"{line}\nunique {k} z y x w v {'q' * k} u {'r' * k} t {'s' * k}" for k, line in enumerate(lines)])).orderBy("doc_id").collect()
    assert [r["n_dropped_lines"] for r in rows[:4]] == [0, 1, 1, 1] and rows[4]["n_dropped_lines"] == 0
    small = linededup.recurring_lines(frame(spark, lines), leaf_lines=4)
    assert small.count() == 3


def test_line_templates_in_leaves_of_any_size(spark):
    lines = [f"the quick brown {w} jumps over seven small sleeping dogs" for w in ("fox", "cat", "hen", "cow", "pig", "ant")]
    assert linededup.recurring_lines(frame(spark, lines), leaf_lines=4).count() == 5
    rng = random.Random(11)
    for n in (4, 5, 9, 17):
        rows = [(k, np.array([1, 2, 3, *(rng.randrange(3 if j % 2 else 9) for j in range(n - 3))], np.int64)) for k in range(600)]
        assert linededup.templates(rows, 0.8, leaf_lines=3) == linededup.templates(rows, 0.8)


def test_line_dedup_of_few_tokens(spark):
    texts = [f"All rights reserved.\nSee also\n{100 + k}\n这一行没有空格但是它在每一个文本里都会重复出现一次啊\nown line {'q' * k} of this text {'z' * k}" for k in range(12)]
    rows = linededup.query(frame(spark, texts)).orderBy("doc_id").collect()
    assert rows[0]["text"] == texts[0] and all(r["text"] == "\n".join(t.split("\n")[2:5:2]) for r, t in zip(rows[1:], texts[1:], strict=True))
    few = linededup.query(frame(spark, texts[:4])).orderBy("doc_id").collect()
    assert all(r["text"] == "\n".join(t.split("\n")[k] for k in (1, 2, 4)) for r, t in zip(few[1:], texts[1:4], strict=True))


def test_passages_recur_whole(spark):
    rng = random.Random(12)
    own = lambda n: ["".join(rng.choices("abcdefghij", k=10)) for _ in range(n)]
    shared = [own(n) for n in (50, 51, 60, 200)]
    laid = lambda words: "".join(w + rng.choice(["  ", " ", " ", " ", "\n", "\n\n"]) for w in words)
    texts = [laid(own(30) + shared[a] + own(rng.randrange(9)) + shared[b] + own(5)) for a in range(4) for b in range(4) if a != b] + ["word " * 400, "\n" + "word " * 500, None, "a b"]
    texts += ["".join(chr(0x4E00 + rng.randrange(9000)) for _ in range(70))]
    texts += [f"前{texts[-1]}後 one"]
    rows = linededup.query(frame(spark, texts)).orderBy("doc_id").collect()
    words = [wordhash.words_of(r["text"] or "") for r in rows]
    seen = defaultdict(set)
    for k, w in enumerate(words):
        for at in range(len(w) - 50):
            seen[tuple(w[at : at + 51])].add(k)
    assert all(len(x) == 1 for x in seen.values())
    kept = {w for ws in words for w in ws}
    assert kept == {w for t in texts for w in wordhash.words_of(t or "")}
    assert sum(set(shared[0]) <= set(w) for w in words) == 6 and all(sum(set(s) <= set(w) for w in words) == 1 for s in shared[1:])
    assert rows[0]["text"] == texts[0] and rows[-1]["text"] == "前後 one" and [len(w) for w in words[12:14]] == [51, 0]


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_html_blocks():
    found = htmltext.blocks_of(page("<nav><ul><li><a href='/'>Home</a><li>About</ul></nav><!-- x > --><article class='postBody main'><p>One &amp; <b>two</b><br>three<p>four\n five</article>tail &lt;x"))
    assert [t for _, t, _ in found] == ["Home", "About", "One & two three", "four five", "tail <x"]
    assert found[0][2] == 4 and found[2][0][-4:] == ("post", "body", "main", "<p")
    assert htmltext.blocks_of(None) == htmltext.blocks_of("") == [] and [t for _, t, _ in htmltext.blocks_of("<p a=\"x>y")] == ["y"]
    assert [t for _, t, _ in htmltext.blocks_of("a < b <p>c <unclosed d='")] == ["a < b", "c"]
    assert [t for _, t, _ in htmltext.blocks_of("<div>" * 3000 + "x")] == ["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("<html><head><title>T</title><meta charset=x><body><p>one", ["one"]),
        ("<head><link><noscript><link><p>one", ["one"]),
        ("<head><title>T</title>one<p>two", ["one", "two"]),
        ("<head><noscript><img src=x></noscript><title>T</title></head><p>one", ["one"]),
        ("<div>a <svg/> b</div><div>c <svg width='1' /> d</div><svg><text>no</text></svg>e", ["a", "b", "c", "d", "e"]),
        ("<svg><path><p>one", ["one"]),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x</annotation></math> holds", ["so x=2 holds"]),
        ("<select><option>no<p>one<button>no<div>two</div><noscript>no<h2>three", ["one", "two", "three"]),
        ("<button><div>no</div></button><noscript><p>no</p></noscript><p>one", ["one"]),
    ],
)
def test_html_omitted_end_tags(given, want):
    assert [t for _, t, _ in htmltext.blocks_of(given)] == want


def test_html_gradients():
    rng = np.random.default_rng(0)
    net = htmltext.Labeller.new()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    pages = []
    for _ in range(2):
        made = htmltext.training_page(rng, ["The quick brown fox jumps over the lazy dog again."], ["home", "about us"])
        pages.append(([b for b, _ in made], np.array([y for _, y in made], np.float32)))

    def loss():
        return sum((np.logaddexp(0, z) - y * z).sum() for (_, y), z in zip(pages, net.score([b for b, _ in pages]), strict=True)) / sum(len(y) for _, y in pages)

    for name, g in htmltext.gradients(net, pages).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        net.p[name][at] += 1e-3
        high = loss()
        net.p[name][at] -= 2e-3
        assert g[at] == pytest.approx((high - loss()) / 2e-3, rel=1e-2, abs=1e-6)
        net.p[name][at] += 1e-3


def test_html_extraction(spark):
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ta", "mo", "ri", "lu", "se") for b in ("nda", "kel", "pos", "vit")]
    prose = lambda n: (" ".join(rng.choices(words, k=n)) + ".").capitalize()
    rows, want = [], []
    for k in range(80):
        main = [prose(8), *(prose(rng.randrange(15, 50)) for _ in range(rng.randrange(2, 6)))]
        want.append("\n".join(main))
        inner = "".join(f"<p>{p}</p>" for p in main[1:])
        rows.append((k, f"u{k}", page(f"<nav><ul><li><a>Home</a></li><li><a>News</a></li></ul></nav><div class='ad'>{prose(9)}</div><{'article' if k % 2 else 'main'}><h1>{main[0]}</h1>{inner}</{'article' if k % 2 else 'main'}><div class='comments'><p>{prose(12)}</p></div><footer>{prose(5)}</footer>")))
    rows += [(100, None, None), (101, "u", ""), (102, "u", "<div>")]
    found = {r["page_id"]: r for r in htmltext.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert sum(found[k]["text"] == want[k] for k in range(80)) >= 76
    assert all(found[k]["text"] == "" and found[k]["n_chars"] == 0 for k in (100, 101, 102))
    assert htmltext.query(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(10)
    vocabulary = {"en": ["the", "thing", "other", "with"], "de": ["der", "schluss", "ungern", "keit"]}
    texts, langs = [], []
    for k in range(240):
        lang = ("en", "de")[k % 2]
        texts.append("\n".join(" ".join(rng.choice(vocabulary[lang]) + rng.choice("abcdefgh") + rng.choice("ijklm") for _ in range(12)) for _ in range(5)))
        langs.append(lang)
    texts += [texts[0], texts[0], texts[1] + " x", "short", "! ? . , ; : - ( ) [ ] ! ?"]
    langs += ["en", "en", "de", "en", "en"]
    docs = spark.createDataFrame([(k, t, l, "s", len(t)) for k, (t, l) in enumerate(zip(texts, langs, strict=True))], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(0, 240, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path)).cache()
        assert step.columns == docs.columns
        seen.append({r["doc_id"] for r in step.select("doc_id").collect()})
    assert set(range(240)) <= seen[0] and 243 not in seen[0] and 244 not in seen[1]
    assert set(range(240)) <= seen[2] and not {240, 241} & seen[3] and set(range(240)) <= seen[3]
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == seen[3]


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert json.dumps(sorted(__spark_entry__.oracle_sql()))


def jaccard_groups(texts, width=5, similarity=0.8):
    """Distinct texts by brute force: text -> the texts reachable over links."""
    distinct = sorted({t or "" for t in texts})
    sets = []
    for t in distinct:
        words = wordhash.words_of(t.lower())
        sets.append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else {()})
    root = list(range(len(distinct)))
    for a, b in itertools.combinations(range(len(distinct)), 2):
        if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]) - 1e-9:
            low, high = sorted((root[a], root[b]))
            root = [low if r == high else r for r in root]
    return {t: root[k] for k, t in enumerate(distinct)}


def near_texts(rng, families=14):
    words = [a + b for a in ("lo", "mi", "ta", "ru", "se") for b in ("na", "vi", "dor", "ke", "pum", "s")]
    out = [None, "", " \n", "One two", "one  TWO", "one two three four five", "\u4e00\u4e01\u4e02\u4e03\u4e04\u4e05\u4e06\u4e07", "\u4e00\u4e01\u4e02\u4e03\u4e04\u4e05\u4e06\u4e07\u4e08"]
    for f in range(families):
        base = [rng.choice(words) for _ in range(rng.choice((12, 40, 150, 400)))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy) if f % 2 else "\n".join(copy).upper())
    return out


@pytest.mark.parametrize("turns, whole, many", [(simhash.TURNS, simhash.WHOLE, simhash.MANY), (1, 2, simhash.MANY), (2, 4, 500)])
def test_one_row_of_each_near_duplicate_group_by_brute_force(spark, monkeypatch, turns, whole, many):
    for name, value in (("TURNS", turns), ("WHOLE", whole), ("ROWS", whole), ("MANY", many)):
        monkeypatch.setattr(simhash, name, value)
    rng = random.Random(21)
    texts = near_texts(rng)
    texts += rng.choices(texts, k=20)
    ids = [rng.randrange(1000) if k % 9 else None for k in range(len(texts))]
    rows = [(i, t, "en", "s", k % 3, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    rows += rows[:15]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, hit int, row_key string")
    groups = jaccard_groups(texts)
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    got = got.collect()
    assert sorted(groups[r["text"] or ""] for r in got) == sorted(set(groups.values()))
    least = defaultdict(lambda: float("inf"))
    for i, t, *_ in rows:
        least[groups[t or ""]] = min(least[groups[t or ""]], float("inf") if i is None else i)
    assert all((float("inf") if r["doc_id"] is None else r["doc_id"]) == least[groups[r["text"] or ""]] for r in got)
    assert {tuple(r) for r in got} <= set(rows)
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_unknown_language_has_no_letters(spark):
    df = frame(spark, ["½ ² Ⅷ ①", "12 _ -", None, "", "ab"])
    assert [r["lang_pred"] == "und" for r in langid.query(df).orderBy("doc_id").collect()][:4] == [True] * 4
