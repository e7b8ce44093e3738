"""Messages: references, expansion, requests, answers, commits, streams."""

import datetime

import pytest
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from anchorline.functions import answers, keys, markers
from anchorline.operators import messages, references, releases, vision
from anchorline.sources import cache
from anchorline.sources.commits import read_commit_log
from anchorline.sources.messages import read_messages
from anchorline.streaming import jobs

UTC = datetime.timezone.utc
UTC_START = datetime.datetime(2024, 1, 1, tzinfo=UTC)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def marker(spark, name, token, mime=""):
    return one(spark, markers.encode_reference_marker(F.lit(name), F.lit(token), F.lit(mime)))


def test_modes(spark):
    given = [("网页中红色按钮在哪里", (False, True, False)), ("请还原这个网页", (True, False, True)), ("红色按钮位于左上角吗", (False, True, False)), ("生成页面", (True, False, False)), (None, (True, False, False))]
    df = spark.createDataFrame([(q,) for q, _ in given], "query string")
    assert [(r["describe"], r["ground"], r["restore"]) for r in vision.classify_vision_mode(df).collect()] == [m for _, m in given]
    assert one(spark, vision.story_summary(F.lit("这个漫画的这一章讲了什么"))) and not one(spark, vision.story_summary(F.lit("把按钮放在哪里")))


def test_markers(spark):
    for name, token, mime in (("README (1).md", "t-1", ""), ("汇总报告.pdf", "t-2", "application/pdf"), ("🙂\"\\", "t", "")):
        made = marker(spark, name, token, mime)
        assert set(made) <= set(markers.DIGITS + markers.START + markers.END)
        assert tuple(one(spark, markers.decode_reference_marker(F.lit(f"请总结{made}重点")))) == (token, name, mime)
        assert references.first_reference(f"请总结{made}重点")[2:] == ("hidden", token, name, mime)
    assert marker(spark, "x", "") is None
    bare = markers.START + "".join(markers.DIGITS[ord(c) >> s & 3] for c in "legacy" for s in range(14, -1, -2)) + markers.END
    assert tuple(one(spark, markers.decode_reference_marker(F.lit(bare)))) == ("legacy", "", "")
    lone = markers.START + "".join(markers.DIGITS[0xD800 >> s & 3] for s in range(14, -1, -2)) + markers.END
    assert one(spark, markers.decode_reference_marker(F.lit(lone))) is None
    assert one(spark, markers.decode_reference_marker(F.lit(markers.START + markers.DIGITS[0] * 7 + markers.END))) is None


def test_reference_forms(spark):
    hidden = marker(spark, "b.md", "tb")
    assert references.first_reference("x [📎 README.md](sfv-document://legacy%2Dtoken) y")[2:5] == ("link", "legacy-token", "README.md")
    assert references.first_reference("[📎 README.md]")[2:5] == ("label", None, "README.md")
    assert references.first_reference("see 📎 a.md") is None and references.first_reference("q\n📎 a b.md \nrest")[2:5] == ("bare", None, "a b.md")
    df = spark.createDataFrame([(1, f"[📎 a.md](sfv-document://ta) mid {hidden} end"), (2, "nothing"), (3, "[📎 x]" * 17)], "id long, text string")
    rows = references.split_references(df, ["id"]).orderBy("id", "seg_no").collect()
    assert [(r["kind"], r["text"] if r["kind"] == "text" else r["token"]) for r in rows if r["id"] == 1] == [("text", "[📎 a.md](sfv-document://ta) mid"), ("ref", "tb"), ("text", "end")]
    assert not [r for r in rows if r["id"] == 2] and sum(r["kind"] == "ref" for r in rows if r["id"] == 3) == 16
    assert references.stripped("[📎 x]" * 17) == "[已上传文档:x]" and references.stripped("a [[SFV_DOCUMENT_V1 name=a%20b mime=]]AA==[[/SFV_DOCUMENT_V1]] b") == "a\n[已上传文档:a b]\nb"


def test_expanded_messages(spark):
    one_, two = marker(spark, "a.md", "ta"), marker(spark, "b.md", "tb")
    given = [(1, 0, f"总结：{one_}{two}", False), (2, 0, "这章漫画讲了什么", False), (3, 0, '[{"type":"text","text":"请总结 [📎 none.md] 的重点"},"plain",{"type":"tool-result","content":[{"type":"text","text":"in [📎 a.md]"}]}]', True)]
    blocks = read_messages(spark.createDataFrame(given, "conv_id long, turn long, content string, is_array boolean"))
    segments = references.split_references(blocks, ["conv_id", "turn", "path"])
    store = spark.createDataFrame([("ta", "a.md", 10, 1, datetime.datetime(2024, 1, 1, tzinfo=UTC)), ("tb", "b.md", 20, 1, datetime.datetime(2024, 1, 1, tzinfo=UTC))], "token string, name string, doc_id long, n_bytes long, created_at timestamp").withColumn("last_used_at", F.col("created_at"))
    by_name = references.resolve_by_name(segments.where("kind = 'ref'").withColumn("msg_ts", F.lit(datetime.datetime(2024, 1, 1, 0, 30, tzinfo=UTC))), store).drop("msg_ts")
    resolved = references.resolve_by_token(segments.where("kind = 'ref'"), store).unionByName(by_name).unionByName(segments.where("kind = 'text'").withColumn("doc_id", F.lit(None).cast("long")))
    contexts = spark.createDataFrame([(10, "# one"), (20, "# two")], "doc_id long, context string")
    found = {r["conv_id"]: r["content"] for r in messages.expand_messages(blocks, resolved, contexts).collect()}
    assert found[2] == "这章漫画讲了什么"
    assert found[1] == '[{"type":"text","text":"总结：\\n\\n# one\\n\\n# two"}]'
    failure = references.FAILED.format(references.EXPIRED)
    assert found[3] == f'[{{"type":"text","text":"{failure}"}},"plain",{{"type":"tool-result","content":[{{"type":"text","text":"in\\n\\n# one"}}]}}]'
    late = references.resolve_by_name(segments.where("kind = 'ref'").withColumn("msg_ts", F.lit(datetime.datetime(2024, 1, 1, 0, 30, 1, tzinfo=UTC))), store)
    assert not late.where("doc_id is not null").count()


def uses_of(spark, minutes, token="t"):
    start = datetime.datetime(2024, 1, 1, tzinfo=UTC)
    return spark.createDataFrame([(token, start + datetime.timedelta(minutes=m)) for m in minutes], "token string, ts timestamp")


def test_liveness_and_retention(spark):
    rows = references.reference_liveness(uses_of(spark, [0, 30, 60 + 1 / 60, 61])).orderBy("ts").collect()
    assert [r["alive"] for r in rows] == [True, True, False, False]
    stored = spark.range(65).select(F.lit("h").alias("host"), F.lpad(F.col("id").cast("string"), 3, "0").alias("token"), F.lit(1).alias("n_bytes"), F.timestamp_seconds("id").alias("created_at"), F.timestamp_seconds(F.lit(1000)).alias("last_used_at"))
    now = F.timestamp_seconds(F.lit(2000))
    assert "000" not in {r["token"] for r in references.retain_references(stored, now, "host").collect()} and references.retain_references(stored, now, "host").count() == 64
    assert references.retain_references(stored.withColumn("n_bytes", F.lit(64 * 2**20)), now, "host").count() == 2
    assert references.retain_references(stored, F.timestamp_seconds(F.lit(1000 + 1801)), "host").count() == 0


def test_answers(spark):
    given = ['```json\n{"a":1}\n```', 'say {"a":"}{","b":{"c":2}} bye', '{"a":1', "no", '{"a":NaN}', None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(given)], "k int, t string")
    assert [r["j"] for r in df.select("k", answers.extract_json_object(F.col("t")).alias("j")).orderBy("k").collect()] == ['{"a":1}', '{"a":"}{","b":{"c":2}}', None, None, None, None]
    r = one(spark, answers.normalize_image_result(F.lit('{"kind":"odd","ocr":" x ","objects":[{"label":" a "},{"label":1}],"confidence":"0.5"}')))
    assert (r["kind"], r["ocr"], [o["label"] for o in r["objects"]], r["confidence"]) == ("mixed", "x", ["a"], 0.5)
    assert one(spark, answers.normalize_image_result(F.lit(" just words ")))["description"] == "just words"
    g = one(spark, answers.normalize_grounding(F.lit('{"objects":[{"label":"no"},{"label":"a","bbox":["900",10,100,"20"],"attributes":[1,"b"]},{"bbox":[1,2,3,4],"center":[5,true]}],"ocr":[{"text":"t","bbox":[0,0,1,1]},{"text":"u"}]}')))
    assert [o["bbox"] for o in g["objects"]] == [[100, 10, 900, 20], [1, 2, 3, 4]]
    assert (g["objects"][0]["center"], g["objects"][0]["region"], g["objects"][0]["attributes"]) == ([500, 15], "上中", ["1", "b"]) and g["objects"][1]["center"] == [5, 1] and g["objects"][1]["label"] == "未命名目标"
    assert [o["text"] for o in g["ocr"]] == ["t"] and one(spark, answers.normalize_grounding(F.lit("no"))) is None


def test_html_answers(spark):
    df = spark.createDataFrame([(0, "```html\n<!DOCTYPE html><p></html>\n```"), (1, "Sure! <html lang=x>a</HTML> done"), (2, "<html >a"), (3, None)], "k int, t string")
    rows = vision.extract_html(df, "t").orderBy("k").collect()
    assert [(r["html"], r["complete"]) for r in rows] == [("<!DOCTYPE html><p></html>", True), ("<html lang=x>a</HTML>", True), ("<html >a", False), ("", False)]


def test_commits(spark, tmp_path):
    subjects = ["feat(pdf): render scanned pages", "fix!: change upload protocol", "docs: x", "chore: y", "plain", "release: v1.2.0", " "]
    (tmp_path / "log").write_text("".join(f"{'abcdef0123'}{k}\x1f{s}\x1fA\x1fa@x\x1e\n" for k, s in enumerate(subjects)))
    df = read_commit_log(spark, str(tmp_path / "log"))
    assert df.count() == 7
    found = releases.categorize_commits(df).collect()
    assert {r["category"] for r in found} == {"Features", "Bug Fixes", "Documentation", "Maintenance", "Other Changes"} and len(found) >= 5
    parsed = {tuple(r["parsed"]) for r in found}
    assert ("feat", "pdf", False, "render scanned pages") in parsed and ("fix", None, True, "change upload protocol") in parsed
    notes = releases.release_notes(df.where("trim(subject) <> ''"), F.lit("pkg"), F.lit("1.2.0"), F.lit(None).cast("string"), F.lit("https://github.com/o/r")).first()["notes"]
    assert notes.startswith("## pkg v1.2.0\n\nChanges since the beginning of the repository\n\n### Features\n\n- **pdf:** render scanned pages ([abcdef0](https://github.com/o/r/commit/abcdef01230))") and "**BREAKING**" in notes and "release: v1.2.0" not in notes
    empty = releases.release_notes(df.where("subject like 'release%'"), F.lit("p"), F.lit("1"), F.lit("v0"), F.lit(None).cast("string")).first()["notes"]
    assert "No user-facing changes" in empty
    tags = spark.createDataFrame([("r", 0, "v1.2.1"), ("r", 1, "发行说明"), ("r", 2, "v1.0.0")], "repo string, pos int, tag string")
    assert releases.previous_release_tag(tags, F.lit("v1.2.1")).first()["previous_tag"] == "v1.0.0" and one(spark, releases.semver(F.lit("v1.2.1"))) == "1.2.1"


def test_keys_and_cache(spark, tmp_path):
    h = 5381
    for c in "abc":
        h = (h * 33 ^ ord(c)) & 0xFFFFFFFF
    digits, n = "", h
    while n:
        digits, n = "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36] + digits, n // 36
    assert one(spark, keys.legacy_hash(F.lit("abc"))) == "h" + digits
    assert one(spark, keys.normalize_base_url(F.lit("ftp://x"), "https://d")) is None and one(spark, keys.completion_endpoint(F.lit("http://x/v1/chat/completions/"), "https://d")) == "http://x/v1/chat/completions"
    entries = spark.createDataFrame([("k", "describe", "m", "u", "q", "t", "", datetime.datetime(2024, 1, 1, tzinfo=UTC)), (None, "describe", "m", "u", "q", "t", "", None)], cache.SCHEMA)
    name = cache.write_cache(entries, str(tmp_path / "cache"))
    assert [r["key"] for r in cache.read_cache(spark, str(tmp_path / "cache"), name).collect()] == ["k"]


def run_stream(stream, tmp_path, **options):
    writer = stream.writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
    writer.start().awaitTermination()


def test_streamed_liveness_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    uses = uses_of(spark, [0, 29, 70, 40, 75, 120, 121]).unionByName(uses_of(spark, [5, 36, 50], "u"))
    uses.orderBy(F.rand(1)).write.parquet(str(tmp_path / "in"))
    # A last use of another token moves the watermark past all others.
    uses_of(spark, [10_000], "end").write.mode("append").parquet(str(tmp_path / "in"))
    given = spark.readStream.schema(uses.schema).parquet(str(tmp_path / "in"))
    run_stream(jobs.stream_reference_liveness(given, watermark="5 days"), tmp_path)
    found = {(r["token"], r["ts"], r["alive"]) for r in spark.read.parquet(str(tmp_path / "rows")).where("token <> 'end'").collect()}
    assert found == {(r["token"], r["ts"], r["alive"]) for r in references.reference_liveness(uses).collect()}


class Handle:
    """A state of one token, with the timers that were asked for."""

    def __init__(self):
        self.states, self.timers = {}, []

    def getListState(self, name, schema):
        return self.states.setdefault(name, self.Kept([]))

    def getValueState(self, name, schema):
        return self.states.setdefault(name, self.Kept(None))

    def registerTimer(self, at):
        self.timers.append(at)

    class Kept:
        def __init__(self, value):
            self.value = value

        def get(self):
            return list(self.value) if isinstance(self.value, list) else self.value

        def exists(self):
            return self.value is not None

        def update(self, value):
            self.value = value

        put = update

        def clear(self):
            self.value = []

        def appendValue(self, value):
            self.value.append(value)

        def appendList(self, values):
            self.value.extend(values)


class Watermark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_token_has_one_timer_for_all_its_uses():
    handle, liveness = Handle(), jobs.Liveness(60_000)
    liveness.init(handle)
    minutes = [*range(500), 600, 601]
    list(liveness.handleInputRows(("t",), iter([pd.DataFrame({"ts": pd.to_datetime([m * 60 for m in part], unit="s")}) for part in (minutes[250:], minutes[:250])]), None))
    assert handle.timers == [1]
    told = [r for wait in (300, 1000) for batch in liveness.handleExpiredTimer(("t",), Watermark(wait * 60_000), None) for r in batch.itertuples(index=False)]
    assert handle.timers == [1, 300 * 60_000 + 1] and [r.ts.value // 60_000_000_000 for r in told] == minutes
    assert [r.alive for r in told] == [m < 600 for m in minutes]
    assert not list(liveness.handleExpiredTimer(("t",), Watermark(10**9), None))


def test_fan_out_compares_within_spans_of_time(spark, tmp_path):
    asked = spark.createDataFrame([(k, "a" if k % 3 else "b", UTC_START + datetime.timedelta(minutes=7 * k)) for k in range(200)], "request_id long, cache_key string, ts timestamp")
    told = asked.where("request_id % 4 = 0").select("cache_key", (F.col("ts") + F.expr("interval 1 minute")).alias("result_ts"), F.col("request_id").alias("answer"))
    streams = []
    for name, rows in (("asked", asked), ("told", told)):
        rows.write.parquet(str(tmp_path / name))
        streams.append(spark.readStream.schema(rows.schema).parquet(str(tmp_path / name)))
    joined = jobs.stream_fan_out(*streams, "1 hour", "36500 days")
    assert joined.columns == ["request_id", "cache_key", "ts", "result_ts", "answer"]
    assert "_span" in joined._jdf.queryExecution().analyzed().toString()
    run_stream(joined.select("request_id", "answer"), tmp_path)
    near = (F.col("r.result_ts") >= F.col("a.ts") - F.expr("interval 1 hour")) & (F.col("r.result_ts") <= F.col("a.ts") + F.expr("interval 1 hour"))
    want = asked.alias("a").join(told.alias("r"), (F.col("a.cache_key") == F.col("r.cache_key")) & near).select("a.request_id", "r.answer")
    found = spark.read.parquet(str(tmp_path / "rows"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() > 200


def test_streamed_extraction_and_expansion(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("hello\n\nworld")
    seen = []
    jobs.stream_extract(spark, str(tmp_path / "in"), lambda docs, blocks, errors, n: seen.extend(blocks.collect())).option("checkpointLocation", str(tmp_path / "s1")).trigger(availableNow=True).start().awaitTermination()
    assert [b["text"] for b in sorted(seen, key=lambda b: b["block_no"])] == ["hello", "world"]
    rows = spark.createDataFrame([(1, 0, [], "string", "see [📎 a.md]"), (2, 0, [], "string", "plain")], "conv_id long, turn long, path array<int>, type string, text string")
    rows.write.parquet(str(tmp_path / "m"))
    contexts = spark.createDataFrame([(7, "ctx")], "doc_id long, context string")
    out = {}
    resolve = lambda b: references.split_references(b, ["conv_id", "turn", "path"]).withColumn("doc_id", F.when(F.col("kind") == "ref", 7))
    jobs.stream_expand_messages(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "m")), resolve, contexts, lambda df, n: out.update({r["conv_id"]: r["content"] for r in df.collect()})).option("checkpointLocation", str(tmp_path / "s2")).trigger(availableNow=True).start().awaitTermination()
    assert out == {1: '[{"type":"text","text":"see\\n\\nctx"}]', 2: "plain"}


@pytest.mark.parametrize("name", ["p1_route_document_type", "p5_p6_plan_requests", "p9_final_outcomes", "b6_xmind_json", "r3_references", "a7_release_notes", "w4_reference_liveness"])
def test_registered_queries_equal_their_sql(spark, name):
    import duckdb

    import __spark_entry__

    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations", "events", "orders", "customer", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found, want = __spark_entry__.queries()[name](spark, sf_dir).toPandas(), con.execute(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, found[columns].astype(object).values.tolist())) == sorted(map(str, want[columns].astype(object).values.tolist()))


def test_registered_inputs_grow(spark, tmp_path):
    from anchorline.plans import derive, queries

    rows = [(k, "é🙂" * k, "en", "s", 2 * k) for k in range(120)] + [(120, None, "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in derive.store(spark, str(tmp_path)).collect()} == {k for k in range(121) if k % 10 != 3}
    found = {r["doc_id"]: r["hash"] for r in queries.m6_legacy_hash(spark, str(tmp_path)).collect()}
    for k, text, *_ in rows:
        h, data = 5381, (text or "").encode("utf-16-be")
        for at in range(0, len(data), 2):
            h = (h * 33 ^ int.from_bytes(data[at : at + 2], "big")) & 0xFFFFFFFF
        assert found[k] == "h" + np.base_repr(h, 36).lower()


def test_segments_are_handed_on_a_few_texts_at_a_time(spark):
    """A task holds Arrow slices, no frame of a whole batch, and keys stay with their segments across slices."""
    n = 2 * references._TEXTS + 1
    given = spark.range(n, numPartitions=1).selectExpr("id AS k", "concat('a', id, ' [📎 d', id, '](sfv-document://t', id, ')') AS text")
    found = references.split_references(given, ["k"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan
    assert sorted((r["k"], r["seg_no"], r["kind"], r["text"], r["token"]) for r in found.collect()) == [x for k in range(n) for x in ((k, 0, "text", f"a{k}", None), (k, 1, "ref", f"[📎 d{k}](sfv-document://t{k})", f"t{k}"))]
