"""Messages of any nesting come back as they were; containers are read where they lie."""

import json
import random
import re

from pyspark.sql import functions as F

from anchorline.operators import messages, references
from anchorline.operators.blocks import extract_corpus
from anchorline.sources import files
from anchorline.sources.messages import read_messages

SCHEMA = "conv_id long, turn long, content string, is_array boolean"


def made(r, depth):
    """JSON of a block, with escapes, repeated keys, odd numbers and white space."""
    text = json.dumps("".join(r.choice(['"', "\\", "[", "]}", "é🙂", "a", "\n", "{"]) for _ in range(r.randrange(5))), ensure_ascii=r.random() < 0.5)
    kind = r.randrange(6 if depth else 4)
    if kind == 0:
        return text
    if kind == 1:
        return f'{{"type":"text","text":"first","text":{text},"n":1.50}}'
    if kind == 2:
        return r.choice(["null", "-1.0e+5", "true", "[]", "{}", '[{"type":"text"}]', '{"type":"tool-result"}', '{"type":"tool-result","content":"no"}'])
    if kind == 3:
        return f'{{"z":{text},"type":"image","attachment":{{"b":1,"a":{text}}},"content":[{text}]}}'
    inner = ",".join(made(r, depth - 1) for _ in range(r.randrange(4)))
    return r.choice(['{{"content":[{0}],"type":"tool-result","after":[{{}}]}}', '{{"type":"text","content":[1],"type":"tool-result","content":[{0}]}}']).format(inner)


def test_random_messages_come_back_as_they_were(spark):
    r = random.Random(4)
    rows = [(k, 0, "[" + ",".join(made(r, 5) for _ in range(r.randrange(4))) + "]", True) for k in range(400)]
    rows += [(k, 1, c, True) for k, c in enumerate(['{"a":1}', "[1,", "[1]x", "", None, '["\\ud83d"]', "[" + '{"type":"tool-result","content":[' * 300 + "]}" * 300 + "]"])] + [(0, 2, "plain [", False), (1, 2, "", False)]
    found = read_messages(spark.createDataFrame(rows, SCHEMA))
    back = {(x["conv_id"], x["turn"]): x["content"] for x in messages.rebuild_messages(found).collect()}
    assert back == {(c, t): content for c, t, content, _ in rows}
    same = messages.rebuild_messages(messages.renumbered(found.withColumn("piece_no", F.lit(0))))
    assert {(x["conv_id"], x["turn"]): x["content"] for x in same.collect()} == back


def test_blocks_of_a_message(spark):
    content = r'["C:\\dir\\", {"type":"tool-result","content":[{"type":"text","text":"hi"}],"n":1.50}, {"text":"a","text":"b"}]'
    rows = read_messages(spark.createDataFrame([(1, 0, content, True), (2, 0, "[]", True)], SCHEMA)).orderBy("conv_id", "path").collect()
    assert [(r["path"], r["type"], r["text"]) for r in rows] == [([0], "string", "C:\\dir\\"), ([1], "tool-result", None), ([1, 0], "text", "hi"), ([2], "unknown", "b"), ([], "array", None)]
    assert (rows[1]["block"], rows[1]["tail"], rows[1]["opened"]) == ('{"type":"tool-result","content":[', '],"n":1.50}', True)


def test_envelopes(spark):
    code = "aGVsbG8"
    given = [f"see [[sfv_document_v1 name=a.md mime=]] {code} [[/SFV_DOCUMENT_V1]]", f"[[SFV_DOCUMENT_V1 name=a.md mime=]]{code}=[[/SFV_DOCUMENT_V1]] [[SFV_DOCUMENT_V1 name=b.md mime=]]{code}=[[/SFV_DOCUMENT_V1]]", "[[SFV_DOCUMENT_V1 name=a.md mime=]]a[[/SFV_DOCUMENT_V1]]", "[[SFV_DOCUMENT_V1 name=a.md mime=]] no end", "x [[SFV_DOCUMENT_V1 name=m.xmind mime=]]UEsFBgAAAAAAAAAAAAAAAAAAAAAAAA==[[/SFV_DOCUMENT_V1]]"]
    blocks = read_messages(spark.createDataFrame([(k, 0, t, False) for k, t in enumerate(given)], SCHEMA))
    seen = []

    def contexts(docs):
        rows = docs.collect()
        seen.extend((r["name"], bytes(r["content"])) for r in rows)
        ids = [(r["doc_id"], "<" + r["name"] + ">") for r in rows if r["name"] != "m.xmind"]
        return spark.createDataFrame(ids, "doc_id long, context string"), spark.createDataFrame([(r["doc_id"], "missing_main_part") for r in rows if r["name"] == "m.xmind"], "doc_id long, error string")

    out = {r["conv_id"]: (r["text"], r["expanded"]) for r in messages.expand_envelopes(blocks, contexts).collect()}
    assert out[0] == ("see\n\n<a.md>", True) and out[3] == (given[3], False)
    assert out[1] == (f"<a.md>\n\n[[SFV_DOCUMENT_V1 name=b.md mime=]]{code}=[[/SFV_DOCUMENT_V1]]", True)
    assert out[2][0] == references.FAILED.format(references.BAD_BASE64) and out[4][0] == references.FAILED.format(references.NO_XMIND_MAIN)
    assert sorted(seen)[0] == ("a.md", b"hello") and len(seen) == 2


def test_containers_are_read_in_place(spark, tmp_path):
    parts = "array<struct<part_no:int,part_path:string,text:string>>"
    rows = [(f"d{k}.docx", [(0, "word/document.xml", f'<w:p><w:t>{k}</w:t><w:drawing><a:blip r:embed="r"/></w:drawing></w:p>'), (1, "word/_rels/document.xml.rels", '<Relationship Id="r" Target="media/i.png"/>')], [("word/media/i.png", bytearray(b"png%d" % (k % 2)))]) for k in range(4)]
    given = spark.createDataFrame(rows, f"name string, texts {parts}, media array<struct<part_path:string,content:binary>>")
    assert files.write_files(files.packed(given), str(tmp_path / "in")) == 4
    read = files.read_documents(spark, str(tmp_path / "in")).withColumn("mime", F.lit(""))
    docs, blocks, errors = extract_corpus(read)
    assert errors.count() == 0 and docs.count() == 4
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not re.search(r"Exchange[^\n]*content", plan)
    files.write_blocks(blocks, str(tmp_path / "out"), read)
    images = spark.read.parquet(str(tmp_path / "out" / "image_content"))
    wanted = {r["sha"] for r in spark.read.parquet(str(tmp_path / "out" / "blocks")).where("type = 'image'").collect()}
    assert {bytes(r["content"]) for r in images.where(F.col("sha").isin(*wanted)).collect()} == {b"png0", b"png1"} and len(wanted) == 2
    small = files.unpack_packages(read, part_bytes=10)
    assert {r["error"] for r in small.collect()} == {"container_too_large"}


def test_envelope_is_cut_at_its_head_and_its_end(spark):
    """The payload is not matched by a pattern; the first head that an end follows counts, and an end before any head does not."""
    head = "[[SFV_DOCUMENT_V1 name=a%20b.md mime=]]"
    rows = [(1, f"x [[/SFV_DOCUMENT_V1]] {head}YQ=[[/sfv_document_v1]] y {head}Yg[[/SFV_DOCUMENT_V1]]"), (2, f"x {head}YQ=="), (3, None)]
    found = references.parse_document_envelopes(spark.createDataFrame(rows, "k int, content string"), "content")
    assert "(.*?)" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["name"], r["mime"], r["content"] and bytes(r["content"]), r["before"], r["after"], r["stripped"]) for r in found.orderBy("k").collect()] == [
        ("a b.md", "", b"a", "x [[/SFV_DOCUMENT_V1]] ", f" y {head}Yg[[/SFV_DOCUMENT_V1]]", f"x [[/SFV_DOCUMENT_V1]]\n[已上传文档:a b.md]\ny {head}Yg[[/SFV_DOCUMENT_V1]]"),
        (None, None, None, None, None, f"x {head}YQ=="), (None, None, None, None, None, ""),
    ]


def test_messages_are_put_together_in_one_pass(spark):
    """Blocks and the tails of tool results come from one reading of a message."""
    given = [(1, 0, '[{"type":"tool-result","content":["a",{"k":1}],"n":1.50},"b"]', True), (2, 0, "plain", False), (3, 0, "[]", True)]
    rebuilt = messages.rebuild_messages(read_messages(spark.createDataFrame(given, SCHEMA)))
    assert rebuilt._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {r["conv_id"]: r["content"] for r in rebuilt.collect()} == {k: content for k, _, content, _ in given}
