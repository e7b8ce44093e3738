"""Documents: routing, containers, blocks, context."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from anchorline.functions import geometry, markers, text
from anchorline.functions.location import location, location_text
from anchorline.operators import context, docx, markdown, parts, pdftext, pptx, routing, xlsx, xmind
from anchorline.operators.blocks import extract_corpus
from anchorline.sources import files


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


#: Files of all container types; each test looks at its own.
FILES: dict[str, bytes] = {}


def file(name, parts):
    FILES[name] = zipped(parts) if isinstance(parts, dict) else parts


@pytest.fixture(scope="module")
def corpus(spark):
    """Blocks and errors by file name, of one run over all files."""
    names = sorted(FILES)
    rows = [(k, name, "", len(FILES[name]), bytearray(FILES[name])) for k, name in enumerate(names)]
    _, blocks, errors = extract_corpus(spark.createDataFrame(rows, "doc_id long, name string, mime string, length long, content binary"))
    found = {name: [] for name in names}
    for b in blocks.collect():
        found[names[b["doc_id"]]].append(b)
    return {n: sorted(b, key=lambda b: b["block_no"]) for n, b in found.items()}, {names[r["doc_id"]]: r["error"].split(":")[0] for r in errors.collect()}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_routing(spark):
    given = [("report.doc", "", "doc"), ("slides.ppt", "", "ppt"), ("table.xls", "", "xls"), ("map.xmind", "", "xmind"), ("TABLE.XLS", "application/octet-stream", "xls"), ("notes.markdown", "", "markdown"), ("archive.zip", "", None), ("a.pdf", "application/msword", "doc"), ("a", "text/plain; x", "markdown"), ("a", "Application/PDF", None), (None, None, None)]
    df = spark.createDataFrame([(n, m) for n, m, _ in given], "name string, mime string")
    assert [r["doc_type"] for r in routing.route_document_type(df).collect()] == [t for *_, t in given]


DOCX = '<w:document><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r><w:drawing><a:blip r:embed="rId5"/></w:drawing></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
file("a.docx", {"word/document.xml": DOCX, "word/_rels/document.xml.rels": '<Relationships><Relationship Id="rId5" Target="media/image1.png"/></Relationships>', "word/media/image1.png": b"\x89PNG\r\n\x1a\n"})
file("bare.docx", {"word/document.xml": "<w:document>just <b>words</b></w:document>"})


def test_docx_table_cell_with_image(corpus):
    blocks, errors = corpus[0]["a.docx"], corpus[1]
    assert [(b["type"], b["id"], b["location"]["kind"], b["location"]["row"], b["location"]["col"]) for b in blocks] == [("text", "p-1", "table-cell", 1, 1), ("image", "p-1-img-1", "table-cell-anchor", 1, 1)]
    assert blocks[1]["mime"] == "image/png" and "a.docx" not in errors
    assert [(b["id"], b["text"]) for b in corpus[0]["bare.docx"]] == [("p-1", "just words")]


ANCHOR = '<xdr:oneCellAnchor><xdr:from><xdr:col>0</xdr:col><xdr:row>1</xdr:row></xdr:from><a:blip r:embed="r1"/></xdr:oneCellAnchor>'
file(
    "a.xlsx",
    {
        "xl/workbook.xml": '<sheet name="数据" r:id="rId1"/><sheet r:id="gone"/>', "xl/_rels/workbook.xml.rels": '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>', "xl/sharedStrings.xml": "<si><t>标题</t></si><si><t>兼容格式</t></si>",
        "xl/worksheets/sheet1.xml": '<row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>数值</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>42</v></c></row><row r="9"><c><v>&lt;x&gt;</v></c></row><row><c><v>y</v></c></row>',
        "xl/drawings/drawing1.xml": ANCHOR, "xl/drawings/_rels/drawing1.xml.rels": '<Relationship Id="r1" Target="../media/i.gif"/>', "xl/media/i.gif": "gif",
    },
)


def test_xlsx_cells_and_orphan_drawing(corpus):
    blocks = corpus[0]["a.xlsx"]
    found = {b["id"]: b["text"] for b in blocks if b["type"] == "text"}
    assert found == {"sheet-数据-A1": "标题", "sheet-数据-B1": "数值", "sheet-数据-A2": "兼容格式", "sheet-数据-B2": "42", "sheet-数据-A9": "<x>", "sheet-数据-A10": "y"}
    last = max(blocks, key=lambda b: b["block_no"])
    assert (last["id"], last["location"]["range"], last["location"]["sheet"]) == ("xlsx-img-1", "2:1-1:1", None)


file("a.pptx", {"ppt/slides/slide2.xml": "<p:sp><a:t>b</a:t></p:sp>", "ppt/slides/slide10.xml": "<p:sp></p:sp>", "ppt/slides/slide1.xml": "<p:sp><a:t>a </a:t><a:t> c</a:t></p:sp>"})


def test_pptx_without_size_and_empty_slide(corpus):
    blocks = corpus[0]["a.pptx"]
    assert [(b["id"], b["text"]) for b in blocks] == [("slide-1-text-1", "a c"), ("slide-2-text-1", "b"), ("slide-10-empty", "[空白或未解析的幻灯片]")]
    assert blocks[0]["location"]["bbox"] == [0, 0, 0, 0]


TREE = [{"title": "产品", "rootTopic": {"title": "中心", "children": {"attached": [{"title": "需求", "notes": {"plain": {"content": "备注内容"}}}]}}}]
file("a.xmind", {"content.json": json.dumps(TREE), "attachments/image.png": b"x", "thumbnail.png": b"y"})
file("b.xmind", {"content.xml": "<map><topic><title>中心</title><topic><title>分支</title><notes><plain>说明</plain></notes></topic></topic></map>"})
file("broken.xmind", bytes([1, 2, 3]))
file("none.xmind", {"x": "y"})
file("bad.xmind", {"content.json": "{"})
file("old.doc", b"x")
file("what.zip", b"x")


def test_xmind_trees(corpus):
    by = lambda name: [(b["text"], b["location"]["topicPath"]) for b in corpus[0][name]]
    assert by("a.xmind") == [("中心", "中心"), ("需求", "中心 > 需求"), ("[备注]\n备注内容", "中心 > 需求")]
    assert by("b.xmind") == [("分支", "中心 > 分支"), ("[备注]\n说明", "中心 > 分支"), ("中心", "中心")]
    assert not any(b["type"] == "image" for b in corpus[0]["a.xmind"])
    assert corpus[1] == {"broken.xmind": "bad_container", "none.xmind": "missing_main_part", "bad.xmind": "bad_topics", "old.doc": "unsupported_codec", "what.zip": "unsupported"}


def test_deep_topic_tree():
    deep = {"title": "t"}
    for _ in range(200):
        deep = {"title": "t", "children": [deep]}
    assert len(xmind.json_rows(json.dumps(deep))) == 201


def test_markdown_blocks(spark):
    df = spark.createDataFrame([(1, "a\nb\n\nx ![k](p.png) y\nz"), (2, "![i](data:image/PNG;base64,iVBORw==)\r\n \r\ntail"), (3, None), (4, "x ![a](b) mid ![](c \"t\")\nnext")], "doc_id long, text string")
    rows = [(r["doc_id"], r["id"], r["text"], r["location"]["line"]) for r in markdown.markdown_blocks(df).orderBy("doc_id", "block_no").collect()]
    assert [r for r in rows if r[0] == 1] == [(1, "md-1", "a\nb", None), (1, "md-2", "x", None), (1, "md-img-ref-3", "[Markdown 图片: k]", 4), (1, "md-4", "y", None), (1, "md-5", "z", None)]
    assert [(r[1], r[2]) for r in rows if r[0] == 4] == [("md-1", "x"), ("md-img-ref-2", "[Markdown 图片: a]"), ("md-3", "mid"), ("md-img-ref-4", "[Markdown 图片: c]"), ("md-5", "next")]
    image = markdown.markdown_blocks(df).where("type = 'image'").first()
    assert (image["mime"], image["name"], bytes(image["content"])) == ("image/png", "i", b"\x89PNG")


def test_pdf_text(spark):
    raw = rb"<< /Type /Page >> (a\)b) Tj << /Type/Page >> [(c)(d)] TJ"
    df = spark.createDataFrame([(1, bytearray(raw)), (2, bytearray(b"%PDF")), (3, bytearray(b"/Type /Page (" + rb"\\" * 20000 + b") Tj"))], "doc_id long, content binary")
    rows = {(r["doc_id"], r["page"]): r["text"] for r in pdftext.pdf_text_fallback(df).collect()}
    assert rows[1, 1] == "a)b" and rows[1, 2] == "cd" and rows[2, 0] == pdftext.EMPTY and len(rows[3, 1]) == 20000


def test_caps(spark):
    docs = spark.createDataFrame([(k,) for k in range(3)], "doc_id long")
    head = len("[原文文本层]\n[b][文档顺序锚点]\n")
    rows = [(0, 1, "x" * (500 - head)), (1, 1, "x" * (501 - head))]
    blocks = spark.createDataFrame([(d, n, "text", "b", t) for d, n, t in rows], "doc_id long, block_no int, type string, id string, text string").withColumn("location", location())
    found = {r["doc_id"]: r["text_layer"] for r in context.text_layer(docs, blocks, 500).collect()}
    assert len(found[0]) == 500 and "截断" not in found[0] and len(found[1]) == 500 and found[1].endswith("缩小文档范围]")
    assert found[2] == "[原文文本层]\n（没有可直接提取的文字）"


def test_image_limit(spark):
    blocks = spark.range(33).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") + 1).cast("int").alias("block_no"), F.lit("image").alias("type"), F.concat(F.lit("i"), "id").alias("id")).withColumn("location", location())
    images = context.select_document_images(blocks)
    assert images.where("selected").count() == 32 and images.first()["omitted"] == 1
    results = spark.createDataFrame([], f"doc_id long, id string, result {context.RESULT}")
    docs = spark.createDataFrame([(1, "n", "markdown", "p")], "doc_id long, name string, doc_type string, location_precision string")
    layer = context.image_layer(docs, context.attach_image_results(images, results))
    text = layer.first()["image_layer"]
    assert text.count("[图片分析失败]") == 33 and text.count("识别置信度:0") == 33
    whole = context.document_context(docs, spark.createDataFrame([], "doc_id long, text_layer string"), layer, images.select("doc_id", "omitted").distinct()).first()["context"]
    assert "已省略 1 张图片" in whole and whole.endswith("[文档结束]")


def test_text_functions(spark):
    assert one(spark, text.js_trim(F.lit("　﻿ a  "))) == "a"
    assert one(spark, text.js_left(F.lit("a🙂b"), 2)) == "a" and one(spark, text.js_left(F.lit("a🙂b"), 3)) == "a🙂" and one(spark, text.js_length(F.lit("a🙂"))) == 3
    assert one(spark, text.xml_unescape(F.lit("&amp;lt; &#x1F642;&#65;&#xD800;&#99999999; &lt;"))) == "&lt; 🙂A&#xD800;&#99999999; <"
    assert one(spark, text.xml_attr(F.lit("<a xid = 'q' Id=\"w\">"), "id")) == "q" and one(spark, text.xml_attr(F.lit("<a>"), "id")) == ""
    assert one(spark, geometry.normalize_box(F.array(*map(F.lit, (900.0, 5.5, -3.0, 2000.0))))) == [0, 6, 900, 1000]
    assert one(spark, geometry.region_for(F.lit(500), F.lit(500))) == "中间" and one(spark, geometry.rect_region(F.array(*map(F.lit, (0, 700, 100, 900))))) == "下左"
    assert one(spark, geometry.pdf_item_bbox(*map(F.lit, (10.0, 80.0, 20.0, 10.0, 100.0, 100.0)))) == [100, 100, 300, 200]
    assert one(spark, location_text(location(sheet="S", cell="A1", row=F.lit(1), col=F.lit(1), bbox=F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4))))) == "Sheet:S｜单元格:A1｜bbox:[1,2,3,4]"


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("hello ![i](data:image/png;base64,iVBORw==)")
    read = files.read_documents(spark, str(tmp_path / "in"))
    assert read.first()["name"] == "a.md"
    _, blocks, _ = extract_corpus(read.withColumn("mime", F.lit("")))
    files.write_blocks(blocks, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out" / "blocks"))
    assert back.count() == 2 and "content" not in back.columns and {r["doc_type"] for r in back.collect()} == {"markdown"}
    assert spark.read.parquet(str(tmp_path / "out" / "image_content")).first()["sha"]


def test_many_small_files_lie_in_few_tasks(spark, tmp_path):
    names = spark.range(200).select(F.concat(F.lit("d"), "id", F.lit(".md")).alias("name"), F.encode(F.concat(F.lit("text "), F.col("id").cast("string")), "UTF-8").alias("content"))
    assert files.write_files(names, str(tmp_path / "in")) == 200
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    with files.small_files(spark):
        read = files.read_documents(spark, str(tmp_path / "in")).withColumn("mime", F.lit(""))
        assert read.rdd.getNumPartitions() <= 8
        docs, blocks, errors = extract_corpus(read)
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    for df in (docs, blocks, errors):
        assert not any(f.startswith(f"file:{tmp_path}/in") or f.startswith(f"file://{tmp_path}/in") for f in df.inputFiles())
    assert sorted(r["text"] for r in blocks.collect()) == sorted(f"text {k}" for k in range(200)) and errors.count() == 0


def test_plan_has_only_types_that_occur_and_few_tasks_list_files(spark, tmp_path):
    rows = [(1, "a.md", "", 9, bytearray(b"one\n\ntwo"))]
    docs, blocks, errors = extract_corpus(spark.createDataFrame(rows, "doc_id long, name string, mime string, length long, content binary"))
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert "spTree" not in plan and "sharedStrings" not in plan and "content.json" not in plan
    assert [r["text"] for r in blocks.orderBy("block_no").collect()] == ["one", "two"] and docs.count() == 1 and errors.count() == 0

    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    with files.small_files(spark):
        assert int(spark.conf.get(key)) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(key) == before


def test_no_files_and_only_rejected_ones(spark):
    schema = "doc_id long, name string, mime string, length long, content binary"
    for rows, wanted in (([], []), ([(1, "a.bin", "", 1, bytearray(b"x")), (2, "b.doc", "", 1, bytearray(b"x"))], [(1, "unsupported"), (2, "unsupported_codec")])):
        docs, blocks, errors = extract_corpus(spark.createDataFrame(rows, schema))
        assert docs.count() == 0 and blocks.count() == 0 and "location" in blocks.columns
        assert sorted(map(tuple, errors.collect())) == wanted


def test_trim_sees_the_ends_alone(spark):
    texts = [" 　a b﻿\n", "a \u0085", "", "\t  ", "x", None, " é🙂 "]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", text.js_trim(F.col("t")).alias("t"), text.collapse(F.col("t")).alias("c")).orderBy("k").collect()
    assert [r["t"] for r in rows] == ["a b", "a \u0085", "", "", "x", None, "é🙂"]
    assert [r["c"] for r in rows] == ["a b", "a \u0085", "", "", "x", None, "é🙂"]


def test_marker_is_decoded_once_a_value(spark):
    names = ["a.md", "документ 🙂.pdf", "", "n" * 301]
    marked = spark.createDataFrame(list(enumerate(names)), "k int, n string").select("k", markers.encode_reference_marker(F.col("n"), F.lit("t"), F.lit("m")).alias("m")).withColumn("r", markers.decode_reference_marker(F.concat(F.lit("a"), "m", F.lit("b"))))
    assert [r["r"]["name"] for r in marked.orderBy("k").collect()] == ["a.md", "документ 🙂.pdf", "document", "n" * 301]
    assert marked.select("r")._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 2
    bare = "⁣" + "".join("​‌‍⁠"[int(d)] for c in "tok" for d in (str(ord(c) >> s & 3) for s in range(14, -1, -2))) + "⁤"
    odd = [bare, bare[:-2] + "⁤", "⁣⁤", "none"]
    found = spark.createDataFrame(list(enumerate(odd)), "k int, t string").select("k", markers.decode_reference_marker(F.col("t")).alias("r")).orderBy("k").collect()
    assert [r["r"] and r["r"]["token"] for r in found] == ["tok", None, None, None]


def test_what_nobody_asks_for_is_left_out(spark):
    """Ids alone need no boxes and no locations: those are made of the rows, not within a package's array, so the plan drops them."""
    packages = spark.createDataFrame([(1, [], [], [])], "doc_id long, texts " + parts.TEXTS + ", media " + parts.MEDIA + ", rels array<struct<owner_part:string,rel_id:string,target:string,target_part:string>>")
    made = {"shape-coordinate": pptx.pptx_blocks, "cell-coordinate": xlsx.xlsx_cells, "cell-range": xlsx.xlsx_images, "table-cell": docx.docx_blocks}
    for word, blocks in made.items():
        plan = lambda *columns: blocks(packages).select(*columns)._jdf.queryExecution().optimizedPlan().toString()  # noqa: B023, E731
        assert word in plan("id", "location") and word not in plan("id", "text"), word


def test_texts_so_far(spark):
    counted = pptx.counts_so_far(F.array(F.lit(1), F.lit(2), F.lit(4)), F.lit(6))
    assert one(spark, counted) == [0, 1, 2, 2, 3, 3] and one(spark, pptx.counts_so_far(F.array().cast("array<int>"), F.lit(2))) == [0, 0]


def test_markdown_blocks_are_found_within_the_row(spark):
    """Nothing is shuffled, and lines, indents and trailing texts of images stay what they were."""
    given = spark.createDataFrame([(1, "one\n  two ![a](b) and ![](c)\n tail\r\n \r\nthree\n   ![d](data:image/png;base64,iVBORw==)x\ny"), (2, None)], "doc_id long, text string")
    found = markdown.markdown_blocks(given)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(b["block_no"], b["id"], b["text"], b["location"]["line"]) for b in sorted(found.collect(), key=lambda b: b["block_no"])] == [
        (1, "md-1", "one\ntwo", None), (2, "md-img-ref-2", "[Markdown 图片: a]", 2), (3, "md-3", "and", None), (4, "md-img-ref-4", "[Markdown 图片: c]", 2), (5, "md-5", "tail", None),
        (6, "md-6", "three", None), (7, "md-img-7", None, 6), (8, "md-8", "x", None), (9, "md-9", "y", None),
    ]


def test_pdf_text_is_read_once_and_within_the_row(spark):
    pdf = b"/Type /Page (a &amp;  b) Tj /Type /Page ( ) Tj /Type /Page [(c) (d)] TJ"
    found = pdftext.pdf_text_fallback(spark.createDataFrame([(1, bytearray(pdf)), (2, bytearray(b"/Type /Page (&#32;) Tj")), (3, None)], "doc_id long, content binary"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Aggregate" not in plan
    assert sorted((b["doc_id"], b["page"], b["id"], b["text"], b["location"]["kind"]) for b in found.collect()) == [
        (1, 1, "pdf-1-text", "a & b", "pdf-page"), (1, 3, "pdf-3-text", "cd", "pdf-page"), (2, 0, "pdf-empty", pdftext.EMPTY, "pdf-document"), (3, 0, "pdf-empty", pdftext.EMPTY, "pdf-document"),
    ]


def test_listed_files_are_known_to_the_driver_by_their_lists_alone(spark, tmp_path):
    given = spark.range(200).select(F.concat(F.lit("a b#"), "id", F.lit(".md")).alias("name"), F.when(F.col("id") > 0, F.concat(F.lit("text "), "id")).cast("binary").alias("content"))
    lists = str(tmp_path / "lists")
    assert files.write_files(given, str(tmp_path / "in"), lists) == 200
    assert files.write_files(given.where("name = 'a b#7.md'"), str(tmp_path / "in"), lists) == 1
    read = files.read_listed(spark.read.schema("path string").parquet(lists))
    assert all(f.startswith(f"file://{lists}/") for f in read.inputFiles()) and len(read.inputFiles()) <= 8
    assert read.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert sorted((r["name"], bytes(r["content"]), r["length"]) for r in read.collect()) == sorted((f"a b#{k}.md", f"text {k}".encode() if k else b"", len(f"text {k}") if k else 0) for k in range(200))
    assert read.select("doc_id").distinct().count() == 200
