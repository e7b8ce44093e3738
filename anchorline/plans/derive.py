"""Inputs of the registered queries, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.markers import encode_reference_marker
from ..operators.parts import MEDIA, TEXTS, with_relationships
from ..operators.routing import image_mime

EXTENSIONS = (".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".xmind", ".pdf", ".md", ".markdown", ".zip", "")
MIMES = ("", "application/pdf", "text/plain", "application/msword", "application/octet-stream")
QUESTIONS = ("红色按钮在哪里", "请还原这个网页", "这个漫画的这一章讲了什么", "红色按钮位于左上角吗", "", "describe this", "把页面代码还原并说明位置", "生成页面", "  总结一下故事  ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` over all cores where it has few files, as a table of one file has; a large one stays as it is. What is joined or gathered by the key later needs no other deal."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < 4 * cores else df


def pick(values: tuple[str, ...], key: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), (key % len(values)).cast("int"))


def sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc"), d, pick(EXTENSIONS, d)).alias("name"), pick(MIMES, d).alias("mime"), (F.col("n_chars") * 4096).alias("length"))


ATTACHMENTS = f"""SELECT doc_id, 'doc' || doc_id || {sql_list(EXTENSIONS)}[(doc_id % 12 + 1)::INT] AS name, {sql_list(MIMES)}[(doc_id % 5 + 1)::INT] AS mime, n_chars * 4096 AS length, doc_id % 12 AS e, doc_id % 5 AS m FROM documents"""


def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose line ends become paragraph breaks with an image reference, or an embedded image in every seventh document."""
    d = F.col("doc_id")
    image = F.when(d % 7 == 0, "![fig](data:image/PNG;base64,iVBORw==)").otherwise(F.concat(F.lit("![fig](img/"), d, F.lit(".png)")))
    return spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.concat(F.lit("doc"), d, F.lit(".md")).alias("name"), F.replace("text", F.lit(".\n"), F.concat(F.lit(".\n\n"), image, F.lit("\ntail\n"))).alias("text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", pick(QUESTIONS, F.col("doc_id")).alias("query"))


QUESTIONS_SQL = f"SELECT doc_id, {sql_list(QUESTIONS)}[(doc_id % {len(QUESTIONS)} + 1)::INT] AS query FROM documents"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with a reference in one of five forms, by turn and conversation; every sixth has none."""
    token, name = F.concat(F.lit("tok"), F.col("conv_id")), F.concat(F.lit("doc"), F.col("conv_id"), F.lit(".md"))
    hidden = encode_reference_marker(name, token, F.lit("text/markdown"))
    form = (F.col("conv_id") + F.col("turn")) % 6
    marked = (
        F.when(form == 0, F.concat("text", hidden, F.lit(" end")))
        .when(form == 1, F.concat(F.lit("see [📎 "), name, F.lit("](sfv-document://"), token, F.lit(") "), F.col("text")))
        .when(form == 2, F.concat(F.lit("see [📎 "), name, F.lit("] "), F.col("text")))
        .when(form == 3, F.concat(F.lit("📎 "), name, F.lit("\n"), F.col("text")))
        .when(form == 4, F.concat(hidden, hidden, F.col("text")))
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", marked.alias("text"), form.alias("form"), token.alias("want_token"), name.alias("want_name"))


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents: one for each document's token but every tenth."""
    d = F.col("doc_id")
    ids = table(spark, sf_dir, "documents").where(d % 10 != 3)
    stamp = F.timestamp_seconds(d * 60)
    return ids.select(F.concat(F.lit("tok"), d).alias("token"), F.concat(F.lit("doc"), d, F.lit(".md")).alias("name"), "doc_id", F.col("n_chars").alias("n_bytes"), stamp.alias("created_at"), stamp.alias("last_used_at"))


def uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as uses of a token for each user."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id")).alias("token"), F.col("ts").cast("timestamp").alias("ts")).distinct()


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A response log from events: status, body and error by id."""
    e = F.col("event_id") % 7
    answer = F.concat(F.lit("answer "), F.col("event_id"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.when(e != 5, answer).otherwise("").alias("content")).alias("message"), F.when(e == 6, "length").otherwise("stop").alias("finish_reason"))).alias("choices")))
    return table(spark, sf_dir, "events").select(
        F.expr("event_id div 2").alias("request_id"), (F.col("event_id") % 2).cast("int").alias("attempt"), F.when(e == 0, 429).when(e == 1, 503).when(e == 2, 400).otherwise(200).alias("status"),
        F.when(e < 3, F.lit('{"error":"x"}')).otherwise(body).alias("body"), F.when(e == 3, "timeout").alias("error"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits: type by priority, scope by status, repositories by customer."""
    p = F.substring("o_orderpriority", 1, 1)
    kind = F.when(p == "1", "feat").when(p == "2", "fix").when(p == "3", "docs").when(p == "4", "chore").otherwise("plain words")
    subject = F.when(p == "5", F.concat(F.lit("change "), F.col("o_orderkey"))).when(F.col("o_orderkey") % 11 == 0, "release: v1.0.0").otherwise(F.concat(kind, F.lit("("), F.lower("o_orderstatus"), F.lit(")"), F.when(F.col("o_orderkey") % 13 == 0, "!").otherwise(""), F.lit(": change "), F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("repo"), F.col("o_custkey") % 20).alias("repo"), F.col("o_orderkey").alias("pos"), F.md5(F.col("o_orderkey").cast("string")).alias("hash"), subject.alias("subject"), F.lit("a").alias("author"), F.lit("a@example.com").alias("email"))


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
LINES = f"(SELECT * REPLACE (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE_ORDER)})::INT AS l_linenumber) FROM lineitem)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, numbered anew in their order."""
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey").withColumn("l_linenumber", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)))


def xml_of(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def gathered(rows: DataFrame, key: str, order: list[str], value: Column) -> DataFrame:
    """``doc_id`` and the ordered values of its rows, joined."""
    return rows.groupBy(F.col(key).alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct(*order, value.alias("v"))))["v"], "").alias("xml"))


def packages(df: DataFrame, texts: Column, media: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, texts, media, rels`` of ``df(doc_id, ...)`` with an array ``texts`` of parts and the same images in each, by path with their bytes."""
    images = F.array(*(F.struct(F.lit(1000 + k), F.lit(path), image_mime(F.lit(path)), F.sha2(F.lit(data), 256)) for k, (path, data) in enumerate((media or {}).items())))
    return with_relationships(df.select("doc_id", texts.cast(TEXTS).alias("texts"), images.cast(MEDIA).alias("media")))


def text_part(path: Column | str, text: Column | str, part_no: Column | int = 0) -> Column:
    return F.struct((F.lit(part_no) if isinstance(part_no, int) else part_no).cast("int").alias("part_no"), (F.lit(path) if isinstance(path, str) else path).alias("part_path"), (F.lit(text) if isinstance(text, str) else text).alias("text"))


def docx_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as Word documents: a paragraph, then a table of line items with a picture in each row's second cell."""
    rel = '<Relationships><Relationship Id="rId1" Type="image" Target="media/image1.png"/></Relationships>'
    cell = lambda text: F.concat(F.lit("<w:tc><w:p><w:r><w:t>"), text, F.lit("</w:t></w:r></w:p></w:tc>"))
    row = F.concat(F.lit("<w:tr>"), cell(F.col("l_linenumber").cast("string")), F.lit('<w:tc><w:p><w:t xml:space="preserve">'), xml_of(F.concat(F.lit("<"), F.col("l_linestatus"), F.lit("> & "), F.col("l_returnflag"))), F.lit('</w:t><w:drawing><a:blip r:embed="rId1"/></w:drawing></w:p></w:tc></w:tr>'))
    rows = gathered(lines(spark, sf_dir), "l_orderkey", ["l_linenumber"], row)
    main = F.concat(F.lit("<w:document><w:body><w:p><w:r><w:t>Order  "), F.col("doc_id"), F.lit("</w:t></w:r></w:p><w:p></w:p><w:tbl>"), F.col("xml"), F.lit("</w:tbl></w:body></w:document>"))
    return packages(rows, F.array(text_part("word/document.xml", main), text_part("word/_rels/document.xml.rels", rel, 1)), {"word/media/image1.png": "png"})


def pptx_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as presentations: a slide for each line item, with a shape whose place is the quantity, a picture, and none on every fourth slide."""
    shape = F.concat(F.lit('<p:sp><p:spPr><a:xfrm><a:off x="'), F.col("l_quantity").cast("int"), F.lit('" y="0"/><a:ext cx="50" cy="100"/></a:xfrm></p:spPr><a:t>Part '), F.col("l_partkey"), F.lit('</a:t></p:sp><p:pic><a:blip r:embed="rId1"/></p:pic>'))
    slide = F.concat(F.lit("<p:sld><p:spTree>"), F.when(F.col("l_linenumber") == 4, "").otherwise(shape), F.lit("</p:spTree></p:sld>"))
    path = F.concat(F.lit("ppt/slides/slide"), F.col("l_linenumber"), F.lit(".xml"))
    rels = F.concat(F.lit("ppt/slides/_rels/slide"), F.col("l_linenumber"), F.lit(".xml.rels"))
    n = 2 * F.col("l_linenumber")
    each = lines(spark, sf_dir).withColumn("a", text_part(path, slide, n)).withColumn("b", text_part(rels, '<Relationship Id="rId1" Target="../media/a.png"/>', n + 1))
    books = each.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.concat(F.collect_list("a"), F.collect_list("b"))).alias("parts"))
    return packages(books, F.concat("parts", F.array(text_part("ppt/presentation.xml", '<p:sldSz cx="100" cy="200"/>'))), {"ppt/media/a.png": "png"})


def xlsx_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as workbooks: a row for each line item, with a raw, a shared and an inline value, and one drawing of the sheet and one of none."""
    row = F.concat(F.when(F.col("l_linenumber") == 1, '<row r="3">').otherwise("<row>"), F.lit("<c><v>"), F.col("l_quantity").cast("int"), F.lit('</v></c><c t="s"><v>'), F.col("l_linenumber") % 3, F.lit('</v></c><c t="inlineStr"><is><t>'), F.col("l_linestatus"), F.lit("</t></is></c></row>"))
    books = gathered(lines(spark, sf_dir), "l_orderkey", ["l_linenumber"], row)
    anchor = '<xdr:twoCellAnchor><xdr:from><xdr:col>1</xdr:col><xdr:row>2</xdr:row></xdr:from><xdr:to><xdr:col>3</xdr:col><xdr:row>4</xdr:row></xdr:to><a:blip r:embed="rId1"/></xdr:twoCellAnchor>'
    fixed = {
        "xl/workbook.xml": '<workbook><sheets><sheet name="Lines" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/>',
        "xl/sharedStrings.xml": "<sst><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r></si></sst>", "xl/worksheets/_rels/sheet1.xml.rels": '<Relationship Id="rId9" Target="../drawings/drawing1.xml"/>',
        "xl/drawings/drawing1.xml": anchor, "xl/drawings/drawing2.xml": anchor, "xl/drawings/_rels/drawing1.xml.rels": '<Relationship Id="rId1" Target="../media/a.jpg"/>', "xl/drawings/_rels/drawing2.xml.rels": '<Relationship Id="rId1" Target="../media/a.jpg"/>',
    }
    sheet = text_part("xl/worksheets/sheet1.xml", F.concat(F.lit('<worksheet><sheetData>'), F.col("xml"), F.lit('</sheetData><drawing r:id="rId9"/></worksheet>')))
    return packages(books, F.array(sheet, *(text_part(p, t, k + 1) for k, (p, t) in enumerate(fixed.items()))), {"xl/media/a.jpg": "jpg"})


def xmind_packages(spark: SparkSession, sf_dir: str, form: str) -> DataFrame:
    """Customers as mind maps, their orders as topics with a note, in JSON or XML."""
    orders = spread(table(spark, sf_dir, "orders"), "o_custkey")
    if form == "json":
        topic = F.to_json(F.struct(F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"), F.struct(F.struct(F.col("o_orderpriority").alias("content")).alias("plain")).alias("notes")))
        maps = orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("o_orderkey", topic.alias("v"))))["v"], ",").alias("xml"))
        return packages(maps, F.array(text_part("content.json", F.concat(F.lit('[{"title":"Sheet","rootTopic":{"title":"Customer '), F.col("doc_id"), F.lit('","children":{"attached":['), F.col("xml"), F.lit("]}}}]")))))
    topic = F.concat(F.lit("<topic><title>Order "), F.col("o_orderkey"), F.lit("</title><notes><plain>"), F.col("o_orderpriority"), F.lit("</plain></notes></topic>"))
    maps = gathered(orders, "o_custkey", ["o_orderkey"], topic)
    return packages(maps, F.array(text_part("content.xml", F.concat(F.lit("<map><topic><title>Customer "), F.col("doc_id"), F.lit("</title>"), F.col("xml"), F.lit("</topic></map>")))))


def order_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, name, texts, media`` (images with their bytes): the orders of each customer as a Word document with a picture a paragraph, a workbook or a mind map."""
    word = F.concat(F.lit("<w:p><w:r><w:t>Order "), F.col("o_orderkey"), F.lit('</w:t></w:r><w:drawing><a:blip r:embed="rId1"/></w:drawing></w:p>'))
    row = F.concat(F.lit('<row><c t="inlineStr"><is><t>'), F.col("o_orderpriority"), F.lit("</t></is></c></row>"))
    topic = F.to_json(F.struct(F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title")))
    kind = F.col("o_custkey") % 3
    one = F.when(kind == 0, word).when(kind == 1, row).otherwise(topic)
    rows = spread(table(spark, sf_dir, "orders"), "o_custkey").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("o_orderkey", one.alias("v"))))["v"], "\n").alias("xml"))
    kind, xml = F.col("doc_id") % 3, F.col("xml")
    docx = F.array(text_part("word/document.xml", F.concat(F.lit("<w:body>"), xml, F.lit("</w:body>"))), text_part("word/_rels/document.xml.rels", '<Relationship Id="rId1" Target="media/a.png"/>', 1))
    xlsx = F.array(text_part("xl/workbook.xml", '<sheet name="Orders" r:id="rId1"/>'), text_part("xl/_rels/workbook.xml.rels", '<Relationship Id="rId1" Target="sheet.xml"/>', 1), text_part("xl/sheet.xml", xml, 2))
    xmind = F.array(text_part("content.json", F.concat(F.lit('[{"title":"S","rootTopic":{"title":"Customer","children":{"attached":['), F.replace(xml, F.lit("\n"), F.lit(",")), F.lit("]}}}]"))))
    image = F.when(kind == 0, F.array(F.struct(F.lit("word/media/a.png").alias("part_path"), F.concat(F.lit("png "), F.col("doc_id")).cast("binary").alias("content"))))
    return rows.select("doc_id", F.concat(F.lit("c"), F.col("doc_id"), F.when(kind == 0, ".docx").when(kind == 1, ".xlsx").otherwise(".xmind")).alias("name"), F.when(kind == 0, docx).when(kind == 1, xlsx).otherwise(xmind).alias("texts"), image.alias("media"))


def pdf_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF text: a page for each line."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.lit("<< /Type /Page >> ("), F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("("), F.lit("\\(")), F.lit(")"), F.lit("\\)")), F.lit(") Tj\n")))
    return spread(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.concat(F.lit("%PDF-1.4\n"), F.array_join(lines, "")).cast("binary").alias("content"))
