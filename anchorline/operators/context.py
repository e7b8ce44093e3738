"""Bounded context text of documents: a text layer, an image layer, and both under a header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.location import location_text
from ..functions.text import js_left, js_length

#: Caps in UTF-16 units, and images of a document that are analysed.
TEXT_CAP, CONTEXT_CAP, MAX_IMAGES = 180_000, 240_000, 32
#: Wording of the layers.
TEXT_HEAD, TEXT_NONE = "[原文文本层]\n", "（没有可直接提取的文字）"
IMAGE_HEAD, IMAGE_NONE = "[图片内容层]\n", "（文档中没有可提取的内嵌图片）"
IMAGE_FAILED = "[图片分析失败]"
CONSTRAINTS = "[位置约束]\n- 原文文本与图片 OCR 来源不同；图片 OCR 不能当作正文段落。\n- 每个图片内容只属于同一图片 ID 和同一位置锚点，不得跨页、跨幻灯片、跨 Sheet 混合。\n- bbox 使用 0~1000 归一化坐标；没有坐标时只相信页码、单元格、段落或文档顺序。\n[文档结束]"

RESULT = "struct<kind:string,ocr:string,description:string,objects:array<struct<label:string,position:string>>,confidence:double>"


def capped(text: Column, cap: int, note: str, least: int = 0) -> Column:
    return F.when(js_length(text) <= cap, text).otherwise(F.concat(js_left(text, max(least, cap - len(note))), F.lit(note)))


def text_layer(docs: DataFrame, blocks: DataFrame, cap: int = TEXT_CAP) -> DataFrame:
    """``doc_id, text_layer``. Blocks that start beyond the cap are left out before anything is gathered."""
    entry = F.concat(F.lit("["), F.col("id"), F.lit("]["), location_text(F.col("location")), F.lit("]\n"), F.col("text"))
    entries = blocks.where("type = 'text'").select("doc_id", "block_no", entry.alias("entry"))
    order = Window.partitionBy("doc_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    near = entries.withColumn("before", F.coalesce(F.sum(js_length(F.col("entry")) + 2).over(order), F.lit(0))).where(F.col("before") <= cap)
    joined = near.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block_no", "entry")))["entry"], "\n\n").alias("entries"))
    note = f"\n\n[原文文本层已截断：超过 {cap} 字符，请分段上传或缩小文档范围]"
    full = F.concat(F.lit(TEXT_HEAD), F.coalesce("entries", F.lit(TEXT_NONE)))
    return docs.select("doc_id").join(joined, "doc_id", "left").select("doc_id", capped(full, cap, note, len(TEXT_HEAD)).alias("text_layer"))


def select_document_images(blocks: DataFrame, k: int = MAX_IMAGES) -> DataFrame:
    """Image blocks with ``image_no``, whether it is ``selected`` (the first ``k``), and how many the document's others are (``omitted``)."""
    by_doc = Window.partitionBy("doc_id")
    images = blocks.where("type = 'image'").withColumn("image_no", F.row_number().over(by_doc.orderBy("block_no")))
    return images.withColumn("selected", F.col("image_no") <= k).withColumn("omitted", F.greatest(F.count(F.lit(1)).over(by_doc) - k, F.lit(0)))


def attach_image_results(images: DataFrame, results: DataFrame) -> DataFrame:
    """Images with ``result``; a failed default where there is none."""
    failed = F.struct(F.lit("mixed").alias("kind"), F.lit("").alias("ocr"), F.lit(IMAGE_FAILED).alias("description"), F.array().cast("array<struct<label:string,position:string>>").alias("objects"), F.lit(0.0).alias("confidence"))
    return images.join(results.select("doc_id", "id", F.col("result").cast(RESULT).alias("result")), ["doc_id", "id"], "left").withColumn("result", F.coalesce("result", failed))


def plain_number(x: Column) -> Column:
    """A number without trailing zeros: 1, 0, 0.9."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def image_layer(docs: DataFrame, images: DataFrame) -> DataFrame:
    """``doc_id, image_layer`` from images with ``result``; images beyond the limit are listed too."""
    r = F.col("result")
    objects = F.array_join(F.transform(r["objects"], lambda o: F.when(o["position"] != "", F.concat(o["label"], F.lit("("), o["position"], F.lit(")"))).otherwise(o["label"])), "、")
    lines = F.concat_ws(
        "\n", F.concat(F.lit("[图片 "), F.col("id"), F.lit("]["), location_text(F.col("location")), F.lit("]")), F.concat(F.lit("图片类型:"), r["kind"]),
        F.when((r["description"] != "") & (r["kind"] != "text-like"), F.concat(F.lit("图片详细描述:"), r["description"])), F.when(r["ocr"] != "", F.concat(F.lit("图片 OCR（不是原文正文）:"), r["ocr"])),
        F.when(F.size(r["objects"]) > 0, F.concat(F.lit("图片对象:"), objects)), F.concat(F.lit("识别置信度:"), plain_number(r["confidence"])),
    )
    joined = images.select("doc_id", "block_no", lines.alias("entry")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block_no", "entry")))["entry"], "\n\n").alias("entries"))
    return docs.select("doc_id").join(joined, "doc_id", "left").select("doc_id", F.concat(F.lit(IMAGE_HEAD), F.coalesce("entries", F.lit(IMAGE_NONE))).alias("image_layer"))


def document_context(docs: DataFrame, texts: DataFrame, images: DataFrame, omitted: DataFrame, cap: int = CONTEXT_CAP, max_images: int = MAX_IMAGES) -> DataFrame:
    """``doc_id, context`` of ``docs(doc_id, name, doc_type, location_precision)`` and their layers; ``omitted(doc_id, omitted)``."""
    joined = docs.join(texts, "doc_id", "left").join(images, "doc_id", "left").join(omitted, "doc_id", "left")
    left_out = F.when(F.coalesce("omitted", F.lit(0)) > 0, F.concat(F.lit("\n\n[图片内容层已省略 "), F.col("omitted").cast("string"), F.lit(f" 张图片：超过单文档图片上限 {max_images}]"))).otherwise("")
    full = F.concat(
        F.lit("[文档开始]\n文件名:"), F.col("name"), F.lit("\n格式:"), F.col("doc_type"), F.lit("\n位置精度:"), F.col("location_precision"), F.lit("\n\n"), F.coalesce("text_layer", F.lit(TEXT_HEAD + TEXT_NONE)),
        F.lit("\n\n"), F.coalesce("image_layer", F.lit(IMAGE_HEAD + IMAGE_NONE)), left_out, F.lit("\n\n" + CONSTRAINTS),
    )
    return joined.select("doc_id", capped(full, cap, f"\n\n[文档上下文已截断：超过 {cap} 字符，请分段上传文档]").alias("context"))
