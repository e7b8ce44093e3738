"""Markdown to ordered blocks, each document's within its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base import let
from ..functions.location import location
from ..functions.text import SPACE, SPACES, js_trim

#: An image reference, which lies in one line, an image data URL.
IMAGE = r"!\[([^\]\n]*)\]\(([^)\s]+)(?:[^\S\n]+[\"'][^\"'\n]*[\"'])?\)"
DATA_URL = r"(?i)^data:(image/[a-z0-9.+-]+);base64,(.+)$"

#: Blank lines between two paragraphs.
_BLANK = rf"\n[{SPACE}]*\n"


def _paragraphs(piece: Column, after_image: Column, before_image: Column) -> Column:
    """Paragraphs of a text between two images: what follows an image on its line is one of its own, and what stands before an image on its line has no indent."""
    at_end = F.contains(piece, F.lit("\n"))
    first, last = F.substring_index(piece, "\n", 1), F.substring_index(piece, "\n", -1)
    ended = F.when(after_image & at_end, F.concat(first, F.lit("\n"), F.substring(piece, F.length(first) + 1, F.length(piece)))).otherwise(piece)
    bare = lambda x: F.concat(F.substring(x, F.lit(1), F.length(x) - F.length(last)), F.ltrim(last, F.lit(SPACES)))
    indented = before_image & at_end & F.contains(F.lit(SPACES), F.substring(last, 1, 1))
    whole = F.when(indented, let(ended, bare)).otherwise(ended)
    return F.filter(F.transform(F.split(whole, _BLANK, -1), js_trim), lambda p: p != "")


def markdown_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, block_no, type, id, text, name, mime, source, content, location`` of ``df(doc_id, text)``.

    A line is cut at its image references. Text up to a blank line or an image is one paragraph;
    what follows an image on its line is a paragraph of its own. Paragraphs and images share one counter.
    All blocks of a document are found within its row, so nothing is shuffled.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    body = F.when(F.contains(body, F.lit("\r")), F.regexp_replace(body, r"\r\n?", "\n")).otherwise(body)
    # No carriage return is left, so one before and one behind each image cut the text: text, image, text, image, ..., text.
    marked = df.select("doc_id", body.alias("body")).select("doc_id", F.when(F.contains("body", F.lit("![")), F.regexp_replace("body", IMAGE, "\r$0\r")).otherwise(F.col("body")).alias("body"))
    images_in = lambda line: F.floor((F.length(line) - F.length(F.replace(line, F.lit("\r"), F.lit("")))) / 2).cast("int")
    line_of = F.flatten(F.transform(F.split("body", "\n", -1), lambda line, no: F.when(F.contains(line, F.lit("\r")), F.array_repeat(no, images_in(line))).otherwise(F.array().cast("array<int>"))))
    cut = marked.select("doc_id", F.split("body", "\r", -1).alias("pieces"), F.when(F.contains("body", F.lit("\r")), line_of).alias("line_of"))
    block = lambda image, line_no, value: F.struct(F.lit(image).alias("image"), line_no.cast("int").alias("line_no"), value.alias("value"))
    blocks_of = lambda piece, k: F.when(k % 2 == 1, F.array(block(True, F.get("line_of", F.floor(k / 2).cast("int")), piece))).otherwise(
        F.transform(_paragraphs(piece, k > 0, k < F.size("pieces") - 1), lambda p: block(False, F.lit(None), p))
    )
    # An outer explode, as Spark would work the array out twice more to filter empty ones before an inner one.
    numbered = cut.select("doc_id", F.posexplode_outer(F.flatten(F.transform("pieces", blocks_of))).alias("n", "b")).where("n is not null").select("doc_id", (F.col("n") + 1).alias("block_no"), "b.*")
    # Column by column, so that each is worked out once however many others are made of it.
    of_image = lambda x: F.when(F.col("image"), x).otherwise("")
    named = numbered.withColumns({"alt": of_image(F.regexp_extract("value", IMAGE, 1)), "target": of_image(F.regexp_extract("value", IMAGE, 2))})
    named = named.withColumn("mime", F.when(F.col("image"), F.lower(F.regexp_extract("target", DATA_URL, 1))).otherwise(""))
    is_text, embedded, alt, target, n = ~F.col("image"), F.col("mime") != "", F.col("alt"), F.col("target"), F.col("block_no").cast("string")
    linked = F.col("image") & ~embedded
    code = F.rtrim(F.regexp_replace(F.regexp_extract(target, DATA_URL, 2), "[^A-Za-z0-9+/]", ""), F.lit("="))
    code = F.rpad(code, (F.ceil(F.length(code) / 4) * 4).cast("int"), "=")
    place = location(
        kind=F.when(is_text, "markdown-block").when(embedded, "markdown-image").otherwise("markdown-image-ref"), block=F.when(is_text, F.col("block_no")), line=F.when(F.col("image"), F.col("line_no") + 1),
        alt=F.when(embedded, alt), source=F.when(linked, target), precision=F.when(is_text, "document-order").otherwise("line-anchor"),
    )
    return named.select(
        "doc_id", "block_no", F.when(embedded, "image").otherwise("text").alias("type"),
        F.concat(F.when(is_text, "md-").when(embedded, "md-img-").otherwise("md-img-ref-"), n).alias("id"),
        F.when(is_text, F.col("value")).when(linked, F.concat(F.lit("[Markdown 图片: "), F.when(alt != "", alt).otherwise(target), F.lit("]"))).alias("text"),
        F.when(embedded, F.when(alt != "", alt).otherwise(F.concat(F.lit("image-"), n))).alias("name"), F.when(embedded, F.col("mime")).alias("mime"), F.when(embedded, "markdown-data-url").alias("source"),
        F.when(embedded, F.try_to_binary(code, F.lit("base64"))).alias("content"), place.alias("location"),
    )
