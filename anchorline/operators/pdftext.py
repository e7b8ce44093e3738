"""Text that lies uncompressed in PDF files."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.location import location
from ..functions.text import collapse, part_text, xml_unescape

#: Fixed value: text of a file in which none is found.
EMPTY = "[PDF 未发现可提取的文字层；扫描页需要 PDF 页面渲染/OCR 适配器]"

_PAGE = re.compile(r"/Type\s*/Page\b", re.I)
_SHOWN = re.compile(r"\(([^()\\]*(?:\\.[^()\\]*)*)\)\s*Tj|\[([^\]]+)\]\s*TJ", re.S)
_LITERAL = re.compile(r"\(([^()]*)\)")
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}


def literal(text: str) -> str:
    return re.sub(r"\\([\\()nrt])", lambda m: _ESCAPES.get(m[1], m[1]), text)


def page_texts(raw: str | None) -> list[str]:
    """The shown literals of each page, joined by spaces."""
    pages = _PAGE.split(raw or "")[1:]
    return [" ".join(literal(m[1]) if m[1] else "".join(map(literal, _LITERAL.findall(m[2] or ""))) for m in _SHOWN.finditer(page)) for page in pages]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _pages(raw: pd.Series) -> pd.Series:
    return raw.map(page_texts)


def pdf_text_fallback(df: DataFrame, content: str = "content") -> DataFrame:
    """``doc_id, page, type, id, text, location``: a block for each page with text, else one that says there is none.
    All pages of a file are found within its row, so it is read once and nothing is shuffled."""
    raw = df.select("doc_id", _pages(part_text(F.col(content))).alias("pages"))
    shown = F.filter(F.transform("pages", lambda p, k: F.struct((k + 1).alias("page"), collapse(xml_unescape(p)).alias("text"))), lambda p: p["text"] != "")
    texts = raw.select("doc_id", F.posexplode_outer(shown).alias("n", "p")).select("doc_id", F.coalesce("p.page", F.lit(0)).alias("page"), F.coalesce("p.text", F.lit(EMPTY)).alias("text"), F.col("p").isNull().alias("bare"))
    place = location(kind=F.when(F.col("bare"), "pdf-document").otherwise("pdf-page"), page=F.when(~F.col("bare"), F.col("page")), precision=F.when(F.col("bare"), "unknown").otherwise("page-level (fallback parser)"))
    return texts.select("doc_id", "page", F.lit("text").alias("type"), F.when(F.col("bare"), "pdf-empty").otherwise(F.concat(F.lit("pdf-"), F.col("page"), F.lit("-text"))).alias("id"), "text", place.alias("location"))
