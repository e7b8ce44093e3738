"""Where a block lies in its document, as one sparse struct, and as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All location fields in use, with their types; absent is null.
FIELDS = {
    "kind": "string", "precision": "string", "page": "int", "slide": "int", "section": "int", "label": "string", "paragraph": "int", "table": "string", "row": "int", "col": "int",
    "sheet": "string", "cell": "string", "column": "string", "range": "string", "topicPath": "string", "block": "int", "line": "int", "order": "int", "alt": "string", "source": "string",
    "anchor": "string", "id": "string", "region": "string", "bbox": "array<int>",
}

LOCATION = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"


def location(**fields: Column | str) -> Column:
    """A location struct with the given fields."""
    return F.struct(*((F.lit(v) if isinstance(v, str) else v).cast(kind).alias(k) if (v := fields.get(k)) is not None else F.lit(None).cast(kind).alias(k) for k, kind in FIELDS.items()))


def location_text(loc: Column) -> Column:
    """Its parts in fixed order; a row and column only where no cell names them; a fixed text where it has none."""

    def number(key: str, before: str, after: str = "") -> Column:
        return F.when(loc[key].isNotNull(), F.concat(F.lit(before), loc[key].cast("string"), F.lit(after)))

    def word(key: str, before: str) -> Column:
        return F.when(loc[key] != "", F.concat(F.lit(before), loc[key]))

    no_cell = F.coalesce(loc["cell"], F.lit("")) == ""
    section = F.when(loc["section"].isNotNull(), F.concat(F.lit("部分:"), loc["section"].cast("string"), F.when(loc["label"] != "", F.concat(F.lit("（"), loc["label"], F.lit("）"))).otherwise("")))
    bbox = F.when(loc["bbox"].isNotNull(), F.concat(F.lit("bbox:["), F.concat_ws(",", loc["bbox"].cast("array<string>")), F.lit("]")))
    parts = [
        number("page", "第 ", " 页"), number("slide", "第 ", " 张幻灯片"), word("sheet", "Sheet:"), word("topicPath", "主题路径:"), section, word("cell", "单元格:"), word("range", "覆盖范围:"),
        number("paragraph", "段落:"), F.when(no_cell, number("row", "行:")), F.when(no_cell, number("col", "列:")), bbox, word("region", "区域:"), number("line", "第 ", " 行"),
    ]
    text = F.concat_ws("｜", *parts)
    return F.when(text == "", "文档顺序锚点").otherwise(text)
