"""Answers of vision models: JSON objects in chatter, normalised to fixed structs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import let
from .geometry import half_up, normalize_box, region_for
from .text import js_left, js_trim

#: Kinds of images, and caps of answers.
KINDS = ("text-like", "colorful", "mixed", "decorative")
TEXT_CAP, IMAGE_OBJECTS, GROUNDED, ATTRIBUTES = 10_000, 30, 100, 12


_DECODER = json.JSONDecoder(parse_constant=lambda _: 1 / 0)


def _object_in(text: str | None) -> str | None:
    """The first balanced ``{...}`` outside strings, if it is valid JSON."""
    if text is None or (first := text.find("{")) < 0:
        return None
    try:
        return text[first : _DECODER.raw_decode(text, first)[1]]
    except (ValueError, ZeroDivisionError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def _objects(text: pd.Series) -> pd.Series:
    return text.map(_object_in)


def extract_json_object(text: Column) -> Column:
    """The first JSON object of an answer, without its code fence; null where there is none."""
    bare = js_trim(F.regexp_replace(F.regexp_replace(js_trim(text), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    return F.when(F.contains(bare, F.lit("{")), _objects(bare))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _string(v: Column, path: str = "$") -> Column:
    """A string value; null for anything else."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(_kind(at) == "STRING", F.try_variant_get(v, path, "string"))


def _number(v: Column, path: str, low: float, high: float) -> Column:
    """A loose number (digits in a string and booleans count), within bounds; ``low`` where it is none."""
    n = F.coalesce(F.try_variant_get(v, path, "double"), F.try_variant_get(v, path, "boolean").cast("double"))
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.coalesce(F.when(~F.isnan(n), n), F.lit(float(low)))))


def _items(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def normalize_image_result(text: Column) -> Column:
    """``kind, ocr, description, objects, confidence`` of a document image; an answer without JSON is its description."""
    cut = lambda x: F.coalesce(js_left(js_trim(x), TEXT_CAP), F.lit(""))
    none = F.array().cast("array<struct<label:string,position:string>>")

    def read(v: Column) -> Column:
        labelled = F.filter(F.transform(_items(v, "$.objects"), lambda o: F.struct(js_trim(_string(o, "$.label")).alias("label"), F.coalesce(js_trim(_string(o, "$.position")), F.lit("")).alias("position"))), lambda o: o["label"].isNotNull())
        kind, good = _string(v, "$.kind"), v.isNotNull()
        return F.struct(
            F.when(good & kind.isin(*KINDS), kind).otherwise("mixed").alias("kind"), F.when(good, cut(_string(v, "$.ocr"))).otherwise("").alias("ocr"),
            F.when(good, cut(_string(v, "$.description"))).otherwise(cut(text)).alias("description"), F.when(good, F.slice(labelled, 1, IMAGE_OBJECTS)).otherwise(none).alias("objects"), F.when(good, _number(v, "$.confidence", 0, 1)).otherwise(0.0).alias("confidence"),
        )

    return let(F.try_parse_json(extract_json_object(text)), read)


def normalize_grounding(text: Column) -> Column:
    """``answer, objects, ocr, relations``; null for an answer without JSON. Objects without a box go before the cap counts."""
    number = lambda n: _number(n, "$", 0, 1000)
    text_of = lambda o, k: F.coalesce(F.try_variant_get(o, f"$.{k}", "string"), F.lit(""))

    def boxed(v: Column, path: str) -> Column:
        """The first items of a list that have a box, each as ``o`` with its ``box``."""
        pairs = F.transform(_items(v, path), lambda o: F.struct(o.alias("o"), normalize_box(F.transform(F.try_variant_get(o, "$.bbox", "array<variant>"), number)).alias("box")))
        return F.slice(F.filter(pairs, lambda p: p["box"].isNotNull()), 1, GROUNDED)

    def centred(p: Column) -> Column:
        given = F.try_variant_get(p["o"], "$.center", "array<variant>")
        own = F.array(half_up((p["box"][0] + p["box"][2]) / 2), half_up((p["box"][1] + p["box"][3]) / 2))
        return F.struct(p["o"].alias("o"), p["box"].alias("box"), F.when(F.size(given) >= 2, F.transform(F.slice(given, 1, 2), lambda n: half_up(number(n)))).otherwise(own).alias("center"))

    def grounded(p: Column) -> Column:
        o, center, region = p["o"], p["center"], js_trim(F.coalesce(_string(p["o"], "$.region"), F.lit("")))
        return F.struct(
            F.coalesce(js_trim(_string(o, "$.label")), F.lit("未命名目标")).alias("label"), p["box"].alias("bbox"), center.alias("center"), F.when(region != "", region).otherwise(region_for(center[0], center[1])).alias("region"),
            _number(o, "$.confidence", 0, 1).alias("confidence"), F.slice(F.transform(_items(o, "$.attributes"), lambda a: F.coalesce(_string(a), F.to_json(a))), 1, ATTRIBUTES).alias("attributes"),
        )

    def read(v: Column) -> Column:
        relations = F.transform(_items(v, "$.relations"), lambda r: F.struct(*(text_of(r, k).alias(k) for k in ("subject", "relation", "object"))))
        return F.when(v.isNotNull(), F.struct(
            F.coalesce(_string(v, "$.answer"), F.lit("")).alias("answer"), F.transform(F.transform(boxed(v, "$.objects"), centred), grounded).alias("objects"),
            F.transform(boxed(v, "$.ocr"), lambda p: F.struct(F.coalesce(_string(p["o"], "$.text"), F.lit("")).alias("text"), p["box"].alias("bbox"))).alias("ocr"),
            F.slice(F.filter(relations, lambda r: (r["subject"] != "") & (r["relation"] != "") & (r["object"] != "")), 1, GROUNDED).alias("relations"),
        ))

    return let(F.try_parse_json(extract_json_object(text)), read)


def grounding_json(text: Column) -> Column:
    """:func:`normalize_grounding` as JSON, whole confidences without a fraction; null for an answer without JSON."""
    string = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)

    def told(g: Column) -> Column:
        objects = F.transform(g["objects"], lambda o: F.concat(
            F.lit('{"label":'), string(o["label"]), F.lit(',"bbox":'), F.to_json(o["bbox"]), F.lit(',"center":'), F.to_json(o["center"]), F.lit(',"region":'), string(o["region"]),
            F.lit(',"confidence":'), F.regexp_replace(o["confidence"].cast("string"), r"\.0$", ""), F.lit(',"attributes":'), F.to_json(o["attributes"]), F.lit("}"),
        ))
        return F.concat(F.lit('{"answer":'), string(g["answer"]), F.lit(',"objects":['), F.array_join(objects, ","), F.lit('],"ocr":'), F.to_json(g["ocr"]), F.lit(',"relations":'), F.to_json(g["relations"]), F.lit("}"))

    return let(normalize_grounding(text), told)
