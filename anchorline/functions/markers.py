"""Invisible document references: a JSON payload as zero-width characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .base import let

#: The four digits, the start and the end of a hidden reference.
DIGITS, START, END = "\u200b\u200c\u200d\u2060", "\u2063", "\u2064"

#: Hidden references in a text, payload in group 1.
HIDDEN = f"{START}([{DIGITS}]+){END}"

#: UTF-16 in hex without unpaired surrogates.
_WELL_FORMED = "^(?:(?!D[89A-F])[0-9A-F]{4}|D[89AB][0-9A-F]{2}D[C-F][0-9A-F]{2})*$"


def encode_reference_marker(name: Column, token: Column, mime: Column) -> Column:
    """A marker of version 2; null for an empty token."""
    filled = F.when(F.coalesce(name, F.lit("")) == "", "document").otherwise(name)
    payload = F.to_json(F.struct(F.lit(2).alias("v"), token.alias("t"), filled.alias("n"), F.coalesce(mime, F.lit("")).alias("m")))
    hexed = F.hex(F.encode(payload, "UTF-16BE"))
    digits = F.transform(F.regexp_extract_all(hexed, F.lit("[0-9A-F]{16}|[0-9A-F]{4}"), F.lit(0)), lambda h: F.lpad(F.conv(h, 16, 4), 2 * F.length(h), F.lit("0")))
    return F.when(F.coalesce(token, F.lit("")) != "", F.concat(F.lit(START), F.translate(F.array_join(digits, ""), "0123", DIGITS), F.lit(END)))


def decode_reference_marker(text: Column) -> Column:
    """``token, name, mime`` of the first hidden reference; null where there is none or it is malformed.
    A payload that is no JSON object with a token is a bare token."""

    def hexed(payload: Column) -> Column:
        parts = F.regexp_extract_all(payload, F.lit("[0-3]{32}|[0-3]{8}"), F.lit(0))
        return F.array_join(F.transform(parts, lambda d: F.lpad(F.conv(d, 4, 16), (F.length(d) / 2).cast("int"), F.lit("0"))), "")

    def read(x: Column) -> Column:
        known = F.coalesce(x["t"] != "", F.lit(False))
        return F.struct(F.when(known, x["t"]).otherwise(x["plain"]).alias("token"), *(F.when(known, F.coalesce(x[k], F.lit(""))).otherwise("").alias(name) for k, name in (("n", "name"), ("m", "mime"))))

    def typed(json: Column, k: str) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(json, f"$.{k}", "variant")) == "STRING", F.try_variant_get(json, f"$.{k}", "string")).alias(k)

    def parsed(plain: Column) -> Column:
        return let(let(F.try_parse_json(plain), lambda json: F.struct(plain.alias("plain"), *(typed(json, k) for k in "tnm"))), read)

    def decoded(x: Column) -> Column:
        good = (x["payload"] != "") & (F.length(x["payload"]) % 8 == 0) & x["hexed"].rlike(_WELL_FORMED)
        return F.when(good, let(F.decode(F.unhex(x["hexed"]), "UTF-16BE"), parsed))

    payload = F.translate(F.regexp_extract(text, HIDDEN, 1), DIGITS, "0123")
    return let(let(payload, lambda p: F.struct(p.alias("payload"), hexed(p).alias("hexed"))), decoded)
