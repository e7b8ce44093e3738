"""Endpoints and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import js_length, js_trim

#: Fixed value: version of the cache format, the first field of a key.
CACHE_VERSION = 3


def normalize_base_url(url: Column, default: str) -> Column:
    """An http(s) address without query, fragment and last slash; ``default`` where empty; null where it is none."""
    given = js_trim(F.coalesce(url, F.lit("")))
    given = F.when(given == "", F.lit(default)).otherwise(given)
    scheme, host, path = (F.regexp_extract(given, r"(?i)^(https?)://([^/?#\s]+)([^?#]*)", k) for k in (1, 2, 3))
    return F.when(host != "", F.regexp_replace(F.concat(F.lower(scheme), F.lit("://"), F.lower(host), path), "/$", ""))


def completion_endpoint(url: Column, default: str) -> Column:
    base = normalize_base_url(url, default)
    return F.when(base.rlike("(?i)/chat/completions$"), base).otherwise(F.concat(base, F.lit("/chat/completions")))


def content_hash(text: Column) -> Column:
    """Hash of contents in keys: SHA-256, since 32 bits collide on a large table."""
    return F.sha2(text, 256)


def legacy_hash(text: Column) -> Column:
    """The 32-bit hash ``h * 33 xor unit`` over UTF-16 units, in base 36 after an ``h``; for keys of old caches."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1)), lambda x: F.conv(x, 16, 10).cast("long"))
    units = F.coalesce(units, F.array().cast("array<long>"))
    hashed = F.aggregate(units, F.lit(5381).cast("long"), lambda h, u: (h * 33).bitwiseXOR(u).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.concat(F.lit("h"), F.lower(F.conv(hashed.cast("string"), 10, 36)))


def cache_key(content: Column, mode: Column, model: Column, base_url: Column, query: Column, default_url: str, hashed=content_hash) -> Column:
    """Version, content hash, mode, model, endpoint and hash of the trimmed query, joined by a bar."""
    return F.concat_ws("|", F.lit(str(CACHE_VERSION)), hashed(content), mode, model, normalize_base_url(base_url, default_url), hashed(js_trim(F.coalesce(query, F.lit("")))))
