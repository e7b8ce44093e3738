"""Document references in messages: finding, resolving, keeping alive."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base import let
from ..functions.markers import DIGITS, HIDDEN, START, decode_reference_marker
from ..functions.text import js_trim
from .routing import MAX_DOCUMENT_BYTES, document_type
from .scans import RANGE, ranged, ranges_before, with_carried, within

#: References of a message that are followed; visible forms of a reference; the envelope of a document in a text; texts that stand for documents.
MAX_REFS = 16
LINK = r"\[📎\s+([^\]\n]+)\]\(sfv-document://([^)\s]+)\)"
LABEL = r"\[📎\s+([^\]\n]+)\]"
BARE = r"(?:\A|\n)(📎\s+([^\n]+?))\s*(?=\n|\Z)"
ENVELOPE_HEAD, ENVELOPE_END = r"(?i)\[\[SFV_DOCUMENT_V1\s+name=([^\s]+)\s+mime=([^\]]*)\]\]", r"(?i)\[\[/SFV_DOCUMENT_V1\]\]"
ENVELOPE = ENVELOPE_HEAD.replace("(?i)", "(?is)") + "(.*?)" + ENVELOPE_END.replace("(?i)", "")
UPLOADED = "[已上传文档:{}]"
EXPIRED = "文档附件引用已失效，请重新上传文档"
FAILED = "[文档解析失败,未把文档内容当作普通文本发送:{}]"
SENT = "已发送文档"
#: What is wrong with a document in an envelope.
BAD_URI, BAD_BASE64, TOO_LARGE, UNSUPPORTED = "URI malformed", "文档 base64 数据无效", "文档超过 25MB,无法处理", "不支持的文档格式，仅支持 doc/docx/ppt/pptx/xls/xlsx/xmind/pdf/md/markdown"
NO_DOCX_MAIN, NO_XMIND_MAIN, BAD_ZIP = "DOCX 缺少 word/document.xml", "XMind 缺少 content.json 或 content.xml", "invalid zip data"
#: Milliseconds that an unused reference lives, references and bytes of a store.
TTL_MS, MAX_ITEMS, MAX_BYTES = 30 * 60 * 1000, 64, 128 * 1024 * 1024

#: White space as trimmed in the texts: ASCII and Unicode spaces and the byte-order mark.
_SPACE = " \t\n\v\f\r\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
_HIDDEN, _LINK, _LABEL, _BARE = (re.compile(p) for p in (HIDDEN, "(?i)" + LINK, LABEL, BARE))
_ENVELOPE = re.compile(ENVELOPE)

#: Texts whose segments are handed on together.
_TEXTS = 256


def _payload(digits: str) -> tuple[str, str, str] | None:
    """Token, name and MIME type in a hidden reference's digits."""
    if len(digits) % 8:
        return None
    value = int("".join(str(DIGITS.index(d)) for d in digits), 4)
    text = value.to_bytes(len(digits) // 4, "big").decode("utf-16-be", "replace")
    try:
        found = json.loads(text)
    except ValueError:
        return text, "", ""
    if not isinstance(found, dict) or not isinstance(found.get("t"), str) or not found["t"]:
        return text, "", ""
    return found["t"], *(found[k] if isinstance(found.get(k), str) else "" for k in "nm")


def percent_decoded(text: str) -> str:
    """Decoded if it is well-formed, else as it is."""
    if re.search("%(?![0-9A-Fa-f]{2})", text):
        return text
    try:
        return unquote_to_bytes(text).decode()
    except UnicodeDecodeError:
        return text


def first_reference(text: str) -> tuple[int, int, str, str | None, str, str] | None:
    """Start, end, form, token, name and MIME type of the reference to follow next: of all the text, the strongest form."""
    if (m := _HIDDEN.search(text)) and (found := _payload(m[1])):
        return m.start(), m.end(), "hidden", *found
    if m := _LINK.search(text):
        return m.start(), m.end(), "link", percent_decoded(m[2]), m[1].strip(_SPACE), ""
    if m := _LABEL.search(text):
        return m.start(), m.end(), "label", None, m[1].strip(_SPACE), ""
    if m := _BARE.search(text):
        return m.start(1), m.end(), "bare", None, m[2].strip(_SPACE), ""
    return None


def _segments(text: str, max_refs: int) -> Iterator[tuple]:
    rest, found = text, False
    for _ in range(max_refs):
        ref = first_reference(rest)
        if ref is None:
            break
        found = True
        if before := rest[: ref[0]].strip(_SPACE):
            yield "text", before, None, None, None, None
        yield "ref", rest[ref[0] : ref[1]], *ref[2:]
        rest = rest[ref[1] :]
    if found and (rest := rest.strip(_SPACE)):
        yield "text", rest, None, None, None, None


def split_references(df: DataFrame, keys: list[str], text: str = "text", max_refs: int = MAX_REFS) -> DataFrame:
    """Segments of each text that has a reference: ``keys``, ``seg_no, kind (text, ref), text, form, token, name, mime``.
    Texts without any mark of a reference never leave the JVM; of the others a task holds the segments of a few at a time."""
    marked = df.where(F.contains(F.col(text), F.lit(START)) | F.contains(F.col(text), F.lit("📎"))).select(*keys, F.col(text).alias("_text"))
    kinds = {"seg_no": pa.int32(), **dict.fromkeys(("kind", "text", "form", "token", "name", "mime"), pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(start, _TEXTS)
                of, rows = [], []
                for k in range(part.num_rows):
                    for n, segment in enumerate(_segments(part.column(len(keys))[k].as_py(), max_refs)):
                        of.append(k), rows.append((n, *segment))
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                at = pa.array(of, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in range(len(keys))), *(pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True))], [*keys, *kinds])

    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema.fields[:-1])
    return marked.mapInArrow(run, f"{given}, seg_no int, kind string, text string, form string, token string, name string, mime string")


def stripped(text: str | None, max_refs: int = MAX_REFS) -> str:
    """A text without its references, as a question: one beyond the limit, or an envelope, becomes a label."""
    text = text or ""
    for _ in range(max_refs):
        ref = first_reference(text)
        if ref is None:
            break
        text = text[: ref[0]] + text[ref[1] :]
    if ref := first_reference(text):
        label, start, end = UPLOADED.format(ref[4]) if ref[4] else "", ref[0], ref[1]
    elif m := _ENVELOPE.search(text):
        label, start, end = UPLOADED.format(percent_decoded(m[1])), m.start(), m.end()
    else:
        return text
    return "\n".join(x for x in (text[:start].strip(_SPACE), label, text[end:].strip(_SPACE)) if x)


@F.pandas_udf(T.StringType())
def _stripped(text: pd.Series) -> pd.Series:
    return text.map(stripped)


def strip_references(text: Column) -> Column:
    marked = F.contains(text, F.lit(START)) | F.contains(text, F.lit("📎")) | F.upper(text).contains("[[SFV_DOCUMENT_V1")
    return F.when(marked, _stripped(text)).otherwise(text)


def message_query(blocks: DataFrame) -> DataFrame:
    """``conv_id, turn, query`` of message blocks ``(conv_id, turn, path, type, text)``: top-level texts without references, joined by lines."""
    texts = blocks.where((F.size("path") <= 1) & F.col("type").isin("text", "string")).select("conv_id", "turn", "path", strip_references(F.coalesce("text", F.lit(""))).alias("text")).where("text <> ''")
    joined = texts.groupBy("conv_id", "turn").agg(F.array_join(F.array_sort(F.collect_list(F.struct("path", "text")))["text"], "\n").alias("query"))
    return blocks.select("conv_id", "turn").distinct().join(joined, ["conv_id", "turn"], "left").select("conv_id", "turn", js_trim(F.coalesce("query", F.lit(""))).alias("query"))


def has_envelope(text: Column) -> Column:
    return F.upper(text).contains("[[SFV_DOCUMENT_V1")


def base64_bytes(code: Column, empty: bool = False) -> Column:
    """What Base64 without white space stands for, padded or not; null where it is malformed, or empty unless ``empty`` holds. Only a text of odd length is padded anew."""

    def padded(code: Column) -> Column:
        whole = F.rtrim(code, F.lit("="))
        return F.when(F.length(code) % 4 == 0, code).otherwise(F.rpad(whole, (F.ceil(F.length(whole) / 4) * 4).cast("int"), "="))

    good = lambda code: (code != "") & (F.length(code) % 4 != 1) & code.rlike("^[A-Za-z0-9+/]*={0,2}$")
    decoded = lambda c: F.when(good(c), F.try_to_binary(padded(c), F.lit("base64")))
    return let(code, lambda c: F.when(c == "", F.lit(b"")).otherwise(decoded(c)) if empty else decoded(c))


def parse_document_envelopes(df: DataFrame, col: str, empty: bool = False) -> DataFrame:
    """``name, mime, content, before, after, stripped`` of the first document inside a text; null columns where there is none, or for a part that is malformed.

    A payload of no characters is malformed, or a document without bytes where ``empty`` holds.
    The first head that an end follows is the first head, so a text is cut there and behind it, once each.
    """
    text = F.coalesce(F.col(col), F.lit(""))
    # Column by column, so that each is worked out once however many others are made of it.
    cut = df.withColumn("_at_head", F.when(has_envelope(text), F.split(text, ENVELOPE_HEAD, 2)))
    cut = cut.withColumn("_at_end", F.when(F.size("_at_head") == 2, F.split(F.get("_at_head", F.lit(1)), ENVELOPE_END, 2)))
    found = F.coalesce(F.size("_at_end") == 2, F.lit(False))
    head = lambda k: F.when(found, F.regexp_extract(text, ENVELOPE_HEAD, k))
    cut = cut.withColumns({"_name": head(1), "_mime": head(2), "_before": F.when(found, F.get("_at_head", F.lit(0))), "_code": F.when(found, F.get("_at_end", F.lit(0))), "_after": F.when(found, F.get("_at_end", F.lit(1)))})
    decoded = lambda c: F.try_url_decode(F.replace(F.col(c), F.lit("+"), F.lit("%2B")))
    label = F.concat(F.lit("[已上传文档:"), F.coalesce(decoded("_name"), "_name"), F.lit("]"))
    parts = F.array_join(F.filter(F.array(js_trim(F.col("_before")), label, js_trim(F.col("_after"))), lambda x: x != ""), "\n")
    told = {"name": decoded("_name"), "mime": decoded("_mime"), "content": base64_bytes(F.regexp_replace("_code", r"\s+", ""), empty), "before": F.col("_before"), "after": F.col("_after"), "stripped": F.when(F.col("_before").isNotNull(), parts).otherwise(text)}
    return cut.withColumns(told).drop("_at_head", "_at_end", "_name", "_mime", "_before", "_code", "_after")


def envelope_failure(error: Column | None = None, name: Column | None = None) -> Column:
    """What is wrong with a parsed envelope, or, of a document ``name``, what its ``error`` says; null if nothing is."""
    if error is None:
        size = F.octet_length("content")
        return F.when(F.col("name").isNull() | F.col("mime").isNull(), BAD_URI).when(F.col("content").isNull(), BAD_BASE64).when(size > MAX_DOCUMENT_BYTES, TOO_LARGE).when(document_type(F.col("name"), F.col("mime")).isNull(), UNSUPPORTED)
    main = F.when(F.lower(name).endswith(".xmind"), NO_XMIND_MAIN).otherwise(NO_DOCX_MAIN)
    return F.when(error == "missing_main_part", main).when(error == "too_large", TOO_LARGE).when(error == "unsupported", UNSUPPORTED).when(error.startswith("bad_container"), BAD_ZIP).otherwise(error)


def resolve_by_token(refs: DataFrame, store: DataFrame) -> DataFrame:
    """References with a token and the stored ``doc_id``, null where the token is unknown."""
    return refs.where("token is not null").join(store.select("token", "doc_id"), "token", "left")


def resolve_by_name(refs: DataFrame, store: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """References by name ``(name, msg_ts, ...)`` and the ``doc_id`` of the latest document of that name that was stored by then
    and is still alive. As-of by a union and a running last value over ranges of name and time, so a name may hold any share of the rows."""
    wanted = refs.where("token is null").withColumn("_name", js_trim(F.col("name")))
    columns = wanted.columns
    kept = store.select(F.col("name").alias("_name"), F.col("created_at").alias("msg_ts"), F.struct("created_at", "last_used_at", "doc_id").alias("_stored"))
    both = wanted.withColumn("_stored", F.lit(None).cast(kept.schema["_stored"].dataType)).withColumn("_is_ref", F.lit(1)).unionByName(kept.withColumn("_is_ref", F.lit(0)), allowMissingColumns=True).withColumn("_doc", F.col("_stored.doc_id"))
    order = ("msg_ts", "_is_ref", "_doc")
    dealt = with_carried(ranged(both, "_name", *order), "_name", {"_latest": F.max_by("_stored", F.when(F.col("_is_ref") == 0, F.struct("msg_ts", "_doc")))}, {"_before": F.last("_latest", ignorenulls=True).over(ranges_before("_name"))})
    last = dealt.withColumn("_last", F.coalesce(F.last("_stored", ignorenulls=True).over(within("_name", *order)), "_before")).where("_is_ref = 1")
    used = F.greatest(F.col("_last.created_at"), F.least(F.coalesce("_last.last_used_at", "_last.created_at"), F.col("msg_ts")))
    alive = (F.unix_millis("msg_ts") - F.unix_millis(used)) <= ttl_ms
    return last.select(*(c for c in columns if c != "_name"), F.when(alive & (F.col("_name") != ""), F.col("_last.doc_id")).alias("doc_id"))


def retain_references(store: DataFrame, now: Column, owner: str, ttl_ms: int = TTL_MS, max_items: int = MAX_ITEMS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """What each ``owner`` keeps: nothing idle for longer than ``ttl_ms``, then the longest run of newest items within both caps.
    Items are summed over ranges of owner and time, so an owner may hold any share of the rows."""
    idle = F.unix_millis(now) - F.unix_millis(F.coalesce("last_used_at", "created_at"))
    later = ranges_before(owner, descending=True)
    sums = {"_range_items": F.count(F.lit(1)), "_range_bytes": F.sum("n_bytes")}
    dealt = with_carried(ranged(store.where(idle <= ttl_ms), owner, "created_at", "token"), owner, sums, {f"_later_{c}": F.coalesce(F.sum(f"_range_{c}").over(later), F.lit(0)) for c in ("items", "bytes")})
    newest = within(owner, F.desc("created_at"), F.desc("token"))
    counted = dealt.withColumns({"_items": F.col("_later_items") + F.count(F.lit(1)).over(newest), "_bytes": F.col("_later_bytes") + F.coalesce(F.sum("n_bytes").over(newest), F.lit(0))})
    return counted.where((F.col("_items") <= max_items) & (F.col("_bytes") <= max_bytes)).select(*store.columns)


def reference_liveness(uses: DataFrame, ttl_ms: int = TTL_MS) -> DataFrame:
    """``token, ts, alive`` of uses, the first of a token being its creation: alive while no gap so far exceeds ``ttl_ms``.
    Gaps are looked for within ranges of token and time and between them, so a token may have any number of uses."""
    dealt = ranged(uses, "token", "ts")
    gap = F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(Window.partitionBy("token", RANGE).orderBy("ts")))
    dealt = dealt.withColumn("_late", F.coalesce(gap > ttl_ms, F.lit(False)))
    each = Window.partitionBy("token").orderBy(RANGE)
    between = F.coalesce(F.unix_millis("_first") - F.unix_millis(F.lag("_last").over(each)) > ttl_ms, F.lit(False))
    summary = {"_first": F.min("ts"), "_last": F.max("ts"), "_any": F.max("_late")}
    ranges = dealt.groupBy("token", RANGE).agg(*(v.alias(k) for k, v in summary.items())).withColumn("_between", between)
    before = F.coalesce(F.max(F.col("_any") | F.col("_between")).over(ranges_before("token")), F.lit(False)) | F.col("_between")
    carried = ranges.select(F.col("token").alias("_key"), F.col(RANGE).alias("_no"), before.alias("_before"))
    joined = dealt.join(carried, dealt["token"].eqNullSafe(carried["_key"]) & (dealt[RANGE] == carried["_no"]), "left")
    return joined.select(*uses.columns, (~(F.col("_before") | F.max("_late").over(within("token", "ts")))).alias("alive"))


def attachment_extension(name: Column, mime: Column) -> Column:
    ext = F.regexp_extract(name, r"\.([^.]+)$", 1)
    return F.when(ext != "", F.upper(ext)).when(mime == "application/pdf", "PDF").when(mime == "text/markdown", "MD").otherwise("FILE")


def attachment_cards(events: DataFrame) -> DataFrame:
    """Cards of user messages that carry a document: ``session_id, id, name, mime, ext, anchor_seq``.
    Array functions alone, so it runs on a stream too."""
    decoded = F.transform(F.filter("content", lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: decode_reference_marker(b["text"]))
    ref = F.get(F.filter(decoded, lambda r: r.isNotNull()), F.lit(0))
    found = events.where((F.col("event_type") == "user/message") & (F.col("source_kind") == "user")).withColumn("_ref", ref).where("_ref is not null")
    name = F.when(F.col("_ref.name") != "", F.col("_ref.name")).otherwise(SENT)
    return found.select("session_id", "id", name.alias("name"), F.col("_ref.mime").alias("mime"), attachment_extension(name, F.col("_ref.mime")).alias("ext"), (F.col("seq") - 0.01).alias("anchor_seq"))


def last_user_has_image(nodes: DataFrame) -> DataFrame:
    """``session_id, has_image`` of each session's latest user message."""
    return nodes.where("kind = 'user'").groupBy("session_id").agg(F.max_by("has_image", "seq").alias("has_image"))
