"""Messages put together again, with their references, envelopes and images replaced by text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import grounding_json
from ..functions.text import js_trim
from ..sources.scratch import written_once
from . import vision
from .blocks import contexts_of
from .references import EXPIRED, FAILED, envelope_failure, has_envelope, parse_document_envelopes

KEYS = ["conv_id", "turn", "path"]

#: Heads of the texts that stand for an image, by mode; texts for an image that could not be read.
IMAGE_HEADS = {"describe": "[图片内容分析]\n", "ground": "[图片空间定位]\n", "restore": "[该图片的 UI 还原 HTML 代码]\n"}
IMAGE_FAILED = "[图片识别失败,请如实说明原因,不要假装识别成功:{}]"
NO_ANSWER, EMPTY, TRUNCATED, INCOMPLETE = "视觉分析失败", "视觉 API 未返回结果", "视觉模型输出达到长度上限,结果被截断;请提高对应输出上限或缩短问题", "视觉模型未返回完整 HTML,结果不会写入缓存"

#: Behind all blocks of a tool result in the order of paths.
_BEHIND = 2**31 - 1


def around(form: str, message: Column) -> Column:
    before, after = form.split("{}")
    return F.concat(F.lit(before), message, F.lit(after))


def _flag(blocks: DataFrame, name: str = "expanded") -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in blocks.columns else F.lit(False)


def expand_blocks(blocks: DataFrame, segments: DataFrame, contexts: DataFrame) -> DataFrame:
    """Message blocks with ``text`` expanded and ``expanded``: segments in order, references as their context.

    ``segments`` are those of :func:`references.split_references` with the ``doc_id`` that references resolve to;
    ``contexts(doc_id, context)`` is joined once a document. If one reference of a block has none, the whole block
    says so. Blocks without references, and all other columns of blocks, stay as they are.
    """
    filled = segments.join(contexts, "doc_id", "left").withColumn("failed", (F.col("kind") == "ref") & F.col("context").isNull())
    value = F.when(F.col("kind") == "ref", F.col("context")).otherwise(F.col("text"))
    joined = filled.groupBy(*KEYS).agg(F.bool_or("failed").alias("failed"), F.array_join(F.array_sort(F.collect_list(F.struct("seg_no", value.alias("value"))))["value"], "\n\n").alias("joined"))
    text = F.when(F.col("failed"), FAILED.format(EXPIRED)).when(F.col("joined").isNotNull(), F.col("joined")).otherwise(F.col("text"))
    others = [c for c in blocks.columns if c not in (*KEYS, "type", "text", "expanded")]
    return blocks.join(joined, KEYS, "left").select(*KEYS, F.when(F.col("failed").isNotNull(), "text").otherwise(F.col("type")).alias("type"), text.alias("text"), *others, F.col("failed").isNotNull().alias("expanded"))


def expand_envelopes(blocks: DataFrame, contexts_of: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = contexts_of, empty: bool = False) -> DataFrame:
    """Message blocks with the first document that a text carries in an envelope replaced by its context, and ``expanded``.

    Texts that were expanded already, and blocks that are no texts, stay. Documents go through ``contexts_of(files)``,
    which gives ``contexts(doc_id, context)`` and ``errors(doc_id, error)``; a document that several messages carry goes
    through it once. Payloads are shuffled once, to find those; what comes back is joined by name, type and hash.
    An envelope that cannot be read makes the whole text say so; one without an end stays as it is. One without a
    payload cannot be read, or carries a document without bytes where ``empty`` holds.
    """
    expanded, blocks = _flag(blocks), written_once(blocks, "envelope-blocks")
    carrying = blocks.where(~expanded & F.col("type").isin("text", "string") & has_envelope(F.col("text"))).select(*KEYS, "text")
    parsed = parse_document_envelopes(carrying, "text", empty).withColumn("sha", F.sha2("content", 256))
    # Those without an end are left out of what is written, not before, where Spark would cut each text once more to know them.
    told = written_once(parsed.select(*KEYS, "name", "mime", "content", "sha", "before", "after", envelope_failure().alias("failure")), "envelopes").where("before is not null")
    named = ["name", "mime", "sha"]
    files = told.where("failure is null").select(*named, "content").dropDuplicates(named).withColumn("doc_id", F.monotonically_increasing_id())
    files = written_once(files, "envelope-documents").withColumn("length", F.octet_length("content").cast("long"))
    contexts, errors = contexts_of(files)
    known = files.select(*named, "doc_id").join(contexts, "doc_id", "left").join(errors.groupBy("doc_id").agg(F.min("error").alias("error")), "doc_id", "left").drop("doc_id")
    failure = F.coalesce("failure", envelope_failure(F.col("error"), F.col("name")))
    parts = F.filter(F.array(js_trim(F.col("before")), F.col("context"), js_trim(F.col("after"))), lambda x: x != "")
    replaced = told.drop("content").join(known, named, "left").select(*KEYS, F.when(failure.isNotNull(), around(FAILED, failure)).otherwise(F.array_join(parts, "\n\n")).alias("_new"))
    others = [c for c in blocks.columns if c not in (*KEYS, "type", "text", "expanded")]
    new = F.col("_new")
    return blocks.join(replaced, KEYS, "left").select(*KEYS, F.when(new.isNotNull(), "text").otherwise(F.col("type")).alias("type"), F.coalesce(new, "text").alias("text"), *others, (expanded | new.isNotNull()).alias("expanded"))


def image_requests(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """``conv_id, turn, path, attachment, query, mode_no, mode, timeout_ms, max_tokens``: what each image block asks for, by its message's ``queries(conv_id, turn, query)``."""
    images = blocks.where("type = 'image' and attachment is not null").select(*KEYS, "attachment")
    return vision.plan_requests(images.join(queries.select("conv_id", "turn", "query"), ["conv_id", "turn"], "left"))


def image_answers(requests: DataFrame, cache: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``requests(cache_key, request_id, mode, ...)`` with ``value`` and ``failure``: from the cache, else from the last outcome of the request.

    ``cache`` is that of :func:`vision.split_cached`, ``outcomes`` are those of :func:`vision.final_outcomes`. An answer that was cut
    short, that is empty, or that is a page without its end is a failure, and so is a request without an outcome.
    """
    known, asked = vision.split_cached(requests, cache)
    told = asked.join(outcomes.select("request_id", "outcome", "answer"), "request_id", "left")
    page = vision.html_of(F.col("answer"))
    value = F.when(F.col("mode") == "ground", grounding_json(F.col("answer"))).when(F.col("mode") == "restore", page).otherwise(F.col("answer"))
    failure = (
        F.when(F.col("outcome") == "truncated", TRUNCATED).when(F.col("outcome") == "empty", EMPTY).when(F.coalesce(F.col("outcome") != "ok", F.lit(True)), NO_ANSWER)
        .when((F.col("mode") == "restore") & ~vision.is_whole_page(page), INCOMPLETE).when(value.isNull(), NO_ANSWER)
    )
    columns = requests.columns
    return known.select(*columns, F.col("cached_value").alias("value"), F.lit(None).cast("string").alias("failure")).unionByName(told.select(*columns, value.alias("value"), failure.alias("failure")))


def expand_images(blocks: DataFrame, answered: DataFrame) -> DataFrame:
    """Message blocks with each image as one to three texts, in order of ``piece_no`` at its path, and ``expanded``.

    ``answered`` are rows of :func:`image_requests` with ``value`` and ``failure``. If one mode of an image failed, the image
    is one text that says so, with the reason of the first such mode. Images that nobody asked about stay.
    """
    head = F.coalesce(*(F.when(F.col("mode") == m, h) for m, h in IMAGE_HEADS.items()))
    pieces = F.array_sort(F.collect_list(F.struct("mode_no", F.concat(head, F.col("value")).alias("value"), "failure")))
    told = answered.groupBy(*KEYS).agg(pieces.alias("_pieces"))
    failed = F.get(F.filter(F.col("_pieces"), lambda p: p["failure"].isNotNull()), F.lit(0))["failure"]
    texts = F.when(failed.isNotNull(), F.array(around(IMAGE_FAILED, failed))).otherwise(F.col("_pieces")["value"])
    expanded = _flag(blocks)
    others = [c for c in blocks.columns if c not in (*KEYS, "type", "text", "expanded", "piece_no")]
    joined = blocks.join(told.select(*KEYS, texts.alias("_texts")), KEYS, "left").select(*KEYS, "type", "text", *others, expanded.alias("_was"), F.posexplode_outer("_texts").alias("_no", "_new"))
    new = F.col("_new")
    return joined.select(*KEYS, F.when(new.isNotNull(), "text").otherwise(F.col("type")).alias("type"), F.coalesce(new, "text").alias("text"), *others, (F.col("_was") | new.isNotNull()).alias("expanded"), F.coalesce("_no", F.lit(0)).alias("piece_no"))


def renumbered(blocks: DataFrame) -> DataFrame:
    """Blocks whose paths count what :func:`expand_images` put in place of images. A message is read in order, and only the numbers along one path are held."""
    at = {c: k for k, c in enumerate(blocks.columns)}
    dealt = blocks.repartition("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "path", "piece_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        message, above, counts = None, [], []
        for batch in batches:
            out = []
            for conv_id, turn, path in zip(*(batch.column(at[c]).to_pylist() for c in KEYS), strict=True):
                if (conv_id, turn) != message:
                    message, above, counts = (conv_id, turn), [], []
                if path:
                    depth = len(path)
                    counts = [*counts[:depth], *[-1] * (depth - len(counts))]
                    counts[-1] += 1
                    above = [*above[: depth - 1], counts[-1]]
                out.append(list(above) if path else [])
            columns = [*batch.columns]
            columns[at["path"]] = pa.array(out, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, list(at))

    return dealt.mapInArrow(run, blocks.schema).withColumn("piece_no", F.lit(0))


def rebuild_messages(blocks: DataFrame) -> DataFrame:
    """``conv_id, turn, content``: nested content as JSON; a message of one plain string stays one, and so does content that is no array.

    Blocks that were not expanded stay as they were written, as :func:`read_messages` gives them in ``block`` and ``tail``; an
    expanded one is a text block.
    """
    have = set(blocks.columns)
    new, changed = F.to_json(F.struct(F.lit("text").alias("type"), "text")), _flag(blocks)
    given = F.when(F.col("type") == "other", F.col("block")).otherwise(F.coalesce("block", F.to_json(F.struct("type", "text")))) if "block" in have else F.to_json(F.struct("type", "text"))
    top = F.size("path") == 0
    whole = F.when(top, F.when(changed, F.concat(F.lit("["), new, F.lit("]"))).when(F.col("type") == "string", F.col("text")).otherwise(given))
    piece_no = F.col("piece_no") if "piece_no" in have else F.lit(0)
    follows = (F.element_at("path", -1) > 0) | (piece_no > 0)
    item = F.struct("path", piece_no.alias("piece_no"), F.concat(F.when(follows, ",").otherwise(""), F.when(changed, new).otherwise(given)).alias("json"))
    # Two lists of one pass, as a union of blocks and tails would work the blocks out twice.
    items = F.collect_list(F.when(~top, item))
    if "tail" in have:
        behind = F.struct(F.concat("path", F.array(F.lit(_BEHIND))).alias("path"), F.lit(0).alias("piece_no"), F.col("tail").alias("json"))
        items = F.concat(items, F.collect_list(F.when(F.col("tail").isNotNull(), behind)))
    told = blocks.groupBy("conv_id", "turn").agg(F.bool_or(top).alias("top"), F.first(whole, ignorenulls=True).alias("whole"), F.array_join(F.array_sort(items)["json"], "").alias("items"))
    return told.select("conv_id", "turn", F.when(F.col("top"), F.col("whole")).otherwise(F.concat(F.lit("["), F.col("items"), F.lit("]"))).alias("content"))


def expand_messages(blocks: DataFrame, segments: DataFrame, contexts: DataFrame) -> DataFrame:
    """:func:`expand_blocks`, then :func:`rebuild_messages`."""
    return rebuild_messages(expand_blocks(blocks, segments, contexts))
