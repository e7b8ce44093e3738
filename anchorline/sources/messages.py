"""Messages of mixed shape, one row a block."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of JSON: a string, a number, a word, a mark.
_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)|([\[\]{}:,]))', re.ASCII)
_SPACE = re.compile(r"[ \t\n\r]*")

#: Rows handed on at a time.
_ROWS = 4096

_COLUMNS = "path array<int>, type string, text string, attachment string, block string, tail string, opened boolean"


class _Open:
    """An array or object that is being read. ``blocks``: an array of blocks, or a block; of others only the end is sought."""

    __slots__ = ("blocks", "fields", "inner", "is_array", "items", "key", "start")

    def __init__(self, start: int, is_array: bool, blocks: bool):
        self.start, self.is_array, self.blocks = start, is_array, blocks
        self.key, self.fields, self.inner, self.items = None, {}, None, []


def _unquoted(token: str) -> str:
    """What a JSON string stands for; halves of pairs that stand alone are replaced."""
    text = json.loads(token)
    return text if text.isascii() else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _read(text: str) -> list | None:
    """The blocks of a JSON array as a tree of ``[start, end, fields, inner]``; null if it is no JSON or no array.

    ``fields``: where the last value of each key lies, null for what is no object; ``inner``: start, end and blocks of
    the last ``content`` that is an array. One pass over the tokens; nothing nests in Python's own stack.
    """
    stack, at, expected, whole = [], 0, "value", None
    while True:
        found = _TOKEN.match(text, at)
        if found is None:
            return None
        start, at = found.start(found.lastindex), found.end()
        mark = found[3]
        inside = stack[-1] if stack else None
        if mark == "[" or mark == "{":
            if expected not in ("value", "first"):
                return None
            if inside is None:
                as_blocks = mark == "["
            elif mark == "[":
                as_blocks = inside.blocks and not inside.is_array and inside.key == "content"
            else:
                as_blocks = inside.blocks and inside.is_array
            stack.append(_Open(start, mark == "[", as_blocks))
            expected = "first" if mark == "[" else "first key"
            continue
        if mark == ":":
            if expected != "colon":
                return None
            expected = "value"
            continue
        if mark == ",":
            if expected != "after":
                return None
            expected = "value" if inside.is_array else "key"
            continue
        if mark is None and expected in ("key", "first key"):
            if found[1] is None:
                return None
            inside.key = _unquoted(found[1]) if inside.blocks else None
            expected = "colon"
            continue
        if mark is None:
            if expected not in ("value", "first"):
                return None
            closed = None
        else:
            if inside is None or (mark == "]") != inside.is_array or expected not in ("after", "first" if inside.is_array else "first key"):
                return None
            closed = stack.pop()
            start, inside = closed.start, stack[-1] if stack else None
        if inside is None:
            whole = closed
            break
        if inside.blocks:
            if inside.is_array:
                inside.items.append([start, at, closed.fields if closed is not None and not closed.is_array else None, closed.inner if closed is not None and not closed.is_array else None])
            else:
                inside.fields[inside.key] = (start, at)
                if inside.key == "content":
                    inside.inner = (start, at, closed.items) if closed is not None and closed.is_array else None
        expected = "after"
    if whole is None or not whole.is_array or _SPACE.fullmatch(text, at) is None:
        return None
    return whole.items


def _string(text: str, span: tuple[int, int] | None) -> str | None:
    return _unquoted(text[span[0] : span[1]]) if span and text[span[0]] == '"' else None


def _blocks(text: str | None) -> Iterator[tuple]:
    """Path, type, text, attachment, block, tail, opened of each block of a JSON array, in order."""
    items = None if text is None else _read(text)
    if items is None:
        yield [], "other", None, None, text, None, False
        return
    if not items:
        yield [], "array", None, None, text, None, False
    waiting = [(items, 0, [])]
    while waiting:
        items, k, above = waiting.pop()
        if k == len(items):
            continue
        waiting.append((items, k + 1, above))
        (start, end, fields, inner), path = items[k], [*above, k]
        if fields is None:
            own = _string(text, (start, end))
            yield path, "unknown" if own is None else "string", own, None, text[start:end], None, False
            continue
        kind, attachment = _string(text, fields.get("type")) or "unknown", fields.get("attachment")
        attachment = text[attachment[0] : attachment[1]] if attachment and text[attachment[0] : attachment[1]] != "null" else None
        if kind == "tool-result" and inner is not None:
            yield path, kind, _string(text, fields.get("text")), attachment, text[start : inner[0] + 1], text[inner[1] - 1 : end], True
            waiting.append((inner[2], 0, path))
        else:
            yield path, kind, _string(text, fields.get("text")), attachment, text[start:end], None, False


def read_messages(df: DataFrame) -> DataFrame:
    """``conv_id, turn, path, type, text, attachment, block, tail, opened`` of ``df(conv_id, turn, content, is_array)``.

    A string is one block at the empty path; an array gives a row for each block, strings included; blocks inside
    a tool result follow under its path, however deep. ``block`` is the block's JSON as it was written; of an ``opened``
    tool result ``block`` is what stands before its blocks and ``tail`` what stands behind them. Of repeated keys the last counts.
    An array without blocks is one row of type ``array`` at the empty path; content that should be an array and is not
    (null too) is one of type ``other``. So every message has a row, and all of its content is in its rows.
    Each content is read once, where it lies.
    """
    start = F.array().cast("array<int>").alias("path")
    nothing = F.lit(None).cast("string")
    plain = df.where("not is_array").select("conv_id", "turn", start, F.lit("string").alias("type"), F.col("content").alias("text"), nothing.alias("attachment"), nothing.alias("block"), nothing.alias("tail"), F.lit(False).alias("opened"))
    arrays = df.where("is_array").select("conv_id", "turn", "content")
    kinds = [pa.list_(pa.int32()), *[pa.string()] * 5, pa.bool_()]
    names = ["path", "type", "text", "attachment", "block", "tail", "opened"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, rows = [], []

            def told(of=of, rows=rows, batch=batch):
                at = pa.array(of, pa.int64())
                columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", "turn", *names])

            for k in range(batch.num_rows):
                for row in _blocks(batch.column(2)[k].as_py()):
                    of.append(k)
                    rows.append(row)
                    if len(rows) == _ROWS:
                        yield told()
                        of.clear(), rows.clear()
            yield told()

    keys = ", ".join(f"{c} {arrays.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn"))
    return plain.unionByName(arrays.mapInArrow(run, f"{keys}, {_COLUMNS}"))
