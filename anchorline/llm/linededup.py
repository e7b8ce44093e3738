"""Line dedup by a log-template tree.

Lines are routed down a fixed-depth tree: token count, then leading tokens, where a token
with a digit is a variable field. In a leaf, lines of enough equal tokens share a
template, whose differing positions become variable fields too. A template that recurs
across documents stays where it comes first and is dropped everywhere else. So is a
passage that recurs word by word inside of lines or over several: see :mod:`passages`.

One scan counts leaves and marks, a second one lets out the lines and windows of those that
are in two texts, a third one drops what recurs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import passages
from .common import hot_join, let_through, materialize, sieve, slices, with_hits
from .wordhash import Words, mixed, parts, runs, summed

#: Leading tokens of the tree, equal tokens of a template, templates of a leaf from which on blocks of tokens pick those to compare with.
DEPTH, SIMILAR, LEAF_LINES = 3, 0.8, 10_000
#: A template recurs in LEAST_TEXTS different texts; in two, if it is longer than LONG tokens; in SHORT_TEXTS, if all its lines are short: of fewer tokens than LEAST_TOKENS and fewer characters than SHORT_CHARS.
LEAST_TOKENS, LEAST_TEXTS, LONG = 4, 3, 50
SHORT_CHARS, SHORT_TEXTS = 20, 10

#: Fixed value: what stands for the hash of a variable field.
VARIABLE = np.uint64(0x2A)

_ROW = ("doc_id", "text_key")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("text_key"), "text")


class Lines:
    """All lines with a token: number of the text, number of the line in it, token count (below zero for a short line), tree leaf, and key of the line with variable fields masked.

    A token with a digit is a variable field. A line of few tokens that are all variable fields is keyed as it is:
    without that all numbers would be one template. In texts with letters of scripts without spaces, which are
    tokens of their own, a line is short by its characters alone.
    """

    def __init__(self, words: Words, depth: int = DEPTH, least_tokens: int = LEAST_TOKENS):
        data, start, end = words.data, words.start, words.end
        before = np.cumsum(np.bincount(np.searchsorted(start, np.flatnonzero(data == 10)), minlength=len(start) + 1))[:-1]
        new = np.flatnonzero(np.append(True, (before[1:] != before[:-1]) | (words.text[1:] != words.text[:-1]))) if len(start) else start
        self.first, self.n = new, np.diff(np.append(new, len(start)))
        self.text = words.text[new]
        head = np.searchsorted(np.flatnonzero(data == 10), words.at[:-1])
        self.number = before[new] - head[self.text]
        variable = np.zeros(len(start), bool)
        variable[np.searchsorted(start, np.flatnonzero((data >= 48) & (data < 58)), side="right") - 1] = True
        self.tokens = np.where(variable, VARIABLE, words.hashes)
        last = self.first + self.n
        sums = summed(self.tokens)
        key = runs(sums, self.first, last)
        fields = np.append(0, np.cumsum(variable))
        bare = (self.n < least_tokens) & (fields[last] - fields[self.first] == self.n)
        if bare.any():
            words_sums, some = summed(words.hashes), parts(self.first[bare], self.n[bare])
            key[bare] = runs(words_sums, self.first[bare], last[bare])
            self.tokens[some] = words.hashes[some]
            sums = summed(self.tokens)
        self.key = mixed(key + self.n.astype(np.uint64))
        self.leaf = mixed(runs(sums, self.first, np.minimum(last, self.first + depth)) + self.n.astype(np.uint64))
        inside = np.flatnonzero((data & 0xC0) == 0x80)
        ends = end[last - 1] if len(last) else last
        chars = ends - start[new] - (np.searchsorted(inside, ends) - np.searchsorted(inside, start[new]))
        short = (chars < SHORT_CHARS) & ((self.n < least_tokens) | np.isin(self.text, words.changed))
        self.size = np.where(short, -self.n, self.n)


def seen_twice(rows: DataFrame, depth: int, least_tokens: int) -> DataFrame:
    """``key``: tree leaves of lines and marks of windows that are in two texts of ``rows(doc_id, text_key, text)``."""

    def run(batches):
        for part in slices(batches):
            words = Words(part.column(1))
            lines, (text, mark) = Lines(words, depth, least_tokens), passages.Windows(words).distinct()
            of = pa.array(np.concatenate([lines.text, text]))
            yield pa.RecordBatch.from_arrays([part.column(0).take(of), pa.array(np.concatenate([lines.leaf, mark]).view(np.int64))], ["text_key", "key"])

    keys = rows.select("text_key", "text").mapInArrow(run, "text_key long, key long")
    return keys.groupBy("key").agg(F.min("text_key").alias("a"), F.max("text_key").alias("b")).where("a <> b").select("key")


def candidates(docs: DataFrame, depth: int = DEPTH, least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """Lines and windows whose leaf or mark may be in two texts; only they leave their tasks.

    ``doc_id, text_key, start, n, key, whole, parts, line``: of a line its number, token count, leaf, key, and (once in a batch)
    hashed tokens; of neighbouring windows of one mark the first word, their number, the mark, one hash of all and of each.
    """
    rows = keyed(docs)
    bits = docs.sparkSession.sparkContext.broadcast(sieve(seen_twice(rows, depth, least_tokens), "key"))

    def run(batches):
        for part in slices(batches):
            words = Words(part.column(2))
            lines = Lines(words, depth, least_tokens)
            on = np.flatnonzero(let_through(bits.value, lines.leaf))
            length = np.zeros(len(on), np.int64)
            once = np.unique(lines.key[on], return_index=True)[1]
            length[once] = lines.n[on][once]
            tokens = lines.tokens[parts(lines.first[on], length)]
            text, start, n, mark, whole, begin, windows = passages.Windows(words).rows(bits.value)
            offsets = np.concatenate([np.cumsum(length) - length, begin + len(tokens), [len(tokens) + len(windows)]])
            of = pa.array(np.concatenate([lines.text[on], text]))
            columns = [np.concatenate([lines.number[on], start]), np.concatenate([lines.size[on], n])]
            hashes = [np.concatenate([lines.leaf[on], mark]), np.concatenate([lines.key[on], whole])]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([tokens, windows]).view(np.int64)))
            kind = pa.array(np.arange(len(of)) < len(on))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(of), part.column(1).take(of), *(pa.array(c, pa.int32()) for c in columns), *(pa.array(h.view(np.int64)) for h in hashes), lists, kind],
                ["doc_id", "text_key", "start", "n", "key", "whole", "parts", "line"],
            )

    found = rows.mapInArrow(run, "doc_id long, text_key long, start int, n int, key long, whole long, parts array<long>, line boolean")
    return materialize(found, "candidates", by="line")


def templates(rows: list[tuple[int, np.ndarray]], similar: float, depth: int = DEPTH, leaf_lines: int = LEAF_LINES) -> list[tuple[int, int]]:
    """``(line_key, template)`` for lines of one leaf, in key order; a template is named by its first line.

    A line joins the template with which it has most equal tokens, the first of equals, if they are at least
    ``similar`` of all; positions at which they differ become variable and count as unequal from then on.

    From ``leaf_lines`` templates on, a line is compared only with those that can take it: as at most ``spare``
    tokens may be unequal, one of ``spare + 1`` blocks behind the leading tokens is equal whole. The result is the same.
    """
    n = len(rows[0][1])
    spare = next(k for k in range(n, -1, -1) if k == 0 or n - k >= similar * n)
    cuts = np.linspace(min(depth, max(0, n - spare - 1)), n, spare + 2).astype(int).tolist()
    blocks = list(zip(cuts, cuts[1:], strict=False))
    names: list[int] = []
    kept = np.empty((len(rows), n), np.int64)
    fixed = np.empty(kept.shape, bool)
    index: dict[tuple[int, bytes], list[int]] = {}
    out = []
    for key, tokens in rows:
        own = [(k, tokens[a:b].tobytes()) for k, (a, b) in enumerate(blocks)] if len(rows) > leaf_lines else []
        some = np.arange(len(names)) if len(names) < leaf_lines else np.array(sorted({t for x in own for t in index.get(x, ())}), np.int64)
        if len(some):
            equal = ((kept[some] == tokens) & fixed[some]).sum(axis=1)
            at = int(equal.argmax())
            best = int(some[at])
            if equal[at] >= similar * n:
                fixed[best] &= kept[best] == tokens
                out.append((key, names[best]))
                continue
        for x in own:
            index.setdefault(x, []).append(len(names))
        kept[len(names)], fixed[len(names)] = tokens, True
        names.append(key)
        out.append((key, key))
    return out


def generalised(leaves: DataFrame, similar: float, depth: int, leaf_lines: int) -> DataFrame:
    """``line_key, template`` of lines that share a template with another line of their leaf."""

    def run(batches):
        leaf, held = None, []

        def close():
            found = templates(held, similar, depth, leaf_lines) if len(held) > 1 else []
            shared = {t for k, t in found if k != t}
            return [x for x in found if x[1] in shared]

        for part in slices(batches, 4096):
            out = []
            for this, key, tokens in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if this != leaf or len(tokens) != len(held[0][1]):
                    out += close()
                    leaf, held = this, []
                held.append((key, np.array(tokens, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([t for _, t in out], pa.int64())], ["line_key", "template"])
        out = close()
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([t for _, t in out], pa.int64())], ["line_key", "template"])

    dealt = leaves.select("leaf", "line_key", "tokens").repartition("leaf").sortWithinPartitions("leaf", F.size("tokens"), "line_key")
    return dealt.mapInArrow(run, "line_key long, template long")


def repeated_lines(lines: DataFrame, depth: int = DEPTH, similar: float = SIMILAR, leaf_lines: int = LEAF_LINES, least_texts: int = LEAST_TEXTS, long: int = LONG) -> DataFrame:
    """``doc_id, text_key, pos``: lines (by number, from 0) that repeat a template from elsewhere.

    ``lines(doc_id, text_key, start, n, key, whole, parts)`` are all lines whose leaf may be in two texts, as files.
    """
    distinct = lines.where(F.size("parts") > 0).groupBy(F.col("whole").alias("line_key")).agg(F.first("key").alias("leaf"), F.first("parts").alias("tokens"))
    template = materialize(generalised(distinct, similar, depth, leaf_lines), "templates")
    rows = lines.select(*_ROW, F.col("start").alias("pos"), "n", F.col("whole").alias("line_key"))
    named = materialize(hot_join(rows, template, "line_key", "left").select(*_ROW, "pos", "n", F.coalesce("template", "line_key").alias("template")), "named-lines")
    # Copies of one text have the same lines, so the least of each column is the first place.
    texts = named.groupBy("template", "text_key").agg(F.min("doc_id").alias("doc_id"), F.min("pos").alias("pos"), F.max("n").alias("n"))
    recurring = texts.groupBy("template").agg(F.count(F.lit(1)).alias("texts"), F.min(F.struct("doc_id", "text_key", "pos")).alias("first"), F.max("n").alias("n"))
    enough = F.when(F.col("n") > long, 2).when(F.col("n") > 0, least_texts).otherwise(max(least_texts, SHORT_TEXTS))
    recurring = materialize(recurring.where(F.col("texts") >= enough).select("template", "first"), "recurring")
    at_first = F.struct("doc_id", "text_key", "pos").eqNullSafe(F.col("first"))
    return hot_join(named, recurring, "template").where(~at_first).select(*_ROW, "pos")


def recurring_lines(docs: DataFrame, depth: int = DEPTH, least_tokens: int = LEAST_TOKENS, **parameters) -> DataFrame:
    """``doc_id, text_key, positions``: lines of each row that repeat a template from elsewhere."""
    found = candidates(docs, depth, least_tokens).where("line")
    return repeated_lines(found, depth, **parameters).groupBy(*_ROW).agg(F.collect_set("pos").alias("positions"))


def without_recurring(docs: DataFrame, depth: int = DEPTH, least_tokens: int = LEAST_TOKENS, **parameters) -> DataFrame:
    """``docs`` with recurring lines and passages dropped from ``text``, and ``dropped_lines array<string>`` (lines, and pieces inside of lines) beside it.

    Null texts stay null. A text whose lines all go is empty. Rows that repeat another row whole are treated
    alike; texts that repeat another count once, so copies of one document do not make its lines recur.
    Other columns stay, whatever their names, but for one called ``dropped_lines``, which gives way; an empty
    table gives an empty one. Only rows with something to drop, and few others, are shuffled with their texts.
    """
    docs = docs.drop("dropped_lines")
    both = candidates(docs, depth, least_tokens)
    windows = both.where("not line").select(*_ROW, "start", "n", F.col("key").alias("mark"), F.col("whole").alias("run"), F.col("parts").alias("windows"))
    windows = passages.recurring_windows(windows).select(*_ROW, F.struct("start", "end").alias("pos"))
    lines = repeated_lines(both.where("line"), depth, **parameters).select(*_ROW, F.struct(F.col("pos").alias("start"), F.lit(-1).alias("end")).alias("pos"))  # -1: a line
    found = materialize(lines.unionByName(windows).groupBy(*_ROW).agg(F.collect_set("pos").alias("positions")), "dropped")
    named = [f"c{k}" for k in range(len(docs.columns))]
    at, text = docs.columns.index("text"), named[docs.columns.index("text")]
    doc_id = F.col(named[docs.columns.index("doc_id")]).cast("long")
    text_key = F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))
    row_key = F.xxhash64("doc_id", "text_key")
    rows = docs.toDF(*named).withColumn("doc_id", doc_id).withColumn("text_key", text_key).withColumn("row_key", row_key)
    rows = with_hits(rows, "row_key", found.select(row_key.alias("row_key")))
    # Their positions take far more room in memory than in files, by which Spark would choose to broadcast them.
    of = found.toDF("of", "of_key", "positions").hint("merge")
    some = rows.where("hit").join(of, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")), "left").select(*named, "positions")
    schema = docs.toDF(*named).schema.add("dropped_lines", ArrayType(StringType()))

    def run(batches):
        for part in slices(batches):
            texts, positions = part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist()
            gone: list[list[str]] = []
            for k, drop in enumerate(positions):
                gone.append([])
                if drop:
                    texts[k], gone[-1] = passages.without(texts[k], {x["start"] for x in drop if x["end"] < 0}, [(x["start"], x["end"]) for x in drop if x["end"] >= 0])
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(part.columns[:-1])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(gone, pa.list_(pa.string()))], [*named, "dropped_lines"])

    others = rows.where(~F.col("hit")).select(*named, F.array().cast("array<string>").alias("dropped_lines"))
    return some.mapInArrow(run, schema).unionByName(others).toDF(*docs.columns, "dropped_lines")


def query(docs: DataFrame) -> DataFrame:
    """Per document: ``doc_id``, the text that is left, and how many lines (or pieces of lines) and characters recur elsewhere."""
    slim = docs.select("doc_id", "text")
    return without_recurring(slim).select(
        "doc_id", "text", F.size("dropped_lines").cast("long").alias("n_dropped_lines"),
        F.aggregate("dropped_lines", F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("n_dropped_chars"),
    )
