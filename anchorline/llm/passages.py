"""Word passages that recur in another text, wherever lines begin and end.

A passage counts from WINDOW words on. Each window of so many words is marked by the least
hash of the GRAM-word runs in it, so equal windows have equal marks, and neighbouring ones
mostly share theirs. Only windows leave their task whose mark was seen in two texts,
neighbours of one mark as one row. Rows that are equal whole are told apart by one hash;
only the first of them, and only if its mark also stands in other rows, is compared window
by window. So no window that recurs word by word is missed, and near copies do not multiply
their windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join, let_through, materialize, sieve
from .wordhash import WORD, Words, parts, runs, summed

#: Words of the least passage that counts, and of the runs whose least hash marks it.
WINDOW, GRAM = 51, 16
#: Windows of one mark in a row, at most.
ROW_WINDOWS = 64


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :])


class Windows:
    """All windows that lie in one text each: number of the text, first word, and mark."""

    def __init__(self, words: Words, window: int = WINDOW, gram: int = GRAM):
        self.words, self.window = words, window
        self.sums = summed(words.hashes)
        each = np.maximum(0, words.counts - (window - 1))
        self.text, self.start = np.repeat(np.arange(len(each)), each), parts(words.first[:-1], each)
        self.mark = np.zeros(0, np.uint64)
        if len(self.start):
            places = np.arange(len(words.hashes) - gram + 1)
            self.mark = least(runs(self.sums, places, places + gram), window - gram + 1)[self.start]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Text and mark of windows whose neighbour before has another mark."""
        if not len(self.text):
            return self.text, self.mark
        new = np.append(True, (self.text[1:] != self.text[:-1]) | (self.mark[1:] != self.mark[:-1]))
        return self.text[new], self.mark[new]

    def rows(self, bitmap: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows of neighbouring windows of one mark that the bitmap lets through: text, first word in it, number, mark, hash of all, and where in the last array its windows begin."""
        on = let_through(bitmap, self.mark)
        text, start, mark = self.text[on], self.start[on], self.mark[on]
        begin = np.flatnonzero(np.append(True, (np.diff(start) > 1) | (text[1:] != text[:-1]) | (mark[1:] != mark[:-1]))) if len(text) else text
        length = np.diff(np.append(begin, len(text)))
        cut = -(-length // ROW_WINDOWS)
        nth = parts(np.zeros(len(cut), np.int64), cut)
        begin, length = np.repeat(begin, cut) + nth * ROW_WINDOWS, np.minimum(ROW_WINDOWS, np.repeat(length, cut) - nth * ROW_WINDOWS)
        whole = runs(self.sums, start[begin], start[begin] + length + (self.window - 1))
        return text[begin], start[begin] - self.words.first[text[begin]], length, mark[begin], whole, begin, runs(self.sums, start, start + self.window)


def recurring_windows(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, text_key, start, end``: runs of words (by number, from 0, without the end) that repeat windows from elsewhere.

    ``found(doc_id, text_key, start, n, mark, run, windows)`` are the rows of all windows whose mark may be in two texts, as files.
    A window recurs if it is in two different texts. Its first place is not among the runs, nor are places that overlap that.
    """
    context = found.sparkSession.sparkContext
    slim = found.drop("windows")
    place = F.struct("doc_id", "text_key", "start").alias("place")

    def firsts(of: DataFrame, by: str, recurs) -> DataFrame:
        return of.groupBy(by).agg(F.min(place).alias("first"), recurs.alias("recurs")).where("recurs").select(by, "first")

    def beside(words) -> Column:
        return F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")) & (F.col("start") < F.col("first.start") + words)

    two = F.min("text_key") != F.max("text_key")
    words = F.col("n") + (window - 1)
    told = hot_join(slim, firsts(slim, "run", two), "run", "left").select("doc_id", "text_key", "start", "n", "mark", (F.col("first").isNull() | beside(words)).alias("kept"), F.col("first").isNotNull().alias("shared"))
    told = materialize(told, "passages")
    several = slim.groupBy("mark").agg((F.min("run") != F.max("run")).alias("several")).where("several").select("mark")
    place_key = F.xxhash64("doc_id", "text_key", "start").alias("at")
    left = materialize(hot_join(told.where("kept").select("doc_id", "text_key", "start", "mark", "shared", place_key), several, "mark", "left_semi").drop("mark"), "compared")
    left_places = context.broadcast(sieve(left, "at"))

    def held(batches):
        for part in batches:
            yield part.filter(pa.array(let_through(left_places.value, part.column(0).to_numpy().view(np.uint64))))

    some = found.select(place_key, "doc_id", "text_key", "start", "windows").mapInArrow(held, "at long, doc_id long, text_key long, start int, windows array<long>")
    those = left.select(F.col("doc_id").alias("of"), "text_key", "start", "at", "shared").distinct()
    wide = some.join(those.hint("merge"), ["at", "text_key", "start"]).where(F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", "text_key", "start", "shared", "windows")
    wide = materialize(wide, "compared-windows")
    twice = wide.select("shared", F.explode("windows").alias("window")).groupBy("window").agg(((F.count(F.lit(1)) > 1) | F.max("shared")).alias("twice")).where("twice").select("window")
    window_bits = context.broadcast(sieve(twice, "window"))

    def single(batches):
        for part in batches:
            lists = part.column(4)
            windows = lists.flatten()
            length = pc.list_value_length(lists).to_numpy()
            row = np.repeat(np.arange(part.num_rows), length)
            start = part.column(2).to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            on = let_through(window_bits.value, windows.to_numpy().view(np.uint64))
            of = pa.array(row[on])
            yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(1).take(of), pa.array(start[on], pa.int32()), part.column(3).take(of), windows.filter(pa.array(on))], ["doc_id", "text_key", "start", "shared", "window"])

    ones = materialize(wide.mapInArrow(single, "doc_id long, text_key long, start int, shared boolean, window long"), "single-windows")
    again = hot_join(ones, firsts(ones, "window", two | F.max("shared")), "window").where(~beside(F.lit(window)))
    runs_gone = told.where(~F.col("kept")).select("doc_id", "text_key", "start", (F.col("start") + words).alias("end"))
    return runs_gone.unionByName(again.select("doc_id", "text_key", "start", (F.col("start") + window).alias("end")))


def without(text: str, lines: set[int], found: list[tuple[int, int]]) -> tuple[str, list[str]]:
    """The text without the given lines and runs of words, and what went: whole lines, and pieces inside of lines."""
    spans = [m.span() for m in WORD.finditer(text)] if found else []
    steps = np.zeros(len(spans) + 1, np.int32)
    if found:
        np.add.at(steps, [a for a, _ in found], 1)
        np.add.at(steps, [b for _, b in found], -1)
    gone = (np.cumsum(steps) > 0).tolist()
    kept, dropped, at, w = [], [], 0, 0
    for number, line in enumerate(text.split("\n")):
        end, first = at + len(line), w
        while w < len(spans) and spans[w][0] < end:
            w += 1
        if number in lines or first < w and all(gone[first:w]):
            dropped.append(line)
        elif first < w and any(gone[first:w]):
            left, k, held = at, first, ""
            while k < w:
                if gone[k]:
                    last = k
                    while last + 1 < w and gone[last + 1]:
                        last += 1
                    dropped.append(text[spans[k][0] : spans[last][1]])
                    held += text[left : spans[k][0]]
                    left = spans[last + 1][0] if last + 1 < w else end
                    k = last
                k += 1
            held += text[left:end]
            kept.append(held.rstrip() if gone[w - 1] else held)
        elif not (first == w and 0 < w < len(spans) and gone[w - 1] and gone[w]):
            kept.append(line)
        at = end + 1
    return "\n".join(kept), dropped
