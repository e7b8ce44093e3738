"""Quality rules: an isolation forest over rule statistics, its threshold calibrated from labelled rows."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices

#: Trees, rows of each tree, and the share of good labelled rows that the threshold may reject.
TREES, TREE_ROWS, GOOD_LOSS = 128, 256, 0.003
#: Steps of the score in which labelled rows are counted for the threshold, a power of 2.
STEPS = 1 << 16
#: The symbols of the rule, and white space of words.
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\v\f\r"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols_a_char", "chars_a_word", "capitals", "digits", "marks", "dup_lines", "repeats", "pipes", "distinct", "longest")


@functools.cache
def kinds() -> np.ndarray:
    """Byte classes as a 0/1 matrix: space, symbol, A-Z, digit, other ASCII mark, pipe."""
    out = np.zeros((256, 6))
    out[list(SPACES), 0] = 1
    out[list(SYMBOLS), 1] = 1
    out[65:91, 2] = 1
    out[48:58, 3] = 1
    out[[b for b in range(33, 127) if not chr(b).isalnum() and b not in SYMBOLS], 4] = 1
    out[124, 5] = 1
    return out


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside 5-word windows that occur at least twice; ``ids`` numbers the words."""
    n = len(ids)
    if n < 6 or distinct == n:
        return 0
    pairs, two = np.unique(ids[:-1] * distinct + ids[1:], return_inverse=True)
    if len(pairs) == n - 1:
        return 0
    fours, four = np.unique(two[:-2] * len(pairs) + two[2:], return_inverse=True)
    if len(fours) == n - 3:
        return 0
    _, five, times = np.unique(four[:-1] * distinct + ids[4:], return_inverse=True, return_counts=True)
    again = times[five] > 1
    inside = np.zeros(n, bool)
    for k in range(5):
        inside[k : n - 4 + k] |= again
    return int(inside.sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """``BASE`` counts and ``FEATURES`` of a whole text; a null text counts as empty."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    if not n:
        return [0, 0, 0, 0, 0], [0.0] * len(FEATURES)
    space, symbols, capitals, digits, marks, pipes = (np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ kinds()).tolist()
    lines = [x for x in data.split(b"\n") if x.strip()]
    number = dict.fromkeys(words)
    for k, w in enumerate(number):
        number[w] = k
    repeats = repeated_words(np.fromiter(map(number.__getitem__, words), np.int64, n), len(number))
    chars, dup = len(text) - int(space), len(lines) - len(set(lines))
    rates = [symbols / chars, chars / n, capitals / chars, digits / chars, marks / chars, dup / len(lines), repeats / n, pipes / n, len(number) / n**0.8, np.log1p(max(map(len, number)))]
    return [n, chars, int(symbols), dup, repeats], rates


def base_fails(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


@dataclass
class Forest:
    """Trees as arrays: split feature (-1 at a leaf), split value, left child, path length at a leaf. Above ``threshold`` is an anomaly."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    norm: float
    threshold: float = np.inf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in 0..1 from mean path lengths; 0 without trees."""
        if not len(self.feature) or not len(x):
            return np.zeros(len(x))
        trees = np.arange(len(self.feature))
        at = np.zeros((len(x), len(trees)), np.int32)
        for _ in range(int(np.ceil(np.log2(TREE_ROWS)))):
            f = self.feature[trees, at]
            right = np.take_along_axis(x, np.maximum(f, 0), 1) >= self.value[trees, at]
            at = np.where(f < 0, at, self.left[trees, at] + right)
        return 2.0 ** (-self.path[trees, at].mean(axis=1) / self.norm)


def mean_path(n: int) -> float:
    """Mean path length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def grow(x: np.ndarray, box: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 7) -> Forest:
    """An isolation forest of ``x``; without at least two rows it has no trees.

    Splits are drawn over the cell of a node inside ``box`` (lowest and highest value of each feature), not over the
    rows in it, so that values which no row of ``x`` has are cut off early. Trees have rows of their own where ``x`` has enough.
    """
    rng = np.random.default_rng(seed)
    dealt = rng.permutation(len(x)).reshape(trees, rows) if len(x) == trees * rows else None
    size, depth = min(rows, len(x)), int(np.ceil(np.log2(rows)))
    nodes = 2 ** (depth + 1)
    made = []
    for t in range(trees if size > 1 else 0):
        feature, value, left, path = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes, np.int32), np.zeros(nodes)
        todo, used = [(0, x[rng.choice(len(x), size, replace=False) if dealt is None else dealt[t]], box, 0)], 1
        while todo:
            node, part, cell, level = todo.pop()
            spread = np.flatnonzero(cell[1] > cell[0])
            if level == depth or len(part) < 2 or not len(spread):
                path[node] = level + mean_path(len(part))
                continue
            f = rng.choice(spread)
            feature[node], value[node], left[node] = f, rng.uniform(cell[0, f], cell[1, f]), used
            high, below, above = part[:, f] >= value[node], cell.copy(), cell.copy()
            below[1, f] = above[0, f] = value[node]
            todo += [(used, part[~high], below, level + 1), (used + 1, part[high], above, level + 1)]
            used += 2
        made.append((feature, value, left, path))
    stack = [np.array(a) for a in zip(*made, strict=True)] if made else [np.empty((0, nodes))] * 4
    return Forest(*stack, norm=mean_path(size) or 1.0)


def calibrate(steps: np.ndarray, good: np.ndarray, bad: np.ndarray, loss: float = GOOD_LOSS) -> float:
    """The lowest threshold above which lie at most ``loss`` of the good rows and more bad rows than good; infinite without bad rows.

    ``good`` and ``bad`` rows are counted by step, where step ``k`` has the scores above ``k / STEPS`` up to ``(k + 1) / STEPS``.
    """
    order = np.argsort(-steps, kind="stable")
    steps, lost, caught = steps[order], np.cumsum(good[order]), np.cumsum(bad[order])
    fine = (lost <= loss * max(1, good.sum())) & (caught > 2 * lost) if bad.sum() else np.zeros(0, bool)
    if not fine.any():
        return np.inf
    k = int(np.flatnonzero(fine)[-1])
    below = steps[k + 1] + 1 if k + 1 < len(steps) else 0
    return float((steps[k] + below) / 2 / STEPS)


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id, counts array<long>, features array<double>`` of each row of ``docs(doc_id, text)``."""

    def run(batches):
        for part in slices(batches, 1024):
            found = [statistics(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c for c, _ in found], pa.list_(pa.int64())), pa.array([r for _, r in found], pa.list_(pa.float64()))], ["doc_id", "counts", "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, counts array<long>, features array<double>")


def counted(rows: DataFrame, forest: Forest) -> DataFrame:
    """``step, good, bad``: how many rows of ``rows(features, quality)`` have a score in each step; at most ``STEPS`` rows."""

    def run(batches):
        for batch in batches:
            scores = forest.score(_matrix(batch.column(0), len(FEATURES)))
            yield pa.RecordBatch.from_arrays([pa.array(np.ceil(scores * STEPS).astype(np.int64) - 1), batch.column(1)], ["step", "quality"])

    good = F.col("quality") == 1
    return rows.select("features", "quality").mapInArrow(run, "step long, quality int").groupBy("step").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fit(measured: DataFrame, labels: DataFrame) -> Forest:
    """Forest and threshold from all labelled rows of ``measured``, as :func:`measure` gives them; labels are ``doc_id, quality`` (1 good).

    Of rows with one id the least statistics count. Rows that the base rules reject are left out. The box and the threshold are
    of all rows that remain; the trees draw their ``TREES * TREE_ROWS`` rows, which the method has each tree draw for itself,
    from all good ones. Without labelled bad rows nothing is an anomaly.
    """
    chosen = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    one = measured.join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.struct("counts", "features")).alias("least"), F.min("quality").alias("quality")).select("doc_id", "least.*", "quality")
    words, repeats = (F.get("counts", F.lit(BASE.index(name))) for name in ("n_words", "n_repeat_words"))
    rows = materialize(one.where(~((words < 10) | (100 * repeats > 20 * words))).select("doc_id", "features", "quality"), "labelled")
    of = [F.get("features", F.lit(k)) for k in range(len(FEATURES))]
    n, n_good, *ends = rows.agg(F.count(F.lit(1)), F.count_if(F.col("quality") == 1), *map(F.min, of), *map(F.max, of)).first()
    if not n:
        return grow(np.empty((0, len(FEATURES))), np.zeros((2, len(FEATURES))))
    # Few more than are wanted are left before they are put in order, so that no task hands on as many as all together.
    wanted, at = TREES * TREE_ROWS, F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))
    drawn = (rows.where("quality = 1") if n_good else rows).where(at < int(1.25 * wanted / (n_good or n) * (1 << 32)))
    drawn = drawn.orderBy(at, "doc_id").limit(wanted).select("features").collect()
    forest = grow(np.array([r[0] for r in drawn]), np.array(ends).reshape(2, -1), TREES, TREE_ROWS)
    forest.threshold = calibrate(*(np.array(c) for c in zip(*counted(rows, forest).collect(), strict=True)))
    return forest


def verdicts(measured: DataFrame, forest: Forest) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``anomaly`` (the score) and ``kept``, for each row of ``measured``, as :func:`measure` gives them.

    Null and empty texts have no words and fail the base rule; repeated rows are judged one by one; an empty table gives no rows.
    """

    def run(batches):
        for part in batches:
            counts = _matrix(part.column(1), len(BASE))
            failed, scores = base_fails(counts), forest.score(_matrix(part.column(2), len(FEATURES)))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(scores), pa.array(~failed & (scores <= forest.threshold))], ["doc_id", *BASE, "base_failed", "anomaly", "kept"])

    return measured.mapInArrow(run, "doc_id long, " + ", ".join(f"{b} long" for b in BASE) + ", base_failed boolean, anomaly double, kept boolean")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows and judge every document; each is measured once."""
    measured = materialize(measure(docs), "measured")
    return verdicts(measured, fit(measured, labels)).select("doc_id", *BASE, "base_failed", "kept", "anomaly")


def kept_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns, whatever their names.

    Null and empty texts go, as they fail the base rule; repeated rows stay or go together; an empty table gives an empty one.
    """
    forest = fit(materialize(measure(docs), "measured"), labels)

    def run(batches):
        at = None
        for part in slices(batches, 1024):
            at = part.schema.get_field_index("text") if at is None else at
            found = [statistics(t) for t in part.column(at).to_pylist()]
            counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(BASE))
            scores = forest.score(np.array([r for _, r in found]).reshape(-1, len(FEATURES)))
            yield part.filter(pa.array(~base_fails(counts) & (scores <= forest.threshold)))

    return docs.mapInArrow(run, docs.schema)
