"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover all learning rows. The weights are learned by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of each
language, and a temperature is fitted on sampled rows that the weights have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, slices

#: Hashed n-grams, longest n-gram, and code points counted at a time.
BUCKETS, LONGEST, BLOCK = 1 << 14, 3, 1 << 16
#: Learning rows of each language at most, and over all languages about; one in CALIBRATION_PART sets the temperature.
LANGUAGE_ROWS, SAMPLE_ROWS, CALIBRATION_PART = 1024, 4096, 5
#: Of FTRL: learning rate, its smoothing, L1 and L2 penalties, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 2e-3, 1e-3, 3
#: Documents whose id's crc32 has this remainder are never learned from.
FOLDS, HELD_OUT = 5, 0

UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def counts(text: str) -> np.ndarray:
    """How often each bucket occurs among the 1- to 3-grams of the lower-cased text, padded with a space; in blocks of any number."""
    out = np.zeros(BUCKETS, np.int64)
    text = f" {text.lower()} "
    for at in range(0, len(text), BLOCK):
        points = np.frombuffer(text[at : at + BLOCK + LONGEST - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        grams = np.zeros(len(points), np.uint32)
        for n in range(LONGEST):
            grams = (grams[: len(points) - n] ^ points[n:]) * np.uint32(0x9E3779B1)
            own = grams[: min(BLOCK, len(text) - at) - n] if at + BLOCK >= len(text) else grams[:BLOCK]
            out += np.bincount((own ^ own >> np.uint32(15)) % np.uint32(BUCKETS), minlength=BUCKETS)
    return out


def vector(counted: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets present and their TF-IDF weights, of length one."""
    at = np.flatnonzero(counted)
    x = np.log1p(counted[at]) * idf[at]
    return at, x / (np.sqrt(x @ x) or 1.0)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray = field(default_factory=lambda: np.ones(BUCKETS))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0)))
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        at, x = vector(counts(text), self.idf)
        return x @ self.weights[at]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS, seed: int = 11) -> np.ndarray:
    """Weights ``(BUCKETS, classes)`` after ``epochs`` passes in shuffled order; L1 keeps most of them zero."""
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
    rng = np.random.default_rng(seed)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, x, y = rows[k]
            w = weights(z[at], n[at])
            p = x @ w
            p = np.exp(p - p.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    return weights(z, n)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, on a grid of powers; 1 without rows."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    return min((2.0 ** (k / 8) for k in range(-40, 41)), key=loss)


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.where((fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Rows of ``docs`` and, for each bucket, rows that have it. Tasks' sums are added in groups before they reach the driver."""

    def count(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                df += counts(text) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([df.tobytes()], pa.binary())], ["n", "df"])

    def add(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for part in batches:
            n += sum(part.column(0).to_pylist())
            for x in part.column(1).to_pylist():
                df += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([df.tobytes()], pa.binary())], ["n", "df"])

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "n long, df binary")
    for parts in (64, 8):
        sums = sums.repartition(parts).mapInArrow(add, "n long, df binary")
    rows = sums.collect()
    return sum(r["n"] for r in rows), sum((np.frombuffer(r["df"], np.int64) for r in rows), np.zeros(BUCKETS, np.int64))


def sample(docs: DataFrame, language_rows: int, sample_rows: int) -> list[tuple]:
    """``(doc_id, lang, text counts)`` of a bounded number of learning rows a language, those of least hashed id.

    Of rows with one id and language the least text counts. Rows whose hash lies well above what the number of
    rows of their language lets expect are left out before the rest is ordered, so that no language is ordered whole.
    """
    rows = learning_rows(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = rows.groupBy("lang").count()
    languages = sizes.count()
    each = max(16, min(language_rows, sample_rows // max(1, languages)))
    low = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 40)) * F.col("count") < (2 * each + 64) * (1 << 40)
    few = rows.select("doc_id", "lang").join(F.broadcast(sizes), "lang").where(low).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    chosen = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).select("doc_id", "lang")

    def count(batches):
        for part in slices(batches):
            found = [counts(t) for t in part.column(2).to_pylist()]
            at = [np.flatnonzero(c).astype(np.int32) for c in found]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([a.tobytes() for a in at], pa.binary()), pa.array([c[a].astype(np.int32).tobytes() for c, a in zip(found, at, strict=True)], pa.binary())], ["doc_id", "lang", "at", "n"])

    picked = rows.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    return sorted(picked.mapInArrow(count, "doc_id long, lang string, at binary, n binary").collect(), key=lambda r: (r["doc_id"], r["lang"], r["at"], r["n"]))


def fit(docs: DataFrame, language_rows: int = LANGUAGE_ROWS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the text and language of rows outside the held-out fold; without such rows every prediction is ``und``."""
    rows = sample(docs, language_rows, sample_rows)
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return Model([])
    total, df = document_frequencies(learning_rows(docs))
    model = Model(languages, np.log((1 + total) / (1 + df)) + 1.0)

    def unpacked(r) -> tuple[np.ndarray, np.ndarray, int]:
        at, n = np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int32)
        x = np.log1p(n) * model.idf[at]
        return at, x / (np.sqrt(x @ x) or 1.0), languages.index(r["lang"])

    unseen = [unpacked(r) for k, r in enumerate(rows) if k % CALIBRATION_PART == 0]
    model.weights = ftrl([unpacked(r) for k, r in enumerate(rows) if k % CALIBRATION_PART], len(languages))
    model.temperature = fit_temperature(np.array([x @ model.weights[at] for at, x, _ in unseen]).reshape(-1, len(languages)), np.array([y for *_, y in unseen], int))
    return model


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of each whole text of ``docs(doc_id, text)``.

    Null texts and texts without letters are ``und`` with score 0; ties go to the first language in order of
    names; repeated rows are predicted alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in slices(batches):
            found = [shared.value.predict(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p for p, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    """Learn and predict under the contract."""
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return predictions(docs, fit(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def kept_rows(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """Rows of ``docs`` with a language: predicted, not ``und``, with a calibrated score of at least ``least``.

    Null and empty texts and texts without letters go; without learning rows all go. Repeated rows stay or go together,
    other columns stay whatever their names, and an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches):
        for part in slices(batches):
            found = [shared.value.predict(t) for t in part.column(part.schema.get_field_index("text")).to_pylist()]
            yield part.filter(pa.array([p != UNKNOWN and s >= least for p, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
