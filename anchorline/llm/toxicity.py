"""Toxic spans by a linear-chain conditional random field.

Documents carry labels, tokens do not: a small set of words and word stems that together explain the
toxic labelled documents, and hardly occur in others, labels the tokens. A two-state
chain (clean, toxic) over hashed word-form features is trained on segments around them;
forward-backward marginals of whole texts give offending offsets and document scores.
"""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Memory
from .common import fold, materialize, slices

#: Labelled documents that are learned from, at most, by label; chosen by a hash of their ids.
TOXIC_ROWS, CLEAN_ROWS = 1024, 3072
#: A labelling unit: this share of its documents is toxic, and chance gives as many in different surroundings only this likely.
LEAST_PRECISION, CHANCE, MOST_UNITS = 0.75, 1e-5, 4000
#: Words of a training segment, and segments without a toxic token from each document.
SEGMENT, CLEAN_SEGMENTS = 64, 3
#: Hashed features, training steps, step size, penalty.
BUCKETS, STEPS, RATE, PENALTY = 1 << 16, 80, 0.25, 1e-3
#: Log odds of a word of which nothing is known; not learned, so that new words are clean until something speaks against them.
UNSEEN = -6.0
#: Documents whose id's crc32 has this remainder are never learned from; score from which a document counts as toxic.
FOLDS, HELD_OUT, TOXIC_SCORE = 3, 1, 0.7

#: Marks that do not belong to a word they stand beside; lengths of beginnings that can be a toxic stem.
_EDGES = string.punctuation + "«»“”„‘’‚…–—¡¿·"
STEMS = (4, 5, 6, 7)


def form(word: str) -> str:
    return word.lower().strip(_EDGES)


def units(word_form: str) -> list[str]:
    """What can mark a form as toxic: the whole form, or its beginning (written with a star)."""
    return [word_form, *(word_form[:k] + "*" for k in STEMS if len(word_form) >= k)]


def features(word: str) -> list[int]:
    """Buckets of a word's form, its beginnings and its end."""
    w = form(word)
    return [crc32(x.encode("utf-8", "surrogatepass")) % BUCKETS for x in ("w" + w, w[:3] + "*", *(w[:k] + "*" for k in STEMS[:3]), "*" + w[-3:])]


class Ragged:
    """Sequences of any lengths laid out step by step, so that a step of all that are still running is one slice."""

    def __init__(self, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths = lengths[self.order]
        longest = int(self.lengths[0]) if len(lengths) else 0
        self.running = len(lengths) - np.searchsorted(self.lengths[::-1], np.arange(longest), side="right")
        self.at = np.concatenate([[0], np.cumsum(self.running)]).astype(np.int64)

    def places(self, k: int) -> np.ndarray:
        """Where the values of the k-th longest sequence lie."""
        return self.at[: self.lengths[k]] + k

    def marginals(self, x: np.ndarray, chain: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward odds of toxic, and ``x`` times backward, of emission odds ``x`` with transition odds ``chain`` (clean-toxic, toxic-clean, toxic-toxic)."""
        ct, tc, tt = chain
        forward, backward = np.empty_like(x), np.ones_like(x)
        for t in range(len(self.running)):
            n, at = self.running[t], self.at[t]
            if t == 0:
                r = x[:n] * start
            else:
                r = x[at : at + n] * (ct + tt * r[:n]) / (1 + tc * r[:n])
            forward[at : at + n] = r
        for t in range(len(self.running) - 2, -1, -1):
            n, after = self.running[t + 1], self.at[t + 1]
            xs = x[after : after + n] * backward[after : after + n]
            backward[self.at[t] : self.at[t] + n] = (tc + tt * xs) / (1 + ct * xs)
        return forward, backward, x * backward


def evidence(toxic_words: float, words: int) -> tuple[float, float, float]:
    """What a document's score weighs: a constant, how many toxic words are expected, and their share."""
    return 1.0, math.log(toxic_words + 0.1), math.log((toxic_words + 0.01) / (words + 10))


def weigh(rows: np.ndarray, y: np.ndarray, penalty: float = 0.1) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; toxic labels weigh a tenth of all, however many were sampled."""
    share = np.where(y == 1, 0.1 / max(1, y.sum()), 0.9 / max(1, (1 - y).sum())) * len(y)
    w = np.zeros(rows.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        h = (rows * (share * p * (1 - p))[:, None]).T @ rows + penalty * np.eye(len(w))
        w -= np.linalg.solve(h, rows.T @ (share * (p - y)) + penalty * w)
    return tuple(w.tolist())


@dataclass
class Chain:
    """Weights by feature bucket, bias, log odds of transitions and of a toxic start."""

    weights: list[float]
    bias: float
    moves: np.ndarray
    start: float
    document: tuple[float, float, float] = (0.0, 2.0, 0.0)

    def score(self, toxic_words: float, words: int) -> float:
        """Of a document, from its expected toxic words and its length."""
        z = float(np.dot(self.document, evidence(toxic_words, words)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) if words else 0.0

    def emission(self, word: str) -> float:
        return math.exp(max(-30.0, min(30.0, sum(map(self.weights.__getitem__, features(word))) + self.bias)))


def train(segments: list[tuple[list[str], list[bool]]], steps: int = STEPS) -> Chain:
    """Maximum likelihood with a squared penalty, by Adam on exact forward-backward gradients. Without a toxic token everything is clean."""
    moves = np.array([-2.0, 0.0, 0.0])
    if not any(any(y) for _, y in segments):
        return Chain([0.0] * BUCKETS, -30.0, moves, 0.0)
    shape = Ragged(np.array([len(w) for w, _ in segments]))
    number: dict[str, int] = {}
    words, y = np.empty(shape.at[-1], np.int64), np.empty(shape.at[-1])
    for k, s in enumerate(shape.order):
        at = shape.places(k)
        words[at] = [number.setdefault(w, len(number)) for w in segments[s][0]]
        y[at] = segments[s][1]
    feats = np.array([features(w) for w in number])
    first = shape.running[0]
    # Places of each token that has one before it, and of that one: the same column of the step before.
    later = np.arange(first, shape.at[-1])
    step = np.repeat(np.arange(1, len(shape.running)), shape.running[1:])
    before = later - shape.at[step] + shape.at[step - 1]
    seen = np.array([((1 - y[before]) * y[later]).sum(), (y[before] * (1 - y[later])).sum(), (y[before] * y[later]).sum()])
    theta = np.concatenate([np.zeros(BUCKETS), [UNSEEN], moves, [0.0]])
    m, v, known = np.zeros_like(theta), np.zeros_like(theta), np.ones_like(theta)
    known[BUCKETS] = 0
    for k in range(1, steps + 1):
        w, bias, moves, start = theta[:BUCKETS], theta[BUCKETS], theta[BUCKETS + 1 : BUCKETS + 4], theta[-1]
        x = np.exp(np.clip(w[feats].sum(axis=1) + bias, -30, 30))[words]
        chain = np.exp(np.clip(moves, -10, 10))
        forward, backward, xs = shape.marginals(x, chain, np.exp(np.clip(start, -10, 10)))
        p = forward * backward / (1 + forward * backward)
        pairs = np.stack([chain[0] * xs[later], forward[before] * chain[1], forward[before] * chain[2] * xs[later]])
        expected = (pairs / (1 + pairs.sum(axis=0))).sum(axis=1)
        wrong = np.bincount(words, p - y, len(number))
        g = np.concatenate([np.bincount(feats.ravel(), np.repeat(wrong, feats.shape[1]), BUCKETS), [0.0], expected - seen, [(p - y)[:first].sum()]]) / len(segments)
        g += PENALTY / len(segments) * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - RATE * known * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Chain(theta[:BUCKETS].tolist(), float(theta[BUCKETS]), theta[BUCKETS + 1 : BUCKETS + 4], float(theta[-1]))


def learning_rows(docs: DataFrame, labels: DataFrame, toxic_rows: int, clean_rows: int) -> DataFrame:
    """``doc_id, toxic, text`` of a bounded number of labelled documents outside the held-out fold; of rows with one id the least text counts."""
    ids = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = [ids.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, toxic_rows), (0, clean_rows))]
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return given.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def labelling_units(rows: DataFrame) -> set[str]:
    """Units whose documents are toxic more often than chance allows. Copies of one document count once: support
    counts the different surroundings (words beside it) that a unit has."""

    def each_unit(batches):
        for part in slices(batches, 32):
            for doc_id, toxic, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                forms = ["", *map(form, text.split()), ""]
                found: dict[str, int] = {}
                for before, f, after in dict.fromkeys(zip(forms, forms[1:], forms[2:], strict=False)):
                    for u in units(f) if f else ():
                        found.setdefault(u, crc32(f"{before} {f} {after}".encode("utf-8", "surrogatepass")))
                yield pa.RecordBatch.from_arrays([pa.array([toxic] * len(found), pa.int32()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["toxic", "unit", "beside"])

    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.countDistinct("doc_id").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return set()
    support = math.log(CHANCE) / math.log(sizes[1] / (sizes[0] + sizes[1]))
    toxic = F.col("toxic") == 1
    counted = rows.mapInArrow(each_unit, "toxic int, unit string, beside long").groupBy("unit", "beside").agg(F.count_if(toxic).alias("t"), F.count(F.lit(1)).alias("n"))
    counted = counted.groupBy("unit").agg(F.count_if(F.col("t") > 0).alias("support"), F.sum("t").alias("t"), F.sum("n").alias("n"))
    best = counted.where((F.col("support") >= support) & (F.col("t") >= LEAST_PRECISION * F.col("n"))).orderBy(F.desc("support"), "unit").limit(MOST_UNITS)
    return {r["unit"] for r in best.select("unit").collect()}


def segments_of(text: str, toxic: bool, labelling: set[str], doc_id: int) -> list[tuple[list[str], list[bool]]]:
    words = text.split()
    y = [toxic and not labelling.isdisjoint(units(form(w))) for w in words]
    whole = [(words[k : k + SEGMENT], y[k : k + SEGMENT]) for k in range(0, len(words), SEGMENT)]
    clean = [s for s in whole if not any(s[1])]
    stride = max(1, len(clean) // CLEAN_SEGMENTS)
    return [s for s in whole if any(s[1])][: 4 * CLEAN_SEGMENTS] + clean[doc_id % stride :: stride][:CLEAN_SEGMENTS]


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Chain:
    """Token weights, then the weights of the document score, from a bounded number of labelled documents."""
    rows = materialize(learning_rows(docs, labels, toxic_rows, clean_rows), "toxicity-sample")
    labelling = labelling_units(rows)

    def cut(batches):
        for part in slices(batches):
            made = [s for doc_id, toxic, text in zip(*(c.to_pylist() for c in part.columns), strict=True) for s in segments_of(text, toxic == 1, labelling, doc_id)]
            yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in made], pa.list_(pa.string())), pa.array([s[1] for s in made], pa.list_(pa.bool_()))], ["words", "toxic"])

    made = rows.mapInArrow(cut, "words array<string>, toxic array<boolean>").collect()
    model = train(sorted((list(r["words"]), list(r["toxic"])) for r in made))
    known = expected(rows, model).join(F.broadcast(rows.select("doc_id", "toxic").distinct()), "doc_id").select("toxic_words", "words", "toxic").where("words > 0").collect()
    if labelling and {r["toxic"] for r in known} == {0, 1}:
        known = sorted(known)
        model.document = weigh(np.array([evidence(r["toxic_words"], r["words"]) for r in known]), np.array([r["toxic"] for r in known]))
    return model


class Tagger:
    """Scores whole texts with one model; emissions of frequent words are remembered."""

    def __init__(self, model: Chain):
        self.emissions = Memory(model.emission)
        self.chain, self.start = np.exp(np.clip(model.moves, -10, 10)), float(np.exp(np.clip(model.start, -10, 10)))

    def __call__(self, texts: list[str | None]) -> list[tuple[float, int, list[dict]]]:
        """For each text its expected toxic words, its words and its spans. Expected are the marginals of offending words; where
        none offends, half the largest, so that many words of little doubt never add up to one of much."""
        odds = []
        for text in texts:
            words = (text or "").split()
            odds.append(np.fromiter(map(self.emissions.__getitem__, words), np.float64, len(words)))
        shape = Ragged(np.array([len(x) for x in odds], np.int64))
        x = np.empty(shape.at[-1])
        for k, s in enumerate(shape.order):
            x[shape.places(k)] = odds[s]
        forward, backward, _ = shape.marginals(x, self.chain, self.start)
        p = forward * backward / (1 + forward * backward)
        out: list = [None] * len(texts)
        for k, s in enumerate(shape.order):
            own = p[shape.places(k)]
            hits = np.flatnonzero(own >= 0.5)
            out[s] = float(own[hits].sum() if len(hits) else own.max(initial=0.0) / 2), len(own), self.spans(texts[s], own, hits) if len(hits) else []
        return out

    @staticmethod
    def spans(text: str, p: np.ndarray, hits: np.ndarray) -> list[dict]:
        """Offsets in code points of runs of toxic words, each with its highest marginal."""
        wanted, runs = set(hits.tolist()), []
        for k, m in enumerate(re.finditer(r"\S+", text)):
            if k in wanted:
                if runs and runs[-1]["last"] == k - 1:
                    runs[-1] |= {"last": k, "end": m.end(), "marginal": max(runs[-1]["marginal"], float(p[k]))}
                else:
                    runs.append({"last": k, "start": m.start(), "end": m.end(), "marginal": float(p[k])})
        return [{k: r[k] for k in ("start", "end", "marginal")} for r in runs]


def tagged(docs: DataFrame, model: Chain) -> DataFrame:
    """``doc_id, toxic_words, words, score, spans``: the work of :func:`tag`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches):
        tagger = Tagger(shared.value)
        for part in slices(batches, 2048):
            found = tagger(part.column(1).to_pylist())
            sums, words, runs = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums, pa.float64()), pa.array(words, pa.int64()), pa.array([shared.value.score(t, n) for t, n, _ in found], pa.float64()), pa.array(runs, spans)], ["doc_id", "toxic_words", "words", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, toxic_words double, words long, score double, spans array<struct<start:long,end:long,marginal:double>>")


def expected(docs: DataFrame, model: Chain) -> DataFrame:
    return tagged(docs, model).select("doc_id", "toxic_words", "words")


def tag(docs: DataFrame, model: Chain) -> DataFrame:
    """``doc_id, score, spans`` of each whole text of ``docs(doc_id, text)``.

    Null and empty texts score 0 and have no spans; repeated rows are scored alike; an empty table gives no rows.
    """
    return tagged(docs, model).select("doc_id", "score", "spans")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn outside the held-out fold and score every document, under the contract."""
    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return tag(docs, fit(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= TOXIC_SCORE, 1).otherwise(0).alias("predicted"), F.size("spans").cast("long").alias("n_spans"))
