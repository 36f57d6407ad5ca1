"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme-value statistics.

Words fall into a fixed number of hash buckets, so the model has one size however large the vocabulary grows. From
labelled documents each bucket gets the log-odds of toxic against clean text under a Dirichlet prior that follows the
corpus (the words of all training texts together), shrunk by its standard error. A text counts once for each bucket. A
word speaks through the stronger of itself and its first 5 bytes (a stem); one that repeats the word before it says
nothing new. Documents are scored as sequences:
the scan of Ruzzo and Tompa finds every maximal-scoring segment in linear time. Scores of segments in clean text follow
an extreme-value law, P(S >= x) = 1 - exp(-K n exp(-lambda x)), with lambda the positive root of
sum p(s) exp(lambda s) = 1 over the clean training words; a segment is significant where that is at most
``significance``. A document's evidence is its best segments' log P-values summed; a logistic fit on the training
documents turns it into a probability.

The fit uses at most ``TRAIN_DOCS`` labelled documents (those with the lowest hashes of their ids), a documented bound.

Defined results: null and empty texts have no segments and get the score that such evidence has; without labels of
both kinds every score is 0. Repeated rows get a row each. Only ``doc_id`` and ``text``, and the label's column, are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ._shared import column, materialise, scratch, slices
from ._words import ALNUM, words

BUCKETS = 1 << 18
TRAIN_DOCS = 20_000
#: Total prior count; each bucket gets the share that it has of all training words.
PRIOR = 2_000.0
#: A word's log-odds is lowered by so many standard errors (towards the background) before it can speak for toxicity.
SHRINK = 2.5
#: What each word of no evidence costs a segment.
DRIFT = -0.4
SIGNIFICANCE = 0.01


#: Bytes of a word's head that are tokens of their own. This and ``SHRINK`` had the least log loss of 28 choices in a
#: five-fold cross-validation within training rows, copies of a text in one fold.
HEADS = (5,)


@dataclass
class Model:
    score: np.ndarray  # float32 by bucket
    lam: float
    k: float
    weight: float = 0.0
    bias: float = -30.0


def _tokens(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and its heads (one row each), and the words' bounds of texts; a repeat is -1."""
    w = words(col, ALNUM, HEADS)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    rows = [(h * np.uint64(2 * i + 1) >> shift).astype(np.int64) for i, h in enumerate([w.hashes, *w.heads])]
    again = np.zeros(len(w.hashes), bool)
    again[1:] = w.hashes[1:] == w.hashes[:-1]
    again[w.bounds[:-1][w.bounds[:-1] < len(again)]] = False
    out = np.stack(rows)
    out[:, again] = -1
    return out, w.bounds


def _scores(model: Model, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buckets, bounds = _tokens(col)
    return np.where(buckets[0] >= 0, model.score[buckets].max(0), np.float32(DRIFT)).astype(np.float64), bounds


def _runs(score: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of words of one sign within each text: sums, first words, and run bounds of texts."""
    n = len(score)
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    edge[1:n] |= (score[1:] > 0) != (score[:-1] > 0)
    first = np.flatnonzero(edge[:n])
    return (np.add.reduceat(score, first) if n else score), first, np.searchsorted(first, bounds)


def maximal_segments(score: list[float]) -> list[tuple[int, int, float]]:
    """(first, end, sum) of every maximal-scoring segment of a sequence, in order; linear time (Ruzzo and Tompa)."""
    total = 0.0
    stack: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum after, nearest lower one below
    for i, s in enumerate(score):
        before, total = total, total + s
        if s <= 0:
            continue
        first, end, left, right = i, i + 1, before, total
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((first, end, left, right, j))
                break
            first, left = stack[j][0], stack[j][2]
            below = stack[j][4]
            del stack[j:]
            j = below
    return [(a, b, r - l) for a, b, l, r, _ in stack]


def _evidence(model: Model, score: np.ndarray, bounds: np.ndarray, significance: float = SIGNIFICANCE) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Summed -log P of significant segments (or the best one's), and those segments in words, for each text."""
    sums, first, at = _runs(score, bounds)
    out = np.zeros(len(bounds) - 1)
    segments: list[list[tuple[int, int, float]]] = []
    positive = np.concatenate([[0], np.cumsum(sums > 0)])
    for d in range(len(out)):
        a, b = at[d], at[d + 1]
        found = []
        if positive[b] > positive[a]:
            n = int(bounds[d + 1] - bounds[d])
            scale = math.log(model.k * n) if model.k * n > 0 else 0.0
            stops = np.append(first[a:b], bounds[d + 1]) - bounds[d]
            best, total = 0.0, 0.0
            for i, j, s in maximal_segments(sums[a:b].tolist()):
                x = model.lam * s - scale
                p = -math.log(-math.expm1(-math.exp(-x))) if x < 30 else x
                best = max(best, p)
                if p >= -math.log(significance):
                    total += p
                    found.append((int(stops[i]), int(stops[j]), p))
            out[d] = max(best, total)
        segments.append(found)
    return out, segments


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Newton steps for one weight and a bias, with a weak pull to 0 so that separable data stay finite."""
    w = np.zeros(2)
    z = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + 0.01 * w
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.01 * np.eye(2)
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _lambda(score: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1, or a large value where no word scores above 0."""
    if not ((score > 0) & (p > 0)).any():
        return 10.0
    low, high = 0.0, 1.0
    f = lambda x: float((p * np.exp(np.clip(x * score, -700, 700))).sum()) - 1
    while f(high) < 0 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def fit(labelled: DataFrame) -> Model:
    """``labelled``: text, label (0 or 1), as ``split`` gives them."""
    with scratch(labelled.sparkSession):
        return _fit(labelled)


def _fit(labelled: DataFrame) -> Model:
    sample = materialise(labelled.select("text", F.col("label").cast("int").alias("label")), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), np.int64)
        for batch, col in slices(batches, "text"):
            buckets, bounds = _tokens(col)
            toxic = np.array(column(batch, "label").to_pylist(), np.int64) == 1
            text = np.tile(np.repeat(np.arange(len(toxic)), np.diff(bounds)), len(buckets))
            once = np.unique(text * (BUCKETS + 1) + buckets.reshape(-1) + 1)
            text, bucket = once // (BUCKETS + 1), once % (BUCKETS + 1) - 1
            n += np.bincount((toxic[text] * BUCKETS + bucket)[bucket >= 0], minlength=2 * BUCKETS).reshape(2, BUCKETS)
        at = np.flatnonzero(n.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[0, at]), pa.array(n[1, at])], names=["bucket", "clean", "toxic"])

    sums = sample.mapInArrow(count, "bucket bigint, clean bigint, toxic bigint").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    clean, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.toLocalIterator():
        clean[r["bucket"]], toxic[r["bucket"]] = r["clean"], r["toxic"]
    model = Model(np.full(BUCKETS, DRIFT, np.float32), 1.0, 0.1)
    if not clean.sum() or not toxic.sum():
        return model
    prior = PRIOR * (clean + toxic) / (clean.sum() + toxic.sum()) + 1e-3
    a, b = toxic + prior, clean + prior
    delta = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    error = np.sqrt(1 / a + 1 / b)
    model.score = np.where(delta > 0, np.maximum(delta - SHRINK * error, 0), 0).astype(np.float32) + np.float32(DRIFT)
    p = clean / clean.sum()
    model.lam = _lambda(model.score.astype(float), p)
    # K from the share of clean words at which a segment can begin.
    model.k = max(float(p[model.score > 0].sum()), 1e-6)
    at = documents_evidence(sample, model, ["label"]).select("label", "evidence")
    x, y = [], []
    for r in at.toLocalIterator():
        x.append(r["evidence"])
        y.append(r["label"])
    model.weight, model.bias = _logistic(np.log1p(np.array(x)), np.array(y, float))
    return model


def documents_evidence(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep``, evidence, segments (array of first word, end word, -log P) of each text."""
    sent = documents.sparkSession.sparkContext.broadcast(model)
    kinds = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("log_p", pa.float64())]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch, col in slices(batches, "text"):
            evidence, segments = _evidence(m, *_scores(m, col))
            out = [[{"first": a, "end": b, "log_p": p} for a, b, p in s] for s in segments]
            yield pa.RecordBatch.from_arrays([*(column(batch, k) for k in keep), pa.array(evidence), pa.array(out, kinds)], names=[*keep, "evidence", "segments"])

    fields = S.StructType(documents.select(*keep).schema.fields).add("evidence", "double")
    fields = fields.add("segments", S.ArrayType(S.StructType().add("first", "long").add("end", "long").add("log_p", "double")))
    return documents.select(*dict.fromkeys([*keep, "text"])).mapInArrow(look, fields)


def score(documents: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id), score (probability of toxicity), segments."""
    found = documents_evidence(documents, model, keep or ["doc_id"])
    logit = F.log1p("evidence") * F.lit(model.weight) + F.lit(model.bias)
    return found.withColumn("score", 1 / (1 + F.exp(-logit))).drop("evidence")


def split(documents: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Labelled training rows (text, label) of documents whose crc32(doc_id) mod 3 is not 1; at most ``TRAIN_DOCS`` ids."""
    one = labels.select("doc_id", F.col(label).alias("label")).where("label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    one = one.where("crc32(cast(doc_id as string)) % 3 <> 1")
    ids = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "label")
