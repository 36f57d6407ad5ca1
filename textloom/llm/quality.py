"""Quality of texts by a convolutional network over bytes, written in numpy.

Bytes get learned vectors; ``FILTERS`` learned filters of ``WIDTH`` bytes run over every position of a text. Chunks of
``CHUNK`` bytes at half overlap cover the whole text; in each, every filter's strongest response counts (max pooling),
and a linear layer makes a logit of them. The mean and the least of a text's chunk logits give one probability.

Training reads whole texts of labelled documents: of the ``TRAIN_DOCS`` with the lowest hashes of their ids, as many as
``TRAIN_BYTES`` holds, in that order, leaving out those that don't fit in any more (if none fits, the shortest).
For scoring, filters are turned into tables over byte pairs, so each position costs three look-ups however the vectors
were learned.

Defined results: null and empty texts are one chunk of zero bytes; without labels of both kinds every score is the
share of label 1 (0.5 without any). Repeated rows get a row each. Only ``doc_id`` and ``text``, and the label, are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import column, raw, slices

WIDTH, FILTERS, VECTOR, CHUNK = 6, 16, 8, 512
TRAIN_DOCS, TRAIN_BYTES = 2_000, 4_000_000
EPOCHS, BATCH, RATE = 4, 64, 0.01
#: Bytes that one pass of the network works on.
PASS_BYTES = 1 << 18


@dataclass
class Net:
    vectors: np.ndarray  # 256 x VECTOR
    filters: np.ndarray  # WIDTH * VECTOR x FILTERS
    lift: np.ndarray  # FILTERS
    out: np.ndarray  # FILTERS
    bias: float
    mix: tuple[float, float, float] = (1.0, 0.0, 0.0)  # of mean, least, 1

    def tables(self) -> list[np.ndarray]:
        """Responses of byte pairs at offsets 0, 2, 4 (65536 x FILTERS each)."""
        w = self.filters.reshape(WIDTH, VECTOR, FILTERS)
        one = [(self.vectors @ w[i]).astype(np.float32) for i in range(WIDTH)]
        one[0] += self.lift.astype(np.float32)
        # A pair is read as a little-endian 16-bit number: its first byte is the low one.
        return [(one[i + 1][:, None, :] + one[i][None, :, :]).reshape(65536, FILTERS) for i in range(0, WIDTH, 2)]


def chunk_logits(net: Net, tables: list[np.ndarray], col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all chunks, and the bounds of each text's."""
    data, off = raw(col)
    n = np.diff(off)
    half = CHUNK // 2
    halves = np.maximum(-(-n // half), 1)
    pooled = np.full((int(halves.sum()), FILTERS), -np.inf, np.float32)
    at = np.concatenate([[0], np.cumsum(halves)])
    for d in range(len(n)):
        # The text with WIDTH - 1 zero bytes behind it, so that every byte begins a window.
        for first in range(0, max(int(n[d]), 1), PASS_BYTES):
            size = min(int(n[d]) - first, PASS_BYTES) if n[d] else 1
            own = np.zeros(size + WIDTH, np.uint8)
            have = data[off[d] + first : min(off[d + 1], off[d] + first + size + WIDTH - 1)]
            own[: len(have)] = have
            pair = own[:-1].astype(np.uint16) | own[1:].astype(np.uint16) << np.uint16(8)
            r = tables[0][pair[:size]]
            r += tables[1][pair[2 : size + 2]]
            r += tables[2][pair[4 : size + 4]]
            k = at[d] + first // half
            best = np.maximum.reduceat(r, np.arange(0, size, half))
            pooled[k : k + len(best)] = best
    # Chunks are pairs of neighbouring halves; a text of one half is a chunk of its own.
    chunks = np.maximum(halves - 1, 1)
    bounds = np.concatenate([[0], np.cumsum(chunks)])
    first = np.arange(bounds[-1]) - np.repeat(bounds[:-1], chunks) + np.repeat(at[:-1], chunks)
    second = np.minimum(first + 1, np.repeat(at[1:] - 1, chunks))
    top = np.maximum(np.maximum(pooled[first], pooled[second]), 0)
    return top @ net.out + net.bias, bounds


def _summary(logits: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean and least logit of each text."""
    return np.column_stack([np.add.reduceat(logits, bounds[:-1]) / np.diff(bounds), np.minimum.reduceat(logits, bounds[:-1])])


def train(chunks: np.ndarray, label: np.ndarray, seed: int = 7) -> Net:
    """Adam on log loss. chunks: n x CHUNK bytes (zero-padded), label: n of 0 or 1."""
    rng = np.random.default_rng(seed)
    net = Net(rng.normal(0, 0.5, (256, VECTOR)), rng.normal(0, 0.2, (WIDTH * VECTOR, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.2, FILTERS), 0.0)
    names = ("vectors", "filters", "lift", "out", "bias")
    m = {k: np.zeros_like(getattr(net, k), dtype=float) for k in names}
    v = {k: np.zeros_like(getattr(net, k), dtype=float) for k in names}
    # Both labels weigh the same in training; the last fit puts the shares back.
    weight = np.where(label == 1, 0.5 / max(label.mean(), 1e-9), 0.5 / max(1 - label.mean(), 1e-9))
    step, places = 0, CHUNK - WIDTH + 1
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            x = net.vectors.astype(np.float32)[chunks[pick]]  # b x CHUNK x VECTOR
            win = np.lib.stride_tricks.sliding_window_view(x, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(len(pick), places, -1)
            r = win @ net.filters.astype(np.float32) + net.lift.astype(np.float32)
            top = r.argmax(1)  # b x FILTERS
            best = np.take_along_axis(r, top[:, None, :], 1)[:, 0, :]
            act = np.maximum(best, 0)
            p = 1 / (1 + np.exp(-np.clip(act @ net.out + net.bias, -30, 30)))
            g = (p - label[pick]) * weight[pick] / len(pick)
            gr = g[:, None] * net.out * (best > 0)
            rows = np.arange(len(pick))[:, None]
            seen = win[rows, top]  # b x FILTERS x (WIDTH * VECTOR)
            grad = {"out": act.T @ g, "bias": g.sum(), "filters": np.einsum("bfk,bf->kf", seen, gr), "lift": gr.sum(0), "vectors": np.zeros_like(net.vectors)}
            back = np.einsum("kf,bf->bfk", net.filters, gr).reshape(len(pick), FILTERS, WIDTH, VECTOR)
            bytes_at = chunks[pick][rows[:, :, None], top[:, :, None] + np.arange(WIDTH)]
            np.add.at(grad["vectors"], bytes_at, back)
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                setattr(net, k, getattr(net, k) - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
    for k in ("vectors", "filters", "lift", "out"):
        setattr(net, k, getattr(net, k).astype(np.float32))
    net.bias = float(net.bias)
    return net


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a weak pull to 0."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (p - y) + 0.1 * w)
        w -= np.clip(step, -3, 3)
        if abs(step).max() < 1e-8:
            break
    return w


def _sample(sizes: list[int], most: int) -> list[int]:
    """Which of texts of these sizes are taken: those that fit into what the ones before leave of ``most``."""
    left, taken = most, []
    for i, size in enumerate(sizes):
        if size <= left:
            taken.append(i)
            left -= size
    return taken or [min(range(len(sizes)), key=lambda i: (sizes[i], i))] if sizes else []


def training_chunks(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of whole texts (n x CHUNK bytes, zero-padded), and the text number of each."""
    data, off = raw(col)
    n, half = np.diff(off), CHUNK // 2
    count = np.maximum(-(-n // half) - 1, 1)
    owner = np.repeat(np.arange(len(n)), count)
    start = off[:-1][owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * half
    at = start[:, None] + np.arange(CHUNK)
    inside = at < off[1:][owner][:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else np.uint8(0), np.uint8(0)), owner


def fit(documents: DataFrame, labels: DataFrame, label: str) -> Net | float:
    """The net, from labelled documents whose crc32(doc_id) mod 3 is not 1; the share of label 1 if there is one kind only."""
    one = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = one.where("crc32(cast(doc_id as string)) % 3 <> 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.select("doc_id", "label", "text", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"))
    # Sizes first, so that only the texts that are taken come to the driver.
    known = sorted(rows.groupBy("doc_id", "hash").agg(F.max("size").alias("size"), F.xxhash64("doc_id").alias("rank")).collect(), key=lambda r: (r["rank"], r["doc_id"], r["hash"]))
    chosen = [(known[i]["doc_id"], known[i]["hash"]) for i in _sample([r["size"] for r in known], TRAIN_BYTES)]
    table = documents.sparkSession.createDataFrame(chosen, "doc_id long, hash long")
    taken = rows.join(F.broadcast(table), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"]).select("doc_id", "hash", "label", "text").collect()
    taken.sort(key=lambda r: (r["doc_id"], r["hash"]))
    y = np.array([r["label"] for r in taken], float)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.5
    col = pa.array([r["text"] for r in taken], pa.large_string())
    chunks, owner = training_chunks(col)
    net = train(chunks, y[owner])
    net.mix = tuple(_logistic(_summary(*chunk_logits(net, net.tables(), col)), y).tolist())
    return net


def score(documents: DataFrame, net: Net | float) -> DataFrame:
    """doc_id, score (probability of label 1)."""
    sent = documents.sparkSession.sparkContext.broadcast(net)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        tables = own.tables() if isinstance(own, Net) else None
        for batch, col in slices(batches, "text"):
            if tables is None:
                p = np.full(len(col), own)
            else:
                s = _summary(*chunk_logits(own, tables, col))
                p = 1 / (1 + np.exp(-np.clip(s @ np.array(own.mix[:2]) + own.mix[2], -30, 30)))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), pa.array(p)], names=["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(look, "doc_id bigint, score double")
