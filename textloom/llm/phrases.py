"""Document fingerprints by locally consistent parsing.

A text is a sequence of symbols, its UTF-8 bytes at first. On each level runs of one symbol become single symbols;
deterministic coin tossing gives each symbol a label below 8 from its and its left neighbours' names (the lowest bit in
which a name differs from the one before, and that bit; three times over); blocks begin at local maxima of the labels;
a block is named by a hash of the names in it. Where a block ends depends on a few symbols around it only, so equal
substrings get equal names inside, wherever they stand. A text's phrases are its names on ``FROM_LEVEL`` and above
(and the level below for texts of fewer than ``SHORT`` bytes); its fingerprint is a one-permutation MinHash sketch of
them. All texts of a batch are parsed side by side.

``neighbours`` compares each document with the next by doc_id and with an edited copy. One range shuffle moves each
text once; the last document of a partition meets the first of the next in a second step that handles two rows a
partition.

Defined results: null text is empty; an empty text has an empty sketch, and two empty sketches are alike (1). Rows
without doc_id come first. Rows that share a doc_id follow each other by the hash of their texts. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import column, materialise, raw, slices, width
from ._words import _P, _power, mix

FROM_LEVEL, SHORT = 2, 64
LEVELS = 24
#: Cells of the sketch, each of four hex digits; an empty cell is "----".
CELLS = 64


def _labels(name: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Three rounds of coin tossing: from 64 bits to labels below 128, 14 and 8. Neighbours always differ."""
    label = name
    for kind in (np.uint8, np.uint8, np.uint8):
        before = np.empty_like(label)
        before[0] = ~label[0]
        before[1:] = label[:-1]
        before[first] = ~label[first]
        x = label ^ before
        one = x & (~x + x.dtype.type(1))
        low = np.bitwise_count(one - x.dtype.type(1))
        label = (low * np.uint8(2) + ((label & one) != 0)).astype(kind)
    return label


def phrase_names(data: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level from 1: names, the text number of each, and whether it is the whole text's (which ends there)."""
    name = mix(data.astype(np.uint64) + np.uint64(1))
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(off))
    out = []
    for _ in range(LEVELS):
        n = len(name)
        if not n:
            break
        begin = np.ones(n, bool)
        begin[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        run = np.flatnonzero(begin)
        times = np.diff(np.append(run, n))
        name, doc = name[run], doc[run]
        long = times > 1
        name[long] = mix(name[long] * np.uint64(3) + times[long].astype(np.uint64))
        n = len(name)
        start = np.ones(n, bool)
        start[1:] = doc[1:] != doc[:-1]
        label = _labels(name, np.flatnonzero(start))
        peak = np.zeros(n, bool)
        peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        # A text's first symbol begins a block; its second and last never do.
        last = np.append(start[1:], True)
        peak &= ~last
        peak[1:] &= ~start[:-1]
        block = np.flatnonzero(peak | start)
        size = np.diff(np.append(block, n))
        place = np.arange(n) - np.repeat(block, size)
        name = mix(np.add.reduceat(mix(name) * _power(_P, int(size.max()))[place], block) + size.astype(np.uint64))
        doc = doc[block]
        alone = np.bincount(doc, minlength=len(off) - 1)[doc] == 1
        out.append((name, doc, alone))
        name, doc = name[~alone], doc[~alone]
    return out


def sketches(col: pa.Array) -> np.ndarray:
    """Texts x CELLS (int32): 16-bit values of the least phrase in each cell, -1 where there is none."""
    data, off = raw(col)
    docs = len(off) - 1
    least = np.full(docs * CELLS, np.iinfo(np.uint64).max, np.uint64)
    short = np.diff(off) < SHORT
    for i, (name, doc, alone) in enumerate(phrase_names(data, off)):
        if i + 1 < FROM_LEVEL:
            use = short[doc] | alone
            name, doc = name[use], doc[use]
        h = mix(name ^ np.uint64(0x5851F42D4C957F2D))
        cell = (h >> np.uint64(58)).astype(np.int64)
        np.minimum.at(least, doc * CELLS + cell, h & np.uint64(0x03FFFFFFFFFFFFFF))
    out = (least & np.uint64(0xFFFF)).astype(np.int32)
    out[least == np.iinfo(np.uint64).max] = -1
    return out.reshape(docs, CELLS)


def text_of(sketch: np.ndarray) -> str:
    return "".join("----" if v < 0 else f"{v:04x}" for v in sketch.tolist())


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of phrase sets, row by row."""
    used = (a >= 0) | (b >= 0)
    same = (a == b) & used
    return np.where(used.any(1), same.sum(1) / np.maximum(used.sum(1), 1), 1.0)


def edit(text: str, following: str) -> str:
    """The last quarter (rounded down) replaced by as much of the following text's beginning."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(ids: list, texts: list[str]) -> pa.RecordBatch:
    """Results for all texts but the last, each with the one that follows it."""
    edited = [edit(a, b) for a, b in itertools.pairwise(texts)]
    each, new = (sketches(pa.array(x, pa.large_string())) for x in (texts, edited))
    own, nxt, texts = each[:-1], each[1:], texts[:-1]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(list(map(len, texts)), pa.int64()),
            pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in edited]),
            pa.array(list(map(text_of, own))),
            pa.array(list(map(text_of, new))),
            pa.array(likeness(own, new)),
            pa.array(likeness(own, nxt)),
        ],
        names=[x.split()[0] for x in _RESULT.split(", ")],
    )


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, col in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id").cast(pa.int64()), pa.array(list(map(text_of, sketches(col))))], names=["doc_id", "fingerprint"])

    return documents.select("doc_id", "text").mapInArrow(look, "doc_id bigint, fingerprint string")


def neighbours(documents: DataFrame) -> DataFrame:
    """Each document's fingerprint against those of its edited copy and of the next document (after the last: the first)."""
    ranged = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    ranged = ranged.repartitionByRange(width(documents.sparkSession), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    fields = _RESULT + ", part int, role string, text string"

    def edge(part: int, role: str, doc: int | None, text: str) -> pa.RecordBatch:
        blank = [pa.array([doc], pa.int64()), pa.array([None], pa.int64()), *(pa.array([None], pa.string()) for _ in range(3)), *(pa.array([None], pa.float64()) for _ in range(2))]
        return pa.RecordBatch.from_arrays([*blank, pa.array([part], pa.int32()), pa.array([role]), pa.array([text])], names=[x.split()[0] for x in fields.split(", ")])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        for batch, col in slices(batches, "text"):
            ids, texts = column(batch, "doc_id").to_pylist(), col.to_pylist()
            if held is None:
                yield edge(part, "head", ids[0], texts[0])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = ids[-1], texts[-1]
            if len(ids) > 1:
                found = _compare(ids[:-1], texts)
                n = found.num_rows
                yield pa.RecordBatch.from_arrays([*found.columns, pa.array([part] * n, pa.int32()), pa.array(["row"] * n), pa.nulls(n, pa.string())], names=[x.split()[0] for x in fields.split(", ")])
        if held is not None:
            yield edge(part, "tail", *held)

    found = materialise(ranged.mapInArrow(within, fields), "phrases")
    rows = found.where("role = 'row'").select(*(x.split()[0] for x in _RESULT.split(", ")))
    parts = sorted(r["part"] for r in found.where("role = 'head'").select("part").collect())
    if not parts:
        return rows
    after = documents.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, after int")
    tails = found.where("role = 'tail'").select("part", "doc_id", "text").join(after, "part")
    heads = found.where("role = 'head'").select(F.col("part").alias("after"), F.col("text").alias("following"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, a, b in zip(*(column(batch, k).to_pylist() for k in ("doc_id", "text", "following")), strict=True):
                yield _compare([i], [a, b])

    return rows.union(tails.join(heads, "after").select("doc_id", "text", "following").mapInArrow(across, _RESULT))
