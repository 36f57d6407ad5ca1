"""Working storage and row plumbing that the corpus operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one numpy pass works on; a longer single text makes a pass of its own. Passes hold some dozens of
#: bytes for each byte of text.
SLICE_BYTES = 1 << 19


def workdir(spark: SparkSession, name: str) -> str:
    """A fresh folder path under ``spark.checkpoint.dir``, which every executor and the driver share.

    Only a session within one process that names no checkpoint folder (tests) gets one here.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    return path


#: Folders made within each open ``scratch``.
_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes at its end the folders that were made within it, for steps whose result is then at hand or written. What
    is taken out of the list that it gives stays."""
    _scratch.append([])
    try:
        yield _scratch[-1]
    finally:
        discard(spark, _scratch.pop())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to shared storage and read it back: the lineage ends there."""
    path = workdir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of shared storage."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Steps:
    """Tables that the steps of one run write to shared storage; ``clear`` deletes those that its result doesn't read."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = workdir(self.spark, name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[path] = back
        return back

    def clear(self, *kept: DataFrame) -> None:
        gone = [p for p, df in self.paths.items() if not any(df is k for k in kept)]
        discard(self.spark, gone)
        self.paths = {p: df for p, df in self.paths.items() if p not in gone}


def width(spark: SparkSession) -> int:
    """Partitions that a shuffle of this session makes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def texts_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as large_string without nulls (null: empty)."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.large_string())
    return col.fill_null("") if col.null_count else col


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a large_string array end to end, and each text's bounds."""
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], name: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Record batches cut so that the texts of each hold about ``most`` bytes, with those texts. At the end the worker,
    which may wait long for its next task, gives back the memory that it has freed."""
    try:
        for batch in batches:
            col = texts_of(batch, name)
            _, off = raw(col)
            at, n = 0, len(col)
            while at < n:
                to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
                yield batch.slice(at, to - at), col.slice(at, to - at)
                at = to
    finally:
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]
