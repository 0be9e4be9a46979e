"""Helpers shared by the corpus operators.

Words are maximal runs of bytes other than space and 0x09-0x0D. Word hashes
are computed for whole Arrow columns at once: a polynomial over the bytes of
each word, modulo 2**64, then mixed.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 1 << 21
BATCH_BYTES = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a new temporary one where that is unset, which only a local master may leave so."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder if urlparse(folder).scheme else f"file://{folder}"


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bound the Arrow batches that go to Python by bytes, so a worker holds a few texts, whatever their length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > size:
        spark.conf.set(key, str(size))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(n, 256), _BASE, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


class Words:
    """Words of a run of documents: byte spans, hashes and, per document, the first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.data, n = data, len(data)
        solid = ~_SPACE[data]
        starts_doc = np.zeros(n + 1, bool)
        starts_doc[offsets] = True
        before = np.empty(n, bool)
        before[:1] = True
        before[1:] = ~solid[:-1] | starts_doc[1:n]
        self.start = np.flatnonzero(solid & before)
        after = np.empty(n, bool)
        after[-1:] = True
        after[:-1] = ~solid[1:] | starts_doc[1:n]
        self.end = np.flatnonzero(solid & after) + 1
        self.first = np.searchsorted(self.start, offsets)
        length = self.end - self.start
        if len(self.start):
            at = np.arange(n) - np.repeat(self.start, np.diff(np.append(self.start, n))) if self.start[0] == 0 else np.concatenate([np.zeros(self.start[0], np.int64), np.arange(self.start[0], n) - np.repeat(self.start, np.diff(np.append(self.start, n)))])
            at[~solid] = 0
            value = (data.astype(np.uint64) + np.uint64(1)) * powers(int(length.max()))[at]
            value[~solid] = 0
            self.hash = mix(np.add.reduceat(value, self.start) ^ (length.astype(np.uint64) << np.uint64(48)))
        else:
            self.hash = np.zeros(0, np.uint64)

    def __len__(self) -> int:
        return len(self.first) - 1


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``limit`` bytes; a longer document is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, Words) for runs of rows of a string column."""
    data, offsets = texts(column)
    for i, j in runs(offsets, limit):
        yield i, j, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; entry i covers words i..i+n-1."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k, p in enumerate(powers(n)[:n]):
        out += hashes[k : len(hashes) - n + 1 + k] * p
    return mix(out)
