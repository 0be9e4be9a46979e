"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

How many rows each input partition sends to each target cell is drawn from the
multivariate hypergeometric law before any row moves, so shard sizes are exact
and the result is a uniform permutation. A shard is cut into cells of at most
``cell_rows`` rows, so no task ever sorts a whole shard.

The matrix is never materialised: a task draws its own row of it by walking a
binary tree over the partitions, with a random stream seeded by the tree node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftgrid.llm.common import cut

NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """Good items among ``take`` drawn of ``good + bad`` without replacement, for any size.

    Beyond numpy's limit: ratio of uniforms around the mode, in log space.
    """
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, take)) if take and good else 0
    lo, hi = max(0, take - bad), min(good, take)
    if lo == hi:
        return lo
    total = good + bad
    mean = take * good / total
    sd = math.sqrt(max(1e-9, mean * bad / total * (total - take) / max(1, total - 1)))
    lg = math.lgamma

    def log_weight(k: int) -> float:
        return -(lg(k + 1) + lg(good - k + 1) + lg(take - k + 1) + lg(bad - take + k + 1))

    top = log_weight(min(hi, max(lo, int((take + 1) * (good + 1) / (total + 2)))))
    width = 2 * math.sqrt(2 / math.e) * (sd + 1) + 2
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if lo <= k <= hi and 2 * math.log(u) <= log_weight(k) - top:
            return k


def split_counts(rng: np.random.Generator, cells: np.ndarray, take: int) -> np.ndarray:
    """Multivariate hypergeometric: how many of each cell's slots a draw of ``take`` rows fills."""
    total = int(cells.sum())
    if total < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(cells, take, method="marginals")
    out = np.zeros_like(cells)
    for i, c in enumerate(cells.tolist()):
        total -= c
        out[i] = hypergeometric(rng, c, total, take)
        take -= int(out[i])
    return out


def matrix_row(starts: np.ndarray, cells: np.ndarray, part: int, seed: int) -> np.ndarray:
    """Row ``part`` of the communication matrix. ``starts``: rows before each partition, with the total at the end."""
    lo, hi, left = 0, len(starts) - 1, cells.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        drawn = split_counts(np.random.default_rng([seed, lo, hi]), left, int(starts[mid] - starts[lo]))
        if part < mid:
            hi, left = mid, drawn
        else:
            lo, left = mid, left - drawn
    return left


def cell_sizes(rows: int, shards: int, cell_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, first slot, size) of every cell; shard sizes differ by one at most."""
    shard, first, size = [], [], []
    for s in range(shards):
        n = rows // shards + (s < rows % shards)
        parts = max(1, -(-n // cell_rows))
        edges = [n * k // parts for k in range(parts + 1)]
        for a, b in zip(edges, edges[1:]):
            shard.append(s), first.append(a), size.append(b - a)
    return np.array(shard), np.array(first, np.int64), np.array(size, np.int64)


def shuffle_into_shards(df: DataFrame, shards: int, seed: int = 0, cell_rows: int = 1 << 20) -> DataFrame:
    """``df`` with ``shard`` (int, from 0) and ``slot`` (long, gapless from 0 in each shard).

    Every arrangement of the rows over all slots is equally likely for a random
    seed, and one seed and one input give one result. The rows are written to
    the checkpoint folder first, so pass the columns to be placed, not more.
    Counts alone reach the driver: one for each input partition.

    Nulls and repeated rows are rows like any other; an empty input gives an
    empty result; columns of ``df`` named shard or slot are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    kept = cut(df.drop("shard", "slot").withColumn("__part", F.spark_partition_id()))
    counts = {r[0]: r[1] for r in kept.groupBy("__part").count().collect()}
    parts = sorted(counts)
    place_of = {p: i for i, p in enumerate(parts)}
    starts = np.concatenate([[0], np.cumsum([counts[p] for p in parts])]).astype(np.int64)
    shard, first, size = cell_sizes(int(starts[-1]), shards, cell_rows)
    names = [f.name for f in kept.schema.fields if f.name != "__part"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = key = None
        at = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if cell is None:
                part = batch.column(batch.schema.get_field_index("__part"))[0].as_py()
                index = place_of[part]
                row = matrix_row(starts, size, index, seed)
                rng = np.random.default_rng([seed, 1 << 20, index])
                cell = rng.permutation(np.repeat(np.arange(len(row), dtype=np.int32), row))
                key = rng.permutation(len(cell)).astype(np.int64) << 31 ^ rng.integers(0, 1 << 31, len(cell))
            here = slice(at, at + batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(cell[here]), pa.array(key[here]), pa.array(np.full(batch.num_rows, index, np.int32))], [*names, "__cell", "__key", "__part"])
            at += batch.num_rows

    fields = [kept.schema[c] for c in names]
    placed = kept.mapInArrow(place, T.StructType([*fields, T.StructField("__cell", T.IntegerType()), T.StructField("__key", T.LongType()), T.StructField("__part", T.IntegerType())]))
    order = F.xxhash64("__key", "__part", F.lit(seed))
    slot = F.row_number().over(Window.partitionBy("__cell").orderBy(order, "__key", "__part")) - 1
    # cell to shard and first slot: arithmetic on the sizes, not a table that grows
    rows, per = int(starts[-1]), np.bincount(shard, minlength=shards)
    low, high = (int(per[-1]), int(per[0])) if rows else (1, 1)
    wide = int((per == high).sum()) if high != low else shards
    cut_at = wide * high
    placed = placed.withColumn("__wide", F.col("__cell") < cut_at)
    placed = placed.withColumn("__shard", F.expr(f"IF(__wide, __cell div {high}, {wide} + (__cell - {cut_at}) div {low})"))
    placed = placed.withColumn("__first", F.expr(f"({rows // shards} + IF(__shard < {rows % shards}, 1, 0)) * IF(__wide, __cell % {high}, (__cell - {cut_at}) % {low}) div IF(__wide, {high}, {low})"))
    return placed.select(*names, F.col("__shard").cast("int").alias("shard"), (F.col("__first") + slot).cast("long").alias("slot"))
