"""Exact top-k inner products by columnar branch and bound.

Candidates are held in vertical layout, the dimensions with the most mass
first. Products are accumulated block of dimensions by block. After the first
block the most promising candidates are finished, which gives a floor for the
k-th best; after each block a candidate stays only if its partial product plus
the most that the remaining dimensions can add (Cauchy-Schwarz on the remaining
mass) reaches the floor.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8
PROMISING = 4  # so many times k candidates are finished after the first block


def search(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK, alive_after: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, product) of each query's k best; ties to the smaller id. Integer components.

    ``alive_after`` gets the number of candidates left after each block, over all queries.
    """
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    order = np.argsort(-(vectors.astype(np.float64) ** 2).sum(0), kind="stable")
    queries, columns = queries[:, order], np.ascontiguousarray(vectors[:, order].T.astype(kind))
    edges = list(range(0, columns.shape[0], block)) + [columns.shape[0]]
    if alive_after is not None:
        alive_after[:] = [0] * (len(edges) - 1)
    square = columns.astype(np.float64) ** 2
    mass = np.zeros((len(edges), columns.shape[1]))
    for b in range(len(edges) - 2, -1, -1):
        mass[b] = mass[b + 1] + square[edges[b] : edges[b + 1]].sum(0)
    mass = np.sqrt(mass) * (1 + 1e-9)
    out_q, out_c, out_s = [], [], []
    for qi, q in enumerate(queries.astype(kind)):
        rest = np.sqrt(np.concatenate([np.cumsum((q.astype(np.float64) ** 2)[::-1])[::-1], [0.0]])) * (1 + 1e-9)
        alive = np.flatnonzero(ids != query_ids[qi])
        part, floor = np.zeros(len(alive), kind), -np.inf
        for b in range(len(edges) - 1):
            rows = columns[edges[b] : edges[b + 1]]
            part = part + q[edges[b] : edges[b + 1]] @ (rows if len(alive) == columns.shape[1] else rows[:, alive])
            if b == 0 and len(alive) > k:
                some = np.argpartition(-part, min(PROMISING * k, len(alive)) - 1)[: PROMISING * k]
                whole = part[some] + q[edges[1] :] @ columns[edges[1] :, alive[some]]
                floor = float(np.partition(whole, len(some) - k)[len(some) - k])
            if len(alive) > k and b < len(edges) - 2:
                keep = part + rest[edges[b + 1]] * mass[b + 1][alive] >= floor - 1e-6 * (1 + abs(floor))
                if not keep.all():
                    alive, part = alive[keep], part[keep]
            if alive_after is not None:
                alive_after[b] += len(alive)
        if len(alive) > k:
            bar = np.partition(part, len(part) - k)[len(part) - k]
            keep = part >= bar
            alive, part = alive[keep], part[keep]
        best = np.lexsort((ids[alive], -part))[:k]
        out_q.append(np.full(len(best), qi)), out_c.append(alive[best]), out_s.append(part[best].astype(np.int64))
    cat = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    return cat(out_q), cat(out_c), cat(out_s)


def top_k(df: DataFrame, queries: Column, k: int = 20, *, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64, slab_rows: int = 8192, group_rows: int = 4096) -> DataFrame:
    """The k largest integer inner products of each query row against all other rows.

    Components become floor(scale * x). ``queries`` is a predicate on ``df``.
    Candidates are dealt into slabs of about ``slab_rows`` and queries into
    groups of about ``group_rows``; each (slab, group) pair is one bounded task,
    then the k best of every query's slabs are merged. Candidates are sent once
    for each query group, queries once for each slab; nothing is broadcast or
    collected.

    Returns query_id long, rank int (from 1), vec_id long, score long. Ties go
    to the smaller id. Null vectors or ids, vectors with null or non-finite
    components, and vectors whose length isn't the query's take no part; rows
    that share the query's id are not its candidates; of those that ask by one
    id the one with the least vector does (the shorter, then the smaller), and
    rows of another repeated id count each. Empty input gives an empty result; other columns are ignored.
    """
    v = F.col(vector_col)
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    ok = df.where(v.isNotNull() & F.col(id_col).isNotNull() & finite)
    rows = ok.select(F.col(id_col).cast("long").alias("id"), F.size(v).alias("dims"), whole.alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    size = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("q").cast("long")), F.lit(0))).first()
    slabs, groups = max(1, -(-size[0] // slab_rows)), max(1, -(-size[1] // group_rows))
    slab = F.pmod(F.xxhash64("id", "v"), F.lit(slabs)).cast("int")
    group = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("id", "dims", "v", slab.alias("slab"), every(groups).alias("part"))
    asked = rows.where("q").groupBy("id").agg(F.min(F.struct("dims", "v")).alias("__q")).select("id", "__q.*")
    right = asked.select("id", "dims", "v", every(slabs).alias("slab"), group.alias("part"))

    def best(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dims, ask in asked.groupby("dims"):
            have = candidates[candidates.dims == dims]
            if len(have) and dims:
                ids, asked_ids = have.id.to_numpy(), ask.id.to_numpy()
                q, c, s = search(np.stack(ask.v.to_list()), asked_ids, np.stack(have.v.to_list()), ids, k)
                out.append(pd.DataFrame({"query_id": asked_ids[q], "vec_id": ids[c], "score": s}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    found = left.groupBy("slab", "part").cogroup(right.groupBy("slab", "part")).applyInPandas(best, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
