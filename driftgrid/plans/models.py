"""Registered queries of trained networks and their relevances."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.functions.columns import LAND_FILL
from driftgrid.operators import networks as N
from driftgrid.operators import scoring as R
from driftgrid.operators import splits as B
from driftgrid.plans import base
from driftgrid.plans.registry import query, rounded
from driftgrid.session import scratch, table
from driftgrid.sources import tables

SPLITS = list(range(9))
TRAINING = {"runs": 5, "hidden": (8,), "epochs": 10, "patience": 3}


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("vec_id").cast("int").alias("member"), (F.col("label") < 5).cast("int").alias("label"), F.col("embedding").alias("features"))


def trained(spark: SparkSession, sf: str) -> tuple[DataFrame, list[N.Model]]:
    """45 networks of nine splits and five runs, each scaled by its split's training part over the ocean."""
    s = vectors(spark, sf)
    stats = B.split_statistics(base.cells(spark, sf), where=F.col("cell_id") % 7 != 0)
    scaling = {r.split: (r.mu, r.sigma) for r in stats.collect()}  # a row for each split
    width = s.agg(F.max(F.size("features"))).first()[0]
    return s, N.train_networks(s, SPLITS, scaling=scaling, land=[i for i in range(width) if i % 7 == 0], **TRAINING)


@query()
def network_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of 45 networks on every part: iterative, so no SQL; tests compare them with networks trained alone."""
    s, models = trained(spark, sf)
    return rounded(N.network_scores(s, models, keys=["vec_id"]), 4)


@query()
def network_histories(spark: SparkSession, sf: str) -> DataFrame:
    """The losses of every epoch, written as histories and read back to a row for each epoch."""
    out = scratch(spark, "history")
    N.histories(spark, trained(spark, sf)[1]).write.json(out)
    return rounded(R.learning_curves(tables.read_history(spark, out), keys=["split", "run"]), 5)


HIDDEN = 3


def given_weights(width: int) -> N.Weights:
    """Two layers without biases, by rule: sin(3 i + j) / 8 and cos(j)."""
    i, j = np.arange(width)[:, None], np.arange(HIDDEN)[None, :]
    return [(np.sin(3 * i + j) / 8, np.zeros(HIDDEN)), (np.cos(j.T), np.zeros(1))]


@query(f"""WITH x AS (SELECT vec_id, k - 1 AS i, CASE WHEN (k - 1) % 7 = 0 THEN 0 ELSE embedding[k]::DOUBLE END AS x FROM embeddings, range(1, 65) r(k) WHERE k <= len(embedding)),
w AS (SELECT i, j, sin(3 * i + j) / 8 AS w FROM range(0, 64) a(i), range(0, {HIDDEN}) b(j)),
z AS (SELECT vec_id, j, sum(x * w) AS z FROM x JOIN w ON x.i = w.i GROUP BY vec_id, j),
o AS (SELECT vec_id, sum(greatest(z, 0) * cos(j)) AS margin FROM z GROUP BY vec_id)
SELECT x.vec_id, x.i::INT AS cell_id, round(any_value(margin), 5) AS margin, round(sum(CASE WHEN z > 0 THEN x * w / z * (z * cos(z.j)) ELSE 0 END), 5) AS relevance
FROM x JOIN w ON x.i = w.i JOIN z ON x.vec_id = z.vec_id AND w.j = z.j JOIN o ON x.vec_id = o.vec_id GROUP BY x.vec_id, x.i""")
def dense_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Relevance of every cell through two dense layers with given weights; land comes filled and counts as zero."""
    e = table(spark, sf, "embeddings")
    filled = F.transform("embedding", lambda x, i: F.when(i % 7 == 0, F.lit(LAND_FILL)).otherwise(x.cast("double")))
    width = e.agg(F.max(F.size("embedding"))).first()[0]
    return rounded(N.dense_relevance(e.select("vec_id", filled.alias("features")), given_weights(width), keys=["vec_id"]), 5)
