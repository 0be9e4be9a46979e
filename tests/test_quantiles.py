from __future__ import annotations

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.operators.fields import percentile_scaled
from driftgrid.operators.quantiles import exact_percentiles
from driftgrid.operators.statistics import kernel_density

QS = [0.0, 0.005, 0.025, 0.5, 0.97, 0.975, 1.0]


def test_one_hot_key_and_ties_equal_plain_percentiles(spark):
    rng = np.random.default_rng(1)
    groups = {"hot": rng.standard_cauchy(60_000), "ties": rng.integers(0, 3, 20_000).astype(float), "one": np.full(9000, 4.0), "steps": np.repeat([1.0, 5.0, 1e9], [5000, 7, 3000]), "small": rng.normal(size=11), None: np.exp(rng.normal(0, 30, 8000))}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("hot", None)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(6)
    for held in (50, 5000, 10**6):
        got = {r.k: r.percentiles for r in exact_percentiles(df, QS, keys=["k"], held=held).collect()}
        assert got.keys() == groups.keys()
        for k, x in groups.items():
            assert got[k] == pytest.approx(np.quantile(x, QS).tolist(), rel=1e-12, abs=1e-12)
    alone = exact_percentiles(df.where("k = 'hot'"), QS, keys=[], held=100).first().percentiles
    assert alone == pytest.approx(np.quantile(groups["hot"], QS).tolist(), rel=1e-12)
    assert exact_percentiles(df.where("false"), QS, keys=["k"]).count() == 0


def test_no_task_holds_a_hot_key(spark):
    df = spark.range(0, 400_000, 1, 8).select(F.lit(1).alias("k"), F.sin(F.col("id") * 1.7).alias("value"))
    got = exact_percentiles(df, [0.97], keys=["k"], held=1000)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(__v" in plan and got.first().percentiles[0] == pytest.approx(np.quantile(np.sin(np.arange(400_000) * 1.7), 0.97), rel=1e-12)
    scaled = percentile_scaled(df, keys=["k"])
    assert scaled.agg(F.max("scaled")).first()[0] == 1.0


def brute_density(x, y, points):
    n = len(x)
    cov = np.cov(x, y) * n ** (-1 / 3)
    inverse, gx, gy = np.linalg.inv(cov), np.linspace(*np.quantile(x, [0.005, 0.995]), points), np.linspace(*np.quantile(y, [0.005, 0.995]), points)
    out = np.zeros((points, points))
    for i in range(points):
        dx = gx[i] - x[:, None]
        dy = gy[None, :] - y[:, None]
        out[i] = np.exp(-0.5 * (inverse[0, 0] * dx * dx + 2 * inverse[0, 1] * dx * dy + inverse[1, 1] * dy * dy)).sum(0)
    return out / (2 * math.pi * n * math.sqrt(np.linalg.det(cov)))


@pytest.mark.parametrize(("n", "slope"), [(40, 0.3), (3000, -2.0), (20_000, 5.0)])
def test_density_is_the_sum_of_all_kernels(spark, n, slope):
    rng = np.random.default_rng(n)
    x = rng.normal(100, 3, n)
    y = slope * x + rng.standard_t(3, n)
    got = kernel_density(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y double"), "x", "y", points=40).toPandas().sort_values(["gi", "gj"])
    want = brute_density(x, y, 40)
    assert np.abs(got.density.to_numpy().reshape(40, 40) - want).max() < 1e-9 * want.max()


def test_time_of_a_density_hardly_grows(spark):
    took = []
    for n in (20_000, 2_000_000):
        df = spark.range(0, n, 1, 8).select(F.randn(1).alias("x"), F.randn(2).alias("y"))
        start = time.time()
        total = kernel_density(df, "x", "y", points=60).agg(F.count("*").alias("n"), F.max("density").alias("m")).first()
        took.append(time.time() - start)
        assert total.n == 3600 and total.m == pytest.approx(1 / (2 * math.pi), rel=0.1)
    assert took[1] < 40 * took[0]  # for a hundred times the samples, on a busy machine too
