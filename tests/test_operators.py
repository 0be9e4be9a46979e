"""Small cases with known answers, properties, and failing inputs."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from driftgrid.functions import columns as K
from driftgrid.operators import events as E
from driftgrid.operators import fields as D
from driftgrid.operators import learning as M
from driftgrid.operators import scoring as R
from driftgrid.operators import series as T
from driftgrid.operators import spatial as X
from driftgrid.operators import splits as B
from driftgrid.operators import statistics as Q
from driftgrid.operators.lowpass import chebyshev, lowpass, zero_phase
from driftgrid.plans import indices as I
from driftgrid.plans.trends import ensemble_events, observed_series, observed_thresholds, warming_events
from driftgrid.sources import catalog, ingest, tables


def yearly(spark, values, member=0, first=2000):
    return spark.createDataFrame([(member, first + i, v) for i, v in enumerate(values)], "member int, year int, value double")


def column(df, *order, name="value"):
    return [r[name] for r in df.orderBy(*order).collect()]


def test_ramp_has_its_slope_and_drops_the_last_window(spark):
    out = T.sliding_slopes(yearly(spark, [2.0 * i for i in range(15)]), 10, keys=["member"]).collect()
    assert len(out) == 5 and all(abs(r.slope - 2) < 1e-12 for r in out)


def test_hole_in_a_window(spark):
    values = [2.0 * i if i != 4 else None for i in range(15)]
    strict = T.sliding_slopes(yearly(spark, values), 10, keys=["member"])
    tolerant = T.sliding_slopes(yearly(spark, values), 10, keys=["member"], least=2, start=2001)
    assert strict.count() == 0 and tolerant.count() == 4 and all(abs(r.slope - 2) < 1e-12 for r in tolerant.collect())


def test_year_gaps_do_not_stretch_windows(spark):
    df = yearly(spark, [float(i) for i in range(20)]).where("year != 2005")
    assert min(column(T.sliding_slopes(df, 5, keys=["member"]), "start", name="start")) == 2000
    assert not {2001, 2002, 2003, 2004, 2005} & set(column(T.sliding_slopes(df, 5, keys=["member"]), "start", name="start"))


def test_missing_slopes_are_no_events(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "slope double").select(E.exceeds(F.col("slope"), F.lit(2.0)).alias("a"), E.exceeds(F.col("slope"), F.lit(2.0), "below").alias("b"))
    assert sorted(map(tuple, df.collect())) == [(0, 0), (0, 1), (1, 0)]


@pytest.fixture
def grid(spark):
    rows = [(i * 6 + j, i, j, -50.0 + 20 * i, 60.0 * j, 1e12, int(j == 5)) for i in range(6) for j in range(6)]
    return spark.createDataFrame(rows, "cell_id int, i int, j int, lat double, lon double, area double, land int")


def field(spark, grid, f, members=(0,), years=(2000,), months=(1,)):
    cells = grid.select("cell_id", "lat", "lon")
    keys = spark.createDataFrame([(m, y, k) for m in members for y in years for k in months], "member int, year int, month int")
    return keys.crossJoin(cells).withColumn("value", f).drop("lat", "lon")


def test_box_means(spark, grid):
    boxes = {"x": (-10.0, 50.0, 0.0, 200.0), "y": (-90.0, 90.0, 0.0, 360.0)}
    out = D.box_means(field(spark, grid, F.lit(5.0)), grid, boxes, keys=["member"]).collect()
    assert {r.region for r in out} == {"x", "y"} and all(abs(r["value"] - 5) < 1e-12 for r in out)
    two = spark.createDataFrame([(0, 0, 4.0), (0, 1, None)], "member int, cell_id int, value double")
    row = {"r": (-50.0, -50.0, 0.0, 60.0)}
    assert abs(D.box_means(two, grid, row, keys=["member"]).first()["value"] - 2) < 1e-12
    assert abs(D.box_means(two, grid, row, keys=["member"], skipna=True).first()["value"] - 4) < 1e-12


def test_ice(spark):
    g = spark.createDataFrame([(i, lat, 1e12) for i, lat in enumerate([60.0, 60.0, 60.0, 40.0])], "cell_id int, lat double, area double")
    c = spark.createDataFrame([(0, i, v) for i, v in enumerate([0.10, 0.15, 0.50, 0.9])], "member int, cell_id int, value double")
    out = D.ice_metrics(c, g, keys=["member"]).first()
    assert abs(out.extent - 2) < 1e-12 and abs(out["area"] - 0.75) < 1e-12
    none = D.ice_metrics(c.withColumn("value", F.lit(None).cast("double")), g, keys=["member"]).first()
    assert (none.extent, none["area"]) == (0.0, 0.0)


def test_demeaned_members_sum_to_zero_and_base_deviation_is_one(spark, grid):
    rng = random.Random(0)
    df = spark.createDataFrame([(m, 2000 + y, 1, y, rng.random()) for m in range(4) for y in range(12)], "member int, year int, month int, t int, value double")
    sums = D.demean(df, keys=["t"]).groupBy("t").agg(F.sum("value").alias("s")).collect()
    assert all(abs(r.s) < 1e-12 for r in sums)
    n = D.normalized(df, keys=["member"], base=(2002, 2006)).where("year BETWEEN 2002 AND 2006").groupBy("member").agg(F.stddev_pop("value").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in n)
    flat = D.normalized(df.withColumn("value", F.lit(1.0)), keys=["member"], base=(2002, 2006))
    assert flat.where("value IS NOT NULL").count() == 0


def test_smoothing_repeats_the_ends(spark):
    df = spark.createDataFrame([(0, i, float(i + 1)) for i in range(5)], "k int, t int, value double")
    assert np.allclose(column(T.smoothed(df, 5, keys=["k"]), "t", name="smoothed"), [1.6, 2.2, 3.0, 3.8, 4.4])
    assert column(T.smoothed(df, 1, keys=["k"]), "t", name="smoothed") == [1, 2, 3, 4, 5]


def test_quadratic_gap(spark):
    df = spark.createDataFrame([(0, x, None if x in (4, 5) else float(x * x)) for x in range(1, 9)], "k int, t int, value double")
    out = column(T.filled_gaps(df, [4, 5], keys=["k"]), "t")
    assert np.allclose(out, [x * x for x in range(1, 9)])
    few = df.withColumn("value", F.when(F.col("t") > 7, F.col("value")))
    assert T.filled_gaps(few, [4, 5], keys=["k"]).where("value IS NOT NULL").count() == 1


def test_runs_and_intervals(spark):
    v = [0.4] * 5 + [0.0] + [0.4] * 6 + [-0.5] * 6 + [0.1]
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate(v)], "k int, t int, value double")
    out = T.run_labels(df, 0.4, 6, keys=["k"])
    assert column(out, "t", name="label") == [0] * 6 + [1] * 6 + [-1] * 6 + [0]
    assert sorted(map(tuple, T.phase_intervals(out, keys=["k"]).collect())) == [(0, -1, 12, 17), (0, 1, 6, 11)]
    wave = spark.createDataFrame([(0, i, (-1.0) ** i) for i in range(20)], "k int, t int, value double")
    assert set(column(T.run_labels(wave, 0.4, 6, keys=["k"]), "t", name="label")) == {0}


def test_cuts(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (None,), (1.1,)], "v double")
    out = df.select(K.phase_label(F.col("v"), 1.0).alias("i"), K.phase_label(F.col("v"), 1.0, inclusive=False).alias("s"), K.clipped(F.col("v"), -1.0, 1.0).alias("c")).collect()
    assert [tuple(r) for r in out] == [(1, 0, 1.0), (-1, 0, -1.0), (0, 0, None), (1, 1, 1.0)]


def test_pairs_and_tripole(spark):
    row = lambda a, b: spark.range(1).select(*[c.alias(n) for c, n in zip(K.split_pair(F.lit(a), F.lit(b)), "ab")]).first()
    assert np.allclose(row(2.0, 1.0), (1.6, 0.2)) and np.allclose(row(2.0, -1.0), (2, -1))
    assert spark.range(1).select(K.tripole(F.lit(3.0), F.lit(1.0), F.lit(1.0)).alias("t")).first().t == 2


def test_month_arithmetic_and_fills(spark):
    df = spark.createDataFrame([(1999, 12), (2000, 1)], "y int, m int").withColumn("t", K.month_index(F.col("y"), F.col("m"), 1995))
    back = df.select("y", "m", K.year_of(F.col("t"), 1995).alias("y2"), K.month_of(F.col("t")).alias("m2"), K.month_label(F.col("m")).alias("n")).collect()
    assert all(r.y == r.y2 and r.m == r.m2 for r in back) and [r.n for r in back] == ["DEC", "JAN"]
    v = spark.createDataFrame([(float("nan"),), (-10.0,), (-9999.0,), (None,)], "v double")
    out = v.select(K.missing(F.col("v")).alias("a"), K.missing_below(F.col("v"), -9e3).alias("b"), K.unfill(F.col("v")).alias("c")).collect()
    assert [r.a for r in out] == [None, -10.0, -9999.0, None] and [r.b for r in out] == [None, -10.0, None, None] and out[1].c == 0.0


def test_detrending_and_forced_correction(spark):
    rows = [(k, t, 1.0 + 2 * t + k * math.sin(t)) for k in (0, 1) for t in range(20)]
    obs = spark.createDataFrame(rows, "k int, t int, value double")
    assert all(abs(r.residual) < 1e-9 for r in T.detrended(obs, keys=["k"]).where("k = 0").collect())
    forced = spark.createDataFrame([(k, t, math.sin(t) + 0.5 * t) for k in (0, 1) for t in range(20)], "k int, t int, value double")
    both = obs.where("k = 1").join(forced.where("k = 1").select("t", F.col("value").alias("f")), "t").select("k", "t", (F.col("f") + 3.0 + 0.7 * F.col("t")).alias("value"))
    out = T.forced_removed(both, "ensmean", keys=["k"], forced=forced.where("k = 1"))
    assert out.count() == 20 and all(abs(r.residual) < 1e-9 for r in out.collect())
    with pytest.raises(ValueError):
        T.forced_removed(both, "ensmean", keys=["k"], forced=forced.where("k = 1 AND t > 3"))
    with pytest.raises(ValueError):
        T.forced_removed(both, "other", keys=["k"])


def test_lowpass(spark):
    b, a = chebyshev(4, 0.05, 2 / (12 * 13))
    gain = lambda years: abs(np.polyval(b[::-1], np.exp(-2j * np.pi / (12 * years))) / np.polyval(a[::-1], np.exp(-2j * np.pi / (12 * years)))) ** 2
    for years, want in ((1e9, 0.98855), (13, 0.98855), (50, 0.99716), (8, 0.06347)):
        assert abs(gain(years) - want) < 1e-5
    assert np.allclose(zero_phase(b, a, np.ones(60)), 0.98855, atol=1e-5)
    df = spark.createDataFrame([(k, t, 1.0 if k or t else None) for k in (0, 1) for t in range(40)], "k int, t int, value double")
    out = lowpass(df, keys=["k"])
    assert out.where("k = 0 AND filtered IS NOT NULL").count() == 0 and out.where("k = 1 AND abs(filtered - 0.98855) < 1e-4").count() == 40


@pytest.mark.parametrize("block", [1, 7, 16, 256])
def test_blocks_equal_the_filter_step_by_step(spark, block):
    rng = np.random.default_rng(block)
    b, a = chebyshev(4, 0.05, 2 / (12 * 2))
    series = {"long": rng.normal(5, 2, 700), "short": rng.normal(0, 1, 16), "gap": rng.normal(0, 1, 40), None: np.cumsum(rng.normal(0, 1, 90))}
    rows = [(k, i + (100 if k != "gap" or i < 20 else 105), float(v)) for k, x in series.items() for i, v in enumerate(x)]
    for some in (rows, [r for r in rows if r[0] != "gap"]):  # by order, and by value of t
        rows_ = [*some, *(("few", i, 1.0) for i in range(15)), *(("hole", i, None if i == 7 else 1.0) for i in range(60))]
        out = lowpass(spark.createDataFrame(rows_, "k string, t int, value double"), keys=["k"], cutoff_years=2.0, block=block).toPandas().sort_values("t")
        assert len(out) == len(rows_) and out[out.k.isin(["few", "hole"])].filtered.isna().all()
        for k in {r[0] for r in some}:
            got = out[out.k.isna() if k is None else out.k == k]
            assert np.allclose(got.filtered, zero_phase(b, a, series[k]))
    with pytest.raises(Exception, match="missing or repeated"):
        lowpass(spark.createDataFrame([("x", t if t != 9 else 8, 1.0) for t in range(30)], "k string, t int, value double"), keys=["k"]).collect()


def test_splits(spark):
    df = spark.range(100).select(F.col("id").cast("int").alias("member"))
    B.check_members(df, 100)
    s = B.with_splits(df)
    assert s.count() == 900 and s.groupBy("split", "member").count().where("count > 1").count() == 0
    zero = s.where("split = 0")
    assert column(zero.where("part = 'te'"), "member", name="member") == list(range(0, 100, 10)) and column(zero.where("part = 'va'"), "member", name="member") == list(range(1, 100, 10)) and zero.where("part = 'tr'").count() == 80
    with pytest.raises(ValueError):
        B.check_members(df.where("member > 0"), 100)
    with pytest.raises(ValueError):
        B.aligned(df, df.where("member > 0").withColumn("y", F.lit(1)), on=["member"])


def test_weights_and_percentiles(spark):
    df = spark.createDataFrame([(int(i > 7),) for i in range(10)], "label int")
    assert [(r.label, r.weight) for r in B.class_weights(df, keys=[]).orderBy("label").collect()] == [(0, 0.625), (1, 3.75)]
    m = spark.createDataFrame([(0, i, float(i)) for i in range(11)], "model int, cell_id int, value double")
    out = column(D.percentile_scaled(m, keys=["model"]), "cell_id", name="scaled")
    assert abs(out[5] - 5 / 9.7) < 1e-12 and out[10] == 1.0
    zero = D.percentile_scaled(m.withColumn("value", F.lit(0.0)), keys=["model"])
    assert set(column(zero, "cell_id", name="scaled")) == {0.0}


def test_threshold_ties_and_metrics(spark):
    rng = random.Random(4)
    rows = [(round(rng.random(), 1), rng.randint(0, 1)) for _ in range(200)]
    df = spark.createDataFrame([(0, p, y) for p, y in rows], "k int, y_prob double, y_true int")
    got = R.metric_set(df, keys=["k"]).first()
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(got.auroc - auc) < 1e-12
    ap, before = 0.0, 0.0
    best = None
    for t in sorted({p for p, _ in rows}, reverse=True):
        tp, n = sum(p >= t for p in pos), sum(p >= t for p, _ in rows)
        prec, rec = tp / n, tp / len(pos)
        ap, before = ap + prec * (rec - before), rec
        if best is None or (abs(prec - rec), t) < best:
            best = (abs(prec - rec), t)
    assert abs(got.auprc - ap) < 1e-12 and got.threshold == best[1]
    curve = spark.createDataFrame([(0, 0.2, 0.5, 0.6), (0, 0.3, 0.6, 0.5), (0, 0.4, 0.9, 0.1)], "k int, threshold double, precision double, recall double")
    assert R.optimal_thresholds(curve, keys=["k"]).first().threshold == 0.2
    one = R.metric_set(df.withColumn("y_true", F.lit(0)), keys=["k"]).first()
    assert one.f1 == 0 and one.mcc == 0 and one.auroc is None


def test_regridding(spark, grid):
    target = spark.createDataFrame([(0, 12.5, 100.0), (1, -50.0, 0.0), (2, 50.0, 300.0), (3, 80.0, 10.0), (4, None, 3.0)], "cell_id int, lat double, lon double")
    plane = field(spark, grid, 2 * F.col("lat") + 3 * F.col("lon"))
    out = {r.cell_id: r["value"] for r in X.regridded(plane, X.bilinear_weights(target, grid), keys=["member"], corners=4).collect()}
    assert set(out) == {0, 1, 2} and abs(out[0] - 325) < 1e-9 and abs(out[1] + 100) < 1e-9 and abs(out[2] - 1000) < 1e-9
    holes = plane.withColumn("value", F.when(F.col("cell_id") != 19, F.col("value")))
    assert any(r["value"] is None for r in X.regridded(holes, X.bilinear_weights(target, grid), keys=["member"], corners=4).collect())
    hit = grid.where("cell_id = 8").select("cell_id", "lat", "lon")
    one = X.regridded(plane, X.nearest_weights(hit, grid), keys=["member"]).first()["value"]
    four = X.regridded(plane, X.nearest_weights(hit, grid, k=4), keys=["member"]).first()["value"]
    assert one == 2 * -30.0 + 3 * 120.0 and abs(four - one) < 1e-6


def test_nearest_equals_brute_force(spark):
    rng = random.Random(8)
    s = [(i, rng.uniform(-90, 90), rng.uniform(0, 360)) for i in range(120)]
    t = [(i, rng.uniform(-90, 90), rng.uniform(0, 360)) for i in range(60)]
    schema = "cell_id int, lat double, lon double"
    for size in (5.0, 40.0):
        got = X.nearest_weights(spark.createDataFrame(t, schema), spark.createDataFrame(s, schema), k=3, bin_degrees=size).collect()
        want = {(i, j) for i, a, b in t for j, _, _ in sorted(s, key=lambda r: (math.hypot(r[1] - a, r[2] - b), r[0]))[:3]}
        assert {(r.target_id, r.source_id) for r in got} == want
    with pytest.raises(ValueError):
        X.overlap_join(spark.createDataFrame([(1, 1.0)], "t int, value double"), spark.createDataFrame([(2, 1.0)], "t int, value double"))


def test_nearest_of_a_regional_source(spark):
    s = [(i, 40.0 + i % 3, 5.0 + i // 3) for i in range(9)]
    t = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in (-85.0, 0.0, 41.2) for b in (6.3, 120.0, 355.0))]
    schema = "cell_id int, lat double, lon double"
    targets = spark.createDataFrame(t, schema)
    got = X.nearest_weights(targets, spark.createDataFrame(s, schema), k=2).collect()
    want = {(i, j) for i, a, b in t for j, _, _ in sorted(s, key=lambda r: (math.hypot(r[1] - a, r[2] - b), r[0]))[:2]}
    assert {(r.target_id, r.source_id) for r in got} == want and len(got) == 18
    assert X.nearest_weights(targets, spark.createDataFrame(s[:1], schema), k=2).count() == 9
    assert X.nearest_weights(targets, spark.createDataFrame([], schema), k=2).count() == 0


def test_statistics(spark):
    even = Q.contingency(spark.range(40).select((F.col("id") % 2).alias("phase"), (F.col("id") % 4 < 2).cast("int").alias("event")), phase="phase", event="event").first()
    assert (even.chi2, even.dof, even.p, even.fisher_p) == (0.0, 1, 1.0, pytest.approx(1.0))
    df = spark.createDataFrame([(ph, int(i < e)) for ph, n, e in ((1, 400, 100), (0, 400, 200)) for i in range(n)], "phase int, event int")
    for r in Q.bootstrap_shares(df, phase="phase", event="event", replicates=4000).collect():
        want = 0.25 if r.phase == "1" else 0.5
        half = 1.96 * math.sqrt(want * (1 - want) / 400)
        assert r.p == want and abs(r.low - (want - half)) < 0.01 and abs(r.high - (want + half)) < 0.01
    v = Q.variance_explained(df, phase="phase", event="event", replicates=2000).first()
    assert abs(v.explained - 0.015625 / (0.375 * 0.625)) < 1e-12 and v.low < v.explained < v.high
    odds = Q.logistic_effect(df, phase="phase", event="event").first()
    assert abs(odds.odds_ratio - 1 / 3) < 1e-4 and odds.low < odds.odds_ratio < odds.high
    assert Q.logistic_effect(df.where("event = 1"), phase="phase", event="event").first().odds_ratio is None
    h = Q.histogram(spark.createDataFrame([(float(i),) for i in range(11)], "value double"), 5, keys=[]).collect()
    assert sum(r.n for r in h) == 11 and abs(sum(r.density * 2 for r in h) - 1) < 1e-12 and max(r.bin for r in h) == 4


def test_clusters(spark, grid):
    maps = grid.select("cell_id").crossJoin(spark.range(3).select(F.col("id").cast("int").alias("model"))).withColumn("value", F.when(F.col("cell_id") < 12, 5.0).otherwise(-1.0) + F.col("model") * 0.01)
    out = M.cluster_ensemble(maps.where("NOT (cell_id = 35 AND model = 1)"), grid, 2, model="model").collect()
    assert len(out) == 36 and {r.cluster for r in out if r.cell_id < 12} == {0} and {r.cluster for r in out if 12 <= r.cell_id < 35} == {1}
    assert [r.cluster for r in out if r.cell_id == 35] == [None]


def test_trend_pipelines(spark):
    rng = random.Random(6)
    rows = [(m, 1 + k, 2000 + y, -float(y) + rng.random() * 6) for m in range(4) for k in range(2) for y in range(25)]
    s = spark.createDataFrame(rows, "member int, month int, year int, value double")
    slopes, thresholds = observed_thresholds(s.where("member = 0").drop("member"), 10)
    assert thresholds.count() == 2 and slopes.agg(F.sum("slowdown")).first()[0] > 0 and slopes.where("slowdown = 1 AND riles = 1").count() == 0
    out = ensemble_events(s, thresholds.select("month", F.col("fraction_slowdown").alias("fraction")), 10)
    assert out.count() == 4 * 2 * 15 and out.where("event = 1 AND slope <= threshold").count() == 0
    w = warming_events(s.where("month = 1").withColumn("value", -F.col("value")), 10)
    assert w.count() == 60 and w.where("event = 1 AND slope >= threshold").count() == 0
    rec = spark.createDataFrame([(t, 1987 + t // 12, t % 12 + 1, None if t in (11, 12) else float(t)) for t in range(24)], "t int, year int, month int, value double")
    done = observed_series(rec, gaps=[11, 12], masked={1988: (3, 4)})
    assert np.allclose([r["value"] for r in done.where("t IN (11, 12)").orderBy("t").collect()], [11, 12]) and done.where("value IS NULL").count() == 2


def test_index_paths_agree(spark, grid):
    f = F.sin(F.col("cell_id") * 0.7 + F.col("member") * 1.3 + F.col("month") * 2.1 + F.col("year") * 0.4)
    cells = field(spark, grid, f, members=range(3), years=(2000, 2001, 2002), months=range(1, 13))
    box = {"b": (-30.0, 30.0, 0.0, 180.0)}
    a, b = (I.nino34(cells, grid, base=(2000, 2001), boxes=box, fast=x).orderBy("member", "t").collect() for x in (False, True))
    assert len(a) == 108 and all(abs(x["value"] - y["value"]) < 1e-9 and x.label == y.label for x, y in zip(a, b))
    one = cells.where("member = 0")
    obs = I.arctic_observed(one, grid, I.forced_arctic(cells, grid, box), base=(2000, 2001), boxes=box)
    assert obs.count() == 36
    z = I.observed_input(one.drop("member"), grid, "linear")
    land = {r.cell_id for r in grid.where("land = 1").collect()}
    values = z.collect()
    assert len(values) == 108 and all((r["value"] == -10) == (r.cell_id in land) for r in values)


def test_cell_anomalies_deal_cells_once(spark, grid):
    f = F.sin(F.col("cell_id") * 0.7 + F.col("member") * 1.3 + F.col("month") * 2.1 + F.col("year") * 0.4)
    cells = field(spark, grid, f, members=range(3), years=(2000, 2001, 2002), months=range(1, 13))
    out = I.cell_anomalies(cells, ensemble=True, base=(2000, 2001))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(cell_id") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan.split("Exchange hashpartitioning")[0]
    want = D.anomalies(D.demean(cells, keys=["year", "month", "cell_id"]), keys=["member", "month", "cell_id"], base=(2000, 2001), name="value")
    key = lambda r: (r.member, r.year, r.month, r.cell_id)
    a, b = (sorted(x.collect(), key=key) for x in (out, want))
    assert len(a) == len(b) and all(key(x) == key(y) and abs(x["value"] - y["value"]) < 1e-12 for x, y in zip(a, b))


def test_sources(spark, tmp_path, grid):
    cells = field(spark, grid, F.when(F.col("cell_id") == 3, float("nan")).otherwise(F.col("cell_id") * 1.0), members=(0, 1), months=(1, 6)).withColumn("variable", F.lit("sst"))
    path = str(tmp_path / "cells")
    tables.write_table(cells, path, by=["variable", "month"], units={"value": "degC"}, sort=["cell_id"])
    june = tables.read_cells(spark, path, variable="sst", months=[6])
    plan = june._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(variable" in plan and june.count() == 72 and june.where("value IS NULL").count() == 2
    with pytest.raises(Exception, match="nothing"):
        tables.read_columns(spark, path, ["nothing"])
    obs = spark.createDataFrame([(31 * k, 0.0, 0.0, -9999.0 if k == 1 else float(k)) for k in range(10)], "day_offset int, lat double, lon double, value double")
    obs.write.parquet(str(tmp_path / "obs"))
    got = tables.read_observed(spark, str(tmp_path / "obs"))
    assert got.where("value IS NULL").count() == 1 and got.count() == 4
    with pytest.raises(ValueError):
        tables.write_complete(cells, path, keys=["member", "cell_id"], years=1, by=["month"])
    members = spark.createDataFrame([("1001.001", "a"), ("1181.010", "b")], "member_code string, member_group string")
    periods = spark.createDataFrame([(1990, 1999, "hist"), (2000, 2009, "fut")], "start_year int, end_year int, scenario string")
    variables = spark.createDataFrame([("sst", "ocn")], "variable string, component string")
    m = catalog.manifest(members, periods, variables, base_url="u")
    assert m.count() == 4 and m.select("file").distinct().count() == 4
    have = m.limit(3).select("file")
    assert catalog.missing_files(m, have).count() == 1
    with pytest.raises(FileNotFoundError):
        catalog.require(m, have)
    axes = tables.grid_from_axes(spark.createDataFrame([(0, -10.0), (1, 10.0)], "i int, lat double"), spark.createDataFrame([(0, -90.0), (1, 0.0), (2, 90.0)], "j int, lon double"))
    assert sorted((r.cell_id, r.lat, r.lon) for r in axes.collect())[0] == (0, -10.0, 270.0) and axes.count() == 6
    sheets = {k: spark.createDataFrame([(1979, 1.0), (1980, float("nan"))], "year int, extent double") for k in (1, 2)}
    monthly = tables.read_monthly(sheets, "extent", {1: (1979, 1980), 2: (1980, 1980)})
    assert monthly.count() == 3 and monthly.where("value IS NULL").count() == 2


def test_overlapping_chunks_and_absent_tables(spark, tmp_path):
    raw = f"{tmp_path}/raw"
    rows = [("ens.hist.0001.001.sst.1", 2000, 1, 0, 1.5), ("ens.hist.0001.001.sst.2", 2001, 1, 0, float("nan")), ("ens.hist.0002.001.sst.1", 2000, 1, 0, 2.5)]
    df = spark.createDataFrame(rows, "chunk string, year int, month int, cell_id int, value double")
    df.write.partitionBy("chunk").parquet(raw)
    got = ingest.process_variable(spark, raw, f"{tmp_path}/out")
    assert sorted((r.member_code, r.year, r.value) for r in got.collect()) == [("0001.001", 2000, 1.5), ("0001.001", 2001, None), ("0002.001", 2000, 2.5)]
    df.where("year = 2000").withColumn("chunk", F.lit("ens.hist.0001.001.sst.9")).write.mode("append").partitionBy("chunk").parquet(raw)
    with pytest.raises(ValueError):
        ingest.process_variable(spark, raw, f"{tmp_path}/out2")
    assert tables.read_where_present(spark, "series", [f"{tmp_path}/nothing"]).count() == 0


def test_typed_tables_refuse_missing_columns(spark, tmp_path):
    spark.createDataFrame([(1, 2.0)], "member int, value double").write.parquet(f"{tmp_path}/short")
    with pytest.raises(AnalysisException):
        tables.read_typed(spark, "series", f"{tmp_path}/short").collect()


def test_next_present_cell_steps_in(spark):
    source = spark.createDataFrame([(i, 0.0, 10.0 * i) for i in range(5)], "cell_id int, lat double, lon double")
    target = spark.createDataFrame([(0, 1.0, 21.0)], "cell_id int, lat double, lon double")
    cells = spark.createDataFrame([(t, i, None if (t, i) in {(1, 2), (2, 2), (2, 3)} else float(10 * t + i)) for t in range(3) for i in range(5)], "t int, cell_id int, value double")
    out = X.regridded_valid(cells, target, source, keys=["t"])
    assert sorted((r.t, r.value) for r in out.collect()) == [(0, 2.0), (1, 13.0), (2, 21.0)]
    assert X.regridded_valid(cells.where("t > 9"), target, source, keys=["t"]).count() == 0


def test_any_number_of_masks_is_one_plan(spark):
    rng = random.Random(3)
    source = [(i, rng.uniform(-60, 60), rng.uniform(0, 300)) for i in range(150)]
    target = [(i, rng.uniform(-70, 70), rng.uniform(-20, 320)) for i in range(40)]
    at = lambda rows: spark.createDataFrame(rows, "cell_id int, lat double, lon double")
    share = [rng.choice([0.01, 0.05, 0.5, 0.9, 1.0]) for _ in range(1000)]
    rows = [(t, i, rng.uniform(-1, 1) if rng.random() < share[t] else None) for t in range(1000) for i in range(150)]
    cells = spark.createDataFrame(rows, "t int, cell_id int, value double").repartition(8).cache()

    def brute(k):
        out = {}
        held = {}
        for t, i, v in rows:
            if v is not None:
                held.setdefault(t, []).append((i, v))
        xy = np.array([(b, c) for _, b, c in source])
        for t, some in held.items():
            ids, v = np.array([i for i, _ in some]), np.array([x for _, x in some])
            for j, lat, lon in target:
                d = np.hypot(xy[ids, 0] - lat, xy[ids, 1] - lon)
                near = np.lexsort((ids, d))[:k]
                w = 1 / (d[near] + 1e-10)
                out[t, j] = (w * v[near]).sum() / w.sum()
        return out

    plans = []
    for k in (1, 4):
        got = X.regridded_valid(cells, at(target), at(source), keys=["t"], k=k)
        want = brute(k)
        have = {(r.t, r.cell_id): r["value"] for r in got.collect()}
        assert have.keys() == want.keys() and all(abs(have[x] - want[x]) < 1e-9 for x in want)
        plans.append(got._jdf.queryExecution().optimizedPlan().toString())
    assert all(p.count("Join Inner") == 2 and p.count("LogicalRDD") <= 6 for p in plans)  # rounds, whatever the number of masks


def test_default_bins_find_the_nearest(spark):
    rng = random.Random(9)
    for s, t in [(300, 50), (5, 40), (1, 3)]:
        source = [(i, rng.gauss(0, 20), rng.choice([0.0, rng.uniform(0, 360)])) for i in range(s)]
        target = [(i, rng.uniform(-90, 90), rng.uniform(-60, 400)) for i in range(t)]
        frames = [spark.createDataFrame(x, "cell_id int, lat double, lon double") for x in (target, source)]
        got = {}
        for r in X.nearest_weights(*frames, k=3).collect():
            got.setdefault(r.target_id, []).append((r["rank"], r.source_id))
        for i, lat, lon in target:
            want = [j for _, j in sorted((math.hypot(b - lat, c - lon), j) for j, b, c in source)[:3]]
            assert [j for _, j in sorted(got[i])] == want


def test_irregular_source_is_refused(spark):
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random()) for i in range(50)]
    df = spark.createDataFrame(rows, "cell_id int, lat double, lon double")
    with pytest.raises(ValueError):
        X.bilinear_weights(df, df)


def test_curve_over_ranges_is_the_plain_one(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice([rng.random(), round(rng.random(), 1), 0.0, 1.0]), int(rng.random() < 0.3)) for k in (0, 1) for _ in range(300)]
    df = spark.createDataFrame(rows, "split int, y_prob double, y_true int")
    one, many = ({(r.split, r.threshold): (r.tp, r.predicted, r.positives, r.total) for r in R.pr_curve(df, keys=["split"], ranges=n).collect()} for n in (1, 1024))
    assert one == many
    for (k, th), (tp, predicted, _, _) in many.items():
        assert tp == sum(y for s, p, y in rows if s == k and p >= th) and predicted == sum(p >= th for s, p, _ in rows if s == k)


def test_student_p(spark):
    known = [(2.228138851, 10, 0.05), (12.70620474, 1, 0.05), (3.182446305, 3, 0.05), (2.0, 4, 0.116117), (0.0, 7, 1.0), (1.96, 1001, 0.050274)]
    df = spark.createDataFrame([(t, f) for t, f, _ in known], "t double, f int").select(Q.student_p(F.col("t"), F.col("f")).alias("p"))
    assert all(abs(r.p - p) < 2e-5 for r, (_, _, p) in zip(df.collect(), known))


def test_two_phase_label_keeps_missing(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (None,)], "v double").select(K.two_phase_label(F.col("v")).alias("l"))
    assert [r.l for r in df.collect()] == [1, -1, None]


def test_hexagons_compute_their_samples_once(spark):
    later = F.udf(lambda v: v - time.monotonic() * 1e-9, "double").asNondeterministic()  # less whenever it is computed again
    df = spark.createDataFrame([(0.0, 0.5), (1.0, 0.5), (0.5, 0.0), (0.5, 1.0)], "a double, b double").select(later("a").alias("a"), "b")
    out = {r.hex_i for r in Q.hexagons(df, "a", "b").collect() if r.hex_j == 11.5}
    assert out == {0.5, 40.5}
