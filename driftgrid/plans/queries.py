"""Registered queries of the reference's operators on the driver's tables, with oracle SQL.

Floating results are rounded alike on both sides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
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
from driftgrid.operators.lowpass import chebyshev, lowpass, steady
from driftgrid.plans import base
from driftgrid.plans import indices as I
from driftgrid.plans.base import C, G, L, O, P, S
from driftgrid.plans.registry import query, rounded
from driftgrid.plans.trends import ensemble_events
from driftgrid.session import table
from driftgrid.sources import catalog

#: Mean prices are decimal fractions; in a prime unit none of them sits on a rounding tie.
UNIT = 997

BOXES = {"tropics": (-30.0, 30.0, 0.0, 360.0), "north": (30.0, 90.0, 0.0, 180.0), "all": (-90.0, 90.0, 0.0, 360.0)}
SQL_BOXES = "boxes(region, a, b, x, y) AS (VALUES ('tropics', -30.0, 30.0, 0.0, 360.0), ('north', 30.0, 90.0, 0.0, 180.0), ('all', -90.0, 90.0, 0.0, 360.0))"
SLOPES = f"""{S}, w AS (
  SELECT member, t AS start, count(value) OVER x AS n, regr_slope(value, t::DOUBLE) OVER x AS slope, max(t) OVER (PARTITION BY member) AS last
  FROM s WINDOW x AS (PARTITION BY member ORDER BY t RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING)
), k AS (SELECT member, start, n, slope FROM w WHERE n = 12 AND start <= last - 12)"""


def slopes(spark: SparkSession, sf: str) -> DataFrame:
    return T.sliding_slopes(base.series(spark, sf), 12, keys=["member"], t="t")


@query(f"""WITH {SLOPES}, m AS (SELECT member, avg(slope) + stddev_pop(slope) AS threshold FROM k GROUP BY member)
SELECT k.member, start, round(slope, 4) AS slope, round(threshold, 4) AS threshold, (slope > threshold)::TINYINT AS event FROM k JOIN m ON k.member = m.member""")
def trend_events(spark: SparkSession, sf: str) -> DataFrame:
    """Sliding trends per member and the windows above the member's mean plus one deviation."""
    k = slopes(spark, sf)
    return rounded(E.classified(k, E.trend_thresholds(k, keys=["member"]), on=["member"]).select("member", "start", "slope", "threshold", "event"), 4)


@query(f"""WITH {SLOPES}, m AS (SELECT member, avg(slope) AS mean, stddev_pop(slope) AS std FROM k GROUP BY member)
SELECT member, round(mean, 4) AS mean, round(std, 4) AS std, round(mean - std, 4) AS threshold, round((mean - std) / mean, 4) AS fraction,
 (SELECT count(*) FROM k WHERE k.member = m.member AND slope < mean - std) AS events FROM m""")
def decline_events(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds one deviation below the mean trend, and how many windows fall below."""
    k = slopes(spark, sf)
    m = E.trend_thresholds(k, keys=["member"], sigmas=-1.0)
    n = E.classified(k, m, on=["member"], direction="below").groupBy("member").agg(F.sum("event").alias("events"))
    return rounded(m.join(n, "member"), 4)


@query(f"""WITH {S}, e AS (SELECT t, avg(value) AS value FROM s GROUP BY t), w AS (
  SELECT t AS start, count(value) OVER x AS n, regr_slope(value, t::DOUBLE) OVER x AS slope, max(t) OVER () AS last FROM e WINDOW x AS (ORDER BY t RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING))
SELECT start, n, round(CASE WHEN n >= 2 THEN slope END, 4) AS slope FROM w WHERE n >= 2 AND start <= last - 12""")
def ensemble_trend(spark: SparkSession, sf: str) -> DataFrame:
    """Slopes of the ensemble mean, tolerant of missing values."""
    mean = base.series(spark, sf).groupBy("t").agg(F.avg("value").alias("value")).withColumn("all", F.lit(0))
    return rounded(T.sliding_slopes(mean, 12, keys=["all"], t="t", least=2).drop("all"), 4)


@query(f"""WITH {SLOPES}, f AS (SELECT (avg(slope) - stddev_pop(slope)) / avg(slope) AS fraction FROM k),
e AS (SELECT t, avg(value) AS value FROM s GROUP BY t), ew AS (
  SELECT t AS start, count(value) OVER x AS n, regr_slope(value, t::DOUBLE) OVER x AS slope, max(t) OVER () AS last FROM e WINDOW x AS (ORDER BY t RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING)),
m AS (SELECT start, slope * fraction AS threshold FROM ew, f WHERE n >= 2 AND start <= last - 12)
SELECT member, k.start, round(slope, 4) AS slope, round(threshold, 2) AS threshold, (slope < threshold)::TINYINT AS event FROM k JOIN m ON k.start = m.start""")
def forced_threshold_events(spark: SparkSession, sf: str) -> DataFrame:
    """Member trends against a fraction of the ensemble mean's trend in the same window."""
    s = base.series(spark, sf).withColumn("all", F.lit(0))
    fraction = E.grand_fraction(slopes(spark, sf)).select("fraction").withColumn("all", F.lit(0))
    out = ensemble_events(s, fraction, 12, keys=["all"], direction="below", t="t").drop("all")
    return rounded(out.select("member", "start", "slope", "threshold", "event"), 4, threshold=2)


TWO = f"""{SLOPES}, {L}, lw AS (
  SELECT member, t AS start, count(value) OVER x AS n, regr_slope(value, t::DOUBLE) OVER x AS slope, max(t) OVER (PARTITION BY member) AS last
  FROM l WINDOW x AS (PARTITION BY member ORDER BY t RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING)
), lk AS (SELECT member, start, slope FROM lw WHERE n = 12 AND start <= last - 12),
a AS (SELECT k.member, start, (slope > th)::INT AS e FROM k JOIN (SELECT member, avg(slope) + stddev_pop(slope) AS th FROM k GROUP BY member) x ON k.member = x.member),
b AS (SELECT lk.member, start, (slope > th)::INT AS e FROM lk JOIN (SELECT member, avg(slope) + stddev_pop(slope) AS th FROM lk GROUP BY member) x ON lk.member = x.member)"""


def two_event_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    out = []
    for s in (base.series(spark, sf), base.second_series(spark, sf)):
        k = T.sliding_slopes(s, 12, keys=["member"], t="t")
        out.append(E.classified(k, E.trend_thresholds(k, keys=["member"]), on=["member"]))
    return out[0], out[1]


@query(f"WITH {TWO} SELECT a.start, sum(a.e)::BIGINT AS n_a, sum(b.e)::BIGINT AS n_b, sum(a.e * b.e)::BIGINT AS n_both FROM a JOIN b ON a.member = b.member AND a.start = b.start GROUP BY a.start")
def joint_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of two series per window, over the windows that both have."""
    return E.events_per_window(*two_event_sets(spark, sf), keys=["member"])


@query(f"""WITH {TWO}, j AS (SELECT sum(a.e)::BIGINT AS a, sum(b.e)::BIGINT AS b, sum(a.e * b.e)::BIGINT AS both FROM a JOIN b ON a.member = b.member AND a.start = b.start)
SELECT a, b, "both", round("both" / nullif(a, 0), 6) AS of_a, round("both" / nullif(b, 0), 6) AS of_b FROM j""".replace("AS both", 'AS "both"'))
def joint_shares(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.overlap(E.events_per_window(*two_event_sets(spark, sf), keys=["member"])))


@query(f"""WITH {TWO}, h AS (SELECT 'all' AS period, member, e FROM a UNION ALL SELECT CASE WHEN start < 40 THEN 'early' ELSE 'late' END, member, e FROM a),
m AS (SELECT period, member, avg(e::DOUBLE) AS share, sum(e) AS n, count(*) AS w FROM h GROUP BY period, member)
SELECT period, round(sum(n) / sum(w), 6) AS frequency, round(avg(share), 6) AS mean, round(median(share), 6) AS median, round(min(share), 6) AS low, round(max(share), 6) AS high, round(stddev_pop(share), 6) AS std FROM m GROUP BY period""")
def event_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.event_frequency(two_event_sets(spark, sf)[0], cut=40))


@query(f"""WITH {C}, {G}, {SQL_BOXES} SELECT member, year, month, region, round(sum(coalesce(value * cos(radians(lat)), 0)) / sum(cos(radians(lat))), 6) AS value
FROM c JOIN g ON c.cell_id = g.cell_id JOIN boxes ON lat BETWEEN a AND b AND lon BETWEEN x AND y GROUP BY member, year, month, region""")
def regional_means(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted means of several boxes in one pass."""
    return rounded(D.box_means(base.cells(spark, sf), base.grid(spark, sf), BOXES, keys=["member", "year", "month"]))


@query(f"WITH {C} SELECT member, year, month, cell_id, round(value - avg(value) OVER (PARTITION BY year, month, cell_id), 6) AS value FROM c")
def demeaned_field(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.demean(base.cells(spark, sf).drop("label"), keys=["year", "month", "cell_id"]))


@query(f"WITH {S} SELECT member, t, round((value - avg(CASE WHEN year BETWEEN 1996 AND 1999 THEN value END) OVER (PARTITION BY member, month)) / 997, 6) AS anomaly FROM s")
def monthly_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.anomalies(base.series(spark, sf), keys=["member", "month"], base=(1996, 1999)).select("member", "t", (F.col("anomaly") / UNIT).alias("anomaly")))


@query(f"WITH {S} SELECT member, t, round(value / stddev_pop(CASE WHEN year BETWEEN 1996 AND 1999 THEN value END) OVER (PARTITION BY member), 6) AS value FROM s")
def normalized_series(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.normalized(base.series(spark, sf), keys=["member"], base=(1996, 1999)).select("member", "t", "value"))


@query(f"WITH {C} SELECT member, year, cell_id, round(avg(value), 6) AS value FROM c WHERE month IN (6, 7, 8) GROUP BY member, year, cell_id HAVING count(DISTINCT month) = 3")
def season_field(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.season_means(base.cells(spark, sf), "JJA", keys=["member", "year", "cell_id"]))


@query(f"WITH {C}, m AS (SELECT member, year, cell_id, avg(value) AS v FROM c WHERE month IN (6, 7, 8) GROUP BY ALL HAVING count(DISTINCT month) = 3) SELECT year, cell_id, round(avg(v), 6) AS value FROM m GROUP BY year, cell_id")
def forced_season_field(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.forced_season(base.cells(spark, sf), "JJA", keys=["year", "cell_id"]))


@query(f"""WITH {C}, {G}, {SQL_BOXES}, m AS (SELECT member, year, month, region, sum(coalesce(value * cos(radians(lat)), 0)) / sum(cos(radians(lat))) AS v
FROM c JOIN g ON c.cell_id = g.cell_id JOIN boxes ON lat BETWEEN a AND b AND lon BETWEEN x AND y GROUP BY ALL)
SELECT year, month, region, round(avg(v), 6) AS value FROM m GROUP BY year, month, region""")
def forced_regions(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.forced_region(base.cells(spark, sf), base.grid(spark, sf), BOXES, keys=["year", "month"]))


@query(f"""WITH {C}, {G} SELECT member, year, month, round(coalesce(sum(CASE WHEN value >= 0.15 THEN area END), 0) / 1e12, 6) AS extent, round(coalesce(sum(value * area), 0) / 1e12, 6) AS area
FROM c JOIN g ON c.cell_id = g.cell_id WHERE lat >= 50 GROUP BY member, year, month""")
def ice_extent_area(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.ice_metrics(base.cells(spark, sf), base.grid(spark, sf), keys=["member", "year", "month"]))


@query(f"""WITH {C}, {G}, a AS (SELECT member, year, month, lon, sum(value * cos(radians(lat))) / sum(cos(radians(lat))) AS v FROM c JOIN g ON c.cell_id = g.cell_id GROUP BY ALL),
b AS (SELECT member, year, month, avg(v) AS v FROM a GROUP BY ALL) SELECT member, year, round(avg(v), 6) AS value FROM b GROUP BY member, year HAVING count(*) = 12""")
def global_annual_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.annual_global_mean(base.cells(spark, sf), base.grid(spark, sf)))


@query(f"""WITH {S}, x AS (SELECT member, t, row_number() OVER w AS i, count(*) OVER (PARTITION BY member) AS n, sum(value) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v,
 first_value(value) OVER w AS a, last_value(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM s WINDOW w AS (PARTITION BY member ORDER BY t))
SELECT member, t, round((v + greatest(3 - i, 0) * a + greatest(i + 2 - n, 0) * z) / 5 / 997, 6) AS smoothed FROM x""")
def moving_means(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.smoothed(base.series(spark, sf), 5, keys=["member"]).select("member", "t", (F.col("smoothed") / UNIT).alias("smoothed")))


@query(f"""WITH {O}, h AS (SELECT event_type, t, CASE WHEN t IN (10, 11) THEN NULL ELSE value END AS value FROM o),
f AS (SELECT event_type, count(*)::DOUBLE AS s0, sum(x) AS s1, sum(x * x) AS s2, sum(x * x * x) AS s3, sum(x * x * x * x) AS s4, sum(y) AS y0, sum(x * y) AS y1, sum(x * x * y) AS y2
 FROM (SELECT event_type, (t - 10)::DOUBLE AS x, value AS y FROM h WHERE t BETWEEN 7 AND 14 AND value IS NOT NULL) GROUP BY event_type),
d AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det FROM f),
q AS (SELECT event_type, (y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2)) / det AS c0,
 (s0 * (y1 * s4 - s3 * y2) - y0 * (s1 * s4 - s3 * s2) + s2 * (s1 * y2 - y1 * s2)) / det AS c1,
 (s0 * (s2 * y2 - y1 * s3) - s1 * (s1 * y2 - y1 * s2) + y0 * (s1 * s3 - s2 * s2)) / det AS c2 FROM d)
SELECT h.event_type, t, round(coalesce(value, c0 + c1 * (t - 10) + c2 * (t - 10) * (t - 10)), 4) AS value FROM h JOIN q ON h.event_type = q.event_type""")
def gap_filled(spark: SparkSession, sf: str) -> DataFrame:
    """A record with days 10 and 11 taken out and filled by a quadratic fit of their surroundings."""
    held = base.observed(spark, sf).withColumn("value", F.when(~F.col("t").isin(10, 11), F.col("value")))
    return rounded(T.filled_gaps(held, [10, 11], keys=["event_type"]).select("event_type", "t", "value"), 4)


RUNS = f"""{S}, z AS (SELECT member, t, (value - avg(value) OVER (PARTITION BY member)) / stddev_pop(value) OVER (PARTITION BY member) AS v FROM s),
x AS (SELECT *, CASE WHEN v >= 0.2 THEN 1 WHEN v <= -0.2 THEN -1 ELSE 0 END AS sg FROM z), y AS (SELECT *, t - row_number() OVER (PARTITION BY member, sg ORDER BY t) AS g FROM x),
runs AS (SELECT member, t, v, CASE WHEN count(*) OVER (PARTITION BY member, sg, g) >= 3 THEN sg ELSE 0 END::TINYINT AS label FROM y)"""


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    s = base.series(spark, sf)
    z = D.anomalies(s, keys=["member"], base=None, name="value").select("member", "t", "year", "value")
    return T.run_labels(D.normalized(z, keys=["member"], base=(0, 9999)), 0.2, 3, keys=["member"])


@query(f"WITH {RUNS} SELECT member, t, label FROM runs")
def run_phases(spark: SparkSession, sf: str) -> DataFrame:
    return labelled(spark, sf).select("member", "t", "label")


@query(f"""WITH {RUNS}, n AS (SELECT *, (coalesce(lag(label) OVER (PARTITION BY member ORDER BY t), 0) <> label)::INT AS new FROM runs),
m AS (SELECT *, sum(new) OVER (PARTITION BY member ORDER BY t) AS run FROM n) SELECT member, label, min(t) AS "first", max(t) AS "last" FROM m WHERE label <> 0 GROUP BY member, run, label""")
def phase_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return T.phase_intervals(labelled(spark, sf), keys=["member"])


@query(f"""WITH {S}, f AS (SELECT member, regr_intercept(value, t::DOUBLE) AS i, regr_slope(value, t::DOUBLE) AS k FROM s GROUP BY member)
SELECT s.member, t, round(i + k * t, 4) AS fitted, round(value - (i + k * t), 4) AS residual FROM s JOIN f ON s.member = f.member""")
def detrended(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.detrended(base.series(spark, sf), keys=["member"], fitted="fitted").select("member", "t", "fitted", "residual"), 4)


@query(f"""WITH {S}, e AS (SELECT t, avg(value) AS f FROM s GROUP BY t), j AS (SELECT member, s.t, value AS o, f FROM s JOIN e ON s.t = e.t),
a AS (SELECT member, regr_slope(o, t::DOUBLE) AS so, regr_slope(f, t::DOUBLE) AS sf, avg(o) AS mo, avg(f) AS mf, avg(t) AS mx FROM j GROUP BY member)
SELECT j.member, t, round(o - ((f - mf - sf * (t - mx)) + (mo + so * (t - mx))), 4) AS residual FROM j JOIN a ON j.member = a.member""")
def forced_corrected(spark: SparkSession, sf: str) -> DataFrame:
    """Each member as an observation, corrected by the ensemble mean shifted to its mean and trend."""
    s = base.series(spark, sf)
    forced = s.select("member", "t").join(s.groupBy("t").agg(F.avg("value").alias("value")), "t")
    return rounded(T.forced_corrected(s, forced, keys=["member"]), 4)


@query(f"WITH {SLOPES} SELECT member, start, round(slope - avg(slope) OVER (PARTITION BY start), 4) AS anomaly FROM k")
def window_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.window_anomalies(slopes(spark, sf), window=["start"]).select("member", "start", "anomaly"), 4)


@query(f"WITH {SLOPES} SELECT k.member, k.start, (k.start + i)::INT AS t, round((value + slope * i) / 997, 6) AS level FROM k JOIN s ON k.member = s.member AND k.start = s.t, range(0, 12) r(i)")
def trend_segments(spark: SparkSession, sf: str) -> DataFrame:
    out = T.trend_segments(slopes(spark, sf), base.series(spark, sf).select("member", F.col("t").alias("year"), "value"), 12, keys=["member"])
    return rounded(out.select("member", "start", "t", (F.col("level") / UNIT).alias("level")))


@query(f"""WITH {SLOPES}, m AS (SELECT member, avg(slope) + stddev_pop(slope) AS th FROM k GROUP BY member)
SELECT k.member, k.start, round(CASE WHEN slope > th THEN value / 997 END, 6) AS start_value FROM k JOIN m ON k.member = m.member JOIN s ON k.member = s.member AND k.start = s.t""")
def values_at_start(spark: SparkSession, sf: str) -> DataFrame:
    k = slopes(spark, sf)
    e = E.classified(k, E.trend_thresholds(k, keys=["member"]), on=["member"])
    out = T.value_at_start(e, base.series(spark, sf).select("member", F.col("t").alias("year"), "value"), keys=["member"])
    return rounded(out.select("member", "start", (F.col("start_value") / UNIT).alias("start_value")))


TARGET = "tg AS (SELECT cell_id, lat * 0.8 + 1.25 AS lat, lon * 0.7 + 3.5 AS lon FROM g)"


def target(spark: SparkSession, sf: str) -> DataFrame:
    """An off-set grid inside the source's extent."""
    return base.grid(spark, sf).select("cell_id", (F.col("lat") * 0.8 + 1.25).alias("lat"), (F.col("lon") * 0.7 + 3.5).alias("lon"))


NEAR = f"""{C}, {G}, {TARGET}, d AS (SELECT t.cell_id AS tid, g.cell_id AS sid, sqrt((t.lat - g.lat) ** 2 + (t.lon - g.lon) ** 2) AS d FROM tg t, g),
n AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY d, sid) AS r FROM d)"""


@query(f"WITH {NEAR} SELECT member, year, month, tid AS cell_id, round(value, 6) AS value FROM c JOIN n ON c.cell_id = n.sid WHERE r = 1")
def nearest_regrid(spark: SparkSession, sf: str) -> DataFrame:
    w = X.nearest_weights(target(spark, sf), base.grid(spark, sf))
    return rounded(X.regridded(base.cells(spark, sf), w, keys=["member", "year", "month"]))


@query(f"""WITH {NEAR}, w AS (SELECT tid, sid, (1 / (d + 1e-10)) / sum(1 / (d + 1e-10)) OVER (PARTITION BY tid) AS w FROM n WHERE r <= 4)
SELECT member, year, month, tid AS cell_id, round(sum(value * w) / sum(w), 6) AS value FROM c JOIN w ON c.cell_id = w.sid GROUP BY member, year, month, tid""")
def inverse_distance_regrid(spark: SparkSession, sf: str) -> DataFrame:
    w = X.nearest_weights(target(spark, sf), base.grid(spark, sf), k=4)
    return rounded(X.regridded(base.cells(spark, sf), w, keys=["member", "year", "month"]))


@query(f"""WITH {C}, {G}, {TARGET}, b AS (SELECT cell_id, lat, lon, floor((lat + 70) / 20)::INT AS i, floor(lon / 45)::INT AS j FROM tg WHERE lat BETWEEN -70 AND 70 AND lon BETWEEN 0 AND 315),
f AS (SELECT cell_id, least(i, 6) AS i, least(j, 6) AS j, (lat + 70) / 20 - least(i, 6) AS fy, lon / 45 - least(j, 6) AS fx FROM b),
w AS (SELECT cell_id AS tid, i * 8 + j AS sid, (1 - fy) * (1 - fx) AS w FROM f UNION ALL SELECT cell_id, i * 8 + j + 1, (1 - fy) * fx FROM f UNION ALL SELECT cell_id, i * 8 + j + 8, fy * (1 - fx) FROM f UNION ALL SELECT cell_id, i * 8 + j + 9, fy * fx FROM f)
SELECT member, year, month, tid AS cell_id, round(CASE WHEN count(value) = 4 THEN sum(value * w) END, 6) AS value FROM c JOIN w ON c.cell_id = w.sid GROUP BY member, year, month, tid""")
def bilinear_regrid(spark: SparkSession, sf: str) -> DataFrame:
    w = X.bilinear_weights(target(spark, sf), base.grid(spark, sf))
    return rounded(X.regridded(base.cells(spark, sf), w, keys=["member", "year", "month"], corners=4))


@query(f"""WITH {S}, z AS (SELECT member, t, (value - avg(value) OVER (PARTITION BY member)) / stddev_pop(value) OVER (PARTITION BY member) AS v FROM s)
SELECT member, t, (1995 + t // 12)::INT AS year, ['JAN','FEB','MAR','APR','MAY','JUN','JUL','AUG','SEP','OCT','NOV','DEC'][t % 12 + 1] AS month, sign(v)::TINYINT AS sign,
 CASE WHEN v >= 0.4 THEN 1 WHEN v <= -0.4 THEN -1 ELSE 0 END::TINYINT AS inclusive, CASE WHEN v > 1 THEN 1 WHEN v < -1 THEN -1 ELSE 0 END::TINYINT AS strict, CASE WHEN v > 0 THEN 1 ELSE -1 END::TINYINT AS two_phase,
 round(greatest(least(v, 1), -1), 6) AS clipped, round(CASE WHEN v > 0 THEN v ELSE 0 END, 6) AS positive FROM z""")
def index_labels(spark: SparkSession, sf: str) -> DataFrame:
    s = D.anomalies(base.series(spark, sf), keys=["member"], base=None, name="value")
    v = F.col("value")
    z = D.normalized(s, keys=["member"], base=(0, 9999))
    out = z.select("member", "t", K.year_of(F.col("t"), 1995).alias("year"), K.month_label(K.month_of(F.col("t"))).alias("month"), K.sign_label(v).alias("sign"), K.phase_label(v, 0.4).alias("inclusive"), K.phase_label(v, 1.0, inclusive=False).alias("strict"), K.two_phase_label(v).alias("two_phase"), K.clipped(v, -1.0, 1.0).alias("clipped"), K.positive(v).alias("positive"))
    return rounded(out)


@query(f"""WITH {C}, {G} SELECT member, year, month, c.cell_id, round(CASE WHEN land = 0 THEN value END, 6) AS ocean, round(CASE WHEN land = 1 THEN -10 ELSE value END, 6) AS filled, round(CASE WHEN land = 1 THEN 0 ELSE value END, 6) AS unfilled FROM c JOIN g ON c.cell_id = g.cell_id""")
def land_masks(spark: SparkSession, sf: str) -> DataFrame:
    held = D.with_grid(base.cells(spark, sf), base.grid(spark, sf).select("cell_id", "land")).withColumn("value", F.col("value").cast("double"))
    filled = K.fill_land(F.col("value"), F.col("land"))
    return rounded(held.select("member", "year", "month", "cell_id", K.ocean(F.col("value"), F.col("land")).alias("ocean"), filled.alias("filled"), K.unfill(filled).alias("unfilled")))


CURVE = f"""{P}, a AS (SELECT split, y_prob AS threshold, sum(y_true) AS p, count(*) AS n FROM p GROUP BY ALL),
b AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS predicted, sum(p) OVER (PARTITION BY split) AS positives, sum(n) OVER (PARTITION BY split) AS total FROM a WINDOW w AS (PARTITION BY split ORDER BY threshold DESC)),
curve AS (SELECT *, tp / predicted AS "precision", coalesce(tp / nullif(positives, 0), 0) AS recall FROM b)"""


@query(f"""WITH {CURVE} SELECT split, threshold, tp::BIGINT AS tp, predicted::BIGINT AS predicted, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0), 6) AS f1 FROM curve""")
def pr_curves(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.curve_f1(R.pr_curve(base.scores(spark, sf), keys=["split"])).select("split", "threshold", "tp", "predicted", "precision", "recall", "f1"))


BEST = f"""{CURVE}, best AS (SELECT split, threshold, "precision" AS precision_at, recall AS recall_at FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY abs("precision" - recall), threshold) AS r FROM curve) WHERE r = 1)"""


@query(f"WITH {BEST} SELECT split, threshold, round(precision_at, 6) AS precision_at, round(recall_at, 6) AS recall_at FROM best")
def best_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.optimal_thresholds(R.pr_curve(base.scores(spark, sf), keys=["split"]), keys=["split"]))


METRICS = f"""{BEST}, ar AS (SELECT split, sum("precision" * (recall - prev)) AS auprc, sum(p * ((total - predicted) - (positives - tp) + (n - p) / 2.0)) / nullif(max(positives) * (max(total) - max(positives)), 0) AS auroc
 FROM (SELECT *, coalesce(lag(recall) OVER (PARTITION BY split ORDER BY threshold DESC), 0) AS prev FROM curve) GROUP BY split),
h AS (SELECT p.split, y_true::DOUBLE AS y, y_prob AS q, (y_prob >= threshold)::INT AS hit, least(greatest(y_prob, 1e-15), 1 - 1e-15) AS c FROM p JOIN best ON p.split = best.split),
m AS (SELECT split, sum(y * hit) AS tp, sum((1 - y) * hit) AS fp, sum(y * (1 - hit)) AS fn, sum((1 - y) * (1 - hit)) AS tn, avg((q - y) ** 2) AS brier, avg(-(y * ln(c) + (1 - y) * ln(1 - c))) AS log_loss, avg(y) AS prevalence FROM h GROUP BY split),
metrics AS (SELECT m.split, auprc, auroc, brier, coalesce(tp / nullif(tp + fp, 0), 0) AS "precision", coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + tn) / (tp + fp + fn + tn) AS accuracy,
 threshold, precision_at, recall_at, prevalence, log_loss, coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0) AS mcc FROM m JOIN ar ON m.split = ar.split JOIN best ON m.split = best.split)"""


@query(f"""WITH {METRICS} SELECT split, round(auprc, 6) AS auprc, round(auroc, 6) AS auroc, round(brier, 6) AS brier, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f1, 6) AS f1, round(accuracy, 6) AS accuracy,
 round(threshold, 6) AS threshold, round(precision_at, 6) AS precision_at, round(recall_at, 6) AS recall_at, round(prevalence, 6) AS prevalence, round(log_loss, 6) AS log_loss, round(mcc, 6) AS mcc FROM metrics""")
def score_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.metric_set(base.scores(spark, sf), keys=["split"]))


@query(f"""WITH {METRICS}, lm AS (UNPIVOT metrics ON COLUMNS(* EXCLUDE (split)) INTO NAME metric VALUE value)
SELECT metric, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS low, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.975), 6) AS high FROM lm GROUP BY metric""")
def metric_summary(spark: SparkSession, sf: str) -> DataFrame:
    m = R.long_metrics(R.metric_set(base.scores(spark, sf), keys=["split"]), keys=["split"])
    return rounded(R.metric_intervals(m, keys=["metric"]))


@query(f"""WITH {P} SELECT split, phase, CASE WHEN y_true = yp THEN 'T' ELSE 'F' END || CASE WHEN yp = 1 THEN 'P' ELSE 'N' END AS outcome, count(*) AS n FROM (SELECT *, (y_prob >= 0.4)::INT AS yp FROM p) GROUP BY ALL""")
def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    s = base.scores(spark, sf).withColumn("y_pred", K.binarize(F.col("y_prob"), 0.4))
    return s.groupBy("split", "phase", K.outcome(F.col("y_true"), F.col("y_pred")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {P} SELECT split, y_true, (y_prob >= 0.4)::TINYINT AS y_pred, count(*) AS n FROM p GROUP BY ALL")
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return R.confusion(base.scores(spark, sf).withColumn("y_pred", K.binarize(F.col("y_prob"), 0.4)), keys=["split"])


@query(f"WITH {P} SELECT phase, run, round(avg((y_prob >= 0.4)::INT), 6) AS share, count(*) AS models, (avg((y_prob >= 0.4)::INT) >= 0.5)::TINYINT AS event FROM p GROUP BY phase, run")
def vote_shares(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.votes(base.scores(spark, sf).withColumn("y_pred", K.binarize(F.col("y_prob"), 0.4)), keys=["phase", "run"]))


@query(f"WITH {P} SELECT doc_id, y_true::INT AS actual, (y_true = 1 AND y_prob >= 0.4)::INT AS hit, (y_true = 0 AND y_prob >= 0.4)::INT AS false_alarm FROM p")
def skill(spark: SparkSession, sf: str) -> DataFrame:
    return R.skill_table(base.scores(spark, sf).withColumn("y_pred", K.binarize(F.col("y_prob"), 0.4)), keys=["doc_id"])


@query(f"WITH {P} SELECT phase, round(sqrt(avg((y_prob - y_true) ** 2)) / nullif(stddev_pop(y_true), 0), 6) AS nrmse, round(covar_pop(y_prob, y_true) / nullif(stddev_pop(y_prob) * stddev_pop(y_true), 0), 6) AS pearson FROM p GROUP BY phase")
def fit_quality(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.fit_quality(base.scores(spark, sf), keys=["phase"], predicted="y_prob", observed="y_true"))


@query("""SELECT split, CASE WHEN c_custkey % 10 = split THEN 'te' WHEN c_custkey % 10 = split + 1 THEN 'va' ELSE 'tr' END AS part, count(*) AS n, round(sum(c_acctbal), 2) AS total
FROM customer, range(0, 9) r(split) GROUP BY ALL""")
def block_splits(spark: SparkSession, sf: str) -> DataFrame:
    s = B.with_splits(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), member="c_custkey")
    return rounded(s.groupBy(F.col("split").cast("long").alias("split"), "part").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("total")), 2)


@query(f"""WITH {C}, {G}, x AS (SELECT split::INT AS split, CASE WHEN member = split THEN 'te' WHEN member = split + 1 THEN 'va' ELSE 'tr' END AS part, member, year, month, c.cell_id, land, value FROM c JOIN g ON c.cell_id = g.cell_id, range(0, 9) r(split)),
s AS (SELECT split, avg(value) AS mu, stddev_pop(value) AS sigma FROM x WHERE part = 'tr' AND land = 0 GROUP BY split)
SELECT x.split, part, member, year, month, cell_id, round(CASE WHEN land = 1 THEN -10 ELSE (value - mu) / sigma END, 6) AS z FROM x JOIN s ON x.split = s.split""")
def standardized_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Nine splits of the cells, standardised by their training part's ocean, land filled."""
    held = D.with_grid(base.cells(spark, sf), base.grid(spark, sf).select("cell_id", "land"))
    s = B.with_splits(held)
    z = B.standardized(s, keys=["split"], where=(F.col("part") == "tr") & (F.col("land") == 0)).withColumn("z", K.fill_land(F.col("z"), F.col("land")))
    return rounded(z.select("split", "part", "member", "year", "month", "cell_id", "z"))


@query(f"""WITH {P}, n AS (SELECT split, y_true, count(*) AS n FROM p GROUP BY ALL)
SELECT split, y_true, n, round(sum(n) OVER (PARTITION BY split) / (count(*) OVER (PARTITION BY split) * n) * CASE WHEN y_true = 1 THEN 1.5 ELSE 1 END, 6) AS weight FROM n""")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.class_weights(base.scores(spark, sf), keys=["split"], label="y_true"))


@query(f"WITH {P} SELECT split, run, count(*) AS n, sum(y_true)::BIGINT AS positives, round(avg(y_true), 6) AS prevalence FROM p GROUP BY split, run")
def prevalence(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(B.prevalence(base.scores(spark, sf), keys=["split", "run"], label="y_true"))


@query(f"""WITH {C}, q AS (SELECT member, year, month, quantile_cont(abs(value), 0.97) AS p FROM c GROUP BY ALL)
SELECT c.member, c.year, c.month, cell_id, round(CASE WHEN p > 0 THEN greatest(least(value / p, 1), -1) ELSE value END, 6) AS scaled FROM c JOIN q ON c.member = q.member AND c.year = q.year AND c.month = q.month""")
def scaled_maps(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.percentile_scaled(base.cells(spark, sf), keys=["member", "year", "month"]).select("member", "year", "month", "cell_id", "scaled"))


@query(f"""WITH {C}, q AS (SELECT label, quantile_cont(value, 0.97) AS p FROM c GROUP BY label)
SELECT member, year, month, cell_id, round(CASE WHEN p > 0 THEN greatest(least(value / p, 1), 0) ELSE value END, 6) AS scaled FROM c JOIN q ON c.label = q.label""")
def shared_scale_maps(spark: SparkSession, sf: str) -> DataFrame:
    """One scale for all maps of a label."""
    return rounded(D.percentile_scaled(base.cells(spark, sf), keys=["label"], absolute=False).select("member", "year", "month", "cell_id", "scaled"))


@query(f"WITH {C} SELECT label, cell_id, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, count(value) AS n FROM c GROUP BY label, cell_id")
def class_composites(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.composites(base.cells(spark, sf), keys=["label", "cell_id"]))


@query(f"WITH {C}, m AS (SELECT member, label, cell_id, avg(CASE WHEN value > 0 THEN value ELSE 0 END) AS v FROM c GROUP BY ALL) SELECT label, cell_id, round(avg(v), 6) AS mean, count(v) AS models FROM m GROUP BY label, cell_id")
def model_composites(spark: SparkSession, sf: str) -> DataFrame:
    """Positive relevance by model, then over models."""
    held = base.cells(spark, sf).withColumn("value", K.positive(F.col("value").cast("double")))
    return rounded(D.mean_of_means(held, model=["member"], keys=["label", "cell_id"]))


@query(f"WITH {C} SELECT cell_id, round(avg((abs(value) > 0.15)::INT), 6) AS absolute, round(avg((value > 0.15)::INT - (value < -0.15)::INT), 6) AS signed FROM c GROUP BY cell_id")
def exceedance(spark: SparkSession, sf: str) -> DataFrame:
    c = base.cells(spark, sf)
    a = D.exceedance(c, 0.15, keys=["cell_id"]).withColumnRenamed("frequency", "absolute")
    b = D.exceedance(c, 0.15, keys=["cell_id"], mode="signed").withColumnRenamed("frequency", "signed")
    return rounded(a.join(b, "cell_id"))


@query(f"WITH {C} SELECT member, round(min(value), 6) AS low, round(avg(value), 6) AS mean, round(max(value), 6) AS high FROM c GROUP BY member")
def map_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(D.value_range(base.cells(spark, sf), keys=["member"]))


@query(f"""WITH {P}, e AS (SELECT phase, min(y_prob) AS lo, max(y_prob) AS hi, count(*) AS total FROM p GROUP BY phase),
b AS (SELECT p.phase, least(floor((y_prob - lo) / ((hi - lo) / 30)), 29)::INT AS bin, lo, hi, total FROM p JOIN e ON p.phase = e.phase WHERE hi > lo)
SELECT phase, bin, round(lo + bin * ((hi - lo) / 30), 6) AS low, round(lo + (bin + 1) * ((hi - lo) / 30), 6) AS high, count(*) AS n, round(count(*) / (total * ((hi - lo) / 30)), 6) AS density FROM b GROUP BY phase, bin, lo, hi, total""")
def histograms(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Q.histogram(base.scores(spark, sf), 30, keys=["phase"], value="y_prob"))


@query("SELECT event_type, floor(value / 10)::BIGINT AS bin, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL")
def integer_histograms(spark: SparkSession, sf: str) -> DataFrame:
    return Q.integer_histogram(table(spark, sf, "events").select("event_type", (F.col("value") / 10).alias("value")), keys=["event_type"])


JOINT = f"{S}, {L}, j AS (SELECT s.member, s.t, s.value AS a, l.value AS b FROM s JOIN l ON s.member = l.member AND s.t = l.t)"


def joint(spark: SparkSession, sf: str) -> DataFrame:
    a, b = base.series(spark, sf), base.second_series(spark, sf)
    return a.select("member", "t", F.col("value").alias("a")).join(b.select("member", "t", F.col("value").alias("b")), ["member", "t"])


@query(f"""WITH {JOINT}, e AS (SELECT min(a) AS x0, max(a) AS x1, min(b) AS y0, max(b) AS y1 FROM j), u AS (SELECT (a - x0) / (x1 - x0) * 40 AS u, (b - y0) / (y1 - y0) * 23 AS v FROM j, e),
h AS (SELECT *, (u - floor(u + 0.5)) ** 2 + 3 * (v - floor(v + 0.5)) ** 2 < (u - floor(u) - 0.5) ** 2 + 3 * (v - floor(v) - 0.5) ** 2 AS f FROM u)
SELECT (CASE WHEN f THEN floor(u + 0.5) ELSE floor(u) + 0.5 END)::DOUBLE AS hex_i, (CASE WHEN f THEN floor(v + 0.5) ELSE floor(v) + 0.5 END)::DOUBLE AS hex_j, count(*) AS n FROM h GROUP BY ALL""")
def hexagon_counts(spark: SparkSession, sf: str) -> DataFrame:
    return Q.hexagons(joint(spark, sf), "a", "b")


@query(f"""WITH {JOINT}, s0 AS (SELECT count(*) AS n, var_samp(a) * count(*) ** (-1.0 / 3) AS vx, var_samp(b) * count(*) ** (-1.0 / 3) AS vy, covar_samp(a, b) * count(*) ** (-1.0 / 3) AS c,
 quantile_cont(a, 0.005) AS x0, quantile_cont(a, 0.995) AS x1, quantile_cont(b, 0.005) AS y0, quantile_cont(b, 0.995) AS y1 FROM j),
q AS (SELECT i::INT AS gi, k::INT AS gj, x0 + (x1 - x0) * i / 199 AS x, y0 + (y1 - y0) * k / 199 AS y, n, vx, vy, c, vx * vy - c * c AS det FROM s0, range(0, 200) r(i), range(0, 200) r2(k))
SELECT gi, gj, round(x / 997, 6) AS x, round(y / 997, 6) AS y, round(1e9 * sum(exp(-0.5 * (vy * (x - a) ** 2 - 2 * c * (x - a) * (y - b) + vx * (y - b) ** 2) / det)) / (2 * pi() * sqrt(any_value(det)) * any_value(n)), 4) AS density FROM q, j GROUP BY gi, gj, x, y""")
def density_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Kernel density of two series on 200 x 200 points, per 1e9."""
    out = Q.kernel_density(joint(spark, sf), "a", "b")
    return rounded(out.withColumns({"density": F.col("density") * 1e9, "x": F.col("x") / UNIT, "y": F.col("y") / UNIT}), 4, x=6, y=6)


@query(f"WITH {JOINT} SELECT member, round(corr(a, b), 6) AS r, count(*) AS n, round(regr_slope(b, a), 6) AS slope, round(regr_intercept(b, a), 4) AS intercept, round(regr_r2(b, a), 6) AS r2 FROM j GROUP BY member")
def series_correlation(spark: SparkSession, sf: str) -> DataFrame:
    j = joint(spark, sf)
    return rounded(Q.correlation(j, "a", "b", keys=["member"]).drop("t").join(Q.least_squares(j, "a", "b", keys=["member"]), "member"), intercept=4)


@query(f"WITH {P} SELECT phase, count(*) AS n, sum(y_true)::BIGINT AS n_y_true, round(avg(y_true), 6) AS p_y_true, sum(toxic)::BIGINT AS n_toxic, round(avg(toxic), 6) AS p_toxic FROM p GROUP BY phase")
def phase_composition(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Q.composition(base.scores(spark, sf), phase="phase", events=["y_true", "toxic"]))


@query("""WITH e AS (SELECT r_regionkey, n_nationkey, printf('%d-%d.parquet', r_regionkey, n_nationkey) AS file FROM region, nation WHERE n_regionkey = r_regionkey),
x AS (SELECT DISTINCT printf('%d-%d.parquet', n_regionkey, n_nationkey) AS file FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_quantity > 49)
SELECT r_regionkey, n_nationkey, e.file, x.file IS NOT NULL AS present FROM e LEFT JOIN x ON e.file = x.file""")
def chunk_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Expected chunks (regions by nations) and whether shipments of 50 were seen for them."""
    name = F.format_string("%d-%d.parquet", "n_regionkey", "n_nationkey")
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    expected = r.join(n, r.r_regionkey == n.n_regionkey).select("r_regionkey", "n_nationkey", name.alias("file"))
    li = table(spark, sf, "lineitem").where("l_quantity > 49").select("l_suppkey").distinct()
    s = table(spark, sf, "supplier")
    seen = li.join(s, li.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey).select(name.alias("file")).distinct()
    gone = catalog.missing_files(expected, seen).withColumn("present", F.lit(False))
    return catalog.present_files(expected, seen).withColumn("present", F.lit(True)).unionByName(gone)


@query("""SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY t) - 1)::INT AS epoch, round(v, 4) AS loss, round(w, 4) AS val_loss
FROM (SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE) AS t, sum(value) AS v, max(value) AS w FROM events GROUP BY ALL)""")
def learning_curves(spark: SparkSession, sf: str) -> DataFrame:
    """Histories as arrays by epoch, back to rows."""
    o = table(spark, sf, "events").groupBy("event_type", F.datediff(F.col("ts").cast("date"), F.lit(base.DAY0).cast("date")).alias("t")).agg(F.sum("value").alias("v"), F.max("value").alias("w"))
    packed = o.groupBy("event_type").agg(F.array_sort(F.collect_list(F.struct("t", "v", "w"))).alias("x"))
    history = packed.select("event_type", F.col("x.v").alias("loss"), F.col("x.w").alias("val_loss"))
    return rounded(R.learning_curves(history, keys=["event_type"]), 4)


@query("""WITH r AS (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand), u AS (SELECT p_brand, -count(*) AS n FROM part WHERE p_size > 25 GROUP BY p_brand HAVING count(*) % 2 = 0)
SELECT p_brand, n::BIGINT AS n FROM r WHERE p_brand NOT IN (SELECT p_brand FROM u) UNION ALL SELECT p_brand, n::BIGINT FROM u""")
def registry_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """A registry of brands with some rows replaced."""
    p = table(spark, sf, "part")
    registry = p.groupBy("p_brand").agg(F.count("*").alias("n"))
    changes = p.where("p_size > 25").groupBy("p_brand").agg((-F.count("*")).alias("n")).where("n % 2 = 0")
    return catalog.upsert(registry, changes, key="p_brand")


@query("""WITH e AS (SELECT n_nationkey, n_name || '.parquet' AS file FROM nation), x AS (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE n_name END || '.parquet' AS file FROM nation JOIN supplier ON s_nationkey = n_nationkey)
SELECT n_nationkey, e.file, coalesce(a.file, b.file) AS "found" FROM e LEFT JOIN x a ON e.file = a.file LEFT JOIN x b ON lower(e.file) = b.file""")
def resolved_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files by their name or its lower-case form."""
    n = table(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit(".parquet")).alias("file"))
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct()
    seen = n.join(s, "n_nationkey").select(F.when(F.col("n_nationkey") % 2 == 0, F.lower("file")).otherwise(F.col("file")).alias("file"))
    return catalog.resolved(n, seen)


@query(f"""WITH {C} SELECT cell_id, (value = 0)::TINYINT AS land FROM c WHERE member = 0 AND year = 2000 AND month = 1""")
def first_step_mask(spark: SparkSession, sf: str) -> DataFrame:
    return D.land_mask(base.cells(spark, sf).where("member = 0 AND year = 2000 AND month = 1"))


@query(f"""WITH {C}, m AS (SELECT member, year, cell_id, avg(value) AS v FROM c WHERE month IN (6, 7, 8) GROUP BY ALL HAVING count(DISTINCT month) = 3)
SELECT member, year, cell_id, round(v - avg(v) OVER (PARTITION BY year, cell_id), 6) AS value FROM m""")
def seasonal_features(spark: SparkSession, sf: str) -> DataFrame:
    """Season means of each member without the ensemble mean: the model's features."""
    return rounded(I.seasonal_features(base.cells(spark, sf).drop("label")))


INDEX_BASE = (2000, 2002)
INDEX_BOXES = {"a": (-30.0, 30.0, 0.0, 180.0), "b": (-90.0, 30.0, 45.0, 270.0), "c": (-30.0, 90.0, 90.0, 315.0)}


def sql_box(name: str, series: str) -> str:
    """Ensemble index series of one box up to the base-period anomalies."""
    a, b, x, y = INDEX_BOXES[name]
    return f"""{series}0 AS (SELECT member, year, month, year * 12 + month - 1 AS t, sum(v * cos(radians(lat))) / sum(cos(radians(lat))) AS v FROM dm JOIN g ON dm.cell_id = g.cell_id WHERE lat BETWEEN {a} AND {b} AND lon BETWEEN {x} AND {y} GROUP BY member, year, month),
{series} AS (SELECT member, t, year, v - avg(CASE WHEN year BETWEEN 2000 AND 2002 THEN v END) OVER (PARTITION BY member, month) AS v FROM {series}0)"""


def sql_smooth(src: str, out: str, keys: str = "member") -> str:
    return f"""{out}0 AS (SELECT {keys}, t, year, row_number() OVER w AS i, count(*) OVER (PARTITION BY {keys}) AS n, sum(v) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s, first_value(v) OVER w AS a,
 last_value(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY t)),
{out}1 AS (SELECT {keys}, t, year, (s + greatest(3 - i, 0) * a + greatest(i + 2 - n, 0) * z) / 5 AS v FROM {out}0),
{out} AS (SELECT {keys}, t, v / stddev_pop(CASE WHEN year BETWEEN 2000 AND 2002 THEN v END) OVER (PARTITION BY {keys}) AS v FROM {out}1)"""


DEMEANED = f"{C}, {G}, dm AS (SELECT member, year, month, cell_id, value - avg(value) OVER (PARTITION BY year, month, cell_id) AS v FROM c)"


@query(f"""WITH {DEMEANED}, {sql_box("a", "ia")}, {sql_smooth("ia", "ib")}, x AS (SELECT member, t, v, CASE WHEN v >= 0.4 THEN 1 WHEN v <= -0.4 THEN -1 ELSE 0 END AS sg FROM ib),
y AS (SELECT *, t - row_number() OVER (PARTITION BY member, sg ORDER BY t) AS k FROM x)
SELECT member, t::INT AS t, round(v, 6) AS value, CASE WHEN count(*) OVER (PARTITION BY member, sg, k) >= 3 THEN sg ELSE 0 END::TINYINT AS label FROM y""")
def ensemble_index(spark: SparkSession, sf: str) -> DataFrame:
    """Regional index with run-length labels: demean, box mean, anomalies, smooth, normalise, label."""
    out = I.nino34(base.cells(spark, sf), base.grid(spark, sf), base=INDEX_BASE, boxes={"a": INDEX_BOXES["a"]}, length=3)
    return rounded(out.select("member", "t", "value", "label"))


@query(f"""WITH {DEMEANED}, {sql_box("a", "ia")}, {sql_smooth("ia", "ib")} SELECT member, t::INT AS t, round(v, 6) AS value, CASE WHEN v > 1 THEN 1 WHEN v < -1 THEN -1 ELSE 0 END::TINYINT AS label FROM ib""")
def strict_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same with strict labels, by the fast path: box means first, then the ensemble mean."""
    out = I.arctic(base.cells(spark, sf).drop("label"), base.grid(spark, sf), base=INDEX_BASE, boxes={"a": INDEX_BOXES["a"]}, fast=True)
    return rounded(out.select("member", "t", "value", "label"))


@query(f"""WITH {DEMEANED}, {sql_box("a", "xa")}, {sql_box("b", "xb")}, {sql_box("c", "xc")},
w AS (SELECT xa.member, xa.t, xa.year, xa.v AS a, xb.v AS b, xc.v AS c, CASE WHEN xa.v * xc.v > 0 THEN 0.4 ELSE 0 END AS k FROM xa JOIN xb ON xa.member = xb.member AND xa.t = xb.t JOIN xc ON xa.member = xc.member AND xa.t = xc.t),
u AS (SELECT 'a' AS idx, member, t, year, a AS v FROM w UNION ALL SELECT 'b', member, t, year, b FROM w UNION ALL SELECT 'c', member, t, year, c FROM w UNION ALL SELECT 'n_ct', member, t, year, a - k * c FROM w UNION ALL SELECT 'n_wp', member, t, year, c - k * a FROM w),
{sql_smooth("u", "z", "idx, member")} SELECT idx AS "index", member, t::INT AS t, round(v, 6) AS value, CASE WHEN v >= 0.4 THEN 1 WHEN v <= -0.4 THEN -1 ELSE 0 END::TINYINT AS label FROM z""")
def index_flavours(spark: SparkSession, sf: str) -> DataFrame:
    """Three box indices and the pair split of two of them."""
    out = I.enso_flavours(base.cells(spark, sf).drop("label"), base.grid(spark, sf), base=INDEX_BASE, boxes=INDEX_BOXES)
    return rounded(out.select("index", "member", "t", "value", "label"))


def sql_filter(source: str, out: str, cutoff_years: float) -> str:
    """Tables for ``WITH RECURSIVE``: the zero-phase filter of ``source`` (member, t, v) by its recurrence, step by step."""
    b, a = chebyshev(4, 0.05, 2 / (12 * cutoff_years))
    z, pad = steady(b, a), 15
    y = f"({b[0]!r} * x + s0)"
    state = ", ".join(f"{f's{k + 1} + ' if k < 3 else ''}{b[k + 1]!r} * x - {a[k + 1]!r} * {y} AS s{k}" for k in range(4)).replace("np.float64(", "(")
    y = y.replace("np.float64(", "(")
    start = ", ".join(f"{float(z[k])!r} * x AS s{k}" for k in range(4))

    def passed(name: str, extended: str) -> str:
        return f"""{name} AS (SELECT member, n, i, {y} AS y, {state} FROM (SELECT *, {start} FROM {extended} WHERE i = 0)
UNION ALL SELECT member, n, i, {y} AS y, {state} FROM (SELECT e.member, e.n, e.i, e.x, s0, s1, s2, s3 FROM {name} f JOIN {extended} e ON e.member = f.member AND e.i = f.i + 1))"""

    return f"""{out}_p AS (SELECT member, t, v, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY member) AS n, first_value(v) OVER w AS f, first_value(v) OVER (PARTITION BY member ORDER BY t DESC) AS l FROM {source} WINDOW w AS (PARTITION BY member ORDER BY t)),
{out}_e AS (SELECT member, n, p + {pad} AS i, v AS x FROM {out}_p UNION ALL SELECT member, n, {pad} - p, 2 * f - v FROM {out}_p WHERE p BETWEEN 1 AND {pad} UNION ALL SELECT member, n, n + {pad} + n - 2 - p, 2 * l - v FROM {out}_p WHERE p BETWEEN n - 1 - {pad} AND n - 2),
{passed(f"{out}_f", f"{out}_e")},
{out}_r AS (SELECT member, n, n + {2 * pad} - 1 - i AS i, y AS x FROM {out}_f),
{passed(f"{out}_b", f"{out}_r")},
{out} AS (SELECT p.member, p.t, p.v, b.y AS filtered FROM {out}_p p JOIN {out}_b b ON b.member = p.member AND b.i = p.n + {pad} - 1 - p.p)"""


def sql_tripole_series(source: str) -> str:
    """Tripole of the anomalies of every cell of ``source`` (member, year, month, cell_id, v), as tables up to tp (member, t, v)."""
    box = lambda n: f"sum(CASE WHEN lat BETWEEN {INDEX_BOXES[n][0]} AND {INDEX_BOXES[n][1]} AND lon BETWEEN {INDEX_BOXES[n][2]} AND {INDEX_BOXES[n][3]} THEN v * cos(radians(lat)) END) / sum(CASE WHEN lat BETWEEN {INDEX_BOXES[n][0]} AND {INDEX_BOXES[n][1]} AND lon BETWEEN {INDEX_BOXES[n][2]} AND {INDEX_BOXES[n][3]} THEN cos(radians(lat)) END)"
    return f"""an AS (SELECT member, year, month, cell_id, v - avg(CASE WHEN year BETWEEN 2000 AND 2002 THEN v END) OVER (PARTITION BY member, month, cell_id) AS v FROM {source}),
tp AS (SELECT member, (year * 12 + month - 1)::INT AS t, {box("a")} - 0.5 * ({box("b")} + {box("c")}) AS v FROM an JOIN g ON an.cell_id = g.cell_id GROUP BY member, year, month)"""


@query(f"""WITH RECURSIVE {C}, {G}, dm AS (SELECT member, year, month, cell_id, value - avg(value) OVER (PARTITION BY year, month, cell_id) AS v FROM c), {sql_tripole_series("dm")}, {sql_filter("tp", "lp", 1.5)}
SELECT member, t, round(v, 6) AS value, round(filtered, 6) AS filtered, sign(round(filtered, 9))::TINYINT AS label FROM lp""")
def tripole_index(spark: SparkSession, sf: str) -> DataFrame:
    """Tripole of per-cell anomalies, raw and low-passed, with the sign of the latter."""
    out = I.ipo(base.cells(spark, sf).drop("label"), base.grid(spark, sf), base=INDEX_BASE, cutoff_years=1.5, boxes=INDEX_BOXES)
    label = K.sign_label(F.round("filtered", 9))  # what is 0 but for its last bits has no sign
    return rounded(out.select("member", F.col("t").cast("int").alias("t"), "value", "filtered", label.alias("label")))


@query(f"WITH RECURSIVE {S}, x AS (SELECT member, t, value AS v FROM s), {sql_filter('x', 'lp', 2.0)} SELECT member, t, round(filtered / 997, 6) AS filtered FROM lp")
def lowpassed_series(spark: SparkSession, sf: str) -> DataFrame:
    """Every member's series, low-passed at two years."""
    out = lowpass(base.series(spark, sf), keys=["member"], cutoff_years=2.0)
    return rounded(out.select("member", "t", (F.col("filtered") / UNIT).alias("filtered")))


@query()
def phase_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """P(event | phase) with bootstrap intervals: random draws, so no SQL."""
    s = base.scores(spark, sf)
    one = Q.bootstrap_shares(s, phase="phase", event="y_true").select("phase", "p", "low", "high", F.lit("samples").alias("kind"))
    two = Q.nested_bootstrap_shares(s, phase="phase", event="y_true", run="run").select("phase", "p", "low", "high", F.lit("runs").alias("kind"))
    return rounded(one.unionByName(two))


@query()
def phase_variance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(Q.variance_explained(base.scores(spark, sf), phase="phase", event="y_true"))


def sql_tests(source: str, keys: str) -> str:
    """Chi-squared with Yates' correction and its p, Fisher's p, and the logistic effect of a phase x of 0 and 1 on an event y, by keys of ``source``."""
    return f"""k AS (SELECT {keys}, sum(y * x)::DOUBLE AS e1, sum(x)::DOUBLE AS n1, sum(y * (1 - x))::DOUBLE AS e0, sum(1 - x)::DOUBLE AS n0 FROM {source} GROUP BY ALL),
m AS (SELECT *, e0 + e1 AS e, n0 + n1 AS n FROM k),
c AS (SELECT *, (abs(e0 - n0 * e / n) - least(0.5, abs(e0 - n0 * e / n))) ** 2 * (1 / (n0 * e / n) + 1 / (n0 * (n - e) / n) + 1 / (n1 * e / n) + 1 / (n1 * (n - e) / n)) AS chi2 FROM m),
f AS (SELECT {keys}, sum(CASE WHEN lp <= lo + 1e-7 THEN exp(lp - mx) ELSE 0 END) / sum(exp(lp - mx)) AS fisher_p FROM (SELECT *, max(lp) OVER (PARTITION BY {keys}) AS mx, max(CASE WHEN i = e0 THEN lp END) OVER (PARTITION BY {keys}) AS lo
FROM (SELECT {keys}, i, e0, -(lgamma(i + 1) + lgamma(e - i + 1) + lgamma(n0 - i + 1) + lgamma(n - e - n0 + i + 1)) AS lp FROM m, range(0, 100000) r(i) WHERE i BETWEEN greatest(0, e + n0 - n) AND least(e, n0))) GROUP BY {keys}),
t AS (SELECT {keys}, sum(exp(i * ln(2) + (2 * i + 1) * ln(sqrt(chi2 / 2)) - (lgamma(2 * i + 2) - i * ln(2) - lgamma(i + 1)))) AS s FROM c, range(0, 400) r(i) GROUP BY {keys}),
o AS (SELECT *, e1 > 0 AND e0 > 0 AND e1 < n1 AND e0 < n0 AS whole, ln(e1 * (n0 - e0) / (e0 * (n1 - e1))) AS b, sqrt(1 / e1 + 1 / (n1 - e1) + 1 / e0 + 1 / (n0 - e0)) AS se FROM m),
l AS (SELECT {keys}, 1 - (e1 * ln(e1 / n1) + (n1 - e1) * ln(1 - e1 / n1) + e0 * ln(e0 / n0) + (n0 - e0) * ln(1 - e0 / n0)) / (e * ln(e / n) + (n - e) * ln(1 - e / n)) AS r2 FROM m)
SELECT c.{keys}, round(chi2, 5) AS chi2, 1 AS dof, round(1 - 2 / sqrt(pi()) * exp(-chi2 / 2) * s, 6) AS p, round(fisher_p, 6) AS fisher_p, CASE WHEN whole THEN round(exp(b), 5) END AS odds_ratio, CASE WHEN whole THEN round(exp(b - 1.959963984540054 * se), 5) END AS low, CASE WHEN whole THEN round(exp(b + 1.959963984540054 * se), 5) END AS high, CASE WHEN whole THEN round(r2, 6) END AS r2
FROM c JOIN f ON c.{keys} = f.{keys} JOIN t ON c.{keys} = t.{keys} JOIN o ON c.{keys} = o.{keys} JOIN l ON c.{keys} = l.{keys}"""


def both_tests(df: DataFrame, *, phase: str, event: str, key: str) -> DataFrame:
    out = Q.contingency(df, phase=phase, event=event, keys=[key]).join(Q.logistic_effect(df, phase=phase, event=event, keys=[key]), key)
    return rounded(out, 5, p=6, fisher_p=6, r2=6)


@query(f"WITH {P}, x AS (SELECT 'toxic' AS phase, toxic AS x, y_true AS y FROM p), {sql_tests('x', 'phase')}")
def phase_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Chi-squared, exact test and logistic effect of toxicity on quality."""
    return both_tests(base.scores(spark, sf).withColumn("phase", F.lit("toxic")), phase="toxic", event="y_true", key="phase")


@query(f"WITH {P}, x AS (SELECT phase, run AS x, (doc_id % 7 < 3)::INT AS y FROM p), {sql_tests('x', 'phase')}")
def grouped_tests(spark: SparkSession, sf: str) -> DataFrame:
    """The same tests of run by an event, for every language at once."""
    s = base.scores(spark, sf).withColumn("event", (F.col("doc_id") % 7 < 3).cast("int"))
    return both_tests(s, phase="run", event="event", key="phase")


SPLITS = list(range(9))


def labelled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return B.with_splits(e.select("vec_id", F.col("vec_id").cast("int").alias("member"), (F.col("label") < 5).cast("int").alias("label"), F.col("embedding").alias("features")))


@query()
def classifier_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A classifier per split and its scores on every part: iterative, so no SQL."""
    _, scores = M.train_all(labelled_vectors(spark, sf), SPLITS, keys=["vec_id"])
    return rounded(scores, 4)


@query()
def linear_relevance(spark: SparkSession, sf: str) -> DataFrame:
    """Relevance of every cell for each split's classifier."""
    s = labelled_vectors(spark, sf)
    models, _ = M.train_all(s, SPLITS, keys=["vec_id"])
    told = [M.linear_relevance(models[k], s.where(F.col("split") == k), keys=["split", "vec_id"]) for k in SPLITS]
    return rounded(reduce(DataFrame.unionByName, told), 4)


@query()
def clustered_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells clustered over all members' scaled maps, ordered by mean, on the grid: iterative, so no SQL."""
    maps = base.cells(spark, sf).groupBy("member", "cell_id").agg(F.avg(F.col("value").cast("double")).alias("value"))
    return rounded(M.cluster_ensemble(maps, base.grid(spark, sf), 3, model="member"))


@query()
def cluster_scan(spark: SparkSession, sf: str) -> DataFrame:
    maps = base.cells(spark, sf).groupBy("member", "cell_id").agg(F.avg(F.col("value").cast("double")).alias("value"))
    return rounded(M.cluster_scan(M.pixel_features(maps, model="member")), 4)


@query(f"""WITH {C} SELECT cell_id, member, round(avg(value), 6) AS value FROM c GROUP BY cell_id, member""")
def pixel_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of each cell over the members, as rows."""
    maps = base.cells(spark, sf).groupBy("member", "cell_id").agg(F.avg(F.col("value").cast("double")).alias("value"))
    return rounded(M.pixel_features(maps, model="member").select("cell_id", F.posexplode("features").alias("member", "value")))
