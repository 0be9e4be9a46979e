"""Registered queries of the typed tables: each is written to the shared folder and read back by its schema, with oracle SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.functions import columns as K
from driftgrid.operators import events as E
from driftgrid.operators import fields as D
from driftgrid.operators import networks as N
from driftgrid.operators import scoring as R
from driftgrid.operators import series as T
from driftgrid.operators import spatial as X
from driftgrid.plans import base
from driftgrid.plans import indices as I
from driftgrid.plans.base import C, G, O, OC, S
from driftgrid.plans.queries import INDEX_BOXES, METRICS, TARGET, UNIT, target
from driftgrid.plans.registry import query, rounded
from driftgrid.session import scratch, table
from driftgrid.sources import tables


def stored(df: DataFrame, name: str, *, by: list[str], **equal: object) -> DataFrame:
    """``df`` written as the table ``name`` by ``by``, and what a reader finds there."""
    spark = df.sparkSession
    out = scratch(spark, name)
    tables.write_table(tables.typed(df, name), out, by=by)
    return tables.read_typed(spark, name, out, **equal)


@query(f"WITH {S} SELECT member, year, round(avg(value) / 997, 5) AS value FROM s WHERE year IN (1996, 1999) GROUP BY member, year")
def annual_store(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly means of every member; two years read."""
    s = base.series(spark, sf).groupBy("member", "year").agg(F.avg("value").alias("value"))
    return rounded(stored(s, "annual", by=["year"], year=[1996, 1999]).withColumn("value", F.col("value") / UNIT), 5)


@query(f"WITH {G} SELECT cell_id, i, j, lat::DOUBLE AS lat, lon::DOUBLE AS lon, area::DOUBLE AS area, land::TINYINT AS land FROM g")
def grid_store(spark: SparkSession, sf: str) -> DataFrame:
    """A grid with its geometry, read from its table."""
    return stored(base.grid(spark, sf), "grid", by=[])


@query(f"""WITH {S}, k AS (SELECT member, month, year AS start_year, count(value) OVER w AS n, regr_slope(value, year::DOUBLE) OVER w AS slope, max(year) OVER (PARTITION BY member, month) AS last FROM s
WINDOW w AS (PARTITION BY member, month ORDER BY year RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING)), ok AS (SELECT * FROM k WHERE n >= 3 AND start_year <= last - 3),
th AS (SELECT month, avg(slope) + stddev_pop(slope) AS threshold FROM ok GROUP BY month)
SELECT member, start_year, (slope > threshold)::TINYINT AS event, round(slope / 997, 5) AS slope, round(threshold / 997, 5) AS threshold, round(CASE WHEN slope > threshold THEN slope / 997 END, 5) AS event_slope
FROM ok JOIN th ON ok.month = th.month WHERE ok.month = 6 AND start_year BETWEEN 1996 AND 1998""")
def event_store(spark: SparkSession, sf: str) -> DataFrame:
    """Trend events with slopes and thresholds, written by variable and month; one month's labels of three years read, slopes of events apart."""
    k = T.sliding_slopes(base.series(spark, sf), 3, keys=["member", "month"])
    e = E.classified(k, E.trend_thresholds(k, keys=["month"]), on=["month"]).withColumns({"variable": F.lit("price"), "start_year": F.col("start")})
    out = scratch(spark, "events")
    tables.write_table(tables.typed(e, "events"), out, by=["variable", "month"])
    got = tables.read_labels(spark, out, variable="price", month=6, years=(1996, 1998))
    slope, threshold = F.col("slope") / UNIT, F.col("threshold") / UNIT
    return rounded(got.select("member", "start_year", "event", slope.alias("slope"), threshold.alias("threshold"), K.event_value(slope, F.col("event")).alias("event_slope")), 5)


@query("""WITH x AS (SELECT vec_id, k - 1 AS i, embedding[k]::DOUBLE AS x FROM embeddings, range(1, 65) r(k) WHERE k <= len(embedding))
SELECT (vec_id % 3)::INT AS split, (vec_id % 2)::INT AS run, (vec_id % 10)::INT AS member, (vec_id // 10)::INT AS year, i::INT AS cell_id, round((x * sin(i))::FLOAT::DOUBLE, 4) AS relevance FROM x WHERE vec_id % 3 = 1 AND vec_id % 2 = 0""")
def attribution_store(spark: SparkSession, sf: str) -> DataFrame:
    """Relevance of every cell for a model with given weights, written by split and run; one model's read."""
    e = table(spark, sf, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0]
    keys = {"split": F.col("vec_id") % 3, "run": F.col("vec_id") % 2, "member": F.col("vec_id") % 10, "year": F.expr("vec_id div 10")}
    told = N.dense_relevance(e.select(*(c.cast("int").alias(k) for k, c in keys.items()), "embedding"), [(np.sin(np.arange(width))[:, None], np.zeros(1))], keys=list(keys), features="embedding")
    return rounded(stored(told, "attributions", by=["split", "run"], split=1, run=0), 4)


@query(f"""WITH {METRICS}, lm AS (UNPIVOT metrics ON COLUMNS(* EXCLUDE (split)) INTO NAME metric VALUE value) SELECT split, 'te' AS part, 0 AS run, metric, round(value, 6) AS value FROM lm WHERE split IN (0, 2)""")
def metric_store(spark: SparkSession, sf: str) -> DataFrame:
    """Thirteen metrics of every split as rows, written by split and part; two splits read."""
    m = R.long_metrics(R.metric_set(base.scores(spark, sf), keys=["split"]), keys=["split"]).withColumns({"part": F.lit("te"), "run": F.lit(0)})
    return rounded(stored(m, "metrics", by=["split", "part"], split=[0, 2], part="te"))


@query(f"""WITH {C}, m AS (SELECT member, year, cell_id, avg(value) AS v FROM c WHERE month IN (6, 7, 8) GROUP BY ALL HAVING count(DISTINCT month) = 3)
SELECT year, cell_id, round(avg(v)::FLOAT::DOUBLE, 5) AS value FROM m WHERE year IN (2000, 2002) GROUP BY year, cell_id""")
def forced_store(spark: SparkSession, sf: str) -> DataFrame:
    """The forced season field, written by year; two years read."""
    f = D.forced_season(base.cells(spark, sf), "JJA", keys=["year", "cell_id"])
    return rounded(stored(f, "forced_field", by=["year"], year=[2000, 2002]), 5)


@query(f"""WITH {C}, {G}, {OC}, {TARGET}, d AS (SELECT tg.cell_id AS tid, g.cell_id AS sid, row_number() OVER (PARTITION BY tg.cell_id ORDER BY sqrt((tg.lat - g.lat) ** 2 + (tg.lon - g.lon) ** 2), g.cell_id) AS r FROM tg, g)
SELECT year, month, tid AS cell_id, round(value, 6) AS value FROM oc JOIN d ON oc.cell_id = d.sid WHERE r = 1 AND month IN (2, 9)""")
def regridded_store(spark: SparkSession, sf: str) -> DataFrame:
    """An observed field on another grid, written by month; two months read."""
    w = X.nearest_weights(target(spark, sf), base.grid(spark, sf))
    out = X.regridded(base.observed_cells(spark, sf).select("year", "month", "cell_id", "value"), w, keys=["year", "month"])
    return rounded(stored(out, "regridded", by=["month"], month=[2, 9]))


@query(f"""WITH {O}, k AS (SELECT event_type, t AS start, count(value) OVER w AS n, regr_slope(value, t::DOUBLE) OVER w AS slope, max(t) OVER (PARTITION BY event_type) AS last FROM o
WINDOW w AS (PARTITION BY event_type ORDER BY t RANGE BETWEEN CURRENT ROW AND 5 FOLLOWING)) SELECT event_type, start, round(slope, 4) AS slope, n FROM k WHERE n >= 6 AND start <= last - 6 AND start >= 10""")
def trends_from_a_step(spark: SparkSession, sf: str) -> DataFrame:
    """Trends of windows from a given step on; a step that no series has would be an error."""
    return rounded(T.sliding_slopes(base.observed(spark, sf), 6, keys=["event_type"], t="t", start=10), 4)


def sql_corrected(source: str, keys: str) -> str:
    """Residual of ``source`` (keys, t, o, f): observed minus the forced signal with the observed mean and trend."""
    return f"""fit AS (SELECT {keys}, regr_slope(o, t::DOUBLE) AS so, regr_slope(f, t::DOUBLE) AS sf, avg(o) AS mo, avg(f) AS mf, avg(t) AS mx FROM {source} WHERE o IS NOT NULL AND f IS NOT NULL GROUP BY {keys}),
rs AS (SELECT {source}.*, o - ((f - mf - sf * (t - mx)) + (mo + so * (t - mx))) AS v, (f - mf) + mo AS shifted, (f - mf - sf * (t - mx)) + (mo + so * (t - mx)) AS corrected FROM {source} JOIN fit ON {source}.{keys} = fit.{keys})"""


@query(f"""WITH {C}, {G}, {OC}, m AS (SELECT year, cell_id, avg(value) AS v FROM oc WHERE month IN (6, 7, 8) GROUP BY ALL HAVING count(DISTINCT month) = 3),
fm AS (SELECT member, year, cell_id, avg(value) AS v FROM c WHERE month IN (6, 7, 8) GROUP BY ALL HAVING count(DISTINCT month) = 3), ff AS (SELECT year, cell_id, avg(v) AS v FROM fm GROUP BY year, cell_id),
h AS (SELECT m.year AS t, m.cell_id, land, CASE WHEN land = 0 THEN m.v END AS o, ff.v AS f FROM m JOIN g ON m.cell_id = g.cell_id JOIN ff ON m.year = ff.year AND m.cell_id = ff.cell_id),
{sql_corrected("h", "cell_id")}, w AS (SELECT h.t, h.cell_id, h.land, rs.v FROM h LEFT JOIN rs ON h.t = rs.t AND h.cell_id = rs.cell_id), st AS (SELECT avg(v) AS mu, stddev_pop(v) AS sigma FROM w WHERE land = 0)
SELECT t AS year, cell_id, round(CASE WHEN land = 1 THEN -10 ELSE (v - mu) / nullif(sigma, 0) END, 4) AS value FROM w, st""")
def observed_input_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    """Model input of one observed field with the ensemble's forced field, corrected cell by cell, taken out."""
    forced = D.forced_season(base.cells(spark, sf), "JJA", keys=["year", "cell_id"])
    return rounded(I.observed_input(base.observed_cells(spark, sf), base.grid(spark, sf), "ensmean", forced=forced), 4)


def _region(source: str) -> str:
    a, b, x, y = INDEX_BOXES["a"]
    return f"SELECT member, year * 12 + month - 1 AS t, sum(value * cos(radians(lat))) / sum(cos(radians(lat))) AS v FROM {source} JOIN g ON {source}.cell_id = g.cell_id WHERE lat BETWEEN {a} AND {b} AND lon BETWEEN {x} AND {y} GROUP BY member, year, month"


@query(f"""WITH {C}, {G}, {OC}, ob AS ({_region("oc")}), fm AS ({_region("c")}), fo AS (SELECT t, avg(v) AS v FROM fm GROUP BY t), x AS (SELECT ob.member, ob.t, ob.v AS o, fo.v AS f FROM ob JOIN fo ON ob.t = fo.t), {sql_corrected("x", "member")}
SELECT t::INT AS t, round(o, 6) AS observed, round(f, 6) AS forced, round(shifted, 6) AS forced_shifted, round(corrected, 6) AS forced_corrected, round(v, 6) AS residual FROM rs""")
def residual_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """What the corrected observed index is made from: both series over their common months, the forced one shifted and corrected, the residual."""
    box = {"a": INDEX_BOXES["a"]}
    forced = I.forced_arctic(base.cells(spark, sf), base.grid(spark, sf), box)
    out = I.residual_diagnostics(base.observed_cells(spark, sf), base.grid(spark, sf), forced, boxes=box)
    return rounded(out.select(F.col("t").cast("int").alias("t"), "observed", "forced", "forced_shifted", "forced_corrected", "residual"))
