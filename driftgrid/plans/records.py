"""Registered queries of sources, sinks, observed records and column rules, with oracle SQL.

A query of a sink writes to the shared folder and returns what a reader finds there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.functions import columns as K
from driftgrid.operators import events as E
from driftgrid.operators import fields as D
from driftgrid.operators import scoring as R
from driftgrid.operators import series as T
from driftgrid.operators import spatial as X
from driftgrid.operators import splits as B
from driftgrid.operators import statistics as Q
from driftgrid.plans import base
from driftgrid.plans import indices as I
from driftgrid.plans.base import C, G, L, O, OC, S
from driftgrid.plans.queries import INDEX_BASE, INDEX_BOXES, JOINT, UNIT, joint, sql_box, sql_filter, sql_smooth, sql_tripole_series
from driftgrid.plans.registry import query, rounded
from driftgrid.plans.trends import observed_series, observed_thresholds, warming_events
from driftgrid.session import scratch, table
from driftgrid.sources import catalog, ingest, tables

# Sources and sinks


@query("""SELECT 'ens.' || CASE WHEN start_year < 2015 THEN 'hist' ELSE 'future' END || '_' || lower(r_name) || '.' || printf('%04d.001', n_nationkey) || '.' || variable || '.' || start_year || '01-' || (start_year + 9) || '12.parquet' AS file, n_name, variable
FROM nation JOIN region ON n_regionkey = r_regionkey, (SELECT 1990 + 10 * i AS start_year FROM range(0, 4) r(i)), (SELECT unnest(['sst', 'aice']) AS variable)""")
def expected_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest of nations as members, four periods and two variables."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    code = F.format_string("%04d.001", "n_nationkey")
    members = n.join(r, n.n_regionkey == r.r_regionkey).select("n_name", code.alias("member_code"), F.lower("r_name").alias("member_group"))
    start = (F.lit(1990) + 10 * F.col("id")).cast("int")
    periods = spark.range(4).select(start.alias("start_year"), (start + 9).alias("end_year"), F.when(start < 2015, "hist").otherwise("future").alias("scenario"))
    variables = spark.range(2).select(F.when(F.col("id") == 0, "sst").otherwise("aice").alias("variable"), F.lit("atm").alias("component"))
    return catalog.manifest(members, periods, variables).select("file", "n_name", "variable")


@query(f"WITH {C} SELECT printf('%04d.001', member) AS member_code, 'sst' AS variable, year, month, cell_id, round(value::FLOAT, 5) AS value FROM c WHERE month IN (6, 7)")
def variable_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of members and years, combined, written by month and read for two months."""
    raw, out = scratch(spark, "chunks"), scratch(spark, "cells")
    c = base.cells(spark, sf).drop("label")
    chunk = F.format_string("ens.hist.%04d.001.sst.%d", "member", "year")
    c.withColumn("chunk", chunk).drop("member").write.partitionBy("chunk").parquet(raw)
    ingest.process_variable(spark, raw, out)
    return rounded(tables.read_cells(spark, out, variable="sst", months=[6, 7]).select("member_code", "variable", "year", "month", "cell_id", "value"), 5)


@query(f"""WITH {C} SELECT variable, member, year, month, cell_id, round((CASE WHEN variable = 'aice' THEN value * value WHEN month = 6 THEN value + 1 ELSE value END)::FLOAT, 5) AS value
FROM c, (SELECT unnest(['sst', 'aice']) AS variable)""")
def rewritten_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """Two variables written one after the other to one table, then one month of the first again: all else stays."""
    out = scratch(spark, "cells")
    c = base.cells(spark, sf).drop("label").withColumn("variable", F.lit("sst"))
    tables.write_table(c, out, by=["variable", "month"])
    tables.write_table(c.withColumns({"variable": F.lit("aice"), "value": F.col("value") * F.col("value")}), out, by=["variable", "month"])
    for _ in range(2):  # again changes nothing
        tables.write_table(c.where("month = 6").withColumn("value", F.col("value") + 1), out, by=["variable", "month"])
    return rounded(tables.read_cells(spark, out).select("variable", "member", "year", "month", "cell_id", F.col("value").cast("float").alias("value")), 5)


def chunk_table(spark: SparkSession, sf: str, path: str, years: tuple[int, int]) -> None:
    """The cells of some years as chunks of a member and two years each, a file each, added to ``path``."""
    c = base.cells(spark, sf).drop("label").where(F.col("year").between(*years))
    first = F.col("year") - F.col("year") % 2
    c = c.withColumn("chunk", F.format_string("ens.hist.%04d.001.sst.%d01-%d12", "member", first, first + 1)).drop("member")
    c.repartition("chunk").write.mode("append").partitionBy("chunk").parquet(path)


@query(f"WITH {C} SELECT printf('%04d.001', member) AS member_code, year, month, cell_id, round(value::FLOAT, 5) AS value FROM c")
def resumed_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks taken in by three runs: those of the first years, those of later ones, and none."""
    raw, out = scratch(spark, "chunks"), scratch(spark, "ingested")
    chunk_table(spark, sf, raw, (0, 2001))
    ingest.ingest(spark, raw, out)
    chunk_table(spark, sf, raw, (2002, 9999))
    ingest.ingest(spark, raw, out)
    return rounded(ingest.ingest(spark, raw, out).select("member_code", "year", "month", "cell_id", "value"), 5)


@query(f"""WITH {C}, h AS (SELECT printf('ens.hist.%04d.001.sst.%d01-%d12', member, year - year % 2, year - year % 2 + 1) AS file, year * 12 + month - 1 AS t FROM c)
SELECT file, min(t)::INT AS "first", max(t)::INT AS "last", count(*) AS "rows" FROM h GROUP BY file""")
def chunk_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """What the manifest says of every chunk that was taken in: its time range and rows."""
    raw, out = scratch(spark, "chunks"), scratch(spark, "ingested")
    chunk_table(spark, sf, raw, (0, 9999))
    files = ingest.chunk_files(spark, raw)
    ingest.ingest(spark, raw, out, expected=files.select("file").distinct())
    return ingest.known_chunks(spark, out).select("file", "first", "last", "rows")


@query(f"WITH {C} SELECT member, year, month, cell_id, round(value::FLOAT, 5) AS value FROM c WHERE member = 3 AND year BETWEEN 2000 AND 2001")
def member_cells(spark: SparkSession, sf: str) -> DataFrame:
    """One member's cells of two years from a table partitioned by variable, month and member."""
    out = scratch(spark, "cells")
    tables.write_table(base.cells(spark, sf).drop("label").withColumn("variable", F.lit("sst")), out, by=["variable", "member"], sort=["year"])
    return rounded(tables.read_cells(spark, out, variable="sst", member=3, years=(2000, 2001)).select("member", "year", "month", "cell_id", "value"), 5)


@query(f"WITH {S} SELECT member, year, month, round(value, 4) AS value FROM s WHERE month IN (1, 2)")
def series_store(spark: SparkSession, sf: str) -> DataFrame:
    """A series table written by month, two months read by schema."""
    out = scratch(spark, "series")
    tables.write_table(base.series(spark, sf).select("member", "year", "month", "value"), out, by=["month"], units={"value": "USD"})
    return rounded(tables.read_typed(spark, "series", out, month=[1, 2]), 4)


@query(f"WITH {S} SELECT member, year, month, round(value, 4) AS value FROM s WHERE month IN (3, 5)")
def present_months(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly tables at paths of their own; one that was never written is skipped."""
    out = scratch(spark, "months")
    s = base.series(spark, sf).select("member", "year", "month", "value")
    for month in (3, 5):
        tables.write_table(s.where(F.col("month") == month), f"{out}/{month}", by=[])
    return rounded(tables.read_where_present(spark, "series", [f"{out}/{m}" for m in (3, 4, 5)]), 4)


@query(f"WITH {O} SELECT event_type, t, round(value, 4) AS value FROM o")
def named_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Three columns of a wider table, by name."""
    out = scratch(spark, "wide")
    tables.write_table(base.observed(spark, sf).withColumns({"event_type2": F.col("event_type"), "other": F.lit(1)}), out, by=[])
    return rounded(tables.read_columns(spark, out, ["event_type", "t", "value"]), 4)


@query(f"""WITH {S}, m AS (SELECT year, month, avg(value) AS value FROM s GROUP BY year, month), f AS (SELECT year FROM m GROUP BY year HAVING count(*) = 12)
SELECT year, month, round(value, 4) AS value FROM m WHERE year IN (SELECT year FROM f)""")
def complete_series(spark: SparkSession, sf: str) -> DataFrame:
    """The forced series of the complete years, written only because each has twelve months."""
    out = scratch(spark, "forced")
    m = base.series(spark, sf).groupBy("year", "month").agg(F.avg("value").alias("value"))
    years = m.groupBy("year").count().where("count = 12").select("year")
    m = m.join(years, "year").withColumn("series", F.lit("all"))
    tables.write_complete(m, out, keys=["series"], years=years.count(), by=[])
    return rounded(tables.read_columns(spark, out, ["year", "month", "value"]), 4)


IDX = f"""{S}, i AS (SELECT * FROM (SELECT 'level' AS "index", member, year, month, value FROM s UNION ALL SELECT 'double', member, year, month, 2 * value FROM s))"""


def index_table(spark: SparkSession, sf: str) -> DataFrame:
    s = base.series(spark, sf).select(F.lit("orders").alias("source"), "member", "year", "month", "value", K.sign_label(F.col("value")).alias("label"))
    return s.withColumn("index", F.lit("level")).unionByName(s.withColumns({"index": F.lit("double"), "value": 2 * F.col("value")}))


@query(f"""WITH {IDX} SELECT "index", member, year, month, round(value, 4) AS value, 1 AS label FROM i WHERE "index" = 'double'""")
def index_store(spark: SparkSession, sf: str) -> DataFrame:
    """Indices with labels, written by source and index; one index read."""
    out = scratch(spark, "indices")
    tables.write_table(index_table(spark, sf), out, by=["source", "index"])
    got = tables.read_typed(spark, "indices", out, source="orders", index="double")
    return rounded(got.select("index", "member", "year", "month", "value", F.col("label").cast("int").alias("label")), 4)


@query(f"""WITH {IDX} SELECT member, year, "index", round(avg(value) / 997, 5) AS value FROM i WHERE month IN (6, 7, 8) GROUP BY ALL HAVING count(DISTINCT month) = 3""")
def seasonal_indices(spark: SparkSession, sf: str) -> DataFrame:
    """Season means of two indices and of one that isn't there and has no rows."""
    out = scratch(spark, "indices")
    tables.write_table(index_table(spark, sf), out, by=["source", "index"])
    got = tables.seasonal_indices(tables.read_typed(spark, "indices", out, source="orders"), ["level", "double", "absent"], "JJA")
    return rounded(got.withColumn("value", F.col("value") / UNIT), 5)


@query(f"""WITH {S}, k AS (SELECT month, avg(value) AS m, stddev_pop(value) AS d FROM s GROUP BY month)
SELECT month, round((m + d) / 997, 4) AS threshold, round((m + d) / m, 6) AS fraction FROM k WHERE month IN (1, 7)""")
def threshold_store(spark: SparkSession, sf: str) -> DataFrame:
    """Thresholds by calendar month with units, two months read."""
    out = scratch(spark, "thresholds")
    th = E.trend_thresholds(base.series(spark, sf), keys=["month"], value="value").select("month", "threshold", "fraction")
    tables.write_table(th, out, by=["month"], units={"threshold": "USD"})
    got = tables.read_typed(spark, "thresholds", out, month=[1, 7])
    return rounded(got.withColumn("threshold", F.col("threshold") / UNIT), 6, threshold=4)


@query("""WITH e AS (SELECT vec_id, vec_id % 10 AS member, label, split, CASE WHEN vec_id % 10 = split THEN 'te' WHEN vec_id % 10 = split + 1 THEN 'va' ELSE 'tr' END AS part, len(embedding) AS n, embedding FROM embeddings, range(0, 9) r(split))
SELECT split::INT AS split, part, member::INT AS member, (vec_id // 10)::INT AS year, label::INT AS label, n::INT AS n, round(embedding[1]::FLOAT, 5) AS "first" FROM e WHERE split IN (0, 4) AND part = 'va'""")
def sample_store(spark: SparkSession, sf: str) -> DataFrame:
    """Samples written by split and part; one part of two splits read."""
    out = scratch(spark, "samples")
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 10).cast("int").alias("member"), F.expr("CAST(vec_id div 10 AS INT)").alias("year"), F.col("label").cast("tinyint").alias("label"), F.col("embedding").cast("array<float>").alias("features"))
    tables.write_table(B.with_splits(e), out, by=["split", "part"])
    got = tables.read_typed(spark, "samples", out, split=[0, 4], part="va")
    return rounded(got.select("split", "part", "member", "year", F.col("label").cast("int").alias("label"), F.size("features").alias("n"), F.col("features")[0].alias("first")), 5)


@query(f"""WITH {C}, x AS (SELECT split::INT AS split, value FROM c, range(0, 9) r(split) WHERE member NOT IN (split, split + 1))
SELECT split, round(avg(value), 6) AS mu, round(stddev_pop(value), 6) AS sigma FROM x GROUP BY split""")
def split_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Means and deviations of every split's training part, written and read."""
    out = scratch(spark, "stats")
    st = B.split_statistics(base.cells(spark, sf))
    tables.write_table(st, out, by=["split"])
    return rounded(tables.read_typed(spark, "split_stats", out))


@query(f"WITH {base.P} SELECT split, run, count(*) AS n, round(avg(y_prob), 5) AS mean, sum(y_true)::BIGINT AS positives FROM p WHERE split IN (0, 2) AND run = 1 GROUP BY split, run")
def score_store(spark: SparkSession, sf: str) -> DataFrame:
    """Scores written by split and run; one run of two splits read."""
    out = scratch(spark, "scores")
    s = base.scores(spark, sf).select("split", "run", F.lit("te").alias("part"), F.col("doc_id").cast("int").alias("member"), F.lit(0).alias("year"), F.col("y_prob").cast("double").alias("y_prob"), F.col("y_true").cast("tinyint").alias("y_true"))
    tables.write_table(s, out, by=["split", "run"])
    got = tables.read_typed(spark, "scores", out, split=[0, 2], run=1)
    return rounded(got.groupBy("split", "run").agg(F.count("*").alias("n"), F.avg(F.col("y_prob").cast("double")).alias("mean"), F.sum(F.col("y_true").cast("long")).alias("positives")), 5)


@query("""WITH h AS (SELECT l_suppkey::INT AS split, l_linenumber::INT AS run, sum(l_quantity) AS q, max(l_extendedprice) AS e FROM lineitem GROUP BY ALL)
SELECT split, (row_number() OVER (PARTITION BY split ORDER BY run) - 1)::INT AS epoch, round(q, 4) AS loss, round(e, 4) AS val_loss FROM h""")
def history_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Training histories as JSON objects of arrays, read back to a row for each epoch."""
    out = scratch(spark, "history")
    h = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias("split"), "l_linenumber").agg(F.sum("l_quantity").cast("double").alias("q"), F.max("l_extendedprice").cast("double").alias("e"))
    packed = h.groupBy("split").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "q", "e"))).alias("x"))
    packed.select("split", F.lit(0).alias("run"), F.col("x.q").alias("loss"), F.col("x.e").alias("val_loss")).write.json(out)
    return rounded(R.learning_curves(tables.read_history(spark, out), keys=["split"]), 4)


@query("""WITH d AS (SELECT o_orderdate::DATE AS day, (o_custkey % 18) * 10.0 - 85 AS lat, (o_custkey % 36) * 10.0 AS lon, CASE WHEN o_totalprice < 2000 THEN NULL ELSE o_totalprice END AS value FROM orders),
l AS (SELECT max(year(day) * 12 + month(day)) AS last FROM d)
SELECT year(day)::INT AS year, month(day)::INT AS month, lat::DOUBLE AS lat, lon::DOUBLE AS lon, count(*) AS n, count(value) AS present, round(sum(value), 2) AS total FROM d, l WHERE year(day) * 12 + month(day) <= last - 6 AND year(day) BETWEEN 1996 AND 2000 GROUP BY ALL""")
def observed_files(spark: SparkSession, sf: str) -> DataFrame:
    """Day offsets to months, fill values missing, the last six months dropped."""
    out = scratch(spark, "observed")
    o = table(spark, sf, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1800-01-01").cast("date"))
    raw = o.select(day.alias("day_offset"), ((F.col("o_custkey") % 18) * 10.0 - 85).alias("lat"), ((F.col("o_custkey") % 36) * 10.0).alias("lon"), F.when(F.col("o_totalprice") < 2000, -9999.0).otherwise(F.col("o_totalprice").cast("double")).alias("value"))
    tables.write_table(raw, out, by=[])
    got = tables.read_observed(spark, out, years=(1996, 2000))
    return rounded(got.groupBy("year", "month", "lat", "lon").agg(F.count("*").alias("n"), F.count("value").alias("present"), F.sum("value").alias("total")), 2)


@query(f"WITH {S}, m AS (SELECT year, month, sum(value) AS value FROM s GROUP BY year, month) SELECT year, month, round(value / 997, 5) AS value FROM m WHERE year BETWEEN 1995 + month % 2 AND 2000 - month % 3")
def monthly_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve sheets, one a calendar month, each within its own years, as one series."""
    m = base.series(spark, sf).groupBy("year", "month").agg(F.sum("value").alias("extent"))
    sheets = {k: m.where(F.col("month") == k).select("year", "extent") for k in range(1, 13)}
    out = tables.read_monthly(sheets, "extent", {k: (1995 + k % 2, 2000 - k % 3) for k in sheets})
    return rounded(out.withColumn("value", F.col("value") / UNIT), 5)


@query("""WITH a AS (SELECT (row_number() OVER (ORDER BY r_regionkey) - 1)::INT AS i, r_regionkey * 30.0 - 60 AS lat FROM region), b AS (SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS j, n_nationkey * 14.4 - 180 AS lon FROM nation)
SELECT (i * (SELECT count(*) FROM b) + j)::INT AS cell_id, i, j, round(lat, 6)::DOUBLE AS lat, round(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END, 6)::DOUBLE AS lon FROM a, b""")
def mesh(spark: SparkSession, sf: str) -> DataFrame:
    """The mesh of two axes, regions by nations, with wrapped longitudes."""
    lats = table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("i"), (F.col("r_regionkey") * 30.0 - 60).alias("lat"))
    lons = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("j"), (F.col("n_nationkey") * 14.4 - 180).alias("lon"))
    return rounded(tables.grid_from_axes(lats, lons))


# Column rules


@query(f"""WITH {C}, {G} SELECT member, year, month, c.cell_id, (year BETWEEN 2000 AND 2001)::INT AS chosen, round(CASE WHEN value >= -0.1 THEN value END, 6) AS held, round(CASE WHEN NOT (year = 2000 AND month IN (1, 2)) THEN value END, 6) AS masked,
 round(value / 1e-3, 4) AS scaled, round(value * 2.5 + 1.5, 6) AS raw, round(lat, 6) AS lat, round(cos(radians(lon)) * cos(radians(lat)), 6) AS x, round(sin(radians(lon)) * cos(radians(lat)), 6) AS y
FROM c JOIN g ON c.cell_id = g.cell_id""")
def column_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Year selection, fill values, masked months, units, inverse standardisation and coordinates on the sphere."""
    c = D.with_grid(base.cells(spark, sf), base.grid(spark, sf).select("cell_id", "lat", "lon")).withColumn("value", F.col("value").cast("double"))
    v, (lat, x, y) = F.col("value"), K.on_sphere(F.col("lat"), F.col("lon"))
    rules = {
        "chosen": K.in_years(F.col("year"), 2000, 2001).cast("int"), "held": K.missing_below(v, -0.1), "masked": K.unless_month(v, F.col("year"), F.col("month"), {2000: (1, 2)}),
        "scaled": K.scaled(v, 1e-3), "raw": K.unstandardized(v, F.lit(1.5), F.lit(2.5)), "lat": lat, "x": x, "y": y,
    }
    return rounded(c.select("member", "year", "month", "cell_id", *(e.alias(k) for k, e in rules.items())), 6, scaled=4)


@query(f"WITH {S}, k AS (SELECT member, avg(value) AS m, stddev_pop(value) AS d FROM s GROUP BY member) SELECT member, round(m / 997, 5) AS mean, round(d / 997, 5) AS std FROM k")
def recovered_moments(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and deviation recovered from a threshold and its fraction of the mean."""
    th = E.trend_thresholds(base.series(spark, sf), keys=["member"], value="value").select("member", "threshold", "fraction")
    mean, std = K.mean_and_std(F.col("threshold"), F.col("fraction"))
    return rounded(th.select("member", (mean / UNIT).alias("mean"), (std / UNIT).alias("std")), 5)


# Observed records and events


OBS_SLOPES = f"""{O}, ow AS (SELECT event_type, t AS start, count(value) OVER x AS n, regr_slope(value, t::DOUBLE) OVER x AS slope, max(t) OVER (PARTITION BY event_type) AS last FROM o
 WINDOW x AS (PARTITION BY event_type ORDER BY t RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING)), ok AS (SELECT event_type, start, n, slope FROM ow WHERE n >= 2 AND start <= last - 10),
oth AS (SELECT event_type, avg(slope) AS m, stddev_pop(slope) AS d FROM ok GROUP BY event_type)"""


def observed_events(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return observed_thresholds(base.observed(spark, sf).withColumnRenamed("t", "year"), 10, keys=["event_type"])


@query(f"WITH {OBS_SLOPES} SELECT ok.event_type, start, n, round(slope, 4) AS slope, (slope > m + d)::TINYINT AS slowdown, (slope < m - d)::TINYINT AS riles FROM ok JOIN oth ON ok.event_type = oth.event_type")
def observed_trends(spark: SparkSession, sf: str) -> DataFrame:
    """Trends of an observed record and the windows beyond either threshold."""
    return rounded(observed_events(spark, sf)[0].select("event_type", "start", "n", "slope", "slowdown", "riles"), 4)


@query(f"WITH {OBS_SLOPES} SELECT event_type, round(m + d, 4) AS threshold_slowdown, round((m + d) / m, 4) AS fraction_slowdown, round(m - d, 4) AS threshold_riles, round((m - d) / m, 4) AS fraction_riles FROM oth")
def observed_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Both thresholds of an observed record and their fractions of the mean trend."""
    return rounded(observed_events(spark, sf)[1], 4)


@query(f"""WITH {O}, h AS (SELECT t, CASE WHEN t IN (10, 11) THEN NULL ELSE sum(value) END AS value FROM o GROUP BY t),
f AS (SELECT count(*)::DOUBLE AS s0, sum(x) AS s1, sum(x * x) AS s2, sum(x * x * x) AS s3, sum(x * x * x * x) AS s4, sum(y) AS y0, sum(x * y) AS y1, sum(x * x * y) AS y2 FROM (SELECT (t - 10)::DOUBLE AS x, value AS y FROM h WHERE t BETWEEN 7 AND 14 AND value IS NOT NULL)),
d AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2) AS det FROM f),
q AS (SELECT (y0 * (s2 * s4 - s3 * s3) - s1 * (y1 * s4 - s3 * y2) + s2 * (y1 * s3 - s2 * y2)) / det AS c0, (s0 * (y1 * s4 - s3 * y2) - y0 * (s1 * s4 - s3 * s2) + s2 * (s1 * y2 - y1 * s2)) / det AS c1, (s0 * (s2 * y2 - y1 * s3) - s1 * (s1 * y2 - y1 * s2) + y0 * (s1 * s3 - s2 * s2)) / det AS c2 FROM d)
SELECT t, (t // 12)::INT AS year, (t % 12 + 1)::INT AS month, round(CASE WHEN (t // 12 = 0 AND t % 12 IN (0, 1)) OR (t // 12 = 2 AND t % 12 = 5) THEN NULL ELSE coalesce(value, c0 + c1 * (t - 10) + c2 * (t - 10) * (t - 10)) END, 3) AS value FROM h, q""")
def observed_record(spark: SparkSession, sf: str) -> DataFrame:
    """A record with its gap filled and the months outside it missing."""
    o = base.observed(spark, sf).groupBy("t").agg(F.sum("value").alias("value")).withColumns({"year": F.expr("CAST(t div 12 AS INT)"), "month": (F.col("t") % 12 + 1).cast("int")})
    held = o.withColumn("value", F.when(~F.col("t").isin(10, 11), F.col("value")))
    return rounded(observed_series(held, gaps=[10, 11], masked={0: (1, 2), 2: (6,)}).select("t", "year", "month", "value"), 3)


YEARLY = f"""{S}, y AS (SELECT member, year, avg(value) AS value FROM s GROUP BY member, year), yw AS (SELECT member, year AS start, count(value) OVER x AS n, regr_slope(value, year::DOUBLE) OVER x AS slope, max(year) OVER (PARTITION BY member) AS last FROM y
 WINDOW x AS (PARTITION BY member ORDER BY year RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING)), yk AS (SELECT member, start, slope FROM yw WHERE n = 3 AND start <= last - 3),
em AS (SELECT year, avg(value) AS value FROM y GROUP BY year), ew AS (SELECT year AS start, count(value) OVER x AS n, regr_slope(value, year::DOUBLE) OVER x AS slope, max(year) OVER () AS last FROM em WINDOW x AS (ORDER BY year RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING)),
ek AS (SELECT start, slope FROM ew WHERE n >= 2 AND start <= last - 3)"""


@query(f"""WITH {YEARLY}, f AS (SELECT CASE WHEN avg(slope) = 0 THEN 1 ELSE (avg(slope) - stddev_pop(slope)) / avg(slope) END AS fraction FROM yk)
SELECT member, yk.start, round(yk.slope, 3) AS slope, round(fraction * ek.slope, 2) AS threshold, (yk.slope < fraction * ek.slope)::TINYINT AS event FROM yk JOIN ek ON yk.start = ek.start, f""")
def warming_slowdowns(spark: SparkSession, sf: str) -> DataFrame:
    """Slow-warming windows of yearly means against the forced trend."""
    y = base.series(spark, sf).groupBy("member", "year").agg(F.avg("value").alias("value"))
    return rounded(warming_events(y, 3).select("member", "start", "slope", "threshold", "event"), 3, threshold=2)


@query(f"""WITH {YEARLY}, m AS (SELECT avg(slope) + stddev_pop(slope) AS th FROM ek) SELECT start, round(slope, 3) AS slope, round(th, 3) AS threshold, (slope > th)::TINYINT AS event FROM ek, m""")
def ensemble_mean_events(spark: SparkSession, sf: str) -> DataFrame:
    """The ensemble mean's own trends against their own threshold."""
    mean = base.series(spark, sf).groupBy("member", "year").agg(F.avg("value").alias("value")).groupBy("year").agg(F.avg("value").alias("value")).withColumn("all", F.lit(0))
    k = T.sliding_slopes(mean, 3, keys=["all"], least=2)
    return rounded(E.classified(k, E.trend_thresholds(k, keys=["all"]), on=["all"]).select("start", "slope", "threshold", "event"), 3)


@query(f"""WITH {C}, x AS (SELECT member, cell_id, year * 12 + month - 1 AS t, value FROM c), f AS (SELECT member, cell_id, regr_intercept(value, t::DOUBLE) AS i, regr_slope(value, t::DOUBLE) AS k FROM x GROUP BY ALL)
SELECT x.member, x.cell_id, t::INT AS t, round(value - (i + k * t), 4) AS residual FROM x JOIN f ON x.member = f.member AND x.cell_id = f.cell_id""")
def detrended_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The forced signal removed from every cell as its linear trend."""
    c = base.cells(spark, sf).withColumn("t", K.month_index(F.col("year"), F.col("month")))
    return rounded(T.forced_removed(c, "linear", keys=["member", "cell_id"], t="t").select("member", "cell_id", F.col("t").cast("int").alias("t"), "residual"), 4)


@query(f"""WITH {C}, x AS (SELECT member, cell_id, year * 12 + month - 1 AS t, value AS o, avg(value) OVER (PARTITION BY year, month, cell_id) AS f FROM c),
a AS (SELECT member, cell_id, regr_slope(o, t::DOUBLE) AS so, regr_slope(f, t::DOUBLE) AS sf, avg(o) AS mo, avg(f) AS mf, avg(t) AS mx FROM x GROUP BY ALL)
SELECT x.member, x.cell_id, t::INT AS t, round(o - ((f - mf - sf * (t - mx)) + (mo + so * (t - mx))), 4) AS residual FROM x JOIN a ON x.member = a.member AND x.cell_id = a.cell_id""")
def corrected_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The forced signal removed from every cell as the ensemble mean with the cell's own mean and trend."""
    c = base.cells(spark, sf).withColumn("t", K.month_index(F.col("year"), F.col("month")))
    forced = c.drop("value").join(D.ensemble_mean(c, keys=["t", "cell_id"], name="value"), ["t", "cell_id"])
    return rounded(T.forced_removed(c, "ensmean", keys=["member", "cell_id"], forced=forced, t="t").select("member", "cell_id", F.col("t").cast("int").alias("t"), "residual"), 4)


OBSERVED = f"{C}, {G}, {OC}, dm AS (SELECT member, year, month, cell_id, value AS v FROM oc)"


def sql_detrend(src: str, out: str, keys: str = "member") -> str:
    return f"""{out}f AS (SELECT {keys}, regr_intercept(v, t::DOUBLE) AS fi, regr_slope(v, t::DOUBLE) AS fk FROM {src} GROUP BY ALL), {out} AS (SELECT {keys}, t, year, v - (fi + fk * t) AS v FROM {src} JOIN {out}f USING ({keys}))"""


@query(f"""WITH {OBSERVED}, {sql_box("a", "ia")}, {sql_detrend("ia", "id")}, {sql_smooth("id", "ib")}, x AS (SELECT member, t, v, CASE WHEN v >= 0.4 THEN 1 WHEN v <= -0.4 THEN -1 ELSE 0 END AS sg FROM ib),
y AS (SELECT *, t - row_number() OVER (PARTITION BY member, sg ORDER BY t) AS k FROM x)
SELECT member, t::INT AS t, round(v, 5) AS value, CASE WHEN count(*) OVER (PARTITION BY member, sg, k) >= 3 THEN sg ELSE 0 END::TINYINT AS label FROM y""")
def observed_index(spark: SparkSession, sf: str) -> DataFrame:
    """The regional index of one observed field, detrended in place of demeaned."""
    out = I.nino34(base.observed_cells(spark, sf), base.grid(spark, sf), ensemble=False, base=INDEX_BASE, boxes={"a": INDEX_BOXES["a"]}, length=3)
    return rounded(out.select("member", F.col("t").cast("int").alias("t"), "value", "label"), 5)


@query(f"""WITH {OBSERVED}, {sql_box("a", "xa")}, {sql_box("b", "xb")}, {sql_box("c", "xc")}, {sql_detrend("xa", "da")}, {sql_detrend("xb", "db")}, {sql_detrend("xc", "dc")},
w AS (SELECT da.member, da.t, da.year, da.v AS a, db.v AS b, dc.v AS c, CASE WHEN da.v * dc.v > 0 THEN 0.4 ELSE 0 END AS k FROM da JOIN db ON da.t = db.t JOIN dc ON da.t = dc.t),
u AS (SELECT 'a' AS idx, member, t, year, a AS v FROM w UNION ALL SELECT 'b', member, t, year, b FROM w UNION ALL SELECT 'c', member, t, year, c FROM w UNION ALL SELECT 'n_ct', member, t, year, a - k * c FROM w UNION ALL SELECT 'n_wp', member, t, year, c - k * a FROM w),
{sql_smooth("u", "z", "idx, member")} SELECT idx AS "index", t::INT AS t, round(v, 5) AS value, CASE WHEN v >= 0.4 THEN 1 WHEN v <= -0.4 THEN -1 ELSE 0 END::TINYINT AS label FROM z""")
def observed_flavours(spark: SparkSession, sf: str) -> DataFrame:
    """Three box indices of one observed field and the pair split of two of them."""
    out = I.enso_flavours(base.observed_cells(spark, sf), base.grid(spark, sf), ensemble=False, base=INDEX_BASE, boxes=INDEX_BOXES)
    return rounded(out.select("index", F.col("t").cast("int").alias("t"), "value", "label"), 5)


@query(f"WITH {C}, {G}, dm AS (SELECT member, year, month, cell_id, value - avg(value) OVER (PARTITION BY year, month, cell_id) AS v FROM c), {sql_tripole_series('dm')} SELECT member, t, round(v, 6) AS value FROM tp")
def tripole_raw(spark: SparkSession, sf: str) -> DataFrame:
    """The tripole before its low-pass filter."""
    out = I.ipo(base.cells(spark, sf).drop("label"), base.grid(spark, sf), base=INDEX_BASE, cutoff_years=1.5, boxes=INDEX_BOXES)
    return rounded(out.select("member", F.col("t").cast("int").alias("t"), "value"))


@query(f"""WITH RECURSIVE {OBSERVED}, {sql_tripole_series('dm')}, {sql_filter("tp", "lp", 1.5)}
SELECT member, t, round(v, 6) AS value, round(filtered, 6) AS filtered, sign(round(filtered, 9))::TINYINT AS label FROM lp""")
def observed_tripole(spark: SparkSession, sf: str) -> DataFrame:
    """The tripole of one observed field, raw and low-passed, with the sign of the latter."""
    out = I.ipo(base.observed_cells(spark, sf), base.grid(spark, sf), ensemble=False, base=INDEX_BASE, cutoff_years=1.5, boxes=INDEX_BOXES)
    label = K.sign_label(F.round("filtered", 9))
    return rounded(out.select("member", F.col("t").cast("int").alias("t"), "value", "filtered", label.alias("label")))


def sql_region(name: str, source: str) -> str:
    a, b, x, y = INDEX_BOXES[name]
    return f"SELECT member, year, month, sum(v * cos(radians(lat))) / sum(cos(radians(lat))) AS v FROM {source} JOIN g ON {source}.cell_id = g.cell_id WHERE lat BETWEEN {a} AND {b} AND lon BETWEEN {x} AND {y} GROUP BY member, year, month"


@query(f"""WITH {OBSERVED}, cm AS (SELECT member, year, month, cell_id, value AS v FROM c), ob AS ({sql_region("a", "dm")}), fm AS ({sql_region("a", "cm")}), fo AS (SELECT year, month, avg(v) AS v FROM fm GROUP BY year, month),
x AS (SELECT ob.member, ob.year, ob.month, ob.year * 12 + ob.month - 1 AS t, ob.v AS o, fo.v AS f FROM ob JOIN fo ON ob.year = fo.year AND ob.month = fo.month),
a AS (SELECT regr_slope(o, t::DOUBLE) AS so, regr_slope(f, t::DOUBLE) AS sf, avg(o) AS mo, avg(f) AS mf, avg(t) AS mx FROM x), r AS (SELECT member, t, year, month, o - ((f - mf - sf * (t - mx)) + (mo + so * (t - mx))) AS v FROM x, a),
ia AS (SELECT member, t, year, v - avg(CASE WHEN year BETWEEN 2000 AND 2002 THEN v END) OVER (PARTITION BY month) AS v FROM r), {sql_smooth("ia", "ib")}
SELECT t::INT AS t, round(v, 5) AS value, CASE WHEN v > 1 THEN 1 WHEN v < -1 THEN -1 ELSE 0 END::TINYINT AS label FROM ib""")
def observed_residual_index(spark: SparkSession, sf: str) -> DataFrame:
    """The regional index of one observed field without the corrected forced series."""
    box = {"a": INDEX_BOXES["a"]}
    forced = I.forced_arctic(base.cells(spark, sf), base.grid(spark, sf), box)
    out = I.arctic_observed(base.observed_cells(spark, sf), base.grid(spark, sf), forced, base=INDEX_BASE, boxes=box)
    return rounded(out.select(F.col("t").cast("int").alias("t"), "value", "label"), 5)


@query(f"""WITH {C}, {G}, {OC}, m AS (SELECT year, cell_id, avg(value) AS v FROM oc WHERE month IN (6, 7, 8) GROUP BY ALL HAVING count(DISTINCT month) = 3),
h AS (SELECT year, m.cell_id, land, CASE WHEN land = 0 THEN v END AS v FROM m JOIN g ON m.cell_id = g.cell_id), f AS (SELECT cell_id, regr_intercept(v, year::DOUBLE) AS i, regr_slope(v, year::DOUBLE) AS k FROM h GROUP BY cell_id HAVING count(v) >= 2),
r AS (SELECT year, h.cell_id, land, v - (i + k * year) AS v FROM h LEFT JOIN f ON h.cell_id = f.cell_id), st AS (SELECT avg(v) AS mu, stddev_pop(v) AS sigma FROM r WHERE land = 0)
SELECT year, cell_id, round(CASE WHEN land = 1 THEN -10 ELSE (v - mu) / nullif(sigma, 0) END, 4) AS value FROM r, st""")
def observed_input(spark: SparkSession, sf: str) -> DataFrame:
    """Model input of one observed field: ocean season means, detrended, standardised by themselves, land filled."""
    return rounded(I.observed_input(base.observed_cells(spark, sf), base.grid(spark, sf), "linear"), 4)


@query(f"""WITH {S}, {L}, a AS (SELECT t, sum(value) AS v FROM s GROUP BY t), b AS (SELECT t, sum(value) AS v FROM l GROUP BY t) SELECT a.t, round(a.v / 997, 5) AS orders, round(b.v / 997, 5) AS shipped FROM a JOIN b ON a.t = b.t""")
def common_span(spark: SparkSession, sf: str) -> DataFrame:
    """Two series over the steps that both have."""
    a, b = (x.groupBy("t").agg(F.sum("value").alias("value")) for x in (base.series(spark, sf), base.second_series(spark, sf)))
    both = X.overlap_join(a, b, names=("orders", "shipped"))
    return rounded(both.select("t", (F.col("orders") / UNIT).alias("orders"), (F.col("shipped") / UNIT).alias("shipped")), 5)


@query(f"""WITH {C}, {G}, tg AS (SELECT cell_id, lat * 0.8 + 1.25 AS lat, lon * 0.7 + 3.5 AS lon FROM g), h AS (SELECT member, year, month, cell_id, value FROM c WHERE (cell_id + month % 2) % 5 <> 0),
d AS (SELECT month % 2 AS odd, t.cell_id AS tid, g.cell_id AS sid, sqrt((t.lat - g.lat) ** 2 + (t.lon - g.lon) ** 2) AS d FROM tg t, g, (SELECT unnest([0, 1]) AS month) WHERE (g.cell_id + month % 2) % 5 <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY odd, tid ORDER BY d, sid) AS r FROM d)
SELECT member, year, month, tid AS cell_id, round(value, 6) AS value FROM h JOIN n ON h.cell_id = n.sid AND h.month % 2 = n.odd WHERE r = 1""")
def masked_regrid(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest neighbours among the cells that each step has; two masks, by odd and even months."""
    c = base.cells(spark, sf).drop("label").withColumn("value", F.when((F.col("cell_id") + F.col("month") % 2) % 5 != 0, F.col("value")))
    g = base.grid(spark, sf)
    off = g.select("cell_id", (F.col("lat") * 0.8 + 1.25).alias("lat"), (F.col("lon") * 0.7 + 3.5).alias("lon"))
    return rounded(X.regridded_valid(c, off, g, keys=["member", "year", "month"]))


@query(f"""WITH {C}, {G}, tg AS (SELECT cell_id, lat * 0.8 + 1.25 AS lat, lon * 0.7 + 3.5 AS lon FROM g), h AS (SELECT member, year * 12 + month - 1 AS t, cell_id, value FROM c WHERE (cell_id * 7 + (year * 12 + month - 1) * (3 + cell_id % 5)) % 11 > (year + month) % 11),
m AS (SELECT DISTINCT t, cell_id FROM h), n AS (SELECT m.t, tg.cell_id AS tid, g.cell_id AS sid, sqrt((tg.lat - g.lat) ** 2 + (tg.lon - g.lon) ** 2) AS d, row_number() OVER (PARTITION BY m.t, tg.cell_id ORDER BY sqrt((tg.lat - g.lat) ** 2 + (tg.lon - g.lon) ** 2), g.cell_id) AS r FROM m JOIN g ON m.cell_id = g.cell_id, tg),
w AS (SELECT t, tid, sid, 1 / (d + 1e-10) / sum(1 / (d + 1e-10)) OVER (PARTITION BY t, tid) AS w FROM n WHERE r <= 4)
SELECT member, h.t::INT AS t, tid AS cell_id, round(sum(w * value), 6) AS value FROM h JOIN w ON h.t = w.t AND h.cell_id = w.sid GROUP BY ALL""")
def drifting_mask_regrid(spark: SparkSession, sf: str) -> DataFrame:
    """Inverse-distance means of the four nearest cells that each step has; every step has a mask of its own."""
    c = base.cells(spark, sf).withColumn("t", K.month_index(F.col("year"), F.col("month")))
    there = (F.col("cell_id") * 7 + F.col("t") * (3 + F.col("cell_id") % 5)) % 11 > (F.col("year") + F.col("month")) % 11
    g = base.grid(spark, sf)
    off = g.select("cell_id", (F.col("lat") * 0.8 + 1.25).alias("lat"), (F.col("lon") * 0.7 + 3.5).alias("lon"))
    return rounded(X.regridded_valid(c.select("member", "t", "cell_id", F.when(there, F.col("value").cast("double")).alias("value")), off, g, keys=["member", "t"], k=4))


# The p value of r is a finite series; its terms are quotients of gamma functions.
@query(f"""WITH {JOINT}, k AS (SELECT member, corr(a, b) AS r, count(*) AS n FROM j GROUP BY member), q AS (SELECT *, n - 2 AS f, atan(abs(r * sqrt(n - 2) / sqrt(1 - r * r)) / sqrt(n - 2)) AS h FROM k),
e AS (SELECT member, r, n, f, h, sum(CASE WHEN f % 2 = 1 THEN cos(h) ** (2 * i) * exp(lgamma(i + 1) + lgamma(1.5) - lgamma(i + 1.5)) ELSE cos(h) ** (2 * i) * exp(lgamma(i + 0.5) - lgamma(0.5) - lgamma(i + 1)) END) AS s FROM q, range(0, 200) x(i) WHERE i <= CASE WHEN f % 2 = 1 THEN (f - 3) / 2 ELSE (f - 2) / 2 END GROUP BY ALL)
SELECT member, round(r, 6) AS r, n, round(1 - CASE WHEN f % 2 = 1 THEN 2 / pi() * (h + sin(h) * cos(h) * s) ELSE sin(h) * s END, 6) AS p FROM e""")
def correlation_p(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of two series with its two-sided p value."""
    return rounded(Q.correlation_p(joint(spark, sf), "a", "b", keys=["member"]).drop("t"))
