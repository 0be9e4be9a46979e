"""Registered queries of samples, scores, composites and set operations, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.functions import columns as K
from driftgrid.operators import fields as D
from driftgrid.operators import learning as M
from driftgrid.operators import scoring as R
from driftgrid.operators import splits as B
from driftgrid.operators import statistics as Q
from driftgrid.plans import base
from driftgrid.plans import indices as I
from driftgrid.plans.base import C, G, L, P, S
from driftgrid.plans.queries import DEMEANED, INDEX_BASE, INDEX_BOXES, METRICS, UNIT, sql_box, sql_smooth
from driftgrid.plans.registry import query, rounded
from driftgrid.session import table

# Composites


@query(f"""WITH {DEMEANED}, {sql_box("a", "ia")}, {sql_smooth("ia", "ib")}, x AS (SELECT member, t, CASE WHEN v >= 0.4 THEN 1 WHEN v <= -0.4 THEN -1 ELSE 0 END AS sg FROM ib), y AS (SELECT *, t - row_number() OVER (PARTITION BY member, sg ORDER BY t) AS k FROM x),
lb AS (SELECT member, t, CASE WHEN count(*) OVER (PARTITION BY member, sg, k) >= 3 THEN sg ELSE 0 END::TINYINT AS label FROM y)
SELECT label, cell_id, round(avg(v), 5) AS mean, count(v) AS n FROM dm JOIN lb ON dm.member = lb.member AND dm.year * 12 + dm.month - 1 = lb.t GROUP BY label, cell_id""")
def phase_composites(spark: SparkSession, sf: str) -> DataFrame:
    """Mean anomaly of every cell in the months of each phase of an index."""
    c = base.cells(spark, sf).drop("label")
    labels = I.nino34(c, base.grid(spark, sf), base=INDEX_BASE, boxes={"a": INDEX_BOXES["a"]}, length=3).select("member", "year", "month", "label")
    return rounded(D.phase_composites(D.demean(c, keys=["year", "month", "cell_id"]), labels, on=["member", "year", "month"]).select("label", "cell_id", "mean", "n"), 5)


@query(f"""WITH {C}, x AS (SELECT *, avg(value) OVER (PARTITION BY member, year, month) AS level FROM c), y AS (SELECT member, cell_id, greatest(value, 0) AS v, CASE WHEN (label >= 5) = (label % 2 = 1) THEN 'T' ELSE 'F' END || CASE WHEN label % 2 = 1 THEN 'P' ELSE 'N' END AS outcome, sign(level)::TINYINT AS phase FROM x),
m AS (SELECT member, outcome, phase, cell_id, avg(v) AS v FROM y GROUP BY ALL) SELECT outcome, phase, cell_id, round(avg(v), 5) AS mean, count(v) AS models FROM m GROUP BY ALL""")
def outcome_phase_composites(spark: SparkSession, sf: str) -> DataFrame:
    """Positive relevance by outcome and phase: by model, then over models."""
    c = base.cells(spark, sf).withColumn("value", F.col("value").cast("double"))
    level = c.groupBy("member", "year", "month").agg(K.sign_label(F.avg("value")).alias("phase"))
    outcome = K.outcome((F.col("label") >= 5).cast("int"), (F.col("label") % 2).cast("int"))
    held = c.join(level, ["member", "year", "month"]).withColumns({"outcome": outcome, "value": K.positive(F.col("value"))})
    return rounded(D.mean_of_means(held, model=["member"], keys=["outcome", "phase", "cell_id"]), 5)


@query(f"WITH {C}, {G}, m AS (SELECT cell_id, avg(value) AS v FROM c GROUP BY cell_id) SELECT m.cell_id, round(v, 6) AS value, round(lat, 6)::DOUBLE AS lat, round(cos(radians(lon)) * cos(radians(lat)), 6) AS x, round(sin(radians(lon)) * cos(radians(lat)), 6) AS y FROM m JOIN g ON m.cell_id = g.cell_id")
def map_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of one map: a cell's value and its place on the sphere."""
    one = base.cells(spark, sf).groupBy("cell_id").agg(F.avg(F.col("value").cast("double")).alias("value"))
    f = F.col("features")
    return rounded(M.map_features(one, base.grid(spark, sf), coordinates=True).select("cell_id", *(f[i].alias(n) for i, n in enumerate(("value", "lat", "x", "y")))))


@query(f"WITH {C}, m AS (SELECT label AS cluster, cell_id, avg(value) AS v FROM c GROUP BY ALL) SELECT cluster, cell_id, round(CASE WHEN cluster = 3 THEN v END, 6) AS value FROM m")
def cluster_masks(spark: SparkSession, sf: str) -> DataFrame:
    """Maps of clusters, missing outside the chosen one."""
    m = base.cells(spark, sf).groupBy(F.col("label").alias("cluster"), "cell_id").agg(F.avg(F.col("value").cast("double")).alias("value"))
    return rounded(M.masked_by_cluster(m, 3))


# Samples


@query(f"""WITH {C}, m AS (SELECT member, year, cell_id, avg(value) AS v FROM c WHERE month IN (6, 7, 8) GROUP BY ALL HAVING count(DISTINCT month) = 3),
d AS (SELECT member, year, cell_id, v - avg(v) OVER (PARTITION BY year, cell_id) AS v FROM m), y AS (SELECT member, year, max(label >= 7)::INT AS label FROM c WHERE month IN (6, 7, 8) GROUP BY member, year HAVING count(DISTINCT month) = 3)
SELECT d.member, d.year, any_value(y.label) AS label, count(*)::INT AS n, round(sum(v::FLOAT::DOUBLE), 5) AS total, round(max(CASE WHEN cell_id = 0 THEN v::FLOAT::DOUBLE END), 5) AS "first" FROM d JOIN y ON d.member = y.member AND d.year = y.year GROUP BY d.member, d.year""")
def aligned_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Feature vectors of members and years with their labels; both sides must have the same samples."""
    c = base.cells(spark, sf)
    x = B.feature_vectors(I.seasonal_features(c.drop("label")), keys=["member", "year"], value="value")
    y = c.where(K.in_season(F.col("month"), "JJA")).groupBy("member", "year").agg(F.max((F.col("label") >= 7).cast("int")).alias("label"), F.count_distinct("month").alias("n")).where("n = 3").drop("n")
    out = B.aligned(x, y, on=["member", "year"])
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    return rounded(out.select("member", "year", "label", F.size("features").alias("n"), total.alias("total"), F.col("features")[0].cast("double").alias("first")), 5)


INDEX_SPLITS = f"""{S}, i AS (SELECT member, year, avg(value) AS v FROM s WHERE month IN (6, 7, 8) GROUP BY ALL HAVING count(DISTINCT month) = 3),
sp AS (SELECT split::INT AS split, CASE WHEN member % 10 = split THEN 'te' WHEN member % 10 = split + 1 THEN 'va' ELSE 'tr' END AS part, member, year, v FROM i, range(0, 9) r(split))"""


@query(f"WITH {INDEX_SPLITS} SELECT split, part, member, year, round(v / 997, 5) AS value FROM sp")
def index_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The split pipeline's index path: an index dealt by the same blocks as the samples, no field read."""
    return rounded(B.split_samples(None, None, index_season(spark, sf)).withColumn("value", F.col("value") / UNIT), 5)


def index_season(spark: SparkSession, sf: str) -> DataFrame:
    return D.season_means(base.series(spark, sf), "JJA", keys=["member", "year"])


@query(f"""WITH {C}, {G}, x AS (SELECT split::INT AS split, CASE WHEN member = split THEN 'te' WHEN member = split + 1 THEN 'va' ELSE 'tr' END AS part, member, year, month, c.cell_id, label, land, value FROM c JOIN g ON c.cell_id = g.cell_id, range(0, 9) r(split)),
s AS (SELECT split, avg(value) AS mu, stddev_pop(value) AS sigma FROM x WHERE part = 'tr' AND land = 0 GROUP BY split), z AS (SELECT x.split, part, member, year, month, label, CASE WHEN land = 1 THEN -10 ELSE (value - mu) / sigma END AS z FROM x JOIN s ON x.split = s.split)
SELECT split, part, member, year, month, max(label)::INT AS label, count(*)::INT AS n, round(sum(z::FLOAT::DOUBLE), 4) AS total FROM z GROUP BY split, part, member, year, month""")
def split_samples(spark: SparkSession, sf: str) -> DataFrame:
    """The split pipeline: standardised, land-filled feature vectors of nine splits with their labels."""
    c = base.cells(spark, sf)
    labels = c.select("member", "year", "month", "label").distinct()
    out = B.split_samples(c.drop("label"), base.grid(spark, sf), labels, on=["member", "year", "month"])
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    return rounded(out.select("split", "part", "member", "year", "month", F.col("label").cast("int").alias("label"), F.size("features").alias("n"), total.alias("total")), 4)


@query(f"""WITH {P}, a AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS relevance FROM embeddings), i AS (SELECT page_id, length(url) AS v FROM pages)
SELECT p.doc_id, split, run, y_true::INT AS y_true, round(y_prob, 4) AS y_prob, round(relevance, 4) AS relevance, v AS index_value FROM p JOIN a ON p.doc_id = vec_id JOIN i ON p.doc_id = page_id""")
def sample_table(spark: SparkSession, sf: str) -> DataFrame:
    """Scores, attributions and an index of the same samples; those that one of them lacks are left out."""
    s = base.scores(spark, sf).select("doc_id", "split", "run", F.col("y_true").cast("int").alias("y_true"), "y_prob")
    a = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double")).alias("relevance"))
    i = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.length("url").cast("long").alias("index_value"))
    return rounded(R.sample_table(s, a, i, on=["doc_id"]), 4)


@query(f"""WITH {P}, v AS (SELECT p.doc_id % 97 AS year, avg((y_prob >= 0.4)::INT) AS share, count(*) AS models FROM p GROUP BY ALL), e AS (SELECT DISTINCT vec_id % 97 AS year FROM embeddings WHERE label = 3)
SELECT v.year, round(share, 6) AS share, models, (e.year IS NOT NULL)::INT AS observed FROM v LEFT JOIN e ON v.year = e.year WHERE share > 0.15""")
def voted_years(spark: SparkSession, sf: str) -> DataFrame:
    """Years that more than 15 % of the models vote for, and whether each is an observed event."""
    s = base.scores(spark, sf).withColumns({"y_pred": K.binarize(F.col("y_prob"), 0.4), "year": F.col("doc_id") % 97})
    events = table(spark, sf, "embeddings").where("label = 3").select((F.col("vec_id") % 97).alias("year"))
    return rounded(R.voted_years(R.votes(s, keys=["year"]), events, on=["year"]).select("year", "share", "models", "observed"))


@query(f"""WITH {METRICS}, lm AS (UNPIVOT metrics ON COLUMNS(* EXCLUDE (split)) INTO NAME metric VALUE value)
SELECT metric, round(max(CASE WHEN split = 0 THEN value END), 6) AS split_0, round(max(CASE WHEN split = 1 THEN value END), 6) AS split_1, round(max(CASE WHEN split = 2 THEN value END), 6) AS split_2 FROM lm GROUP BY metric""")
def split_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics of all splits side by side."""
    m = R.long_metrics(R.metric_set(base.scores(spark, sf), keys=["split"]), keys=["split"])
    return rounded(R.side_by_side(m, keys=["metric"], column="split", values=[0, 1, 2]))


@query(f"""WITH {P}, k AS (SELECT toxic, sum(y_true)::DOUBLE AS e, count(*)::DOUBLE AS n FROM p GROUP BY toxic), t AS (SELECT sum(e) AS se, sum(n) AS sn FROM k),
x AS (SELECT n * se / sn AS e1, e AS o1, n * (sn - se) / sn AS e0, n - e AS o0 FROM k, t), d AS (SELECT e1, e0, abs(o1 - e1) - least(0.5, abs(o1 - e1)) AS d1, abs(o0 - e0) - least(0.5, abs(o0 - e0)) AS d0 FROM x)
SELECT round(sum(d1 * d1 / e1 + d0 * d0 / e0), 6) AS chi2, 1 AS dof FROM d""")
def contingency_test(spark: SparkSession, sf: str) -> DataFrame:
    """Chi-squared of toxicity by quality, with the continuity correction."""
    return rounded(Q.contingency(base.scores(spark, sf), phase="toxic", event="y_true").select("chi2", "dof"))


@query(f"""WITH {P}, k AS (SELECT phase, sum(y_true)::DOUBLE AS e, count(*)::DOUBLE AS n FROM p GROUP BY phase), t AS (SELECT sum(e) / sum(n) AS m, sum(n) AS sn FROM k)
SELECT count(*)::INT AS phases, any_value(sn)::BIGINT AS n, round(sum(n * (e / n - m) ** 2) / any_value(sn) / any_value(m * (1 - m)), 6) AS explained FROM k, t""")
def phase_share_of_variance(spark: SparkSession, sf: str) -> DataFrame:
    """Share of an event's variance between phases."""
    return rounded(Q.variance_explained(base.scores(spark, sf), phase="phase", event="y_true", replicates=100).select("phases", "n", "explained"))


# Set operations


@query("SELECT DISTINCT c_nationkey AS member, c_mktsegment FROM customer ORDER BY member, c_mktsegment")
def distinct_members(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct ids, sorted."""
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("member"), "c_mktsegment").distinct().orderBy("member", "c_mktsegment")


@query(f"WITH {C}, r AS (SELECT *, row_number() OVER (PARTITION BY member, cell_id ORDER BY year, month) AS k FROM c) SELECT member, cell_id, year, month, round(value, 6) AS value FROM r WHERE k = 1")
def first_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The first step of every member and cell."""
    at = F.struct("year", "month")
    out = base.cells(spark, sf).groupBy("member", "cell_id").agg(F.min(at).alias("at"), F.min_by(F.col("value").cast("double"), at).alias("value"))
    return rounded(out.select("member", "cell_id", "at.year", "at.month", "value"))


@query(f"WITH {S}, {L} SELECT t FROM s INTERSECT SELECT t FROM l")
def common_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Steps that two series have."""
    return base.series(spark, sf).select("t").intersect(base.second_series(spark, sf).select("t"))


@query(f"WITH {S} SELECT member, t, round(value, 4) AS value FROM s WHERE t IN (SELECT ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1) FROM lineitem WHERE l_returnflag = 'R')")
def steps_of_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Values at the steps that another table knows."""
    li = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(K.month_index(F.year("l_shipdate"), F.month("l_shipdate"), base.FIRST_YEAR).alias("t"))
    return rounded(base.series(spark, sf).select("member", "t", "value").join(li, "t", "left_semi"), 4)


@query(f"WITH {S}, {L} SELECT 'orders' AS source, member, t, round(value, 4) AS value FROM s UNION ALL SELECT 'shipped', member, t, round(value, 4) FROM l")
def stacked_series(spark: SparkSession, sf: str) -> DataFrame:
    """Two series one below the other."""
    a = base.series(spark, sf).select(F.lit("orders").alias("source"), "member", "t", "value")
    return rounded(a.unionByName(base.second_series(spark, sf).select(F.lit("shipped").alias("source"), "member", "t", F.col("value").cast("double").alias("value"))), 4)


@query("""WITH m AS (SELECT DISTINCT c_nationkey AS member FROM customer), s AS (SELECT split::INT AS split, member FROM m, range(0, 9) r(split))
SELECT split, member FROM s EXCEPT SELECT split, member FROM s WHERE member % 10 IN (split, split + 1)""")
def training_members(spark: SparkSession, sf: str) -> DataFrame:
    """All members of every split less those that test and validate."""
    m = B.with_splits(table(spark, sf, "customer").select(F.col("c_nationkey").alias("member")).distinct())
    return m.select("split", "member").exceptAll(m.where("part != 'tr'").select("split", "member"))
