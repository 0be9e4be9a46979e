"""The roles of the driver's tables in the data model, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.functions.columns import month_index
from driftgrid.session import table

FIRST_YEAR = 1995
DAY0 = "2024-01-01"


def series(spark: SparkSession, sf: str) -> DataFrame:
    """member (nation), year, month, t, value: mean order value by month."""
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("member"))
    out = o.join(c, o.o_custkey == c.c_custkey).groupBy("member", "year", "month").agg(F.avg("o_totalprice").alias("value"))
    return out.withColumn("t", month_index(F.col("year"), F.col("month"), FIRST_YEAR))


def second_series(spark: SparkSession, sf: str) -> DataFrame:
    """member, t, value: quantity shipped by suppliers of a nation by month."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", month_index(F.year("l_shipdate"), F.month("l_shipdate"), FIRST_YEAR).alias("t"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("member"))
    return li.join(s, li.l_suppkey == s.s_suppkey).groupBy("member", "t").agg(F.sum("l_quantity").alias("value"))


def observed(spark: SparkSession, sf: str) -> DataFrame:
    """event_type, t (day), value: a daily record per type."""
    e = table(spark, sf, "events").select("event_type", F.datediff(F.col("ts").cast("date"), F.lit(DAY0).cast("date")).alias("t"), "value")
    return e.groupBy("event_type", "t").agg(F.sum("value").alias("value"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """member, year, month, cell_id, value: embeddings as monthly 8 x 8 fields of ten members."""
    e = table(spark, sf, "embeddings")
    step = F.expr("vec_id div 10")
    return e.select(
        (F.col("vec_id") % 10).cast("int").alias("member"), (2000 + F.floor(step / 12)).cast("int").alias("year"), (step % 12 + 1).cast("int").alias("month"), F.col("label"), F.posexplode("embedding").alias("cell_id", "value"),
    )


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """cell_id, i, j, lat, lon, area, land of the embeddings' dimensions."""
    n = table(spark, sf, "embeddings").agg(F.max(F.size("embedding")).alias("n"))
    c = n.select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("cell_id")).withColumns({"i": F.expr("CAST(cell_id div 8 AS INT)"), "j": F.col("cell_id") % 8})
    c = c.withColumns({"lat": F.col("i") * 20.0 - 70.0, "lon": F.col("j") * 45.0})
    return c.withColumns({"area": 1e12 * (F.col("i") + 1), "land": (F.col("cell_id") % 7 == 0).cast("int")})


def observed_cells(spark: SparkSession, sf: str) -> DataFrame:
    """member (0), year, month, cell_id, value: one field, the largest value of all members."""
    c = cells(spark, sf).groupBy("year", "month", "cell_id").agg(F.max(F.col("value").cast("double")).alias("value"))
    return c.select(F.lit(0).alias("member"), "year", "month", "cell_id", "value")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, split, run, phase, y_true, y_prob: document quality against a function of length with ties."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    y = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    p = F.round(F.col("n_chars") / (F.col("n_chars") + 1500.0), 2)
    return d.join(y, "doc_id").select("doc_id", (F.col("doc_id") % 3).cast("int").alias("split"), (F.col("doc_id") % 2).cast("int").alias("run"), F.col("lang").alias("phase"), F.col("quality").alias("y_true"), "toxic", p.alias("y_prob"))


# The same tables as common table expressions.
S = "s AS (SELECT c_nationkey AS member, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, ((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1)::INT AS t, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
L = "l AS (SELECT s_nationkey AS member, ((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1)::INT AS t, sum(l_quantity) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"
O = "o AS (SELECT event_type, date_diff('day', DATE '2024-01-01', ts::DATE)::INT AS t, sum(value) AS value FROM events GROUP BY ALL)"  # noqa: E741
C = "c AS (SELECT (vec_id % 10)::INT AS member, (2000 + (vec_id // 10) // 12)::INT AS year, ((vec_id // 10) % 12 + 1)::INT AS month, label, k::INT - 1 AS cell_id, embedding[k]::DOUBLE AS value FROM embeddings, range(1, 65) r(k) WHERE k <= len(embedding))"
G = "g AS (SELECT k::INT AS cell_id, (k // 8)::INT AS i, (k % 8)::INT AS j, (k // 8) * 20.0 - 70.0 AS lat, (k % 8) * 45.0 AS lon, 1e12 * ((k // 8) + 1) AS area, (k % 7 = 0)::INT AS land FROM range(0, (SELECT max(len(embedding)) FROM embeddings)) r(k))"
P = "p AS (SELECT d.doc_id, (d.doc_id % 3)::INT AS split, (d.doc_id % 2)::INT AS run, lang AS phase, quality AS y_true, toxic, round(n_chars / (n_chars + 1500.0), 2) AS y_prob FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
OC = "oc AS (SELECT 0 AS member, year, month, cell_id, max(value) AS value FROM c GROUP BY year, month, cell_id)"
