"""Classifiers, attributions and clusters on pyspark.ml."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.functions.columns import on_sphere, positive
from driftgrid.operators.fields import percentile_scaled
from driftgrid.operators.splits import class_weights
from driftgrid.session import cut


TRAINED_AT_ONCE = 4

def train_classifier(samples: DataFrame, *, label: str = "label", features: str = "features", l2: float = 1e-3, iterations: int = 50, positive_weight: float = 1.5):  # noqa: ANN201
    """A weighted logistic regression over feature arrays."""
    weights = class_weights(samples, keys=[], label=label, positive=positive_weight).select(label, "weight")
    held = samples.join(F.broadcast(weights), label).select(F.col(label).cast("double").alias("label"), array_to_vector(features).alias("features"), "weight")
    return LogisticRegression(weightCol="weight", regParam=l2, maxIter=iterations).fit(held)


def scored(model, samples: DataFrame, *, keys: list[str], label: str = "label", features: str = "features") -> DataFrame:  # noqa: ANN001
    """keys, y_prob, y_true, margin (the score before the logistic function)."""
    out = model.transform(samples.withColumn("__v", array_to_vector(features)).drop(features).withColumnRenamed("__v", "features"))
    return out.select(*keys, vector_to_array("probability")[1].alias("y_prob"), F.col(label).cast("tinyint").alias("y_true"), vector_to_array("rawPrediction")[1].alias("margin"))


def train_all(samples: DataFrame, splits: list[int], *, part: str = "part", split: str = "split", keys: list[str], existing: dict | None = None, **settings: float) -> tuple[dict, DataFrame]:
    """A model per split, trained on its training part, and the scores of every part. Models in ``existing`` are reused.

    The samples are cached once and the splits' jobs run side by side.
    """
    models = dict(existing or {})
    held = samples.cache()
    try:
        missing = [k for k in splits if k not in models]
        with ThreadPoolExecutor(TRAINED_AT_ONCE) as pool:
            trained = pool.map(lambda k: train_classifier(held.where((F.col(split) == k) & (F.col(part) == "tr")), **settings), missing)
            models |= dict(zip(missing, trained))
    finally:
        held.unpersist()
    told = [scored(models[k], samples.where(F.col(split) == k), keys=[split, part, *keys]) for k in splits]
    return models, reduce(DataFrame.unionByName, told)


def linear_relevance(model, samples: DataFrame, *, keys: list[str], features: str = "features") -> DataFrame:  # noqa: ANN001
    """keys, cell_id, relevance: the z-rule for one linear layer, input times weight of every cell. Nothing is dropped."""
    spark = samples.sparkSession
    weights = spark.createDataFrame(list(enumerate(model.coefficients.toArray().tolist())), "cell_id int, weight double")
    cells = samples.select(*keys, F.posexplode(features).alias("cell_id", "x"))
    return cells.join(F.broadcast(weights), "cell_id").select(*keys, "cell_id", (F.col("x") * F.col("weight")).alias("relevance"))


def pixel_features(maps: DataFrame, *, model: str, cell: str = "cell_id", value: str = "value") -> DataFrame:
    """cell, features: the values of a cell in all models, in their order; cells valid in every model only."""
    n = maps.select(F.count_distinct(model)).first()[0]
    held = maps.where(F.col(value).isNotNull()).groupBy(cell).agg(F.array_sort(F.collect_list(F.struct(model, value))).alias("__x"))
    return held.where(F.size("__x") == n).select(cell, F.transform("__x", lambda x: x[value]).alias("features"))


def map_features(one_map: DataFrame, grid: DataFrame, *, coordinates: bool = False, cell: str = "cell_id", value: str = "value") -> DataFrame:
    """cell, features of a single map: its value, with coordinates on the sphere if asked."""
    held = one_map.where(F.col(value).isNotNull()).join(grid.select(cell, "lat", "lon"), cell)
    return held.select(cell, F.array(F.col(value).cast("double"), *(on_sphere(F.col("lat"), F.col("lon")) if coordinates else [])).alias("features"))


def clusters(features: DataFrame, k: int, *, cell: str = "cell_id", seeds: tuple[int, ...] = (1, 2, 3)) -> tuple[DataFrame, float]:
    """cell, cluster of the best of several k-means runs, and its cost."""
    held = features.select(cell, array_to_vector("features").alias("features")).cache()
    try:
        fits = [KMeans(k=k, seed=s, maxIter=50).fit(held) for s in seeds]
    finally:
        held.unpersist()
    best = min(fits, key=lambda m: m.summary.trainingCost)
    return best.transform(held).select(cell, F.col("prediction").alias("cluster")), best.summary.trainingCost


def cluster_scan(features: DataFrame, ks: tuple[int, ...] = (2, 3, 4, 5), *, cell: str = "cell_id") -> DataFrame:
    """k, cost, silhouette over all rows."""
    rows = []
    once = cut(features)  # for every k
    held = once.select(cell, array_to_vector("features").alias("features"))
    for k in ks:
        labels, cost = clusters(once, k, cell=cell)
        told = labels.join(held, cell).withColumnRenamed("cluster", "prediction")
        rows.append((k, float(cost), float(ClusteringEvaluator().evaluate(told))))
    return features.sparkSession.createDataFrame(rows, "k int, cost double, silhouette double")


def cluster_means(df: DataFrame, *, keys: list[str], cluster: str = "cluster", value: str = "value") -> DataFrame:
    v = F.col(value).cast("double")
    return df.groupBy(*keys, cluster).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n"))


def ranked_clusters(df: DataFrame, *, keys: list[str], cluster: str = "cluster", value: str = "value") -> DataFrame:
    """``df`` with clusters renumbered from 0 by descending mean."""
    means = cluster_means(df, keys=keys, cluster=cluster, value=value)
    by = Window.partitionBy(*keys).orderBy(F.desc("mean"), cluster) if keys else Window.orderBy(F.desc("mean"), cluster)
    rank = means.withColumn("__r", F.row_number().over(by) - 1).select(*keys, cluster, "__r")  # a row per cluster
    return df.join(rank, [*keys, cluster]).withColumn(cluster, F.col("__r").cast("int")).drop("__r")


def on_grid(labels: DataFrame, grid: DataFrame, *, cell: str = "cell_id") -> DataFrame:
    """A row for every grid cell; cells without a label are NULL."""
    return grid.select(cell, "lat", "lon").join(labels, cell, "left")


def masked_by_cluster(df: DataFrame, chosen: int, *, cluster: str = "cluster", value: str = "value") -> DataFrame:
    return df.withColumn(value, F.when(F.col(cluster) == chosen, F.col(value)))


def cluster_ensemble(maps: DataFrame, grid: DataFrame, k: int, *, model: str, positive_only: bool = False, q: float = 0.97) -> DataFrame:
    """Scale the maps, cluster the cells over all models, order the clusters by mean and put them on the grid: cell_id, lat, lon, cluster, value."""
    held = maps.withColumn("value", positive(F.col("value"))) if positive_only else maps
    scaled = percentile_scaled(held, keys=[model], q=q).select(model, "cell_id", F.col("scaled").alias("value"))
    labels, _ = clusters(pixel_features(scaled, model=model), k)
    mean = scaled.groupBy("cell_id").agg(F.avg("value").alias("value"))
    return on_grid(ranked_clusters(labels.join(mean, "cell_id"), keys=[]), grid)
