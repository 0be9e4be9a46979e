"""Leak-free block splits of ensemble members, and what training needs from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgrid.functions.columns import fill_land
from driftgrid.operators.fields import with_grid


def block_parts(spark: SparkSession, splits: int = 9, blocks: int = 10) -> DataFrame:
    """split, block, part: split k tests on block k, validates on k + 1 and trains on the rest. splits * blocks rows."""
    if not 0 < splits < blocks:
        raise ValueError("splits must be below blocks")
    out = spark.range(splits).select(F.col("id").cast("int").alias("split")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return out.withColumn("part", F.when(F.col("block") == F.col("split"), "te").when(F.col("block") == F.col("split") + 1, "va").otherwise("tr"))


def with_splits(df: DataFrame, *, member: str = "member", splits: int = 9, blocks: int = 10, only: list[int] | None = None, members: int | None = None) -> DataFrame:
    """Rows of ``df`` once for each split with split and part; ``only`` prunes splits. A member's block is its position modulo ``blocks``.

    With ``members``, a table of other members than so many, numbered from 0, is
    an error.
    """
    if members is not None:
        check_members(df, members, member=member)
    parts = block_parts(df.sparkSession, splits, blocks)
    if only is not None:
        parts = parts.where(F.col("split").isin(only))
    return df.withColumn("block", F.pmod(F.col(member), F.lit(blocks)).cast("int")).join(F.broadcast(parts), "block").drop("block")


def check_members(df: DataFrame, members: int, *, member: str = "member") -> None:
    """Raise unless there are exactly ``members`` members, numbered from 0."""
    n, low, high = df.agg(F.count_distinct(member), F.min(member), F.max(member)).first()
    if (n, low, high) != (members, 0, members - 1):
        raise ValueError(f"expected members 0..{members - 1}, found {n} from {low} to {high}")


def split_statistics(df: DataFrame, *, keys: list[str] = [], member: str = "member", value: str = "value", where: Column | None = None, splits: int = 9, blocks: int = 10, only: list[int] | None = None) -> DataFrame:  # noqa: B006
    """keys, split, mu, sigma of every split's training part over the rows of ``where``.

    Rows are aggregated once by block; a split's moments are put together from
    those of its training blocks, so no row is copied.
    """
    v = F.col(value).cast("double")
    of_block = (df if where is None else df.where(where)).groupBy(*keys, F.pmod(F.col(member), F.lit(blocks)).cast("int").alias("block")).agg(F.count(v).alias("n"), F.avg(v).alias("m"), F.var_pop(v).alias("s"))
    parts = block_parts(df.sparkSession, splits, blocks).where("part = 'tr'").drop("part")
    parts = parts if only is None else parts.where(F.col("split").isin(only))
    total = F.sum("n")
    of_split = of_block.join(F.broadcast(parts), "block")
    means = of_split.groupBy(*keys, "split").agg(F.try_divide(F.sum(F.col("n") * F.col("m")), total).alias("mu"))
    held = of_split.join(means, [*keys, "split"])  # at most splits * blocks rows of a key
    return held.groupBy(*keys, "split", "mu").agg(F.sqrt(F.try_divide(F.sum(F.col("n") * (F.col("s") + F.pow(F.col("m") - F.col("mu"), F.lit(2)))), total)).alias("sigma"))


def training_statistics(df: DataFrame, *, keys: list[str], value: str = "value", where: Column | None = None) -> DataFrame:
    """mu and population sigma per key over the rows of ``where`` (training part, ocean)."""
    v = F.col(value).cast("double")
    return (df if where is None else df.where(where)).groupBy(*keys).agg(F.avg(v).alias("mu"), F.stddev_pop(v).alias("sigma"))


def standardized(df: DataFrame, *, keys: list[str], where: Column, value: str = "value", name: str = "z") -> DataFrame:
    """(value - mu) / sigma with the statistics of ``where`` only; NULL for sigma 0."""
    stats = training_statistics(df, keys=keys, value=value, where=where)
    joined = df.join(stats, keys) if keys else df.join(F.broadcast(stats))  # one row
    return joined.withColumn(name, F.try_divide(F.col(value) - F.col("mu"), F.nullif(F.col("sigma"), F.lit(0.0))))


def model_input(cells: DataFrame, grid: DataFrame, *, value: str = "z") -> DataFrame:
    """Standardised cells with the sentinel on land."""
    return with_grid(cells, grid.select("cell_id", "land")).withColumn(value, fill_land(F.col(value), F.col("land"))).drop("land")


def feature_vectors(cells: DataFrame, *, keys: list[str], cell: str = "cell_id", value: str = "z") -> DataFrame:
    """keys, features: one array per sample, in the order of the cells."""
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(cell, value))), lambda x: x[value].cast("float")).alias("features"))


def aligned(features: DataFrame, labels: DataFrame, *, on: list[str]) -> DataFrame:
    """Features with labels; raises if either side has a sample that the other lacks."""
    lost = features.join(labels, on, "left_anti").select(*on).unionByName(labels.join(features, on, "left_anti").select(*on)).limit(1).count()
    if lost:
        raise ValueError("features and labels differ in their samples")
    return features.join(labels, on)


def split_samples(cells: DataFrame | None, grid: DataFrame | None, others: DataFrame, *, on: list[str] = ["member", "year"], splits: int = 9, blocks: int = 10, only: list[int] | None = None) -> DataFrame:  # noqa: B006
    """Samples of every split and part: standardised, land-filled feature vectors with the columns of ``others`` (labels, indices).

    Without cells it is the fast path: ``others`` alone are dealt by the same
    blocks, and no field is read. Statistics are those of each split's training
    part over the ocean. A sample's cells are put together once; splits copy
    whole samples, at the end.
    """
    if cells is None:
        return with_splits(others, splits=splits, blocks=blocks, only=only)
    held = with_grid(cells, grid.select("cell_id", "land"))
    stats = split_statistics(held, where=F.col("land") == 0, splits=splits, blocks=blocks, only=only)
    one = F.struct(F.col("cell_id"), F.col("land"), F.col("value").cast("double").alias("value"))
    each = held.groupBy(*on).agg(F.array_sort(F.collect_list(one)).alias("__x"))  # the cells of one sample
    dealt = with_splits(aligned(each, others, on=on), splits=splits, blocks=blocks, only=only).join(F.broadcast(stats), "split")  # a row for each split
    z = lambda x: fill_land(F.try_divide(x.value - F.col("mu"), F.nullif(F.col("sigma"), F.lit(0.0))), x.land).cast("float")
    return dealt.withColumn("features", F.transform("__x", z)).drop("__x", "mu", "sigma")


def class_weights(df: DataFrame, *, keys: list[str], label: str = "label", positive: float = 1.5) -> DataFrame:
    """Balanced weights n / (classes * count), the positive class times ``positive``: keys, label, n, weight."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys)
    w = F.sum("n").over(by) / (F.count("*").over(by) * F.col("n"))
    return counts.withColumn("weight", F.when(F.col(label) == 1, w * positive).otherwise(w))


def prevalence(df: DataFrame, *, keys: list[str], label: str = "label") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("positives"), F.avg(F.col(label).cast("double")).alias("prevalence"))
