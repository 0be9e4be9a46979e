"""Gridded fields: regional means, ensemble means, seasons, anomalies, ice metrics.

Grid tables hold a row per cell and are broadcast only below BROADCAST_CELLS rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.functions.columns import cos_weight, in_box, in_season
from driftgrid.operators.quantiles import exact_percentiles

BROADCAST_CELLS = 1_000_000


def with_grid(cells: DataFrame, grid: DataFrame, on: str = "cell_id") -> DataFrame:
    """Cells with their geometry: broadcast where the grid is small, a shuffled join beyond."""
    small = grid.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    return cells.join(F.broadcast(grid) if small else grid, on)


def box_means(cells: DataFrame, grid: DataFrame, boxes: dict[str, tuple[float, float, float, float]], *, keys: list[str], value: str = "value", skipna: bool = False) -> DataFrame:
    """cos-latitude weighted means of several boxes in one pass: keys, region, value.

    A missing cell counts as zero in the sum but keeps its weight, unless ``skipna``.
    """
    inside = [F.when(in_box(F.col("lat"), F.col("lon"), b), F.lit(r)) for r, b in boxes.items()]
    held = grid.withColumn("region", F.explode(F.array_compact(F.array(*inside)))).withColumn("__w", cos_weight(F.col("lat"))).select("cell_id", "region", "__w")
    v, w = F.col(value).cast("double"), F.col("__w")
    below = F.sum(F.when(v.isNotNull(), w)) if skipna else F.sum(w)
    return with_grid(cells, held).groupBy(*keys, "region").agg(F.try_divide(F.coalesce(F.sum(v * w), F.lit(0.0)), below).alias("value"))


def ensemble_mean(df: DataFrame, *, keys: list[str], value: str = "value", name: str = "forced") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias(name))


def demean(df: DataFrame, *, keys: list[str], value: str = "value") -> DataFrame:
    """``value`` minus its mean over all rows of a key. Means are aggregated first, so a key's rows never meet in one task."""
    return df.join(ensemble_mean(df, keys=keys, value=value, name="__mean"), keys).withColumn(value, F.col(value) - F.col("__mean")).drop("__mean")


def demean_within(df: DataFrame, *, keys: list[str], value: str = "value") -> DataFrame:
    """``demean`` for rows that are already dealt by one of the keys: a window, so they are not dealt again."""
    return df.withColumn(value, F.col(value).cast("double") - F.avg(F.col(value).cast("double")).over(Window.partitionBy(*keys)))


def season_means(df: DataFrame, season: str, *, keys: list[str], value: str = "value", complete: bool = True) -> DataFrame:
    """Plain mean of a season's months; incomplete seasons are dropped if ``complete``."""
    out = df.where(in_season(F.col("month"), season)).groupBy(*keys).agg(F.avg(F.col(value).cast("double")).alias("value"), F.count_distinct("month").alias("__n"))
    return (out.where("__n = 3") if complete else out).drop("__n")


def forced_season(df: DataFrame, season: str, *, keys: list[str], member: str = "member", value: str = "value") -> DataFrame:
    """Ensemble mean of the members' season means."""
    return season_means(df, season, keys=[member, *keys], value=value).groupBy(*keys).agg(F.avg("value").alias("value"))


def forced_region(cells: DataFrame, grid: DataFrame, boxes: dict, *, keys: list[str], member: str = "member") -> DataFrame:
    """Ensemble mean of regional means."""
    return box_means(cells, grid, boxes, keys=[member, *keys]).groupBy(*keys, "region").agg(F.avg("value").alias("value"))


def anomalies(df: DataFrame, *, keys: list[str], base: tuple[int, int] | None, value: str = "value", name: str = "anomaly") -> DataFrame:
    """Value minus the climatology of its key (series and calendar month) over the base years, or all years."""
    v = F.col(value).cast("double")
    held = v if base is None else F.when(F.col("year").between(*base), v)
    return df.withColumn(name, v - F.avg(held).over(Window.partitionBy(*keys)))


def normalized(df: DataFrame, *, keys: list[str], base: tuple[int, int], value: str = "value", name: str = "value") -> DataFrame:
    """Value over the population deviation of its series within the base years; NULL where that is 0."""
    v = F.col(value).cast("double")
    return df.withColumn(name, F.try_divide(v, F.nullif(F.stddev_pop(F.when(F.col("year").between(*base), v)).over(Window.partitionBy(*keys)), F.lit(0.0))))


def ice_metrics(cells: DataFrame, grid: DataFrame, *, keys: list[str], value: str = "value", north_of: float = 50.0, cut: float = 0.15, unit: float = 1e12) -> DataFrame:
    """extent (area of cells at or above ``cut``) and area (concentration times area), in ``unit``."""
    v = F.col(value).cast("double")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0)) / unit
    return with_grid(cells, grid.where(F.col("lat") >= north_of).select("cell_id", "area")).groupBy(*keys).agg(zero(F.when(v >= cut, F.col("area"))).alias("extent"), zero(v * F.col("area")).alias("area"))


def annual_global_mean(cells: DataFrame, grid: DataFrame, *, member: str = "member", value: str = "value") -> DataFrame:
    """Latitude-weighted mean of each meridian, plain mean over longitudes, plain mean of the 12 months; years must be complete."""
    v = F.col(value).cast("double")
    weighed = with_grid(cells, grid.select("cell_id", "lon", cos_weight(F.col("lat")).alias("__w")))
    lines = weighed.groupBy(member, "year", "month", "lon").agg((F.sum(v * F.col("__w")) / F.sum("__w")).alias("v"))
    months = lines.groupBy(member, "year", "month").agg(F.avg("v").alias("v"))
    return months.groupBy(member, "year").agg(F.avg("v").alias("value"), F.count("*").alias("__n")).where("__n = 12").drop("__n")


def land_mask(first_step: DataFrame, value: str = "value") -> DataFrame:
    """Land is where the first time step is exactly zero."""
    return first_step.select("cell_id", (F.col(value) == 0.0).cast("tinyint").alias("land"))


def value_range(df: DataFrame, *, keys: list[str], value: str = "value") -> DataFrame:
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.min(v).alias("low"), F.avg(v).alias("mean"), F.max(v).alias("high"))


def percentile_scaled(df: DataFrame, *, keys: list[str], value: str = "value", q: float = 0.97, absolute: bool = True, name: str = "scaled") -> DataFrame:
    """Value over the q-th percentile of its map, clipped to [-1, 1] (absolute) or [0, 1]; maps whose percentile is 0 stay."""
    v = F.col(value).cast("double")
    scale = exact_percentiles(df, [q], keys=keys, value=F.abs(v) if absolute else v, name="__p").withColumn("__p", F.col("__p")[0])
    low = F.lit(-1.0 if absolute else 0.0)
    out = df.join(scale, keys)
    return out.withColumn(name, F.when(F.col("__p") > 0, F.when(v.isNotNull(), F.greatest(F.least(v / F.col("__p"), F.lit(1.0)), low))).otherwise(v)).drop("__p")


def composites(df: DataFrame, *, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, sample deviation and count of a value per key: classes, phases or outcomes by cell."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("n"))


def phase_composites(df: DataFrame, labels: DataFrame, *, on: list[str], label: str = "label", cell: str = "cell_id", value: str = "value") -> DataFrame:
    """``composites`` of every cell over the steps of each phase; ``labels`` has a row for each member and step, joined by ``on``."""
    return composites(df.join(labels.select(*on, label), on), keys=[label, cell], value=value)


def mean_of_means(df: DataFrame, *, model: list[str], keys: list[str], value: str = "value") -> DataFrame:
    """Composite per model, then the plain mean over models: each model weighs the same."""
    return df.groupBy(*model, *keys).agg(F.avg(F.col(value).cast("double")).alias("v")).groupBy(*keys).agg(F.avg("v").alias("mean"), F.count("v").alias("models"))


def exceedance(df: DataFrame, threshold: float, *, keys: list[str], mode: str = "absolute", value: str = "value") -> DataFrame:
    """Share of maps beyond a threshold per cell: absolute, positive, negative, or signed (positive minus negative). Missing counts as no."""
    v = F.col(value).cast("double")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    how = {"absolute": yes(F.abs(v) > threshold), "positive": yes(v > threshold), "negative": yes(v < -threshold), "signed": yes(v > threshold) - yes(v < -threshold)}
    return df.groupBy(*keys).agg(F.avg(how[mode]).alias("frequency"))
