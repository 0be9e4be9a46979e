"""Anomalous-trend events: thresholds, classification, counts and overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trend_thresholds(slopes: DataFrame, *, keys: list[str], sigmas: float = 1.0, value: str = "slope") -> DataFrame:
    """threshold = mean + sigmas * population deviation, and its fraction of the mean (NULL for a zero mean)."""
    v = F.col(value)
    out = slopes.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    out = out.withColumn("threshold", F.col("mean") + sigmas * F.col("std"))
    return out.withColumn("fraction", F.try_divide("threshold", "mean"))


def grand_fraction(slopes: DataFrame, value: str = "slope") -> DataFrame:
    """(mean - deviation) / mean over all rows; 1 for a zero mean."""
    out = slopes.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.withColumn("fraction", F.when(F.col("mean") == 0, 1.0).otherwise(F.try_divide(F.col("mean") - F.col("std"), F.col("mean"))))


def exceeds(value: Column, threshold: Column, direction: str = "above") -> Column:
    """1 strictly beyond the threshold; a missing value is no event."""
    return F.coalesce(value > threshold if direction == "above" else value < threshold, F.lit(False)).cast("tinyint")


def classified(slopes: DataFrame, thresholds: DataFrame, *, on: list[str], direction: str = "above", value: str = "slope") -> DataFrame:
    """Slopes with threshold and event. Thresholds are a row per key."""
    out = slopes.join(thresholds.select(*on, "threshold"), on)
    return out.withColumn("event", exceeds(F.col(value), F.col("threshold"), direction))


def model_thresholds(mean_slopes: DataFrame, fractions: DataFrame, *, on: list[str]) -> DataFrame:
    """Thresholds that follow the forced trend: fraction times the slope of the ensemble mean."""
    return mean_slopes.join(fractions.select(*on, "fraction"), on).withColumn("threshold", F.col("fraction") * F.col("slope")).drop("fraction", "slope")


def events_per_window(a: DataFrame, b: DataFrame, *, keys: list[str], window: str = "start") -> DataFrame:
    """Events of two sets over the windows that both have: n_a, n_b, n_both per window."""
    both = a.select(*keys, window, F.col("event").alias("a")).join(b.select(*keys, window, F.col("event").alias("b")), [*keys, window])
    return both.groupBy(window).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("n_both"))


def overlap(counts: DataFrame) -> DataFrame:
    """Shares of joint events: both / a and both / b."""
    s = counts.agg(F.sum("n_a").alias("a"), F.sum("n_b").alias("b"), F.sum("n_both").alias("both"))
    return s.select("a", "b", "both", F.try_divide("both", "a").alias("of_a"), F.try_divide("both", "b").alias("of_b"))


def event_frequency(events: DataFrame, *, member: str = "member", window: str = "start", cut: int) -> DataFrame:
    """Event shares over all windows, and before and from ``cut``, with the spread over members: one row per period."""
    period = F.when(F.col(window) < cut, "early").otherwise("late")
    held = events.withColumn("period", F.explode(F.array(F.lit("all"), period)))
    per = held.groupBy("period", member).agg(F.avg(F.col("event").cast("double")).alias("share"), F.sum("event").alias("n"), F.count("*").alias("windows"))
    return per.groupBy("period").agg((F.sum("n") / F.sum("windows")).alias("frequency"), F.avg("share").alias("mean"), F.median("share").alias("median"), F.min("share").alias("low"), F.max("share").alias("high"), F.stddev_pop("share").alias("std"))
