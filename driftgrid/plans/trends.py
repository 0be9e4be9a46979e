"""Anomalous-trend events: observed thresholds, applied to every member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.columns import unless_month
from driftgrid.operators.events import classified, grand_fraction, model_thresholds, trend_thresholds
from driftgrid.operators.series import filled_gaps, sliding_slopes


def observed_series(df: DataFrame, *, gaps: list[int], masked: dict[int, tuple[int, ...]], t: str = "t") -> DataFrame:
    """The monthly record with its known gap filled and the months outside it missing."""
    filled = filled_gaps(df.withColumn("__all", F.lit(0)), gaps, keys=["__all"], t=t).drop("__all")
    return filled.withColumn("value", unless_month(F.col("value"), F.col("year"), F.col("month"), masked))


def observed_thresholds(df: DataFrame, window: int = 10, *, keys: list[str] = ["month"], start: int | None = None) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(slopes with both events, thresholds) of an observed series per calendar month."""
    slopes = sliding_slopes(df, window, keys=keys, least=2, start=start)
    slow, fast = trend_thresholds(slopes, keys=keys), trend_thresholds(slopes, keys=keys, sigmas=-1.0)
    both = slow.select(*keys, F.col("threshold").alias("threshold_slowdown"), F.col("fraction").alias("fraction_slowdown")).join(fast.select(*keys, F.col("threshold").alias("threshold_riles"), F.col("fraction").alias("fraction_riles")), keys)
    a = classified(slopes, slow, on=keys).withColumnRenamed("event", "slowdown").drop("threshold")
    return classified(a, fast, on=keys, direction="below").withColumnRenamed("event", "riles").drop("threshold"), both


def ensemble_events(series: DataFrame, fractions: DataFrame, window: int = 10, *, keys: list[str] = ["month"], member: str = "member", direction: str = "above", start: int | None = None, t: str = "year") -> DataFrame:  # noqa: B006
    """member, keys, start, slope, threshold, event for all members and months in one plan.

    A window's threshold is the observed fraction times the slope of the
    ensemble mean; the member's slope needs every value, the mean's two.
    """
    own = sliding_slopes(series, window, keys=[member, *keys], t=t, start=start).drop("n")
    mean = series.groupBy(*keys, t).agg(F.avg("value").alias("value"))
    forced = sliding_slopes(mean, window, keys=keys, t=t, least=2, start=start).drop("n")
    return classified(own, model_thresholds(forced, fractions, on=keys), on=[*keys, "start"], direction=direction)


def warming_events(series: DataFrame, window: int = 10, *, member: str = "member", start: int | None = None) -> DataFrame:
    """Slow-warming events of yearly means: slopes below the grand fraction of the forced slope."""
    one = series.withColumn("__all", F.lit(0))
    own = sliding_slopes(one, window, keys=[member, "__all"], start=start)
    fraction = grand_fraction(own).select("fraction").withColumn("__all", F.lit(0))
    return ensemble_events(one, fraction, window, keys=["__all"], member=member, direction="below", start=start).drop("__all")
