"""Time series: sliding trends, smoothing, gaps, runs, detrending, forced corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.functions.columns import event_value, phase_label


def sliding_slopes(df: DataFrame, window: int, *, keys: list[str], t: str = "year", value: str = "value", least: int | None = None, start: int | None = None) -> DataFrame:
    """OLS slope of every window of ``window`` steps: keys, start, slope, n.

    Windows run by the time value, so gaps can't stretch them. A slope needs
    ``least`` values (all, by default). Windows start from ``start``, which is an
    error if no series has it, and, as in the published record, the last
    complete window is dropped.
    """
    if start is not None and df.where(F.col(t) == start).isEmpty():
        raise ValueError(f"no series has the step {start}")
    w = Window.partitionBy(*keys).orderBy(t).rangeBetween(0, window - 1)
    whole = Window.partitionBy(*keys)
    v = F.col(value).cast("double")
    out = df.select(*keys, F.col(t).alias("start"), F.count(v).over(w).alias("n"), F.regr_slope(v, F.col(t).cast("double")).over(w).alias("slope"), F.max(t).over(whole).alias("__last"))
    out = out.where((F.col("n") >= (window if least is None else least)) & (F.col("start") <= F.col("__last") - window))
    return (out if start is None else out.where(F.col("start") >= start)).drop("__last")


def smoothed(df: DataFrame, size: int | None, *, keys: list[str], t: str = "t", value: str = "value", name: str = "smoothed") -> DataFrame:
    """Centred moving mean of an odd size; beyond the ends the end values repeat."""
    v = F.col(value).cast("double")
    if size is None or size <= 1:
        return df.withColumn(name, v)
    half = size // 2
    by = Window.partitionBy(*keys).orderBy(t)
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, n = F.row_number().over(by), F.count(F.lit(1)).over(every)
    left, right = F.greatest(half + 1 - i, F.lit(0)), F.greatest(i + half - n, F.lit(0))
    return df.withColumn(name, (F.sum(v).over(by.rowsBetween(-half, half)) + left * F.first(v).over(every) + right * F.last(v).over(every)) / size)


def filled_gaps(df: DataFrame, gaps: list[int], *, keys: list[str], t: str = "t", value: str = "value", half: int = 3, least: int = 3) -> DataFrame:
    """Missing values at the given steps from a quadratic fit.

    The fit takes the present values from ``half`` steps before the first gap to
    ``half`` after the last (``half`` + 1 before: a 7-step neighbourhood of two
    gaps for 3), relative to the first gap, by normal equations.
    """
    lo, hi = min(gaps) - half, max(gaps) + half
    x, y = (F.col(t) - min(gaps)).cast("double"), F.col(value).cast("double")
    here = F.col(t).between(lo, hi) & y.isNotNull()
    power = {f"s{k}": F.sum(F.when(here, F.pow(x, F.lit(k)))) for k in range(5)} | {f"y{k}": F.sum(F.when(here, F.pow(x, F.lit(k)) * y)) for k in range(3)}
    fit = df.groupBy(*keys).agg(*[c.alias(k) for k, c in power.items()])
    det = lambda r: r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1]) - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0]) + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0])
    s = [[F.col(f"s{i + j}") for j in range(3)] for i in range(3)]
    rhs = [F.col(f"y{i}") for i in range(3)]
    solve = [F.try_divide(det([[rhs[i] if j == k else s[i][j] for j in range(3)] for i in range(3)]), det(s)) for k in range(3)]
    fit = fit.select(*keys, F.col("s0").alias("__n"), *[c.alias(f"__c{k}") for k, c in enumerate(solve)])
    filled = F.when(F.col(t).isin(*gaps) & y.isNull() & (F.col("__n") >= least), F.col("__c0") + F.col("__c1") * x + F.col("__c2") * x * x).otherwise(y)
    return df.join(fit, keys, "left").withColumn(value, filled).drop("__n", "__c0", "__c1", "__c2")


def run_labels(df: DataFrame, cut: float, length: int, *, keys: list[str], t: str = "t", value: str = "value", name: str = "label") -> DataFrame:
    """+1 / -1 where the value is at or beyond the cut for at least ``length`` consecutive steps, else 0. Each sign by itself."""
    out = df.withColumn("__s", phase_label(F.col(value), cut))
    by = Window.partitionBy(*keys, "__s")
    out = out.withColumn("__island", F.col(t) - F.row_number().over(by.orderBy(t)))
    run = F.count(F.lit(1)).over(Window.partitionBy(*keys, "__s", "__island"))
    return out.withColumn(name, F.when(run >= length, F.col("__s")).otherwise(F.lit(0)).cast("tinyint")).drop("__s", "__island")


def phase_intervals(df: DataFrame, *, keys: list[str], t: str = "t", label: str = "label") -> DataFrame:
    """keys, label, first, last of every run of one non-zero label."""
    by = Window.partitionBy(*keys).orderBy(t)
    new = (F.coalesce(F.lag(label).over(by), F.lit(0)) != F.col(label)).cast("int")
    runs = df.withColumn("__new", new).withColumn("__run", F.sum("__new").over(by))
    return runs.where(F.col(label) != 0).groupBy(*keys, "__run", label).agg(F.min(t).alias("first"), F.max(t).alias("last")).drop("__run")


def fits(df: DataFrame, *, keys: list[str], t: str = "t", value: str = "value", least: int = 2) -> DataFrame:
    """keys, intercept, slope, mean of a linear fit; NULL below ``least`` values. Sums only, so any number of series is one aggregate."""
    v, x = F.col(value).cast("double"), F.col(t).cast("double")
    enough = F.count(F.when(x.isNotNull(), v)) >= least
    return df.groupBy(*keys).agg(F.when(enough, F.regr_intercept(v, x)).alias("intercept"), F.when(enough, F.regr_slope(v, x)).alias("slope"), F.avg(v).alias("mean"))


def detrended(df: DataFrame, *, keys: list[str], t: str = "t", value: str = "value", name: str = "residual", fitted: str | None = None) -> DataFrame:
    """Value minus its linear fit, per series or per cell; all-missing series stay missing."""
    fit = fits(df, keys=keys, t=t, value=value).select(*keys, F.col("intercept").alias("__i"), F.col("slope").alias("__s"))
    line = F.col("__i") + F.col("__s") * F.col(t)
    out = df.join(fit, keys).withColumn(name, F.col(value) - line)
    return (out.withColumn(fitted, line) if fitted else out).drop("__i", "__s")


def forced_corrected(obs: DataFrame, forced: DataFrame, *, keys: list[str], t: str = "t", value: str = "value", name: str = "residual") -> DataFrame:
    """keys, t, ``name``: observed minus the forced signal with the observed mean and trend in place of its own.

    The forced series is shifted to the observed mean, its own trend is
    replaced by the observed one, and what remains of the observed is returned.
    Applied per key: series or cells.
    """
    return correction_parts(obs, forced, keys=keys, t=t, value=value).select(*keys, t, F.col("residual").alias(name))


def correction_parts(obs: DataFrame, forced: DataFrame, *, keys: list[str], t: str = "t", value: str = "value") -> DataFrame:
    """keys, t, observed, forced, forced_shifted (to the observed mean), forced_corrected (with the observed trend too), residual over the steps both have."""
    both = obs.select(*keys, t, F.col(value).cast("double").alias("__o")).join(forced.select(*keys, t, F.col(value).cast("double").alias("__f")), [*keys, t])
    x, ok = F.col(t).cast("double"), F.col("__o").isNotNull() & F.col("__f").isNotNull()
    o, f, xx = F.when(ok, F.col("__o")), F.when(ok, F.col("__f")), F.when(ok, x)
    fit = both.groupBy(*keys).agg(F.regr_slope(o, xx).alias("__so"), F.regr_slope(f, xx).alias("__sf"), F.avg(o).alias("__mo"), F.avg(f).alias("__mf"), F.avg(xx).alias("__mx"))
    shape = F.col("__f") - F.col("__mf") - F.col("__sf") * (x - F.col("__mx"))
    line = F.col("__mo") + F.col("__so") * (x - F.col("__mx"))
    parts = {"observed": F.col("__o"), "forced": F.col("__f"), "forced_shifted": F.col("__f") - F.col("__mf") + F.col("__mo"), "forced_corrected": shape + line, "residual": F.col("__o") - (shape + line)}
    return both.join(fit, keys).select(*keys, t, *(c.alias(k) for k, c in parts.items()))


def forced_removed(obs: DataFrame, method: str, *, keys: list[str], forced: DataFrame | None = None, t: str = "t", value: str = "value") -> DataFrame:
    """``linear``: detrend each key; ``ensmean``: correct by the forced field, whose times must be the observed ones."""
    if method == "linear":
        return detrended(obs, keys=keys, t=t, value=value).select(*keys, t, "residual")
    if method != "ensmean" or forced is None:
        raise ValueError("method is 'linear', or 'ensmean' with a forced field")
    if obs.select(t).distinct().join(forced.select(t).distinct(), t, "left_anti").limit(1).count() or forced.select(t).distinct().join(obs.select(t).distinct(), t, "left_anti").limit(1).count():
        raise ValueError("observed and forced times differ")
    return forced_corrected(obs, forced, keys=keys, t=t, value=value)


def window_anomalies(df: DataFrame, *, window: list[str], value: str = "slope", name: str = "anomaly") -> DataFrame:
    """Value minus the mean of all members in the same window."""
    means = df.groupBy(*window).agg(F.avg(value).alias("__m"))
    return df.join(means, window).withColumn(name, F.col(value) - F.col("__m")).drop("__m")


def trend_segments(slopes: DataFrame, series: DataFrame, steps: int, *, keys: list[str], start: str = "start", t: str = "year", value: str = "value") -> DataFrame:
    """Points (t, level) of each window's trend line, drawn from the value at its start; windows without a slope are skipped."""
    at = series.select(*keys, F.col(t).alias(start), F.col(value).alias("__v"))
    k = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    return slopes.where(F.col("slope").isNotNull()).join(at, [*keys, start]).withColumn("k", k).select(*slopes.columns, (F.col(start) + F.col("k")).alias("t"), (F.col("__v") + F.col("slope") * F.col("k")).alias("level"))


def value_at_start(events: DataFrame, series: DataFrame, *, keys: list[str], start: str = "start", t: str = "year", value: str = "value") -> DataFrame:
    """The series' value where an event's window starts; NULL without an event."""
    at = series.select(*keys, F.col(t).alias(start), F.col(value).alias("__v"))
    return events.join(at, [*keys, start], "left").withColumn("start_value", event_value(F.col("__v"), F.col("event"))).drop("__v")
