"""Classifier scores: curves, thresholds, metrics, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.operators.quantiles import exact_percentiles

EPS = 1e-15


def pr_curve(scores: DataFrame, *, keys: list[str], score: str = "y_prob", label: str = "y_true", ranges: int = 1024) -> DataFrame:
    """threshold, precision, recall at every distinct score; tied scores enter together.

    Counts are aggregated per distinct score, then cumulated in two steps: over
    at most ``ranges`` ranges of scores between 0 and 1 for each key, and within
    each range, so that no task holds all scores of a key.
    """
    place = F.greatest(F.least(F.floor(F.col("threshold") * ranges), F.lit(ranges)), F.lit(-1)).cast("int")
    at = scores.groupBy(*keys, F.col(score).alias("threshold")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n")).withColumn("__range", place)
    by = Window.partitionBy(*keys)
    before = by.orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    sums = at.groupBy(*keys, "__range").agg(F.sum("p").alias("__p"), F.sum("n").alias("__n"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = sums.select(*keys, "__range", zero(F.sum("__p").over(before)).alias("__tp"), zero(F.sum("__n").over(before)).alias("__all"), F.sum("__p").over(by).alias("positives"), F.sum("__n").over(by).alias("total"))
    own = Window.partitionBy(*keys, "__range").orderBy(F.desc("threshold"))
    out = at.join(sums, [*keys, "__range"]).select(*keys, "threshold", "p", "n", (F.col("__tp") + F.sum("p").over(own)).alias("tp"), (F.col("__all") + F.sum("n").over(own)).alias("predicted"), "positives", "total")
    return out.withColumn("precision", F.col("tp") / F.col("predicted")).withColumn("recall", F.coalesce(F.try_divide("tp", F.nullif("positives", F.lit(0))), F.lit(0.0)))


def optimal_thresholds(curve: DataFrame, *, keys: list[str]) -> DataFrame:
    """The threshold where precision and recall are closest; the smallest of ties."""
    key = F.struct(F.abs(F.col("precision") - F.col("recall")).alias("d"), F.col("threshold").alias("t"))
    return curve.groupBy(*keys).agg(F.min_by("threshold", key).alias("threshold"), F.min_by("precision", key).alias("precision_at"), F.min_by("recall", key).alias("recall_at"))


def curve_f1(curve: DataFrame) -> DataFrame:
    return curve.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0))), F.lit(0.0)))


def ratio(a, b):  # noqa: ANN001, ANN201
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0).cast("double"))), F.lit(0.0))


def metric_set(scores: DataFrame, *, keys: list[str], score: str = "y_prob", label: str = "y_true") -> DataFrame:
    """Thirteen metrics per key, one column each. Decisions are at the threshold where precision and recall are closest."""
    curve = pr_curve(scores, keys=keys, score=score, label=label)
    best = optimal_thresholds(curve, keys=keys)
    prev = F.coalesce(F.try_divide(F.col("tp") - F.col("p"), F.nullif("positives", F.lit(0))), F.lit(0.0))  # recall at the next higher score
    areas = curve.withColumn("__ap", F.col("precision") * (F.col("recall") - prev))
    below = F.col("total") - F.col("predicted")  # rows with a smaller score
    n0 = F.col("n") - F.col("p")
    below0 = below - (F.col("positives") - F.col("tp"))
    areas = areas.groupBy(*keys).agg(F.sum("__ap").alias("auprc"), F.try_divide(F.sum(F.col("p") * (below0 + n0 / 2.0)), F.nullif(F.max("positives") * (F.max("total") - F.max("positives")), F.lit(0))).alias("auroc"))
    y, p = F.col(label).cast("double"), F.col(score).cast("double")
    q = F.greatest(F.least(p, F.lit(1 - EPS)), F.lit(EPS))
    hit = (p >= F.col("threshold")).cast("double")
    total = lambda c: F.sum(c)
    held = scores.join(best, keys).groupBy(*keys).agg(
        total(y * hit).alias("tp"), total((1 - y) * hit).alias("fp"), total(y * (1 - hit)).alias("fn"), total((1 - y) * (1 - hit)).alias("tn"),
        F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"), F.avg(y).alias("prevalence"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = held.join(best, keys).join(areas, keys)
    out = out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn), "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))})
    return out.select(*keys, "auprc", "auroc", "brier", "precision", "recall", "f1", "accuracy", "threshold", "precision_at", "recall_at", "prevalence", "log_loss", "mcc")


def long_metrics(metrics: DataFrame, *, keys: list[str]) -> DataFrame:
    """keys, metric, value."""
    names = [c for c in metrics.columns if c not in keys]
    return metrics.unpivot(keys, names, "metric", "value")


def side_by_side(metrics: DataFrame, *, keys: list[str], column: str, values: list, value: str = "value") -> DataFrame:
    """``keys`` and one column for each of ``values`` of ``column``: the metrics of all splits next to each other."""
    return metrics.groupBy(*keys).agg(*(F.max(F.when(F.col(column) == v, F.col(value))).alias(f"{column}_{v}") for v in values))


def voted_years(shares: DataFrame, events: DataFrame, *, on: list[str], least: float = 0.15) -> DataFrame:
    """Keys that more than ``least`` of the models vote for, and whether each is among the observed events."""
    held = shares.where(F.col("share") > least)
    known = events.select(*on).distinct().withColumn("observed", F.lit(1))
    return held.join(known, on, "left").withColumn("observed", F.coalesce("observed", F.lit(0)))


def sample_table(scores: DataFrame, *others: DataFrame, on: list[str]) -> DataFrame:
    """Scores with labels, attributions and indices of the same samples; a sample that one of them lacks is left out."""
    for other in others:
        scores = scores.join(other, on)
    return scores


def metric_intervals(metrics: DataFrame, *, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, median and the 2.5 / 97.5 percentiles over runs."""
    p = exact_percentiles(metrics, [0.025, 0.5, 0.975], keys=keys, value=value, name="__p")
    means = metrics.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return means.join(p, keys, "left").select(*keys, "mean", F.col("__p")[0].alias("low"), F.col("__p")[1].alias("median"), F.col("__p")[2].alias("high"))


def confusion(df: DataFrame, *, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    return df.groupBy(*keys, y_true, y_pred).agg(F.count("*").alias("n"))


def votes(df: DataFrame, *, keys: list[str], y_pred: str = "y_pred", majority: float = 0.5) -> DataFrame:
    """Share of models that predict an event, and whether a majority does."""
    return df.groupBy(*keys).agg(F.avg(F.col(y_pred).cast("double")).alias("share"), F.count("*").alias("models")).withColumn("event", (F.col("share") >= majority).cast("tinyint"))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two columns; NULL where one of them is constant."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def fit_quality(df: DataFrame, *, keys: list[str], predicted: str, observed: str) -> DataFrame:
    """Root mean squared error over the population deviation, and Pearson correlation."""
    p, y = F.col(predicted).cast("double"), F.col(observed).cast("double")
    return df.groupBy(*keys).agg(F.try_divide(F.sqrt(F.avg((p - y) * (p - y))), F.nullif(F.stddev_pop(y), F.lit(0.0))).alias("nrmse"), pearson(p, y).alias("pearson"))


def skill_table(scores: DataFrame, *, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Actual event, hit and false alarm of every sample."""
    t, p = F.col(y_true), F.col(y_pred)
    return scores.select(*keys, t.cast("int").alias("actual"), ((t == 1) & (p == 1)).cast("int").alias("hit"), ((t == 0) & (p == 1)).cast("int").alias("false_alarm"))


def learning_curves(history: DataFrame, *, keys: list[str]) -> DataFrame:
    """keys, epoch, loss, val_loss from arrays by epoch."""
    return history.select(*keys, F.posexplode(F.arrays_zip("loss", "val_loss")).alias("epoch", "__x")).select(*keys, "epoch", F.col("__x.loss").alias("loss"), F.col("__x.val_loss").alias("val_loss"))
