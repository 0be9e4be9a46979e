"""Regional indices with phase labels, and the model input of observations.

Cells tables: member, year, month, cell_id, value. Observed ones have no member;
give them a constant one. Each pipeline is one lazy plan over all months.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.columns import fill_land, month_index, ocean, phase_label, sign_label, split_pair, tripole
from driftgrid.operators.fields import anomalies, box_means, demean, demean_within, forced_region, normalized, season_means, with_grid
from driftgrid.operators.lowpass import lowpass
from driftgrid.operators.series import correction_parts, detrended, forced_corrected, forced_removed, run_labels, smoothed
from driftgrid.operators.splits import training_statistics
from driftgrid.session import cut

# Boxes (latmin, latmax, lonmin, lonmax) of the indices.
NINO34 = {"nino34": (-5.0, 5.0, 190.0, 240.0)}
ENSO_BOXES = {"n3": (-5.0, 5.0, 210.0, 270.0), "n34": (-5.0, 5.0, 190.0, 240.0), "n4": (-5.0, 5.0, 160.0, 210.0)}
IPO_BOXES = {"trop": (-10.0, 10.0, 170.0, 270.0), "npac": (25.0, 45.0, 140.0, 215.0), "spac": (-50.0, -15.0, 150.0, 200.0)}
ARCTIC = {"arctic": (70.0, 90.0, 0.0, 360.0)}


def regional_series(cells: DataFrame, grid: DataFrame, boxes: dict, *, ensemble: bool, fast: bool = False) -> DataFrame:
    """member, year, month, t, region, value of the boxes; the forced signal is removed from ensembles.

    By definition the ensemble mean is removed per cell before the box mean.
    ``fast`` does it after: the same where the missing cells of all members
    agree, and it shuffles regions instead of cells.
    """
    keys = ["member", "year", "month"]
    if ensemble and not fast:
        cells = demean(cells, keys=["year", "month", "cell_id"])
    out = box_means(cells, grid, boxes, keys=keys)
    if ensemble and fast:
        out = demean(out, keys=["year", "month", "region"])
    return out.withColumn("t", month_index(F.col("year"), F.col("month")))


def single_box_index(cells: DataFrame, grid: DataFrame, box: dict, *, ensemble: bool, base: tuple[int, int], smooth: int | None, detrend: bool = False, fast: bool = False) -> DataFrame:
    """A box mean as monthly anomalies, detrended if asked, smoothed, and divided by its base deviation."""
    s = regional_series(cells, grid, box, ensemble=ensemble, fast=fast)
    s = anomalies(s, keys=["member", "month"], base=base, name="value")
    if detrend:
        s = detrended(s, keys=["member"], name="__r").withColumn("value", F.col("__r")).drop("__r")
    s = smoothed(s, smooth, keys=["member"], name="value")
    return normalized(s, keys=["member"], base=base)


def nino34(cells: DataFrame, grid: DataFrame, *, ensemble: bool = True, base: tuple[int, int] = (1990, 2020), smooth: int | None = 5, cut: float = 0.4, length: int = 6, boxes: dict = NINO34, fast: bool = False) -> DataFrame:
    """Index and run-length labels; observations are detrended instead of demeaned."""
    s = single_box_index(cells, grid, boxes, ensemble=ensemble, base=base, smooth=smooth, detrend=not ensemble, fast=fast)
    return run_labels(s, cut, length, keys=["member"])


def arctic(cells: DataFrame, grid: DataFrame, *, base: tuple[int, int] = (1990, 2020), smooth: int | None = 5, cut: float = 1.0, boxes: dict = ARCTIC, fast: bool = False) -> DataFrame:
    """Ensemble index with strict labels."""
    s = single_box_index(cells, grid, boxes, ensemble=True, base=base, smooth=smooth, fast=fast)
    return s.withColumn("label", phase_label(F.col("value"), cut, inclusive=False))


def arctic_observed(cells: DataFrame, grid: DataFrame, forced: DataFrame, *, base: tuple[int, int] = (1990, 2020), smooth: int | None = 5, cut: float = 1.0, boxes: dict = ARCTIC) -> DataFrame:
    """Observed index: the corrected forced series (year, month, value) is taken out over the months both have."""
    s = regional_series(cells, grid, boxes, ensemble=False)
    f = forced.withColumn("t", month_index(F.col("year"), F.col("month"))).select("t", "value")
    f = s.select("member", "t").join(f, "t")  # the forced series for each observed member
    r = forced_corrected(s, f, keys=["member"], name="value").join(s.select("member", "t", "year", "month", "region"), ["member", "t"])
    if not r.limit(1).count():
        raise ValueError("the observed and forced series don't overlap")
    r = smoothed(anomalies(r, keys=["member", "month"], base=base, name="value"), smooth, keys=["member"], name="value")
    return normalized(r, keys=["member"], base=base).withColumn("label", phase_label(F.col("value"), cut, inclusive=False))


def residual_diagnostics(cells: DataFrame, grid: DataFrame, forced: DataFrame, *, boxes: dict = ARCTIC) -> DataFrame:
    """member, t, observed, forced, forced_shifted, forced_corrected, residual: what ``arctic_observed`` is made from."""
    s = regional_series(cells, grid, boxes, ensemble=False)
    f = forced.withColumn("t", month_index(F.col("year"), F.col("month"))).select("t", "value")
    return correction_parts(s, s.select("member", "t").join(f, "t"), keys=["member"])


def enso_flavours(cells: DataFrame, grid: DataFrame, *, ensemble: bool = True, base: tuple[int, int] = (1990, 2020), smooth: int | None = 5, cut: float = 0.4, boxes: dict = ENSO_BOXES, fast: bool = False) -> DataFrame:
    """n3, n34, n4, n_ct, n_wp with inclusive labels: member, year, month, t, index, value, label.

    The pair is split before smoothing.
    """
    s = anomalies(regional_series(cells, grid, boxes, ensemble=ensemble, fast=fast), keys=["member", "region", "month"], base=base, name="value")
    if not ensemble:
        s = detrended(s, keys=["member", "region"], name="__r").withColumn("value", F.col("__r")).drop("__r")
    wide = s.groupBy("member", "year", "month", "t").pivot("region", list(boxes)).agg(F.first("value"))
    a, b = list(boxes)[0], list(boxes)[2]
    ct, wp = split_pair(F.col(a), F.col(b))
    wide = wide.withColumns({"n_ct": ct, "n_wp": wp})
    out = wide.unpivot(["member", "year", "month", "t"], [*boxes, "n_ct", "n_wp"], "index", "value")
    out = normalized(smoothed(out, smooth, keys=["member", "index"], name="value"), keys=["member", "index"], base=base)
    return out.withColumn("label", phase_label(F.col("value"), cut))


def cell_anomalies(cells: DataFrame, *, ensemble: bool, base: tuple[int, int]) -> DataFrame:
    """Anomalies of every cell, without the ensemble mean first if asked. Cells are dealt once, by cell, for both: a cell has a row for each member and month."""
    held = cells.repartition("cell_id")
    held = demean_within(held, keys=["year", "month", "cell_id"]) if ensemble else held
    return anomalies(held, keys=["member", "month", "cell_id"], base=base, name="value")


def ipo(cells: DataFrame, grid: DataFrame, *, ensemble: bool = True, base: tuple[int, int] = (1990, 2020), cutoff_years: float = 13.0, boxes: dict = IPO_BOXES) -> DataFrame:
    """Tripole of per-cell anomalies, raw and low-passed, with the sign of the latter."""
    s = box_means(cell_anomalies(cells, ensemble=ensemble, base=base), grid, boxes, keys=["member", "year", "month"]).withColumn("t", month_index(F.col("year"), F.col("month")))
    wide = s.groupBy("member", "year", "month", "t").pivot("region", list(boxes)).agg(F.first("value"))
    raw = cut(wide.select("member", "year", "month", "t", tripole(*[F.col(b) for b in boxes]).alias("value")))  # read several times by the filter
    low = lowpass(raw.select("member", "t", "value"), keys=["member"], cutoff_years=cutoff_years)
    return raw.join(low.select("member", "t", "filtered"), ["member", "t"]).withColumn("label", sign_label(F.col("filtered")))


def forced_arctic(cells: DataFrame, grid: DataFrame, boxes: dict = ARCTIC) -> DataFrame:
    """year, month, value: ensemble mean of the regional mean."""
    return forced_region(cells, grid, boxes, keys=["year", "month"]).drop("region")


def seasonal_features(cells: DataFrame, season: str = "JJA") -> DataFrame:
    """member, year, cell_id, value: season means without the ensemble mean."""
    return demean(season_means(cells, season, keys=["member", "year", "cell_id"]), keys=["year", "cell_id"])


def observed_input(cells: DataFrame, grid: DataFrame, method: str, *, season: str = "JJA", forced: DataFrame | None = None, statistics: DataFrame | None = None) -> DataFrame:
    """year, cell_id, value: ocean season means without the forced signal, standardised (by their own statistics unless given), land filled."""
    mean = season_means(cells, season, keys=["year", "cell_id"])
    mean = with_grid(mean, grid.select("cell_id", "land")).withColumn("value", ocean(F.col("value"), F.col("land"))).drop("land")
    r = forced_removed(mean, method, keys=["cell_id"], forced=forced, t="year").withColumnRenamed("residual", "value")
    r = with_grid(r, grid.select("cell_id", "land"))
    stats = statistics if statistics is not None else training_statistics(r, keys=[], where=F.col("land") == 0)
    z = r.join(F.broadcast(stats.select("mu", "sigma"))).withColumn("value", F.try_divide(F.col("value") - F.col("mu"), F.nullif(F.col("sigma"), F.lit(0.0))))
    return z.select("year", "cell_id", fill_land(F.col("value"), F.col("land")).alias("value"))
