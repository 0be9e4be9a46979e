"""Column expressions. Missing values are NULL; NaN is never stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Season names, month labels, region boxes (latmin, latmax, lonmin, lonmax).
SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11)}
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
LAND_FILL = -10.0


def missing(c: Column) -> Column:
    """NaN as NULL."""
    return F.when(~F.isnan(c), c)


def missing_below(c: Column, limit: float) -> Column:
    """Values below ``limit`` (fill values) and NaN as NULL."""
    return F.when(~F.isnan(c) & (c >= limit), c)


def in_years(year: Column, first: int, last: int) -> Column:
    return year.between(first, last)


def in_season(month: Column, season: str) -> Column:
    """Months by name only: December belongs to its own year."""
    return month.isin(*SEASONS[season])


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive on all four sides."""
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def wrap_longitude(lon: Column) -> Column:
    return F.when(lon < 0, lon + 360.0).otherwise(lon)


def cos_weight(lat: Column) -> Column:
    return F.cos(F.radians(lat))


def ocean(value: Column, land: Column) -> Column:
    """NULL on land."""
    return F.when(land == 0, value)


def fill_land(value: Column, land: Column, fill: float = LAND_FILL) -> Column:
    return F.when(land == 1, F.lit(fill)).otherwise(value)


def unfill(value: Column, fill: float = LAND_FILL, to: float | None = 0.0) -> Column:
    """Values close to the land fill become ``to`` (tolerances of a float comparison: 1e-8 plus 1e-5 of the fill)."""
    return F.when(F.abs(value - fill) <= 1e-8 + 1e-5 * abs(fill), F.lit(to).cast("double")).otherwise(value)


def unless_month(value: Column, year: Column, month: Column, gaps: dict[int, tuple[int, ...]]) -> Column:
    """NULL in the listed months of the listed years."""
    out = value
    for y, months in gaps.items():
        out = F.when((year == y) & month.isin(*months), F.lit(None)).otherwise(out)
    return out


def split_pair(a: Column, b: Column, alpha: float = 0.4) -> tuple[Column, Column]:
    """(a - alpha b, b - alpha a) where a and b have one sign, else (a, b)."""
    k = F.when(a * b > 0, alpha).otherwise(0.0)
    return a - k * b, b - k * a


def tripole(middle: Column, north: Column, south: Column) -> Column:
    return middle - 0.5 * (north + south)


def sign_label(c: Column) -> Column:
    return F.signum(c).cast("tinyint")


def phase_label(c: Column, cut: float, inclusive: bool = True) -> Column:
    """+1, 0 or -1 by a symmetric cut; NULL is 0."""
    up, down = (c >= cut, c <= -cut) if inclusive else (c > cut, c < -cut)
    return F.when(up, 1).when(down, -1).otherwise(0).cast("tinyint")


def two_phase_label(c: Column) -> Column:
    """+1 above zero, else -1; NULL stays NULL."""
    return F.when(c.isNotNull(), F.when(c > 0, 1).otherwise(-1)).cast("tinyint")


def binarize(score: Column, threshold: Column | float) -> Column:
    return (score >= threshold).cast("tinyint")


def outcome(y_true: Column, y_pred: Column) -> Column:
    """TP, FP, TN or FN."""
    hit = F.when(y_true == y_pred, "T").otherwise("F")
    return F.concat(hit, F.when(y_pred == 1, "P").otherwise("N"))


def month_index(year: Column, month: Column, first_year: int = 0) -> Column:
    """Months since January of ``first_year``."""
    return (year - first_year) * 12 + month - 1


def year_of(t: Column, first_year: int = 0) -> Column:
    return (F.floor(t / 12) + first_year).cast("int")


def month_of(t: Column) -> Column:
    return (F.pmod(t, F.lit(12)) + 1).cast("int")


def month_label(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS]), month.cast("int"))


def scaled(c: Column, unit: float) -> Column:
    return c / unit


def unstandardized(c: Column, mu: Column, sigma: Column) -> Column:
    return c * sigma + mu


def clipped(c: Column, low: float, high: float) -> Column:
    """NULL stays NULL."""
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def positive(c: Column, else_zero: bool = True) -> Column:
    """Negative values to 0, or to NULL."""
    return F.when(c > 0, c).otherwise(F.when(c.isNotNull(), 0.0) if else_zero else F.lit(None))


def event_value(value: Column, event: Column) -> Column:
    return F.when(event == 1, value)


def on_sphere(lat: Column, lon: Column) -> list[Column]:
    """Latitude, cos lon cos lat, sin lon cos lat."""
    a, b = F.radians(lat), F.radians(lon)
    return [lat, F.cos(b) * F.cos(a), F.sin(b) * F.cos(a)]


def mean_and_std(threshold: Column, fraction: Column) -> tuple[Column, Column]:
    """The mean and deviation behind threshold = mean + std and fraction = threshold / mean."""
    mean = F.try_divide(threshold, fraction)
    return mean, threshold - mean
