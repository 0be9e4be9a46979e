"""Distributions, regressions and event-by-phase statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.operators.quantiles import exact_percentiles
from driftgrid.operators.scoring import pearson
from driftgrid.session import cut

CELL, ORDER, REACH = 0.5, 12, 8.0  # of the kernel density, in bandwidths
PARTS = 16
MERGED = 50_000  # samples whose powers a task holds besides its cells
MAX_GRID = 1_000_000

# Fixed value: 97.5 % quantile of the normal law.
Z95 = 1.959963984540054


def histogram(df: DataFrame, bins: int, *, keys: list[str], value: str = "value") -> DataFrame:
    """Equal bins between each key's extremes: bin (from 0), low, high, n, density. The last bin is closed on the right."""
    v = F.col(value).cast("double")
    ends = df.groupBy(*keys).agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"), F.count(v).alias("__total"))
    held = (df.join(ends, keys) if keys else df.join(F.broadcast(ends))).where(v.isNotNull())
    width = (F.col("__hi") - F.col("__lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor(F.try_divide(v - F.col("__lo"), width)), F.lit(bins - 1))).cast("int")
    out = held.withColumn("bin", at).groupBy(*keys, "bin", "__lo", "__hi", "__total").agg(F.count("*").alias("n"))
    return out.select(*keys, "bin", (F.col("__lo") + F.col("bin") * width).alias("low"), (F.col("__lo") + (F.col("bin") + 1) * width).alias("high"), "n", F.try_divide(F.col("n"), F.nullif(F.col("__total") * width, F.lit(0.0))).alias("density"))


def integer_histogram(df: DataFrame, *, keys: list[str], value: str = "value") -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.floor(value).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def hexagons(df: DataFrame, x: str, y: str, *, size: int = 40) -> DataFrame:
    """Counts on a hexagonal lattice with ``size`` columns over the extent: two interleaved rectangular lattices, the nearer centre wins.

    The samples are computed once: means that are added up again differ in their
    last bits, and the extremes would miss the ends of the lattice.
    """
    df = cut(df.select(x, y))
    ends = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    rows = int(size / math.sqrt(3))
    out = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(F.broadcast(ends))
    u, v = F.try_divide(F.col(x) - F.col("x0"), F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0))) * size, F.try_divide(F.col(y) - F.col("y0"), F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0))) * rows
    out = out.withColumns({"__u": F.coalesce(u, F.lit(0.0)), "__v": F.coalesce(v, F.lit(0.0))})
    half = lambda c: F.floor(F.col(c) + 0.5)
    near = F.pow(F.col("__u") - half("__u"), 2) + 3 * F.pow(F.col("__v") - half("__v"), 2)
    shifted = F.pow(F.col("__u") - F.floor("__u") - 0.5, 2) + 3 * F.pow(F.col("__v") - F.floor("__v") - 0.5, 2)
    first = near < shifted
    i = F.when(first, half("__u")).otherwise(F.floor("__u") + 0.5)
    j = F.when(first, half("__v")).otherwise(F.floor("__v") + 0.5)
    return out.groupBy(i.cast("double").alias("hex_i"), j.cast("double").alias("hex_j")).agg(F.count("*").alias("n"))


def hermite(x: np.ndarray, order: int) -> np.ndarray:
    """Hermite polynomials 0 to ``order`` (of the weight exp(-x * x / 2))."""
    out = [np.ones_like(x), x]
    for k in range(1, order):
        out.append(x * out[k] - k * out[k - 1])
    return np.stack(out[: order + 1])


def merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cu, cv, sums) of each cell from rows (cu, cv, values) in which cells repeat."""
    cu, cv, m = (np.concatenate(v) for v in zip(*parts))
    rows = np.lexsort((cv, cu))
    cu, cv = cu[rows], cv[rows]
    new = np.flatnonzero(np.append(True, (cu[1:] != cu[:-1]) | (cv[1:] != cv[:-1])))
    return cu[new], cv[new], np.add.reduceat(m[rows], new)


def kernel_density(df: DataFrame, x: str, y: str, *, points: int = 200, low: float = 0.005, high: float = 0.995, width: float = CELL, order: int = ORDER) -> DataFrame:
    """2-D Gaussian kernel density on a points x points grid between two percentiles of each axis: gi, gj, x, y, density.

    The bandwidth is n ** (-1/6) of the sample covariance. In axes where the
    kernel is the plain normal one, samples are aggregated over square cells of
    ``width``: sums of the powers of their offsets from the centre, up to
    ``order`` together. A kernel's series about the centre has terms below
    (width / 2) ** k / sqrt(k!), and beyond REACH it is below 1e-12, so the sum
    over cells is within 1e-10 of the kernel's peak of that over samples. There
    are as many cells as the extent asks for, whatever the number of samples;
    tasks add up their cells' parts of the grid, and the grids are added.
    """
    if points * points > MAX_GRID:
        raise ValueError(f"at most {MAX_GRID} grid points")
    s = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    s = cut(s)
    n, vx, vy, cxy = s.agg(F.count("*"), F.var_samp("x"), F.var_samp("y"), F.covar_samp("x", "y")).first()
    if n < 3 or vx * vy - cxy * cxy <= 0:
        raise ValueError("the samples have no density")
    px, py = (exact_percentiles(s, [low, high], keys=[], value=c).first()[0] for c in ("x", "y"))
    gx, gy = np.linspace(*px, points), np.linspace(*py, points)
    inverse = np.linalg.inv(np.array([[vx, cxy], [cxy, vy]]) * n ** (-1 / 3))
    norm = math.sqrt(np.linalg.det(inverse)) / (2 * math.pi * n)
    root = np.linalg.cholesky(inverse).T  # inverse = root.T @ root
    u, v = root[0, 0] * F.col("x") + root[0, 1] * F.col("y"), root[1, 1] * F.col("y")
    powers = [(p, q) for p in range(order + 1) for q in range(order + 1 - p)]

    def gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows, limit = [], 0, MERGED
        for frame in frames:
            at = [np.floor(frame[c].to_numpy() / width) for c in "uv"]
            off = [frame[c].to_numpy() - (k + 0.5) * width for c, k in zip("uv", at)]
            pu, pv = (np.cumprod([np.ones_like(d), *(d / k for k in range(1, order + 1))], 0) for d in off)
            held.append((*at, np.stack([pu[p] * pv[q] for p, q in powers], 1)))
            rows += len(frame)
            if rows > limit:
                held = [merged(held)]
                rows, limit = len(held[0][0]), 2 * len(held[0][0]) + MERGED
        if held:
            cu, cv, m = merged(held)
            yield pd.DataFrame({"cu": cu, "cv": cv, "m": [r.tobytes() for r in m]})

    cells = s.select(u.alias("u"), v.alias("v")).mapInPandas(gathered, "cu double, cv double, m binary").repartition(PARTS, "cu", "cv")
    gv = root[1, 1] * gy

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held = np.zeros((points, points)), []
        for frame in frames:
            held = [merged([*held, (frame.cu.to_numpy(), frame.cv.to_numpy(), np.stack([np.frombuffer(r) for r in frame.m]))])] if len(frame) else held
        for some in held:
            for cu, cv, m in zip((some[0] + 0.5) * width, (some[1] + 0.5) * width, some[2]):
                j0, j1 = np.searchsorted(gv, [cv - REACH, cv + REACH])
                if j0 == j1:
                    continue
                ends = root[0, 1] * gy[[j0, j1 - 1]]
                i0, i1 = np.searchsorted(root[0, 0] * gx, [cu - REACH - ends.max(), cu + REACH - ends.min()])
                if i0 == i1:
                    continue
                table = np.zeros((order + 1, order + 1))
                table[tuple(zip(*powers))] = m
                dv = gv[j0:j1] - cv
                du = root[0, 0] * gx[i0:i1, None] + root[0, 1] * gy[None, j0:j1] - cu
                across = table @ (hermite(dv, order) * np.exp(-0.5 * dv * dv))  # by power of u
                total[i0:i1, j0:j1] += (hermite(du, order) * across[:, None, :]).sum(0) * np.exp(-0.5 * du * du)
        yield pd.DataFrame({"part": [total.tobytes()]})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(p) for p in frame.part], 0)
        i, j = np.divmod(np.arange(points * points), points)
        return pd.DataFrame({"gi": i.astype(np.int32), "gj": j.astype(np.int32), "x": gx[i], "y": gy[j], "density": total * norm})

    parts = cells.mapInPandas(partial, "part binary")  # PARTS grids
    return parts.groupBy().applyInPandas(added, "gi int, gj int, x double, y double, density double")


def correlation(df: DataFrame, x: str, y: str, *, keys: list[str]) -> DataFrame:
    """Pearson r, n, and the t statistic of r."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    out = df.where(a.isNotNull() & b.isNotNull()).groupBy(*keys).agg(pearson(a, b).alias("r"), F.count("*").alias("n"))
    return out.withColumn("t", F.try_divide(F.col("r") * F.sqrt(F.col("n") - 2), F.nullif(F.sqrt(1 - F.col("r") * F.col("r")), F.lit(0.0))))


def student_p(t: Column, freedom: Column) -> Column:
    """Two-sided p value of a t statistic with whole degrees of freedom: the finite series in the angle atan(t / sqrt(freedom))."""
    angle = F.atan(F.abs(t) / F.sqrt(freedom))
    cos2 = F.pow(F.cos(angle), F.lit(2))
    odd = freedom % 2 == 1

    def step(s: Column, k: Column) -> Column:
        factor = F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        term = s["term"] * cos2 * factor
        return F.struct((s["total"] + term).alias("total"), term.alias("term"))

    last = F.when(odd, (freedom - 3) / 2).otherwise((freedom - 2) / 2).cast("int")
    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    series = F.aggregate(steps, F.struct(F.lit(1.0).alias("total"), F.lit(1.0).alias("term")), step, lambda s: s["total"])
    inner = F.when(odd, 2 / F.lit(math.pi) * (angle + F.when(freedom > 1, F.sin(angle) * F.cos(angle) * series).otherwise(0.0))).otherwise(F.sin(angle) * series)
    return F.when(freedom >= 1, 1 - inner)


def correlation_p(df: DataFrame, x: str, y: str, *, keys: list[str]) -> DataFrame:
    """``correlation`` with the two-sided p value of r; missing below three pairs and for r of 1 or -1."""
    return correlation(df, x, y, keys=keys).withColumn("p", student_p(F.col("t"), (F.col("n") - 2).cast("int")))


def least_squares(df: DataFrame, x: str, y: str, *, keys: list[str]) -> DataFrame:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*keys).agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"))


def composition(df: DataFrame, *, phase: str, events: list[str]) -> DataFrame:
    """Counts and shares of each event by phase."""
    aggs = [F.count("*").alias("n")]
    for e in events:
        aggs += [F.sum(F.col(e).cast("long")).alias(f"n_{e}"), F.avg(F.col(e).cast("double")).alias(f"p_{e}")]
    return df.groupBy(phase).agg(*aggs)


def fold(first: Column, last: Column, start: Column, step, finish) -> Column:  # noqa: ANN001
    """finish(step(... step(start, first) ..., last)) over whole numbers; the start alone where last is below first."""
    numbers = F.when(last >= first, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(numbers, start, step, finish)


def erfc(z: Column) -> Column:
    """Complementary error function of z >= 0: a series of positive terms up to 3, a continued fraction beyond."""

    def term(s: Column, k: Column) -> Column:
        t = s["t"] * 2 * z * z / (2 * k + 1)
        return F.struct((s["sum"] + t).alias("sum"), t.alias("t"))

    series = fold(F.lit(1), F.lit(80), F.struct(z.alias("sum"), z.alias("t")), term, lambda s: s["sum"])
    near = 1 - 2 / math.sqrt(math.pi) * F.exp(-z * z) * series
    tail = fold(F.lit(1), F.lit(80), F.lit(1.0), lambda f, k: 1 + (81 - k) / (2 * z * z * f), lambda f: f)
    return F.when(z <= 3, near).otherwise(F.exp(-z * z) / (z * math.sqrt(math.pi) * tail))


def chi2_p(x: Column, freedom: Column) -> Column:
    """Upper tail of chi-squared for whole degrees of freedom, by the recurrence in steps of two."""
    odd = freedom % 2 == 1
    first = F.when(odd, erfc(F.sqrt(x / 2))).otherwise(F.exp(-x / 2))
    term = F.when(odd, F.sqrt(2 * x / math.pi) * F.exp(-x / 2)).otherwise(F.exp(-x / 2) * x / 2)
    start = F.struct(first.cast("double").alias("sum"), term.cast("double").alias("t"))
    low = F.when(odd, 1).otherwise(2)
    step = lambda s, k: F.struct((s["sum"] + s["t"]).alias("sum"), (s["t"] * x / (low + 2 * k)).alias("t"))
    return F.when(freedom >= 1, fold(F.lit(1), ((freedom - low) / 2).cast("int"), start, step, lambda s: s["sum"]))


def fisher_p(a: Column, row: Column, col: Column, n: Column) -> Column:
    """Two-sided p of a 2 x 2 table with ``a`` in its first cell and these margins: the tables at most as likely.

    Likelihoods follow from that of the mode by ratios of neighbours. Tables
    further than 40 deviations from the mode add less than a double can show, so
    the sums have as many terms as the deviation asks for, not the counts.
    """
    a, row, col, n = (c.cast("double") for c in (a, row, col, n))
    low, high = F.greatest(F.lit(0.0), row + col - n), F.least(row, col)
    mode = F.floor((row + 1) * (col + 1) / (n + 2)).cast("double")
    wide = F.ceil(40 * F.sqrt(row / n * col * (1 - row / n) * (n - col) / F.greatest(n - 1, F.lit(1.0)))) + 20
    up = lambda k: F.log((row - k) * (col - k) / ((k + 1) * (n - row - col + k + 1)))  # from k to k + 1
    total = lambda s, k: s + up(k.cast("double"))
    own = F.when(a >= mode, fold(mode, a - 1, F.lit(0.0), total, lambda s: s)).otherwise(-fold(a, mode - 1, F.lit(0.0), total, lambda s: s))

    def with_own(limit: Column) -> Column:
        def step(s: Column, move: Column) -> Column:
            t = s["t"] + move
            p = F.exp(t)
            return F.struct(t.alias("t"), (s["all"] + p).alias("all"), (s["rare"] + F.when(t <= limit, p).otherwise(0.0)).alias("rare"))

        start = lambda p: F.struct(F.lit(0.0).alias("t"), F.lit(p).alias("all"), F.when(limit >= 0, p).otherwise(0.0).alias("rare"))
        above = fold(mode, F.least(high, mode + wide) - 1, start(1.0), lambda s, k: step(s, up(k.cast("double"))), lambda s: F.struct(s["all"], s["rare"]))
        below = fold(F.lit(1), F.least(mode - low, wide), start(0.0), lambda s, k: step(s, -up(mode - k)), lambda s: F.struct(s["all"], s["rare"]))
        return F.element_at(F.transform(F.array(F.struct(above.alias("u"), below.alias("d"))), lambda x: (x.u["rare"] + x.d["rare"]) / (x.u["all"] + x.d["all"])), 1)

    return F.element_at(F.transform(F.array(own + 1e-7), with_own), 1)


def contingency(df: DataFrame, *, phase: str, event: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """keys, chi2 (with the continuity correction for 2x2), dof, p and Fisher's exact p (2x2 only) of phase by event.

    Everything is an expression over cells that were aggregated first; any
    number of phases and keys. With one phase or one kind of event in a key the
    statistics are missing and dof is 0. Rows with a null phase or event don't
    count.
    """
    held = df.where(F.col(phase).isNotNull() & F.col(event).isNotNull())
    cells = held.groupBy(*keys, F.col(phase).alias("__phase")).agg(F.sum(F.col(event).cast("long")).alias("__e"), F.count("*").alias("__n"))
    sums = cells.groupBy(*keys).agg(F.sum("__e").alias("__es"), F.sum("__n").alias("__ns"), F.count("*").alias("__k"), F.min(F.struct("__phase", "__e", "__n")).alias("__one"))
    both = cells.join(sums.drop("__one"), keys) if keys else cells.join(F.broadcast(sums.drop("__one")))  # one row
    square = (F.col("__k") == 2) & F.col("__es").between(1, F.col("__ns") - 1)

    def part(seen: Column, share: Column) -> Column:
        expected = F.col("__n") * share / F.col("__ns")
        d = F.abs(seen - expected)
        return F.try_divide(F.pow(F.when(square, d - F.least(F.lit(0.5), d)).otherwise(d), F.lit(2)), expected)

    parts = part(F.col("__e"), F.col("__es")) + part(F.col("__n") - F.col("__e"), F.col("__ns") - F.col("__es"))
    chi2 = both.groupBy(*keys).agg(F.sum(parts).alias("__chi2"))
    out = sums.join(chi2, keys) if keys else sums.join(F.broadcast(chi2))
    there = (F.col("__k") >= 2) & F.col("__es").between(1, F.col("__ns") - 1)
    out = out.withColumns({"chi2": F.when(there, F.col("__chi2")), "dof": F.when(there, F.col("__k") - 1).otherwise(0).cast("int")})
    p = F.when(there, chi2_p(F.col("chi2"), F.col("dof")))
    exact = F.when(square, fisher_p(F.col("__one.__e"), F.col("__es"), F.col("__one.__n"), F.col("__ns")))
    return out.select(*keys, "chi2", "dof", p.alias("p"), exact.alias("fisher_p"))


def logistic_effect(df: DataFrame, *, phase: str, event: str, keys: list[str] = [], steps: int = 40) -> DataFrame:  # noqa: B006
    """keys, odds_ratio with its 95 % Wald interval and McFadden's R2 of event by a numeric phase.

    The likelihood depends on the counts of phase by event alone: they are
    aggregated, and Newton's steps are an expression over a key's cells. With
    one phase or one kind of event in a key, or phases that part the events
    entirely, all are missing.
    """
    held = df.where(F.col(phase).isNotNull() & F.col(event).isNotNull())
    cells = held.groupBy(*keys, F.col(phase).cast("double").alias("x")).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(event).cast("double")).alias("e"))
    out = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "n", "e"))).alias("c"), F.sum("n").alias("n"), F.sum("e").alias("e"))
    names = ("g0", "g1", "h00", "h01", "h11")
    start_at = lambda v: F.when(F.col("n") > 0, F.lit(v))  # a value that may become null in a fold
    zero = F.struct(*(start_at(0.0).alias(v) for v in names))

    def gathered(b0: Column, b1: Column) -> Column:
        def add(s: Column, c: Column) -> Column:
            p = 1 / (1 + F.exp(-(b0 + b1 * c.x)))
            left, info = c.e - c.n * p, c.n * p * (1 - p)
            return F.struct(*((s[v] + t).alias(v) for v, t in zip(names, (left, left * c.x, info, info * c.x, info * c.x * c.x))))

        return F.aggregate("c", zero, add)

    def newton(s: Column, _: Column) -> Column:
        def moved(h: Column) -> Column:
            det = F.when(h.h00 > 1e-9 * F.col("n"), h.h00 * h.h11 - h.h01 * h.h01)  # else the fit runs off to certainty
            d0, d1 = F.try_divide(h.h11 * h.g0 - h.h01 * h.g1, det), F.try_divide(h.h00 * h.g1 - h.h01 * h.g0, det)
            return F.struct((s["b0"] + d0).alias("b0"), (s["b1"] + d1).alias("b1"), F.greatest(F.abs(d0), F.abs(d1)).alias("d"))

        return F.when(s["d"] < 1e-12, s).otherwise(F.element_at(F.transform(F.array(gathered(s["b0"], s["b1"])), moved), 1))

    start = F.struct(start_at(0.0).alias("b0"), start_at(0.0).alias("b1"), start_at(1.0).alias("d"))
    out = out.withColumn("b", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, newton)).withColumn("h", gathered(F.col("b.b0"), F.col("b.b1")))

    def likelihood(s: Column, c: Column) -> Column:
        z = F.col("b.b0") + F.col("b.b1") * c.x
        return s - c.e * F.log1p(F.exp(-z)) - (c.n - c.e) * F.log1p(F.exp(z))

    mean = F.col("e") / F.col("n")
    null = F.col("n") * (mean * F.log(mean) + (1 - mean) * F.log(1 - mean))
    se = F.sqrt(F.try_divide(F.col("h.h00"), F.col("h.h00") * F.col("h.h11") - F.pow(F.col("h.h01"), F.lit(2))))
    sure = (F.size("c") > 1) & (F.col("e") > 0) & (F.col("e") < F.col("n")) & (F.col("b.d") < 1e-6)
    told = {"odds_ratio": F.exp("b.b1"), "low": F.exp(F.col("b.b1") - Z95 * se), "high": F.exp(F.col("b.b1") + Z95 * se), "r2": 1 - F.aggregate("c", F.lit(0.0), likelihood) / null}
    return out.select(*keys, *(F.when(sure, v).alias(k) for k, v in told.items()))


def bootstrap_shares(df: DataFrame, *, phase: str, event: str, replicates: int = 5000, seed: int = 42) -> DataFrame:
    """P(event | phase) with a 95 % bootstrap interval: phase, n, p, low, high.

    Resampling zeros and ones depends on their counts alone, so counts are
    aggregated and binomial replicates drawn, a phase in each task.
    """
    cells = df.where(F.col(phase).isNotNull() & F.col(event).isNotNull()).groupBy(F.col(phase).cast("string").alias("phase")).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("e"))

    def draw(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n, e = int(frame.n.iloc[0]), int(frame.e.iloc[0])
        rng = np.random.default_rng([seed, *key[0].encode()])
        shares = rng.binomial(n, e / n, replicates) / n
        low, high = np.percentile(shares, [2.5, 97.5])
        return pd.DataFrame({"phase": [key[0]], "n": [n], "p": [e / n], "low": [low], "high": [high]})

    return cells.groupBy("phase").applyInPandas(draw, "phase string, n long, p double, low double, high double")


def nested_bootstrap_shares(df: DataFrame, *, phase: str, event: str, run: str, replicates: int = 5000, seed: int = 42) -> DataFrame:
    """As bootstrap_shares, resampling runs and then the samples of each drawn run; runs weigh the same."""
    cells = df.where(F.col(phase).isNotNull() & F.col(event).isNotNull()).groupBy(F.col(phase).cast("string").alias("phase"), F.col(run).alias("run")).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("e"))

    def draw(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("run")
        n, share = frame.n.to_numpy(), (frame.e / frame.n).to_numpy()
        rng = np.random.default_rng([seed, *key[0].encode()])
        runs = rng.integers(0, len(n), (replicates, len(n)))
        means = (rng.binomial(n[runs], share[runs]) / n[runs]).mean(1)
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({"phase": [key[0]], "runs": [len(n)], "p": [share.mean()], "low": [low], "high": [high]})

    return cells.groupBy("phase").applyInPandas(draw, "phase string, runs int, p double, low double, high double")


def variance_explained(df: DataFrame, *, phase: str, event: str, replicates: int = 5000, seed: int = 42) -> DataFrame:
    """Share of an event's variance between phases, with a 95 % bootstrap interval drawn from the table of counts."""
    cells = df.where(F.col(phase).isNotNull() & F.col(event).isNotNull()).groupBy(F.col(phase).cast("string").alias("phase")).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("e"))

    def share(no: np.ndarray, yes: np.ndarray) -> np.ndarray:
        n = no + yes
        total, mean = n.sum(-1), yes.sum(-1) / n.sum(-1)
        part = np.divide(yes, n, out=np.zeros_like(yes, float), where=n > 0)
        between = (n * (part - mean[..., None]) ** 2).sum(-1) / total
        whole = mean * (1 - mean)
        return np.divide(between, whole, out=np.zeros_like(whole), where=whole > 0)

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("phase")
        yes, no = frame.e.to_numpy(float), (frame.n - frame.e).to_numpy(float)
        n, k = int((yes + no).sum()), len(frame)
        drawn = np.random.default_rng(seed).multinomial(n, np.concatenate([no, yes]) / n, replicates).astype(float)
        low, high = np.percentile(share(drawn[:, :k], drawn[:, k:]), [2.5, 97.5])
        return pd.DataFrame({"phases": [k], "n": [n], "explained": share(no[None], yes[None]), "low": [low], "high": [high]})

    return cells.groupBy().applyInPandas(draw, "phases int, n long, explained double, low double, high double")
