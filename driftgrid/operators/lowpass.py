"""Zero-phase Chebyshev low-pass filter of monthly series.

A recursive filter is a linear recurrence: its state after a block of steps is a
power of one matrix times the state before, plus what the block alone gives. So
a series is cut into blocks that are filtered apart; blocks' states are added up
by doubling, and each block's output gets what its start state adds. No step
waits for the one before it.
"""

from __future__ import annotations

import cmath
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.session import cut

BLOCK = 256  # steps


def chebyshev(order: int, ripple_db: float, cutoff: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a digital type-I low-pass; ``cutoff`` is a fraction of the Nyquist frequency."""
    eps = math.sqrt(10 ** (ripple_db / 10) - 1)
    mu = math.asinh(1 / eps) / order
    warped = 4 * math.tan(math.pi * cutoff / 2)  # sampling frequency 2
    poles = np.array([-warped * cmath.sinh(complex(mu, math.pi * m / (2 * order))) for m in range(-order + 1, order, 2)])
    gain = np.prod(-poles).real * (1 if order % 2 else 1 / math.sqrt(1 + eps * eps))
    z = (4 + poles) / (4 - poles)
    gain = gain * (1 / np.prod(4 - poles)).real
    return gain * np.poly(-np.ones(order)), np.real(np.poly(z))


def steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Filter state of a constant input of 1."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[0] = -a[1:]
    companion[np.arange(1, n), np.arange(n - 1)] = 1
    return np.linalg.solve(np.eye(n) - companion.T, b[1:] - a[1:] * b[0])


def run(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Transposed direct form with a start state, step by step: what the blocks are tested against."""
    out, state = np.empty_like(x), state.copy()
    for i, v in enumerate(x):
        y = b[0] * v + state[0]
        state[:-1] = state[1:] + b[1:-1] * v - a[1:-1] * y
        state[-1] = b[-1] * v - a[-1] * y
        out[i] = y
    return out


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forwards and backwards over an odd extension of three filter lengths, each from the steady state."""
    pad = padding(b, a)
    if len(x) <= pad:
        raise ValueError(f"a series needs more than {pad} steps")
    ends = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    zi = steady(b, a)
    forth = run(b, a, ends, zi * ends[0])
    back = run(b, a, forth[::-1], zi * forth[-1])[::-1]
    return back[pad:-pad]


def padding(b: np.ndarray, a: np.ndarray) -> int:
    return 3 * max(len(a), len(b))


class Blocks:
    """The filter on blocks of ``size`` steps: output = toeplitz @ x + answer @ state, next state = power @ state + gather.T @ x."""

    def __init__(self, b: np.ndarray, a: np.ndarray, size: int) -> None:
        n = len(a) - 1
        step = np.diag(np.ones(n - 1), 1)
        step[:, 0] -= a[1:]
        enter = b[1:] - a[1:] * b[0]
        self.size, self.answer, self.gather = size, np.zeros((size, n)), np.zeros((size, n))
        row, column = np.eye(n)[0], enter
        for j in range(size):  # powers of the step matrix
            self.answer[j], self.gather[size - 1 - j] = row, column
            row, column = row @ step, step @ column
        impulse = np.concatenate([[b[0]], (self.answer @ enter)[:-1]])
        at = np.arange(size)[:, None] - np.arange(size)[None, :]
        self.toeplitz = np.where(at >= 0, impulse[np.maximum(at, 0)], 0.0)
        self.power = np.linalg.matrix_power(step, size)

    def padded(self, blocks: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        """(blocks as rows, filled with zeros; their lengths)."""
        n = blocks.map(len).to_numpy()
        out = np.zeros((len(blocks), self.size))
        out[np.arange(self.size)[None, :] < n[:, None]] = np.concatenate(blocks.to_list()) if len(blocks) else []
        return out, n

    def states(self, gathered: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The state before each of a series' blocks, from what each block gathers, in as many steps as the number of blocks has digits."""
        out, power, d = np.vstack([start, gathered[:-1]]), self.power, 1
        while d < len(out):
            out[d:] = out[d:] + out[:-d] @ power.T
            power, d = power @ power, 2 * d
        return out


def recurrence(df: DataFrame, filt: Blocks, start: np.ndarray, *, keys: list[str]) -> DataFrame:
    """keys, i, y: the filter along x by i (from 0, without gaps), from the state ``start`` times the first x."""
    size, n = filt.size, len(start)
    order = F.array_sort(F.collect_list(F.struct("i", "x")))
    blocks = df.groupBy(*keys, F.floor(F.col("i") / size).alias("block")).agg(order.alias("e"))
    steps = F.sequence(F.col("block") * size, F.col("block") * size + F.size("e") - 1)
    checked = F.when(F.col("e.i") != steps, F.raise_error("steps are missing or repeated")).otherwise(F.col("e.x"))
    blocks = cut(blocks.select(*keys, "block", checked.alias("x")))  # read twice: for the states, and to be filtered

    @F.pandas_udf("array<double>")
    def gathered(x: pd.Series) -> pd.Series:
        return pd.Series(list(filt.padded(x)[0] @ filt.gather))

    @F.pandas_udf("array<double>")
    def states(z: pd.Series, first: pd.Series) -> pd.Series:
        return pd.Series([filt.states(np.asarray(v).reshape(-1, n), start * f).ravel() for v, f in zip(z, first)])

    @F.pandas_udf("array<double>")
    def filtered(x: pd.Series, s: pd.Series) -> pd.Series:
        rows, length = filt.padded(x)
        y = rows @ filt.toeplitz.T + (np.stack(s.to_list()) @ filt.answer.T if len(s) else 0.0)
        return pd.Series([v[:k] for v, k in zip(y, length)])

    each = F.array_sort(F.collect_list(F.struct("block", gathered("x").alias("z"), F.col("x")[0].alias("first"))))
    series = blocks.groupBy(*keys).agg(each.alias("b")).select(*keys, states(F.flatten("b.z"), F.col("b")[0].first).alias("s"), F.size("b").alias("blocks"))
    cut_up = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.slice("s", k * n + 1, n))
    before = series.select(*keys, F.posexplode(cut_up).alias("block", "s"))
    told = blocks.join(before, [*keys, "block"]).select(*keys, "block", F.posexplode(filtered("x", "s")).alias("j", "y"))
    return told.select(*keys, (F.col("block") * size + F.col("j")).alias("i"), "y")


def lowpass(df: DataFrame, *, keys: list[str], t: str = "t", value: str = "value", cutoff_years: float = 13.0, order: int = 4, ripple_db: float = 0.05, name: str = "filtered", block: int = BLOCK) -> DataFrame:
    """keys, t, value, ``name``: each series low-passed.

    A series with a missing value, or of 15 steps or fewer (three filter
    lengths), comes out missing. Steps follow each other by ``t``; where it is a
    whole number without gaps, as months are, its value tells a row's place and
    no series is sorted. Repeated steps of a series are an error.
    """
    b, a = chebyshev(order, ripple_db, 2 / (12 * cutoff_years))
    pad, zi, filt = padding(b, a), steady(b, a), Blocks(b, a, block)
    held = df.select(*keys, t, df[value].cast("double").alias(value), F.struct(F.lit(0), *keys).alias("__k"))
    v, n, p = F.col(value), F.col("__n"), F.col("__p")
    whole = dict(held.dtypes)[t] in ("tinyint", "smallint", "int", "bigint")
    held = cut(held)
    stats = cut(held.groupBy("__k").agg(F.count("*").alias("__n"), F.count(value).alias("__present"), F.min(t).alias("__t0"), F.max(t).alias("__t1"), F.min_by(value, t).alias("__first"), F.max_by(value, t).alias("__last")))
    regular = whole and stats.where("__n != __t1 - __t0 + 1").isEmpty()
    place = F.col(t) - F.col("__t0") if regular else F.row_number().over(Window.partitionBy("__k").orderBy(t)) - 1
    placed = held.join(stats, "__k").withColumn("__p", place.cast("long"))
    point = lambda i, x: F.struct(i.cast("long").alias("i"), x.alias("x"))
    ends = [point(p + pad, v), F.when(p.between(1, pad), point(pad - p, 2 * F.col("__first") - v)), F.when(p.between(n - 1 - pad, n - 2), point(n + pad + n - 2 - p, 2 * F.col("__last") - v))]
    long = placed.where((n > pad) & (F.col("__present") == n)).select("__k", "__n", F.explode(F.array_compact(F.array(*ends))).alias("e")).select("__k", "__n", "e.i", "e.x")
    back = lambda x: x.select("__k", "__n", (n + 2 * pad - 1 - F.col("i")).alias("i"), F.col("y").alias("x"))
    forth = recurrence(long, filt, zi, keys=["__k", "__n"])
    out = back(recurrence(back(forth), filt, zi, keys=["__k", "__n"]))
    told = out.select("__k", (F.col("i") - pad).alias("__p"), F.col("x").alias(name)).where("__p >= 0")
    return placed.join(told, ["__k", "__p"], "left").select(*keys, t, value, name)
