from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.operators import statistics as Q


def chi2_tail(x, dof):
    """By integration of the density."""
    if dof == 1:
        return math.erfc(math.sqrt(x / 2))
    if dof == 2:
        return math.exp(-x / 2)
    return chi2_tail(x, dof - 2) + (x / 2) ** (dof / 2 - 1) * math.exp(-x / 2) / math.gamma(dof / 2)


def fisher(a, row, col, n):
    ways = {k: math.comb(col, k) * math.comb(n - col, row - k) for k in range(max(0, row + col - n), min(row, col) + 1)}
    return float(Fraction(sum(w for w in ways.values() if w * 10**7 <= ways[a] * (10**7 + 1)), sum(ways.values())))


def newton(cells):
    x, n, e = (np.array(v, float) for v in zip(*cells))
    b = np.zeros(2)
    a = np.stack([np.ones_like(x), x], 1)
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ b))
        info = a.T @ (a * (n * p * (1 - p))[:, None])
        b = b + np.linalg.solve(info, a.T @ (e - n * p))
    se = math.sqrt(np.linalg.inv(info)[1, 1])
    m = e.sum() / n.sum()
    r2 = 1 - (e * np.log(p) + (n - e) * np.log(1 - p)).sum() / (n.sum() * (m * math.log(m) + (1 - m) * math.log(1 - m)))
    return math.exp(b[1]), math.exp(b[1] - Q.Z95 * se), math.exp(b[1] + Q.Z95 * se), r2


def test_tails(spark):
    z = [0.0, 1e-8, 0.3, 1.0, 2.0, 2.999, 3.0, 3.001, 5.0, 10.0, 26.0]
    got = [r.p for r in spark.createDataFrame([(v,) for v in z], "z double").select(Q.erfc(F.col("z")).alias("p")).collect()]
    assert all(g == pytest.approx(math.erfc(v), rel=1e-9 if v >= 3 else 1e-10, abs=1e-15) for g, v in zip(got, z))
    rows = [(x, d) for x in (0.0, 0.1, 1.0, 3.84, 20.0, 90.0) for d in (1, 2, 3, 4, 7, 30)]
    got = [r.p for r in spark.createDataFrame(rows, "x double, d int").select(Q.chi2_p(F.col("x"), F.col("d")).alias("p")).collect()]
    assert all(g == pytest.approx(chi2_tail(x, d), rel=1e-8, abs=1e-14) for g, (x, d) in zip(got, rows))


def test_fisher_is_the_sum_over_all_tables(spark):
    rng = random.Random(1)
    rows = [(3, 4, 4, 8), (0, 1, 1, 2), (0, 5, 3, 9), (2, 2, 2, 4)]
    for _ in range(150):
        n = rng.choice([5, 20, 200, 2000])
        row, col = rng.randint(0, n), rng.randint(0, n)
        rows.append((rng.randint(max(0, row + col - n), min(row, col)), row, col, n))
    got = [r.p for r in spark.createDataFrame(rows, "a long, r long, c long, n long").select(Q.fisher_p(F.col("a"), F.col("r"), F.col("c"), F.col("n")).alias("p")).collect()]
    assert all(g == pytest.approx(fisher(*r), rel=1e-8, abs=1e-300) for g, r in zip(got, rows))


def test_fisher_of_large_counts_takes_few_terms(spark):
    big = spark.createDataFrame([(250_020_000, 500_000_000, 500_000_000, 1_000_000_000)], "a long, r long, c long, n long")
    p = big.select(Q.fisher_p(F.col("a"), F.col("r"), F.col("c"), F.col("n")).alias("p")).first().p
    z = (20_000 - 0.5) / math.sqrt(1e9 / 16)  # for such counts the normal law
    assert p == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-2)


def rows_of(rng, keys, phases):
    return [(k, rng.choice(phases), int(rng.random() < 0.3 + 0.1 * (k % 3))) for k in range(keys) for _ in range(rng.randint(40, 120))]


def test_all_keys_equal_brute_force(spark):
    rng = random.Random(7)
    rows = [*rows_of(rng, 20, [0, 1]), *((100 + k, p, e) for k, p, e in rows_of(rng, 5, [-1, 0, 1, 2.5])), *((200, 1, i % 2) for i in range(9)), *((201, i % 2, 1) for i in range(9)), *((202, i % 2, i % 2) for i in range(40)), (0, None, 1), (0, 1, None)]
    df = spark.createDataFrame([(k, None if p is None else float(p), e) for k, p, e in rows], "k int, phase double, event int")
    tests = {r.k: r for r in Q.contingency(df, phase="phase", event="event", keys=["k"]).collect()}
    effects = {r.k: r for r in Q.logistic_effect(df, phase="phase", event="event", keys=["k"]).collect()}
    for k in {r[0] for r in rows}:
        cells = {}
        for kk, p, e in rows:
            if kk == k and p is not None and e is not None:
                n, s = cells.get(p, (0, 0))
                cells[p] = (n + 1, s + e)
        n, s = sum(v[0] for v in cells.values()), sum(v[1] for v in cells.values())
        t, o = tests[k], effects[k]
        if len(cells) < 2 or not 0 < s < n:
            assert (t.chi2, t.dof, t.p, t.fisher_p, o.odds_ratio, o.r2) == (None, 0, None, None, None, None)
            continue
        chi2 = 0.0
        for m, e in cells.values():
            for seen, want in ((e, m * s / n), (m - e, m * (n - s) / n)):
                d = abs(seen - want)
                chi2 += (d - min(0.5, d) if len(cells) == 2 else d) ** 2 / want
        assert t.chi2 == pytest.approx(chi2) and t.dof == len(cells) - 1 and t.p == pytest.approx(chi2_tail(chi2, t.dof), rel=1e-6)
        first = min(cells)
        assert t.fisher_p is None if len(cells) > 2 else t.fisher_p == pytest.approx(fisher(cells[first][1], s, cells[first][0], n), rel=1e-7)
        if k == 202:
            assert o.odds_ratio is None  # parted entirely
        else:
            assert (o.odds_ratio, o.low, o.high, o.r2) == pytest.approx(newton([(x, *v) for x, v in cells.items()]), rel=1e-6)


def test_thousands_of_phases_without_keys(spark):
    df = spark.range(60_000).select((F.col("id") % 3000).cast("double").alias("phase"), ((F.col("id") * 7919 % 1000) < 300).cast("int").alias("event"))
    r = Q.contingency(df, phase="phase", event="event").first()
    assert r.dof == 2999 and 0 <= r.p <= 1 and r.fisher_p is None
    assert Q.logistic_effect(df, phase="phase", event="event").first().odds_ratio == pytest.approx(1, abs=0.01)
    assert Q.contingency(df.where("false"), phase="phase", event="event").count() == 1
