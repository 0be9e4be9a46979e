from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from driftgrid.llm.topk import search, top_k


def brute(rows, k, scale=64):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for qi, q in ok:
        if qi % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in ok if i != qi and len(v) == len(q))
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(best[:k])]
    return sorted(out)


def rows():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(150, 13)) / 4
    v[30:60] = v[0]
    out = [(i, [float(x) for x in v[i]]) for i in range(150)]
    out[7] = (7, None)
    out[8] = (8, [float("nan")] + out[8][1][1:])
    out[9] = (9, [None] + out[9][1][1:])
    out[11] = (11, [float("inf")] + out[11][1][1:])
    out[12] = (12, [1.0, 2.0])
    return [*out, (None, out[1][1]), (160, [1.0, -2.0]), (180, [])]


def test_matches_brute_force_across_slabs_and_groups(spark):
    data = rows()
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "rank": F.lit("x")})
    for slab, group in ((8192, 4096), (20, 3)):
        got = top_k(df, F.col("vec_id") % 20 == 0, k=20, slab_rows=slab, group_rows=group)
        assert sorted(map(tuple, got.collect())) == brute(data, 20)
        assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_empty_and_single(spark):
    schema = "vec_id long, embedding array<float>"
    assert top_k(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    assert top_k(spark.createDataFrame([(20, [1.0])], schema), F.lit(True)).count() == 0


def test_large_components_are_exact():
    rng = np.random.default_rng(2)
    v = rng.integers(-(2**28), 2**28, (200, 6))
    ids = np.arange(200)
    q, c, s = search(v[:5], ids[:5], v, ids, 7, block=2)
    for i in range(5):
        best = sorted((-int(sum(int(a) * int(b) for a, b in zip(v[i], v[j]))), j) for j in range(200) if j != i)[:7]
        assert [(-int(x), int(y)) for x, y in zip(s[q == i], c[q == i])] == best


def test_half_of_the_candidates_go_by_half_of_the_blocks():
    rng = np.random.default_rng(3)
    scale = 0.9 ** rng.permutation(64)  # mass in a few dimensions, in no order
    v = np.floor(64 * rng.normal(size=(4000, 64)) * scale).astype(np.int64)
    alive: list[int] = []
    q, c, s = search(v[:50], np.arange(50), v, np.arange(4000), 20, alive_after=alive)
    assert alive[len(alive) // 2 - 1] < 0.5 * 50 * 4000 and alive == sorted(alive, reverse=True)
    for i in range(50):
        score = v @ v[i]
        score[i] = score.min() - 1
        assert s[q == i].tolist() == np.sort(score)[::-1][:20].tolist()


def test_an_id_asks_once(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 5.0]), (1, [1.0, 1.0]), (2, [3.0, 0.5]), (2, [3.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in top_k(df, F.col("vec_id") == 20, k=3).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 64 * 5 * 64), (20, 2, 2, 32 * 5 * 64), (20, 3, 2, 32 * 5 * 64)]
