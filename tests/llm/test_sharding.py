from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.llm.queries import op1_shard
from driftgrid.llm.sharding import cell_sizes, hypergeometric, matrix_row, shuffle_into_shards
from tests.llm.data import documents, frame


def test_matrix_has_exact_margins():
    rows = np.array([5, 0, 17, 40, 1])
    starts = np.concatenate([[0], np.cumsum(rows)])
    _, _, size = cell_sizes(int(rows.sum()), 4, 7)
    m = np.array([matrix_row(starts, size, p, 3) for p in range(len(rows))])
    assert (m.sum(1) == rows).all() and (m.sum(0) == size).all() and (m >= 0).all()


def test_large_hypergeometric_has_the_right_mean():
    rng = np.random.default_rng(1)
    good, bad, take = 3 * 10**9, 7 * 10**9, 10**6
    draws = [hypergeometric(rng, good, bad, take) for _ in range(300)]
    assert abs(np.mean(draws) - 3e5) < 5 * np.sqrt(2.1e5 / 300) and 300 < np.std(draws) < 600


@pytest.mark.parametrize("cell_rows", [3, 1 << 20])
def test_shards(spark, cell_rows):
    df = frame(spark).repartition(3)
    out = shuffle_into_shards(df, 5, seed=2, cell_rows=cell_rows).toPandas()
    assert len(out) == df.count() and sorted(out.columns) == sorted(df.columns + ["slot"])
    sizes = out.groupby("shard").size()
    assert set(sizes.index) == set(range(5)) and sizes.max() - sizes.min() <= 1
    for _, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert sorted(map(str, out.text)) == sorted(str(r.text) for r in df.collect())


def test_more_shards_than_rows_and_empty(spark):
    out = shuffle_into_shards(frame(spark).limit(3).coalesce(1), 8).toPandas()
    assert len(out) == 3 and (out.slot == 0).all() and out.shard.nunique() == 3
    assert shuffle_into_shards(frame(spark, []), 4).count() == 0
    with pytest.raises(ValueError):
        shuffle_into_shards(frame(spark, []), 0)


def test_uniform_over_partitions_shards_and_slots(spark):
    df = spark.range(40, numPartitions=4).withColumn("part", F.spark_partition_id()).cache()
    pairs, slots, seeds = np.zeros((4, 4)), np.zeros((4, 10)), 40
    for seed in range(seeds):
        for r in shuffle_into_shards(df, 4, seed=seed).collect():
            pairs[r.part, r.shard] += 1
            slots[r.part, r.slot] += 1
    chi2 = lambda x, e: ((x - e) ** 2 / e).sum()
    # 99.9 % quantiles for 9 and 27 degrees of freedom; both margins are fixed
    assert (pairs.sum(0) == 10 * seeds).all() and chi2(pairs, 2.5 * seeds) < 27.9
    assert (slots.sum(0) == 4 * seeds).all() and chi2(slots, seeds) < 55.5
    assert chi2(pairs, 2.5 * seeds) > 0.5 and chi2(slots, seeds) > 5  # nor too even


def test_query_by_brute_force(spark, tmp_path):
    rows = documents()
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op1_shard(spark, str(tmp_path)).toPandas()
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    ids = [str(None) if np.isnan(x) else str(int(x)) for x in got.doc_id]
    assert sorted(zip(ids, got["size"], got.text_crc32)) == want
    assert set(got.law) == {"rows"} and got.grown_shard.isna().all() and got.shard.between(0, 39).all()
    counts = got.groupby("shard").size().reindex(range(40), fill_value=0)
    assert counts.max() - counts.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
