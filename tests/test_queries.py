"""Every registered query with oracle SQL against DuckDB. Values are rounded by both; on a tie they may differ by the last digit kept."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from driftgrid.plans.registry import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols and len(got)
    tidy = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(tidy(got), tidy(want), check_dtype=False, atol=2e-4)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["member", "start", "slope", "threshold", "event"]
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(ORACLE) <= set(__spark_entry__.oracle_sql())


def test_all_splits_and_cluster_counts(spark):
    splits = set(range(9))
    assert {r.split for r in QUERIES["classifier_scores"](spark, SF).select("split").distinct().collect()} == splits
    relevance = QUERIES["linear_relevance"](spark, SF)
    assert {r.split for r in relevance.select("split").distinct().collect()} == splits
    assert relevance.count() == relevance.select("split", "vec_id", "cell_id").distinct().count()
    assert {r.k for r in QUERIES["cluster_scan"](spark, SF).collect()} == {2, 3, 4, 5}


def test_tripole_of_equal_cells_has_the_label_of_its_oracle(spark, tmp_path):
    path = f"{tmp_path}/embeddings.parquet"
    with duckdb.connect() as con:
        con.execute(f"COPY (SELECT i AS vec_id, list_transform(range(0, 64), lambda k: sin(i)::FLOAT) AS embedding, 0 AS label FROM range(0, 480) r(i)) TO '{path}'")
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}'")
        want = {r[:2]: r[4] for r in con.execute(ORACLE["tripole_index"]).fetchall()}
    got = {(r.member, r.t): r.label for r in QUERIES["tripole_index"](spark, str(tmp_path)).collect()}
    assert len(got) == 480 and got == want
