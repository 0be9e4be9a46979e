from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftgrid.llm.fill_in_middle import UNITS, SkipList, check_markers, fill_in_middle, lengths, restored
from driftgrid.llm.queries import op11_fill_in_middle
from tests.llm.data import documents, frame

SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=400))
def test_ranks_are_reached_exactly(sizes):
    held, upto = SkipList(np.array(sizes, np.int64)), np.concatenate([[0], np.cumsum(sizes, dtype=int)])
    assert [held.points_before(k) for k in range(len(sizes) + 1)] == upto.tolist()
    for units, points, below in held.lanes:
        assert units.sum() == len(sizes) and points.sum() == sum(sizes) and len(units) == len(points) == len(below)


def test_lanes_thin_out_and_few_links_are_passed():
    held = SkipList(np.ones(1_000_000, np.int64))
    assert 5 <= len(held.lanes) <= 20 and len(held.lanes[-1][0]) <= 64
    assert all(len(a[0]) > 1.5 * len(b[0]) for a, b in zip(held.lanes, held.lanes[1:]))
    rng = np.random.default_rng(0)
    for rank in rng.integers(0, 1_000_001, 50):
        assert held.points_before(int(rank)) == rank


@given(st.text(alphabet="ab \n\t　é漢𝒳", max_size=60))
def test_units_cover_the_text(text):
    for unit in UNITS:
        assert lengths(text, unit).sum() == len(text) and (lengths(text, unit) > 0).all()


def by_hand(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, SHA(text), SHA(text)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = text[:i], text[i:j], text[j:]
    out = f"<S>{c}<P>{a}<M>{b}" if h4 % 100 < 20 else f"<P>{a}<S>{c}<M>{b}"
    return n, "spm" if h4 % 100 < 20 else "psm", i, j - i, SHA(out), SHA(text)


def query(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    return op11_fill_in_middle(spark, str(tmp_path))


def test_query_equals_brute_force(spark, tmp_path):
    extra = [(1000 + i, t, None, None, 0, None, None, None, None, None) for i, t in enumerate(["a<P>b", "<S>", "x<M", "<", "<<<S", "S>P>M>", "😀é́", "\x00\n\x00"] * 20)]
    extra += [(2000, "𝒳é " * 400_000, None, None, 0, None, None, None, None, None)]
    rows = documents() + extra
    got = query(spark, rows, tmp_path)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(((r[0], *by_hand(r[0], r[1])) for r in rows), key=key)
    assert {r.form for r in got.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_empty_table(spark, tmp_path):
    assert query(spark, [], tmp_path).count() == 0


@pytest.mark.parametrize("unit", sorted(UNITS))
def test_all_units_and_settings_round_trip(spark, unit):
    df = frame(spark)
    marks = ("«pre»", "«suf»", "«mid»")
    out = fill_in_middle(df, unit=unit, seed=9, plain_percent=0, suffix_first_percent=50, markers=marks).withColumn("back", restored(F.col("output"), F.col("form"), marks))
    rows = out.collect()
    assert sorted(r.back for r in rows) == sorted(r[1] or "" for r in documents())
    whole = [r for r in rows if r.back]
    assert {r.form for r in whole} == {"psm", "spm"} and {r.form for r in rows if not r.back} == {"plain"}
    for r in whole:
        upto = {0, *np.cumsum(lengths(r.back, unit)).tolist()}
        assert {r.prefix_chars, r.prefix_chars + r.middle_chars} <= upto and r.n == len(lengths(r.back, unit))


def test_shares_follow_the_percentages(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"))
    n = {r.form: r["count"] for r in fill_in_middle(df).groupBy("form").count().collect()}
    assert abs(n["plain"] / 20_000 - 0.1) < 0.01 and abs(n["spm"] / (n["spm"] + n["psm"]) - 0.2) < 0.015


def test_wrong_settings(spark):
    for marks in [("<P>", "<P>x", "<M>"), ("", "<S>", "<M>"), ("aba", "cd", "ef")]:
        with pytest.raises(ValueError):
            check_markers(marks)
    with pytest.raises(ValueError):
        fill_in_middle(frame(spark, []), unit="page")
