from __future__ import annotations

from fractions import Fraction

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from driftgrid.llm.mixing import mix_sources, share_out
from driftgrid.llm.queries import OP3_SQL, mix_tokens, mixed
from tests.llm.data import frame


def fill(budget: int, children: list[tuple[int, int]]) -> list[Fraction]:
    """Shares of (weight, cap) children by repeated redistribution."""
    share = [Fraction(0)] * len(children)
    left, free = Fraction(budget), set(range(len(children)))
    while free:
        w = sum(children[i][0] for i in free)
        full = [i for i in free if left * children[i][0] / w >= children[i][1]]
        if not full:
            for i in free:
                share[i] = left * children[i][0] / w
            break
        for i in full:
            share[i] = Fraction(children[i][1])
        left -= sum(children[i][1] for i in full)
        free -= set(full)
    return share


def test_share_out_redistributes_among_siblings(spark):
    cases = {"a": (100, [(5, 10), (3, 100), (2, 100)]), "b": (100, [(1, 20), (1, 30), (8, 10)]), "c": (7, [(1, 100), (1, 100)])}
    rows = [(p, f"k{i}", b, w, c) for p, (b, kids) in cases.items() for i, (w, c) in enumerate(kids)]
    out = share_out(spark.createDataFrame(rows, "p string, k string, budget long, w long, cap long"), ["p"], "k").toPandas().set_index(["p", "k"]).share
    for p, (b, kids) in cases.items():
        for i, want in enumerate(fill(b, kids)):
            assert out[p, f"k{i}"] == int(want)


def test_nulls_repeats_and_clashes(spark):
    df = frame(spark)
    out = mix_sources(df, {"lang": F.col("lang"), "source": F.col("source")}, {"lang": {"en": 3}}, tokens=mix_tokens(), budget=(1, 2), max_epochs=3)
    assert set(out.columns) == set(df.columns) | {"mix_tokens"}
    got, total = out.toPandas(), df.agg(F.sum(mix_tokens())).first()[0]
    assert 0 < got.mix_tokens.sum() <= total // 2 and got.epoch.max() <= 2
    again = got[got.doc_id == 4].groupby("epoch").size()
    assert (again == 2).all()
    assert mix_sources(frame(spark, []), {"lang": F.col("lang")}, {}, tokens=mix_tokens()).count() == 0


def test_zero_weight_leaves_a_source_out(spark):
    out = mix_sources(frame(spark), {"source": F.col("source")}, {"source": {"src0": 0}}, tokens=mix_tokens())
    assert out.where("source = 'src0'").count() == 0 and out.where("source = 'src1'").count() > 0


def test_prefix_of_a_later_epoch(spark):
    rows = [(i, "abcd" * 10, "en", s, 40, 0.0, 0, 0, 0, "") for i, s in enumerate(["a"] * 5 + ["b"] * 50)]
    out = mix_sources(frame(spark, rows), {"source": F.col("source")}, {"source": {"*": 1}}, tokens=mix_tokens(), budget=(24, 55), max_epochs=4).toPandas()
    n = out.groupby("source").size()
    assert n["a"] == 12 and n["b"] == 12  # two whole epochs of five and a prefix of two; a prefix of twelve
    assert out[out.source == "a"].groupby("epoch").size().tolist() == [5, 5, 2]


def test_equals_its_sql(spark):
    df = frame(spark).select("doc_id", "text", "lang", "source")
    documents = df.toArrow()  # noqa: F841
    want = duckdb.sql(OP3_SQL).df()
    got = mixed(df).select("doc_id", "lang", "source", "epoch", F.col("mix_tokens").alias("tokens")).toPandas()
    key = ["doc_id", "lang", "source", "epoch", "tokens"]
    norm = lambda d: d[key].astype(str).replace({"nan": "None", "<NA>": "None"}).sort_values(key).reset_index(drop=True)
    fix = lambda d: d.assign(doc_id=d.doc_id.astype("Float64").astype("Int64"))
    pd.testing.assert_frame_equal(norm(fix(got)), norm(fix(want)))
