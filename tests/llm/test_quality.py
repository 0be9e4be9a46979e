from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from driftgrid.llm import quality
from driftgrid.llm.common import words as split_words
from driftgrid.llm.queries import op13_quality
from tests.llm.data import documents, frame, words


def describe(texts):
    x, parts = zip(*(quality.described(w) for _, _, w in split_words(pa.array(texts))))
    return np.concatenate(x), np.concatenate(parts)


def labelled(n, seed=0, long=False):
    """Prose, and prose that is junk from some place on."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        good = rng.random() < 0.7
        w = words(rng, rng.randint(60, 900 if long else 300))
        if not good:
            at, kind = rng.randrange(len(w) // 2), i % 3
            w[at:] = [x.upper() + "!!" for x in w[at:]] if kind == 0 else [w[at]] * (len(w) - at) if kind == 1 else [f"{x}&&&" for x in w[at:]]
        rows.append((i, " ".join(w), int(good)))
    return rows


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    shapes = {"code": (7, 5), "code0": (5,), "view": (5, 4), "view0": (4,), "gate": (5, 4), "gate0": (4,), "ask": (4,), "out": (5,), "out0": (1,)}
    w = {k: rng.normal(size=s) for k, s in shapes.items()}
    x, parts, y = rng.normal(size=(9, 7)), np.array([1, 5, 3]), np.array([1.0, 0.0, 1.0])
    _, d = quality.gradients(w, x, parts, y)
    for k in w:
        for at in np.ndindex(w[k].shape):
            up, down = ({**w, k: w[k].copy()} for _ in range(2))
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            want = (quality.gradients(up, x, parts, y)[0] - quality.gradients(down, x, parts, y)[0]) / 2e-6
            assert d[k][at] == pytest.approx(want, abs=1e-6)


def test_attention_is_a_weight_of_passages_of_one_text():
    rows = labelled(120)
    x, parts = describe([r[1] for r in rows])
    model = quality.fit(x, parts, np.array([r[2] for r in rows]), epochs=10)
    p, a = model.scores(x, parts)
    assert np.allclose(np.add.reduceat(a, np.cumsum(parts) - parts), 1) and ((0 <= p) & (p <= 1)).all()
    alone = np.concatenate([model.scores(x[i : i + n], np.array([n]))[0] for i, n in zip(np.cumsum(parts) - parts, parts)])
    assert np.allclose(p, alone)  # a text's score depends on nothing else
    assert [quality.fit(x, parts, np.array([r[2] for r in rows]), epochs=2).weights["out"].tolist() for _ in range(2)].count(quality.fit(x, parts, np.array([r[2] for r in rows]), epochs=2).weights["out"].tolist()) == 2


def test_features_are_those_of_each_passage():
    texts = ["Ab cd. EF!! ef ef 12 " * 20, "", None, " \n ", "漢字 é", "x" * 5000]
    x, parts = describe(texts)
    assert parts.tolist() == [3, 1, 1, 1, 1, 1] and (x[3:6] == 0).all() and np.isfinite(x).all()
    one = " ".join((texts[0].split())[48:96])
    assert np.allclose(x[1], describe([one])[0][0])
    assert x[1][1] == pytest.approx(np.sqrt(sum(c.isupper() for c in one) / len(one)))
    w = one.split()
    of_words = x[1][-quality.WORD_FEATURES :]
    assert of_words[3] == pytest.approx(len(set(w)) / 48) and of_words[5] == pytest.approx(sum(p == q for p, q in zip(w, w[1:])) / 48) and of_words[6] == pytest.approx(8 / 48) and of_words[7] == pytest.approx(8 / 48)


def write(spark, rows, labels, path):
    frame(spark, rows).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_held_out_accuracy_and_labels_that_are_never_learnt(spark, tmp_path):
    rows = labelled(800, long=True)
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows}
    docs = [(i, t, "en", f"s{y}", len(t), 0.0, 0, 0, 0, "") for i, t, y in rows]
    results = []
    for k, flip in enumerate((False, True)):
        labels = [(i, 1 - y if flip and held[i] else y, 0) for i, _, y in rows] + [(5, None, None), (None, 1, 0), (99_999, 0, 0)]
        sf = write(spark, docs, labels, tmp_path / str(k))
        results.append(sorted(map(tuple, op13_quality(spark, sf).collect())))
    assert results[0] == results[1]
    good = {i: y for i, _, y in rows}
    assert all(h == held[i] and p == int(s >= 0.7) for i, h, s, p in results[0])
    assert np.mean([p == good[i] for i, h, _, p in results[0] if h]) > 0.97


def test_odd_tables(spark, tmp_path):
    rows = documents()
    sf = write(spark, rows, [(i, i % 2, 0) for i in range(40)], tmp_path / "a")
    got = op13_quality(spark, sf).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 22, 23, 24)}) == 1  # equal texts
    sf = write(spark, rows, [(i, 1, 0) for i in range(40)], tmp_path / "b")  # labels of one kind
    assert len({round(r.score, 9) for r in op13_quality(spark, sf).collect()}) == 1
    sf = write(spark, [], [], tmp_path / "c")
    assert op13_quality(spark, sf).count() == 0


def test_columns_stay_and_attention_is_told(spark):
    df = frame(spark)
    x, parts = describe([r[1] for r in labelled(60)])
    model = quality.fit(x, parts, np.array([r[2] for r in labelled(60)]), epochs=3)
    out = quality.score(df, model, attention_col="n_words")
    assert sorted(out.columns) == sorted(df.columns) and out.count() == df.count()
    row = out.where("doc_id = 28").first()
    assert len(row.n_words) == -(-2000 // 48) and sum(row.n_words) == pytest.approx(1, abs=1e-4)
