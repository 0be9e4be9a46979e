from __future__ import annotations

import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.llm.toxicity import DECAY, POWER, SPAN, Kernel, fit, held_out, score, sentences, train, windows
from tests.llm.data import frame, words

INSULTS = ["blockhead", "numbskull", "dimwit"]


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    texts, toxic = [], []
    for i in range(n):
        s = [" ".join(words(rng, 8)).capitalize() + "." for _ in range(rng.randint(1, 6))]
        bad = i % 5 == 0
        if bad:
            k = rng.randrange(len(s))
            s[k] = s[k][:-1] + f" {rng.choice(INSULTS)} " + words(rng, 1)[0] + "."
        texts.append(" ".join(s)), toxic.append(int(bad))
    return texts, np.array(toxic)


@pytest.fixture(scope="module")
def model():
    return fit(*corpus())


def test_unseen_documents(model):
    texts, toxic = corpus(300, seed=9)
    p = model.scores(texts)
    assert ((p >= 0.5) == toxic).mean() > 0.98 and ((p >= 0) & (p <= 1)).all()


def test_gapped_and_inserted_characters(model):
    for t in ("you b.l.o.c.k.h.e.a.d now", "you BLOCKHEAD", "d i m w i t there", "a numb-skull", "numbxskull", "dimxwit", "dixmwit", "you dim.wit", "bl0ckhead"):
        assert model.scores([t])[0] >= 0.5, t
    for t in ("", "a block of heads", "numb", "y" * 100_000, "blo ckh ead"):
        assert model.scores([t])[0] < 0.5, t[:20]


def brute(a: str, b: str) -> float:
    """The kernel from its definition."""

    def vector(w: str) -> dict:
        w, out = f"\x01{w}\x02", {}
        for i, j, k in combinations(range(len(w)), 3):
            if k - i < SPAN:
                out[w[i] + w[j] + w[k]] = out.get(w[i] + w[j] + w[k], 0) + DECAY ** (k - i - 2)
        return out

    x, y = vector(a), vector(b)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return (dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))) ** POWER


def test_kernel_by_brute_force():
    rng = random.Random(4)
    words_ = ["", "a", "ab", "aaaa", "blockhead", "blxockhead", "蠢货", "dumm\U0001d4b3"] + ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    words_ = [w for w in words_ if w]
    got = Kernel(words_).of(words_)
    want = np.array([[brute(a, b) for b in words_] for a in words_])
    assert np.allclose(got, want, atol=1e-9) and np.allclose(np.diag(got), 1)
    assert np.linalg.eigvalsh(got).min() > -1e-9


def test_landmark_matrix_is_positive_semidefinite(model):
    gram = model.kernel.of(model.landmarks)
    assert np.allclose(gram, gram.T) and np.linalg.eigvalsh(gram).min() > -1e-9


def test_held_out_labels_are_not_learnt(spark):
    texts, toxic = corpus()
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i in range(len(texts))]
    schema = "doc_id long, text string, toxic int"
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], schema)
    got = [r.h for r in docs.select(held_out("doc_id").alias("h"), "doc_id").orderBy("doc_id").collect()]
    assert got == held
    labels = [(i, int(y)) for i, y in enumerate(toxic)]
    wrong = [(i, 1 - y if h else y) for (i, y), h in zip(labels, held)]
    a, b = (train(docs.drop("toxic"), spark.createDataFrame(x + [(None, 1), (3, None)], "doc_id long, toxic int")) for x in (labels, wrong))
    assert a.landmarks == b.landmarks and np.allclose(a.alpha, b.alpha)


def test_table(spark, model):
    df = frame(spark)
    out = score(df, model)
    assert out.count() == df.count() and sorted(out.columns) == sorted(df.columns) and out.where("score IS NULL").count() == 0
    assert out.where("text IS NULL OR text = ''").select(F.count_distinct("score")).first()[0] == 1
    assert score(frame(spark, []), model).count() == 0


def test_without_labels_nothing_is_toxic(spark):
    for m in (fit([], np.zeros(0)), fit(["a b", "c d"], np.zeros(2)), fit(["a b", "c d"], np.ones(2))):
        assert (m.scores(["x", "", "a b blockhead"]) < 0.5).all()
    df = frame(spark)
    m = train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert score(df, m).where("score >= 0.5").count() == 0


def test_known_words_overflow(model):
    texts, _ = corpus(40, seed=3)
    chunks = [texts[i : i + 8] for i in range(0, 40, 8)] * 2
    want = np.concatenate([model.scores([t]) for t in texts] * 2)
    try:
        for limit in (1, 60, 200):
            model.limit, model._known = limit, {}
            assert np.allclose(np.concatenate([model.scores(c) for c in chunks]), want), limit
    finally:
        model.limit, model._known = 250_000, {}


def test_long_runs_are_read_whole(model):
    for t in ("section/" * 12 + "blockhead", "a" * 70 + "blockhead", "a" * 10_000 + "blockhead", ",".join(f"item{i}" for i in range(12)) + ",blockhead", "好的天气今天很" * 40 + "numbskull" + "我们去公园" * 30, "x" * 3_000 + "blockhead" + "x" * 3_000):
        assert model.scores([t])[0] >= 0.5, t[:20]
    for t in ("section/" * 200, "好的天气今天很" * 400, "block" + "x" * 200 + "head"):
        assert model.scores([t])[0] < 0.5, t[:20]


def test_long_runs_by_brute_force(model):
    rng = random.Random(2)
    pieces = ["blockhead", "numbskull", "dimwit", "dim", "bloxckhead", "head", "skull"]
    for _ in range(2):
        run = "".join(rng.choice(pieces) if rng.random() < 0.3 else rng.choice("abdehiklmnotu") for _ in range(rng.randint(30, 60)))
        want = max(sum(a * brute(w, m) for m, a in zip(model.landmarks, model.alpha)) for w in windows(run))
        assert np.isclose(model.margins([run])[0], max(want, 0) + model.bias)
    assert windows("蠢货吗") == ["蠢货", "货吗", "蠢货吗"]


def test_insults_of_two_ideographs_are_learnt():
    rng = random.Random(8)
    letters = "天地人你我他今明好大小上中下来去看听说"
    texts, toxic = [], []
    for i in range(240):
        t = "".join(rng.choice(letters) for _ in range(60))
        if i % 4 == 0:
            k = rng.randrange(60)
            t = t[:k] + "蠢货" + t[k:]
        texts.append(t), toxic.append(int(i % 4 == 0))
    m = fit(texts, np.array(toxic))
    assert ((m.scores(texts) >= 0.5) == np.array(toxic)).mean() > 0.98


def test_one_letter_set_in_anywhere_is_tolerated(model):
    variants = [w[:k] + c + w[k:] for w in INSULTS for k in range(1, len(w)) for c in "abcdefghijklmnopqrstuvwxyz"]
    found = model.scores([f"so {v} it is" for v in variants]) >= 0.5
    assert found.mean() >= 0.9
    texts, toxic = corpus(300, seed=21)
    assert (model.scores(texts)[toxic == 0] >= 0.5).mean() < 0.02  # clean texts stay clean


def test_no_clean_word_of_the_sample_counts_as_a_landmark(model):
    texts, toxic = corpus()
    clean = sorted({w for t, y in zip(texts, toxic) if not y for s in sentences(t) for w in s})
    near = model.kernel.of(clean)[:, : len(model.reach)]
    assert np.isfinite(model.reach).any() and not (near >= model.reach).any()


def test_what_the_fit_reads_of_a_text_is_bounded():
    rng = random.Random(3)
    long = ". ".join(" ".join(words(rng, 50)) for _ in range(60))
    got = sentences(long, most=20)
    assert len(got) == 20 and all(len(s) <= 20 for s in got) and got == sentences(long, most=20)
    assert sentences("A b a. Cd") == [["a", "b"], ["cd"]] and sentences("") == [[]]
