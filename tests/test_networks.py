from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgrid.operators import networks as N
from driftgrid.operators.scoring import learning_curves

SPLITS = list(range(9))


def data(n=400, d=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(3, 2, (n, d))
    y = ((x[:, 0] - 3) * (x[:, 1] - 3) > 0).astype(int)
    return x, y, np.arange(n) % 20


def frame(spark, x, y, member):
    rows = [(i, int(m), int(v), r.tolist()) for i, (r, v, m) in enumerate(zip(x, y, member))]
    return spark.createDataFrame([*rows, (-1, 3, None, x[0].tolist()), (-2, 3, 1, None)], "i int, member int, label int, features array<double>")


def by_hand(x, y, member, split, run, epochs, patience, scaling, land, rate=0.03, l2=1e-4, gamma=0.0):
    """One model alone, on arrays in memory."""
    sizes = [x.shape[1], 8, 1]
    m = N.Model(split, run, N.start_weights(sizes, split, run, 42), *scaling[split], np.isin(np.arange(x.shape[1]), land))
    part = N.parts_of(member % 10, split)
    tr, va = part == 2, part == 1
    z, n1 = m.inputs(x), y[tr].mean()
    w = np.where(y == 1, 1.5 / (2 * n1), 1 / (2 * (1 - n1)))
    best, at, m1, m2, out = (np.inf, m.weights), 0, 0.0, 0.0, ([], [])
    for e in range(1, epochs + 1):
        score, acts = N.logits(m.weights, z[tr])
        loss, slope = N.loss_and_slope(score, y[tr], w[tr], gamma)
        out[0].append(loss.mean())
        out[1].append(N.loss_and_slope(N.logits(m.weights, z[va])[0], y[va], w[va], gamma)[0].mean())
        if out[1][-1] < best[0]:
            best, at = (out[1][-1], m.weights), e
        elif e - at >= patience:
            break
        v = N.packed(m.weights)
        g = N.backward(m.weights, acts, slope) / tr.sum() + l2 * v
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        m.weights = N.unpacked(v - rate * (m1 / (1 - 0.9**e)) / (np.sqrt(m2 / (1 - 0.999**e)) + 1e-8), sizes)
    return best[1], out


@pytest.mark.parametrize("gamma", [0.0, 2.0])
def test_gradients_equal_differences(gamma):
    rng = np.random.default_rng(1)
    weights, x, y, w = N.start_weights([5, 4, 3, 1], 0, 0, 1), rng.normal(size=(7, 5)), rng.integers(0, 2, 7), rng.random(7)
    loss = lambda v: N.loss_and_slope(N.logits(N.unpacked(v, [5, 4, 3, 1]), x)[0], y, w, gamma)[0].sum()
    z, acts = N.logits(weights, x)
    got, v = N.backward(weights, acts, N.loss_and_slope(z, y, w, gamma)[1]), N.packed(weights)
    for k in range(len(v)):
        step = np.zeros(len(v))
        step[k] = 1e-6
        assert got[k] == pytest.approx((loss(v + step) - loss(v - step)) / 2e-6, abs=1e-5)


def test_all_models_equal_those_trained_alone(spark):
    x, y, member = data()
    x[:, 5] = -99.0
    scaling = {k: (3.0 + k / 10, 2.0) for k in SPLITS}
    df = frame(spark, x, y, member).repartition(5)
    jobs = spark.sparkContext.statusTracker()
    models = N.train_networks(df, SPLITS, runs=5, scaling=scaling, land=[5], epochs=6, patience=2)
    assert jobs is not None and [(m.split, m.run) for m in models] == [(k, r) for k in SPLITS for r in range(5)]
    for m in models[::7]:
        weights, (loss, val) = by_hand(x, y, member, m.split, m.run, 6, 2, scaling, [5])
        assert np.allclose(m.loss, loss) and np.allclose(m.val_loss, val) and np.allclose(N.packed(m.weights), N.packed(weights))
    again = N.train_networks(df.repartition(2), SPLITS, runs=5, scaling=scaling, land=[5], epochs=6, patience=2)
    assert all(np.allclose(N.packed(a.weights), N.packed(b.weights)) for a, b in zip(models, again))


def test_early_stopping_keeps_the_best_and_histories_are_told(spark):
    rng = np.random.default_rng(5)
    x, member = rng.normal(size=(60, 6)), np.arange(60) % 20
    y = rng.integers(0, 2, 60)  # nothing to learn: validation gets worse
    models = N.train_networks(frame(spark, x, y, member), [0, 4], runs=2, epochs=40, patience=3, rate=0.2)
    for m in models:
        assert len(m.loss) == len(m.val_loss) < 40 and len(m.val_loss) - 1 - int(np.argmin(m.val_loss)) == 3
        weights, (_, val) = by_hand(x, y, member, m.split, m.run, 40, 3, {0: (0, 1), 4: (0, 1)}, [], rate=0.2)
        assert np.allclose(N.packed(m.weights), N.packed(weights)) and np.allclose(val, m.val_loss)
    curves = learning_curves(N.histories(spark, models), keys=["split", "run"]).collect()
    assert len(curves) == sum(len(m.loss) for m in models)


def test_learning_and_scores(spark):
    x, y, member = data(1200, 4)
    df = frame(spark, x, y, member)
    models = N.train_networks(df, [2], runs=3, hidden=(12,), scaling={2: (3.0, 2.0)}, epochs=60, rate=0.05)
    got = N.network_scores(df.where("label IS NOT NULL"), models, keys=["i"]).toPandas()
    assert len(got) == 3 * 1200 and set(got.part) == {"tr", "va", "te"}
    test = got[got.part == "te"]
    assert (test.i.to_numpy() % 20 % 10 == 2).all() and ((test.y_prob >= 0.5) == (test.y_true == 1)).mean() > 0.9
    want = N.logits(models[1].weights, models[1].inputs(x))[0]
    one = got[got.run == 1].sort_values("i")
    assert np.allclose(one.margin, want) and np.allclose(one.y_prob, N.sigmoid(want))


def test_wrong_samples_are_refused(spark):
    x, y, member = data(100)
    with pytest.raises(ValueError, match="classes"):
        N.train_networks(frame(spark, x, np.zeros(100, int), member), [0])
    df = frame(spark, x, y, member)
    with pytest.raises(ValueError, match="lengths"):
        N.train_networks(df.withColumn("features", F.when(F.col("i") == 5, F.slice("features", 1, 2)).otherwise(F.col("features"))), [0])


def test_relevance_is_conserved_and_land_counts_for_nothing(spark):
    rng = np.random.default_rng(2)
    weights = [(w, np.zeros_like(b)) for w, b in N.start_weights([6, 5, 4, 1], 0, 0, 3)]
    x = rng.normal(size=(40, 6))
    x[:, 2] = -10.0
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, None)], "i int, features array<double>")
    got = N.dense_relevance(df, weights, keys=["i"]).toPandas()
    assert len(got) == 240 and (got[got.cell_id == 2].relevance == 0).all()
    zeroed = np.where(x == -10, 0, x)
    logit = N.logits(weights, zeroed)[0]
    total = got.groupby("i").relevance.sum().to_numpy()
    assert np.allclose(total, logit) and np.allclose(got.groupby("i").margin.first(), logit)

    def slowly(v):
        acts, sums = [v], []
        for k, (w, _) in enumerate(weights):
            sums.append([sum(acts[-1][i] * w[i, j] for i in range(len(w))) for j in range(w.shape[1])])
            acts.append([max(s, 0) if k < 2 else s for s in sums[-1]])
        r = [sums[-1][0]]
        for (w, _), a, s in list(zip(weights, acts, sums))[::-1]:
            r = [sum(a[i] * w[i, j] / s[j] * r[j] for j in range(w.shape[1]) if s[j]) for i in range(len(w))]
        return r

    for i in range(5):
        assert np.allclose(got[got.i == i].sort_values("cell_id").relevance, slowly(zeroed[i]))
    linear = [(rng.normal(size=(6, 1)), np.zeros(1))]
    one = N.dense_relevance(df.where("i = 0"), linear, keys=["i"]).toPandas().sort_values("cell_id")
    assert np.allclose(one.relevance, zeroed[0] * linear[0][0][:, 0])
