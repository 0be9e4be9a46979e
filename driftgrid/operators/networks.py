"""Dense networks over feature arrays: many models trained by one scan an epoch, scored, and explained.

A model belongs to a split and a run. Which rows it trains on follows from the
row's block alone, so rows are never copied for splits; each split standardises
with its own mean and deviation as rows are read, and land is filled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgrid.functions.columns import LAND_FILL

FAN_IN = 32  # partial sums of a model that one task adds up first
Weights = list[tuple[np.ndarray, np.ndarray]]  # (matrix, bias) of each layer


@dataclass
class Model:
    """One trained network, its scaling and the losses of its epochs. ``land`` marks features that are filled, not scaled."""

    split: int
    run: int
    weights: Weights
    mu: float = 0.0
    sigma: float = 1.0
    land: np.ndarray | None = None
    loss: list[float] = field(default_factory=list)
    val_loss: list[float] = field(default_factory=list)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mu) / self.sigma
        return z if self.land is None else np.where(self.land, LAND_FILL, z)


def start_weights(sizes: list[int], split: int, run: int, seed: int) -> Weights:
    rng = np.random.default_rng([seed, split, run])
    return [(rng.normal(0, np.sqrt(2 / (a + b)), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]


def logits(weights: Weights, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(logit of each row, activations that enter each layer). Hidden units are rectified."""
    acts = [x]
    for w, b in weights[:-1]:
        acts.append(np.maximum(acts[-1] @ w + b, 0))
    w, b = weights[-1]
    return (acts[-1] @ w + b)[:, 0], acts


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def loss_and_slope(z: np.ndarray, y: np.ndarray, weight: np.ndarray, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Weighted cross entropy of each row and its derivative by the logit; with ``gamma`` the focal one, which counts sure rows less."""
    sign = np.where(y == 1, 1.0, -1.0)
    p = sigmoid(sign * z)  # of the row's own class
    log_p = -np.logaddexp(0, -sign * z)
    easy = (1 - p) ** gamma
    return -weight * easy * log_p, weight * sign * easy * (gamma * p * log_p - (1 - p))


def backward(weights: Weights, acts: list[np.ndarray], slope: np.ndarray) -> np.ndarray:
    """Gradient by all weights and biases, as one vector."""
    out, d = [], slope[:, None]
    for k in range(len(weights) - 1, -1, -1):
        out += [d.sum(0), (acts[k].T @ d).ravel()]
        if k:
            d = (d @ weights[k][0].T) * (acts[k] > 0)
    return np.concatenate(out[::-1])


def packed(weights: Weights) -> np.ndarray:
    return np.concatenate([v.ravel() for w, b in weights for v in (w, b)])


def unpacked(vector: np.ndarray, sizes: list[int]) -> Weights:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((vector[at : at + a * b].reshape(a, b), vector[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def parts_of(block: np.ndarray, split: int) -> np.ndarray:
    """0 test, 1 validation, 2 training, as the block splits deal them."""
    return np.where(block == split, 0, np.where(block == split + 1, 1, 2))


def matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of a list column whose lists all have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def train_networks(samples: DataFrame, splits: list[int], *, runs: int = 5, hidden: tuple[int, ...] = (8,), scaling: dict[int, tuple[float, float]] | None = None, land: list[int] | None = None, epochs: int = 50, patience: int = 10, rate: float = 0.03, l2: float = 1e-4, gamma: float = 0.0, positive: float = 1.5, seed: int = 42, member: str = "member", blocks: int = 10, label: str = "label", features: str = "features") -> list[Model]:
    """A network for every split and run, by Adam on whole gradients: one scan of ``samples`` an epoch for all of them.

    Tasks add up loss and gradient of each model over its training rows and the
    loss over its validation rows; these sums, not rows, are added in two levels
    by model. A model stops after ``patience`` epochs without a lower validation
    loss and keeps the weights of its best; later scans leave it out. Classes
    are weighed n / (2 * count) within each split's training part, the positive
    one times ``positive``. Starts follow from ``seed``, split and run.

    Rows with a null label, member or array are left out; all arrays must be of
    one length. A split without both classes in training raises. The driver
    holds the models, their sums and nothing of the samples.
    """
    held = samples.where(F.col(label).isNotNull() & F.col(features).isNotNull() & F.col(member).isNotNull())
    held = held.select(F.pmod(F.col(member), F.lit(blocks)).cast("int").alias("block"), F.col(label).cast("int").alias("y"), F.col(features).alias("x"))
    counts = {(r.block, r.y): (r.n, r.least, r.most) for r in held.groupBy("block", "y").agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).collect()}  # two rows a block
    lengths = {v for c in counts.values() for v in c[1:]}
    if len(lengths) != 1:
        raise ValueError(f"feature arrays have lengths {sorted(lengths)}")
    sizes = [lengths.pop(), *hidden, 1]
    mask = None if land is None else np.isin(np.arange(sizes[0]), land)
    weight = {}
    for k in splits:
        n = [sum(c[0] for (b, y), c in counts.items() if y == v and b not in (k, k + 1)) for v in (0, 1)]
        if not all(n):
            raise ValueError(f"split {k} doesn't have both classes in training")
        weight[k] = (sum(n) / (2 * n[0]), positive * sum(n) / (2 * n[1]))
    models = {(k, r): Model(k, r, start_weights(sizes, k, r, seed), *(scaling or {}).get(k, (0.0, 1.0)), mask) for k in splits for r in range(runs)}
    best = {k: (np.inf, m.weights, 0) for k, m in models.items()}
    moments = {k: (0.0, 0.0) for k in models}
    spark, running = samples.sparkSession, sorted(models)
    held = held.cache()
    try:
        for epoch in range(1, epochs + 1):
            sums = epoch_sums(held, [models[k] for k in running], weight, gamma)
            for k in list(running):
                model, (n, loss, val_n, val_loss), gradient = models[k], *sums[k]
                model.loss.append(float(loss / n))
                model.val_loss.append(float(val_loss / val_n if val_n else loss / n))
                if model.val_loss[-1] < best[k][0]:
                    best[k] = (model.val_loss[-1], model.weights, epoch)
                elif epoch - best[k][2] >= patience:
                    running.remove(k)
                    continue
                vector = packed(model.weights)
                g = gradient / n + l2 * vector
                m1, m2 = (0.9 * moments[k][0] + 0.1 * g, 0.999 * moments[k][1] + 0.001 * g * g)
                moments[k] = (m1, m2)
                model.weights = unpacked(vector - rate * (m1 / (1 - 0.9**epoch)) / (np.sqrt(m2 / (1 - 0.999**epoch)) + 1e-8), sizes)
            if not running:
                break
    finally:
        held.unpersist()
    for k, model in models.items():
        model.weights = best[k][1]
    return [models[k] for k in sorted(models)]


def epoch_sums(held: DataFrame, models: list[Model], weight: dict[int, tuple[float, float]], gamma: float) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """(rows, loss, validation rows, their loss) and the training gradient of each model, from one scan."""
    shared = held.sparkSession.sparkContext.broadcast(models)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        told = [np.zeros(4) for _ in own]
        gradients = [np.zeros(len(packed(m.weights))) for m in own]
        for batch in batches:
            block, y, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            scaled: dict[int, np.ndarray] = {}
            for i, m in enumerate(own):
                z = scaled.setdefault(m.split, m.inputs(x))
                part = parts_of(block, m.split)
                w = np.where(y == 1, weight[m.split][1], weight[m.split][0])
                rows, val = part == 2, part == 1
                z_rows, acts = logits(m.weights, z[rows])
                loss, slope = loss_and_slope(z_rows, y[rows], w[rows], gamma)
                gradients[i] += backward(m.weights, acts, slope)
                told[i] += [rows.sum(), loss.sum(), val.sum(), loss_and_slope(logits(m.weights, z[val])[0], y[val], w[val], gamma)[0].sum()]
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([m.split for m in own], pa.int32()), pa.array([m.run for m in own], pa.int32()), pa.array([task] * len(own), pa.int32()), pa.array([np.concatenate(v).tobytes() for v in zip(told, gradients)], pa.binary())], ["split", "run", "task", "sums"])

    def added(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("task")  # the same order of addition each time
        total = np.sum([np.frombuffer(s) for s in frame.sums], 0)
        return pd.DataFrame({"split": [key[0]], "run": [key[1]], "task": [key[2] if len(key) > 2 else 0], "sums": [total.tobytes()]})

    schema = "split int, run int, task int, sums binary"
    each = held.mapInArrow(partial, schema)
    some = each.groupBy("split", "run", F.expr(f"task div {FAN_IN}").cast("int").alias("g")).applyInPandas(added, schema)
    rows = some.groupBy("split", "run").applyInPandas(added, schema).collect()  # a row for each model
    shared.unpersist()
    return {(r.split, r.run): (v[:4], v[4:]) for r in rows for v in [np.frombuffer(r.sums)]}


def histories(spark, models: list[Model]) -> DataFrame:  # noqa: ANN001
    """split, run, loss, val_loss: the losses of every epoch as arrays, as training histories are stored."""
    return spark.createDataFrame([(m.split, m.run, m.loss, m.val_loss) for m in models], "split int, run int, loss array<double>, val_loss array<double>")


def network_scores(samples: DataFrame, models: list[Model], *, keys: list[str], member: str = "member", blocks: int = 10, label: str = "label", features: str = "features") -> DataFrame:
    """split, run, part, keys, y_prob, y_true, margin of every model on every row. Rows with a null array or member are left out."""
    shared = samples.sparkSession.sparkContext.broadcast(models)
    held = samples.where(F.col(features).isNotNull() & F.col(member).isNotNull())

    @F.pandas_udf("array<double>")
    def margins(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_list()).astype(float) if len(x) else np.zeros((0, 1))
        return pd.Series(list(np.stack([logits(m.weights, m.inputs(rows))[0] for m in shared.value], 1)))

    names = F.array(*(F.struct(F.lit(m.split).alias("split"), F.lit(m.run).alias("run")) for m in models))
    each = held.select(*keys, F.pmod(F.col(member), F.lit(blocks)).alias("__block"), F.col(label).cast("tinyint").alias("y_true"), F.explode(F.arrays_zip(names.alias("m"), margins(features).alias("margin"))).alias("__z"))
    part = F.when(F.col("__block") == F.col("__z.m.split"), "te").when(F.col("__block") == F.col("__z.m.split") + 1, "va").otherwise("tr")
    return each.select("__z.m.split", "__z.m.run", part.alias("part"), *keys, (1 / (1 + F.exp(-F.col("__z.margin")))).alias("y_prob"), "y_true", "__z.margin")


def relevance(weights: Weights, x: np.ndarray) -> np.ndarray:
    """The z-rule, layer by layer from the logit: a unit's relevance goes to its inputs by their shares of what it received. A unit that received nothing gives nothing."""
    z, acts = logits(weights, x)
    r = z[:, None]
    for (w, b), a in zip(weights[::-1], acts[::-1]):
        received = a @ w + b
        r = a * (np.divide(r, received, out=np.zeros_like(r), where=received != 0) @ w.T)
    return r


def dense_relevance(samples: DataFrame, weights: Weights, *, keys: list[str], features: str = "features", fill: float = LAND_FILL) -> DataFrame:
    """keys, cell_id, relevance, margin: how much each input adds to a row's logit, through all layers.

    Inputs close to the land fill are zero before anything is computed. Without
    biases the relevances of a row sum to its logit; a bias keeps its share. No
    row is dropped; a null array gives no rows. Batches of rows go through the
    layers in Arrow; the cells are taken apart in Spark.
    """
    shared = samples.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("relevance array<double>, margin double")
    def told(x: pd.Series) -> pd.DataFrame:
        rows = np.stack(x.to_list()).astype(float) if len(x) else np.zeros((0, len(shared.value[0][0])))
        rows = np.where(np.abs(rows - fill) <= 1e-8 + 1e-5 * abs(fill), 0.0, rows)
        return pd.DataFrame({"relevance": list(relevance(shared.value, rows)), "margin": logits(shared.value, rows)[0]})

    each = samples.where(F.col(features).isNotNull()).select(*keys, told(features).alias("__r"))
    return each.select(*keys, F.col("__r.margin").alias("margin"), F.posexplode("__r.relevance").alias("cell_id", "relevance"))
