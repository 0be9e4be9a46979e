"""Quality of whole texts by attention-based multiple-instance learning.

A text is a bag of passages. Every passage is encoded from what it looks like:
its kinds of characters and their neighbours, lengths and repetition of its
words. Gated attention, learnt from the labels of whole texts alone, says how
much each passage counts; the weighted sum of the passages' codes is scored.
Words themselves, languages and sources are no inputs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.common import Words, small_batches, words

PASSAGE = 48  # words
CODE, GATE = 24, 12
TRAIN_ROWS = 4000
TRAIN_PASSAGES = 64  # of a text, evenly spread, in the fit alone
EPOCHS, BATCH, RATE, L2 = 30, 32, 3e-3, 1e-4
LIMIT = 6.0  # of a standardised feature
SMOOTHING = 0.02

#: Kinds of bytes: lower and upper case, digits, space, line ends, other white space, bytes of other scripts, control characters, each punctuation mark.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KINDS, COARSE = 8 + len(PUNCTUATION), 7


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(256, 7, np.int64)
    for k, some in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\r\n", "\t\v\f"]):
        kind[[ord(c) for c in some]] = k
    kind[128:] = 6
    kind[[ord(c) for c in PUNCTUATION]] = 8 + np.arange(len(PUNCTUATION))
    return kind, np.array([0, 1, 2, 3, 3, 3, 4, 5, *[6] * len(PUNCTUATION)])[kind]


KIND, COARSE_KIND = _kinds()
WORD_FEATURES = 11
FEATURES = KINDS + COARSE * COARSE + WORD_FEATURES


def passages(w: Words, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each passage, number of passages of each text); a text without words has none."""
    n = np.diff(w.first)
    parts = -(-n // size)
    at = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    return np.repeat(w.first[:-1], parts) + at * size, parts


def described(w: Words, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """(a row of FEATURES numbers for each passage, number of passages of each text). A text without words is one passage of zeros."""
    first, parts = passages(w, size)
    out = np.zeros((int(np.maximum(parts, 1).sum()), FEATURES), np.float32)
    if len(first):
        out[np.repeat(parts > 0, np.maximum(parts, 1))] = _features(w, first)
    return out, np.maximum(parts, 1)


def _features(w: Words, first: np.ndarray) -> np.ndarray:
    """Shares are those of the bytes between a passage's first and last word, or of its words."""
    count = np.diff(np.append(first, len(w.start)))
    last = first + count - 1
    start, end = w.start[first], w.end[last]
    m, place = len(first), np.repeat(np.arange(len(first)), end - start)
    at = np.arange(len(place)) + np.repeat(start - np.cumsum(end - start) + end - start, end - start)
    kind, coarse = KIND[w.data[at]], COARSE_KIND[w.data[at]]
    kinds = np.bincount(place * KINDS + kind, minlength=m * KINDS).reshape(m, KINDS)
    within = place[1:] == place[:-1]
    pair = (place[1:] * COARSE + coarse[:-1]) * COARSE + coarse[1:]
    pairs = np.bincount(pair[within], minlength=m * COARSE * COARSE).reshape(m, COARSE * COARSE)
    size = (end - start)[:, None]

    word = np.repeat(np.arange(m), count)  # the passage of each word
    length = (w.end - w.start).astype(float)
    mean = np.bincount(word, length, m) / count
    spread = np.sqrt(np.maximum(np.bincount(word, length**2, m) / count - mean**2, 0))
    order = np.lexsort((w.hash, word))
    h, p = w.hash[order], word[order]
    new = np.append(True, (h[1:] != h[:-1]) | (p[1:] != p[:-1]))
    run = np.diff(np.append(np.flatnonzero(new), len(h)))
    most = np.zeros(m)
    np.maximum.at(most, p[new], run)
    again = np.append(False, (w.hash[1:] == w.hash[:-1]) & (word[1:] == word[:-1]))
    heads, tails = KIND[w.data[w.start]], KIND[w.data[w.end - 1]]
    letters = np.concatenate([[0], np.cumsum(np.isin(KIND[w.data], (0, 1, 6)))])
    upper = np.concatenate([[0], np.cumsum(KIND[w.data] == 1)])
    lettered = letters[w.end] - letters[w.start]
    shouted = (upper[w.end] - upper[w.start] == lettered) & (lettered > 1)
    share = lambda yes: np.bincount(word, yes, m) / count
    of_words = [np.log1p(mean), np.log1p(spread), np.log1p(count), np.bincount(p[new], minlength=m) / count, most / count, share(again), share(lettered == 0), share(shouted), share(heads == 1), share(tails >= 8), share(heads >= 8)]
    return np.hstack([np.sqrt(kinds / size), np.sqrt(pairs / size), np.stack(of_words, 1)]).astype(np.float32)


@dataclass
class Model:
    """Standardisation, encoder, gated attention and scorer."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -LIMIT, LIMIT)

    def scores(self, x: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score of each bag, attention of each passage)."""
        told = forward(self.weights, self.standard(x.astype(float)), parts)
        return sigmoid(told["logit"]), told["a"]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(w: dict[str, np.ndarray], x: np.ndarray, parts: np.ndarray) -> dict[str, np.ndarray]:
    """Codes h, gates t and g, attention a within each bag, weighted sum z, logit."""
    first, bag = np.cumsum(parts) - parts, np.repeat(np.arange(len(parts)), parts)
    h = np.tanh(x @ w["code"] + w["code0"])
    t, g = np.tanh(h @ w["view"] + w["view0"]), sigmoid(h @ w["gate"] + w["gate0"])
    s = (t * g) @ w["ask"]
    a = np.exp(s - np.maximum.reduceat(s, first)[bag])
    a /= np.add.reduceat(a, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "logit": z @ w["out"] + w["out0"], "bag": bag, "first": first}


def gradients(w: dict[str, np.ndarray], x: np.ndarray, parts: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of the bags with the L2 term, and its gradients."""
    f = forward(w, x, parts)
    h, t, g, a, bag, first = (f[k] for k in ("h", "t", "g", "a", "bag", "first"))
    p = sigmoid(f["logit"])
    loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    d = (p - y) / len(y)
    dz = d[:, None] * w["out"]
    da = (h * dz[bag]).sum(1)
    ds = a * (da - np.add.reduceat(a * da, first)[bag])
    both = ds[:, None] * w["ask"]
    dt, dg = both * g * (1 - t * t), both * t * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ w["view"].T + dg @ w["gate"].T) * (1 - h * h)
    out = {"code": x.T @ dh, "code0": dh.sum(0), "view": h.T @ dt, "view0": dt.sum(0), "gate": h.T @ dg, "gate0": dg.sum(0), "ask": (t * g).T @ ds, "out": f["z"].T @ d, "out0": d.sum(keepdims=True)}
    for k in ("code", "view", "gate", "ask", "out"):
        loss += L2 * (w[k] ** 2).sum() / 2
        out[k] = out[k] + L2 * w[k]
    return float(loss), out


def fit(x: np.ndarray, parts: np.ndarray, y: np.ndarray, seed: int = 13, epochs: int = EPOCHS) -> Model:
    """By Adam on shuffled batches of bags. Without labels of both kinds every text scores their smoothed share."""
    rng = np.random.default_rng(seed)
    x, y, n = x.astype(float), y.astype(float), len(y)
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(FEATURES), np.zeros(FEATURES))
    shapes = {"code": (x.shape[1], CODE), "code0": (CODE,), "view": (CODE, GATE), "view0": (GATE,), "gate": (CODE, GATE), "gate0": (GATE,), "ask": (GATE,), "out": (CODE,), "out0": (1,)}
    w = {k: np.zeros(s) if k.endswith("0") else rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
    model = Model(mean, np.maximum(scale, 1e-3), w)
    share = (y.sum() + 1) / (n + 2)
    w["out0"][:] = np.log(share / (1 - share))
    if not 0 < y.sum() < n:
        w["out"][:] = 0
        return model
    x, first = model.standard(x), np.cumsum(parts) - parts
    target = y * (1 - 2 * SMOOTHING) + SMOOTHING
    m1, m2, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(n)
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for i in range(0, n, BATCH):
            some = order[i : i + BATCH]
            rows = np.concatenate([np.arange(first[k], first[k] + parts[k]) for k in some])
            _, d = gradients(w, x[rows], parts[some], target[some])
            step += 1
            for k, v in d.items():
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                w[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS, most_passages: int = TRAIN_PASSAGES, epochs: int = EPOCHS) -> Model:
    """Fit on about ``rows`` labelled texts, drawn by a hash of their ids, none held out.

    Tasks describe the texts' passages, of each text ``most_passages`` at most,
    evenly spread over the whole; one task fits on those of 2 * rows texts at
    most whatever the input, and the driver gets the model alone. Null labels
    and texts are left out; a repeated label counts again.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(id_col, label_col)
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(13)), F.lit(max(1, n))) < rows).limit(2 * rows)
    sample = docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(F.broadcast(drawn), id_col)
    sample = sample.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), (F.col(label_col) == 1).cast("int").alias("y"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in words(batch.column(1)):
                x, parts = described(w)
                first = np.cumsum(parts) - parts
                raw = [x[a + np.unique(np.linspace(0, k - 1, min(k, most_passages)).astype(int))].tobytes() for a, k in zip(first, parts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(raw, pa.binary())], ["id", "y", "x"])

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "y", "x"]).head(2 * rows)
        each = [np.frombuffer(r, np.float32).reshape(-1, FEATURES) for r in frame.x]
        return pd.DataFrame({"model": [pickle.dumps(fit(np.concatenate(each), np.array([len(e) for e in each]), frame.y.to_numpy(), epochs=epochs))]})

    got = sample.mapInArrow(describe, "id string, y int, x binary").groupBy().applyInPandas(fitted, "model binary").collect()
    return pickle.loads(got[0].model) if got else fit(np.zeros((0, FEATURES)), np.zeros(0, int), np.zeros(0))


def score(df: DataFrame, model: Model, text_col: str = "text", attention_col: str | None = None) -> DataFrame:
    """``df`` with ``score`` (0 to 1, higher: more likely good), and each passage's weight in ``attention_col`` if named.

    Texts are read whole, in passages of PASSAGE words; a null, empty or white
    text is one passage of zeros. Other columns and repeated rows stay; columns
    of the new ones' names are replaced; an empty table gives no rows. Of the
    table's columns the text alone goes to Python, and it does not come back.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # FEATURES x CODE numbers

    @F.pandas_udf("score double, attention array<float>" if attention_col else "score double")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            column = pa.array([t if isinstance(t, str) else None for t in batch], pa.large_string())
            scores, weights = [np.zeros(0)], []
            for _, _, w in words(column):
                x, parts = described(w)
                p, a = own.scores(x, parts)
                scores.append(p)
                weights += np.split(a.astype(np.float32), np.cumsum(parts)[:-1]) if attention_col else []
            yield pd.DataFrame({"score": np.concatenate(scores)} | ({"attention": weights} if attention_col else {}))

    out = df.drop("score", *([attention_col] if attention_col else [])).withColumn("__told", told(F.col(text_col)))
    out = out.withColumn("score", F.col("__told.score"))
    out = out.withColumn(attention_col, F.col("__told.attention")) if attention_col else out
    return out.drop("__told")
