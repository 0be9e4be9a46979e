"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

A word, with a mark at each end, is the vector of its three-character
subsequences within a short span, weighted by a factor for every gap. The
kernel of two words is the normalised product of these vectors to a fixed
power, so it is positive semidefinite; an insult with inserted or left-out
characters stays near the plain one. Landmarks are words of the labelled texts.
Words are mapped by the inverse root of the landmarks' kernel matrix. A
sentence counts by its worst word: a linear SVM is trained on labelled
sentences, each with the word that the SVM before found worst. A document
scores as its worst sentence. A word whose kernel with a toxic landmark is
larger than that of all words of clean labelled texts counts as that landmark:
so an insult with a character set in or left out stays one, as far as no clean
word is as near.

Landmarks and SVM are fitted in one task on a bounded sample of labelled rows.
Scoring reads whole texts on all executors.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.common import small_batches

TRAIN_ROWS = 3_000
LANDMARKS = 64  # words that mark toxic texts, at most
OTHERS = 32  # as many words of other texts that are nearest to these, and as many drawn from all
SPAN = 6
DECAY = 0.7
WEIGHTS = DECAY ** np.arange(SPAN)
POWER = 3
NEAR = 0.01  # words further from all marking words are worst in no sentence that matters
SLACK = 0.02  # so many more labels, as a share of the toxic ones, may be missed to stay clear of both kinds
SIGNIFICANT = 48.0  # least log-likelihood ratio of a landmark that marks toxic texts
STEM = (3, 10)
RUN = 24  # a longer run of letters is a word in each of its windows
RUN_WINDOWS = (6, 9, 12)
DENSE_WINDOWS = (2, 3, 4)  # of scripts that set no spaces
REACH = 0.1  # how much nearer to a toxic landmark than all clean words, as a share of what is left to 1
FLOOR = 0.2  # kernel below which no word counts as a landmark
TRAIN_SENTENCES = 2_000  # of a labelled text, drawn by hash, and as many words of each, in the fit alone
KNOWN_WORDS = 250_000
CHUNK_CHARS = 1 << 20
CHUNK_WINDOWS = 50_000
CELLS = 1 << 21  # numbers held at a time by one kernel evaluation

SENTENCE = re.compile(r"[.!?\n。！？]+")
WORD = re.compile(r"[^\W_]+")
#: Scripts without spaces between words: Thai to Khmer, kana, ideographs.
DENSE = re.compile(r"[฀-໿ក-៿぀-ヿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")
SCRIPTS = re.compile(f"({DENSE.pattern}+)|[^{DENSE.pattern[1:-1]}]+")
#: Punctuation inserted between the characters of a word, and words spelt with single characters apart.
INSERTED = re.compile(r"(?<=[^\W_])[^\w\s](?=[^\W\d_])")
SPELT = re.compile(r"(?<!\S)(?:[^\W\d_] ){2,}[^\W\d_](?!\S)")
# Digits and signs often written for letters.
LOOKALIKES = str.maketrans("01345@$", "oleasas")


def normal(text: str) -> str:
    """Lower case; inserted punctuation and spelt-out words closed up."""
    text = INSERTED.sub("", text.lower())
    return SPELT.sub(lambda m: m[0].replace(" ", ""), text)


def word_of(w: str) -> str:
    return w.translate(LOOKALIKES) if not w.isdigit() else w


@lru_cache(maxsize=64)
def places(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, gaps) of all subsequences of three of ``size`` characters within SPAN."""
    at = [(i, j, k) for i in range(size) for j in range(i + 1, min(size, i + SPAN)) for k in range(j + 1, min(size, i + SPAN))]
    at = np.array(at, np.int64).reshape(-1, 3)
    return at, at[:, 2] - at[:, 0] - 2


def marked(words: list[str]) -> np.ndarray:
    """Code points of words of one length, with 1 before and 2 after each."""
    n, size = len(words), len(words[0])
    out = np.zeros((n, size + 2), np.int64)
    out[:, 0], out[:, -1] = 1, 2
    out[:, 1:-1] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size) + 3
    return out


def by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Positions of the words of each length, few enough at a time."""
    size = np.array([len(w) for w in words], int)
    for n in np.unique(size).tolist():
        own = np.flatnonzero(size == n)
        step = max(1, CELLS // max(1, len(places(n + 2)[0]) * 8))
        yield from (own[i : i + step] for i in range(0, len(own), step))


def self_products(codes: np.ndarray) -> np.ndarray:
    """Sum of squared subsequence weights of each row of ``codes``."""
    n, size = codes.shape
    at, gaps = places(size)
    local = (codes[:, :, None] == codes[:, None, :]).argmax(2)  # a character is known by its first place in the word
    local = local.astype(np.int32 if size < 512 else np.int64)
    key = ((local[:, at[:, 0]] * size + local[:, at[:, 1]]) * size + local[:, at[:, 2]]) * 4 + gaps.astype(local.dtype)
    key.sort(1)
    weight = WEIGHTS[key & 3]
    new = np.ones(key.shape, bool)
    new[:, 1:] = key[:, 1:] >> 2 != key[:, :-1] >> 2
    total = np.add.reduceat(weight.ravel(), np.flatnonzero(new.ravel()))
    row = np.repeat(np.arange(n), new.sum(1))
    return np.bincount(row, total**2, n)


@dataclass
class Kernel:
    """Kernel values of words against landmarks."""

    landmarks: list[str]
    code: np.ndarray = field(init=False)  # code point to number; 0 for what no landmark has
    used: np.ndarray = field(init=False)  # the landmarks' subsequences; row i + 1 is that of used[i]
    table: np.ndarray | None = field(init=False)  # subsequence to row
    first: np.ndarray = field(init=False)  # where a row's values begin
    owner: np.ndarray = field(init=False)  # landmark and weight, over the landmark's norm, of each value
    value: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        points = sorted({p for w in self.landmarks for p in map(ord, w)})
        self.code = np.zeros(0x110000 + 3, np.int32)
        self.code[[1, 2, *(p + 3 for p in points)]] = np.arange(1, len(points) + 3)
        self.base = len(points) + 3
        keys, owner, weight = [], [], []
        norm = np.zeros(len(self.landmarks))
        for part in by_length(self.landmarks):
            codes = marked([self.landmarks[i] for i in part])
            norm[part] = self_products(codes)
            key, gaps = self.keys(codes)
            keys.append(key.ravel()), owner.append(np.repeat(part, key.shape[1])), weight.append(np.tile(WEIGHTS[gaps], len(part)))
        keys, owner, weight = np.concatenate(keys), np.concatenate(owner), np.concatenate(weight)
        pair, where = np.unique(keys * len(self.landmarks) + owner, return_inverse=True)
        self.owner = (pair % len(self.landmarks)).astype(np.int32)
        self.value = np.bincount(where, weight, len(pair)) / np.sqrt(norm)[self.owner]
        self.used, first = np.unique(pair // len(self.landmarks), return_index=True)
        self.first = np.concatenate([[0], first, [len(pair)]]).astype(np.int64)  # row 0 has no values
        self.table = None
        if self.base**3 <= 1 << 22:
            self.table = np.zeros(self.base**3, np.int32)
            self.table[self.used] = np.arange(1, len(self.used) + 1)

    def keys(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, gaps = places(codes.shape[1])
        c = self.code[codes].astype(np.int64)
        a, b, d = c[:, at[:, 0]], c[:, at[:, 1]], c[:, at[:, 2]]
        return np.where((a > 0) & (b > 0) & (d > 0), (a * self.base + b) * self.base + d, 0), gaps

    def rows(self, key: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.used, key), len(self.used) - 1)
        return np.where(self.used[at] == key, at + 1, 0)

    def of(self, words: list[str]) -> np.ndarray:
        """Matrix words x landmarks."""
        m = len(self.landmarks)
        out = np.zeros((len(words), m))
        for part in by_length(words):
            codes = marked([words[i] for i in part])
            key, gaps = self.keys(codes)
            row = self.rows(key)
            r, e = np.nonzero(row)
            begin = self.first[row[r, e]]
            n = self.first[row[r, e] + 1] - begin
            at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            weight = np.repeat(WEIGHTS[gaps[e]], n) * self.value[at]
            dot = np.bincount(np.repeat(r, n) * m + self.owner[at], weight, len(part) * m).reshape(-1, m)
            out[part] = dot / np.sqrt(self_products(codes))[:, None]
        return np.minimum(out, 1.0) ** POWER


def windows(run: str) -> list[str]:
    """The words that a run of letters stands for: its parts by script, and the windows of parts that are long or set no spaces."""
    if plain(run):
        return [run]
    out: dict[str, None] = {}
    for dense in SCRIPTS.finditer(run):
        part = dense[0]
        sizes = DENSE_WINDOWS if dense[1] and len(part) > 2 else RUN_WINDOWS if len(part) > RUN else (len(part),)
        out |= dict.fromkeys(part[i : i + n] for n in sizes for i in range(max(1, len(part) - n + 1)))
    return list(out)


def plain(w: str) -> bool:
    return len(w) <= RUN and (w.isascii() or not DENSE.search(w))


@dataclass
class Model:
    landmarks: list[str]
    alpha: np.ndarray  # a word's part in the margin is its kernel row times alpha
    bias: float
    slope: float
    offset: float
    reach: np.ndarray = field(default_factory=lambda: np.zeros(0))  # kernel from which a word counts as landmark i, for the first ones
    own: np.ndarray = field(default_factory=lambda: np.zeros(0))  # the part of landmark i itself
    limit: int = KNOWN_WORDS
    _kernel: Kernel | None = field(default=None, init=False, repr=False)
    _known: dict[str, float] = field(default_factory=dict, init=False, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_kernel": None, "_known": {}}

    @property
    def kernel(self) -> Kernel:
        if self._kernel is None:
            self._kernel = Kernel(self.landmarks)
        return self._kernel

    def parts(self, words: set[str]) -> dict[str, float]:
        """Parts in the margin; all of ``words`` are in the result, whatever was forgotten. A run counts by its largest window."""
        new = words - self._known.keys()
        if len(self._known) + len(new) > self.limit:
            self._known.clear()
            new = words
        short = [w for w in new if plain(w)]
        self._known.update(zip(short, self.told([word_of(w) for w in short]).tolist()))
        for w in new.difference(short):
            best, own = -np.inf, windows(word_of(w))
            for i in range(0, len(own), CHUNK_WINDOWS):
                best = max(best, float(self.told(own[i : i + CHUNK_WINDOWS]).max()))
            self._known[w] = best
        return self._known

    def told(self, words: list[str]) -> np.ndarray:
        """Parts of words: by the SVM, or those of a landmark that they come near to."""
        near = self.kernel.of(words)
        part = near @ self.alpha
        if len(self.reach):
            part = np.maximum(part, np.where(near[:, : len(self.reach)] >= self.reach, self.own, -np.inf).max(1, initial=-np.inf))
        return part

    def margins(self, texts: list[str]) -> np.ndarray:
        """The margin of every text's worst word, 0 + bias if it has none above."""
        told = [set(WORD.findall(normal(t))) for t in texts]
        part = self.parts(set().union(*told))
        return np.array([max(map(part.__getitem__, t), default=0.0) for t in told]).clip(0.0) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts) + self.offset, -30, 30)))


def chunks(texts: list[str], chars: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about ``chars`` characters; a longer text is a run of its own."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def draw(w: str) -> int:
    return zlib.crc32(w.encode("utf-8", "surrogatepass"))


def sentences(text: str, most: int = TRAIN_SENTENCES) -> list[list[str]]:
    """The distinct words of each sentence, with the windows of long runs; of very many, ``most`` drawn by hash."""

    def some(items: list[str]) -> list[str]:
        return items if len(items) <= most else sorted(items, key=lambda x: (draw(x), x))[:most]

    return [some(list(dict.fromkeys(x for w in dict.fromkeys(WORD.findall(s)) for x in windows(word_of(w))))) for s in some(SENTENCE.split(normal(text)))]


@dataclass
class Sample:
    """Labelled sentences as numbers of words: sentence i of document owner[i] has words word[first[i]:first[i + 1]]."""

    words: list[str]
    word: np.ndarray
    first: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, texts: list[list[list[str]]]) -> "Sample":
        """From the sentences' words of each text."""
        known: dict[str, int] = {}
        word, first, owner = [], [0], []
        for d, text in enumerate(texts):
            for s in text or [[]]:
                own = {known.setdefault(x, len(known)) for x in s}
                word.append(np.fromiter(own, np.int32, len(own)))
                first.append(first[-1] + len(own)), owner.append(d)
        return cls(list(known), np.concatenate(word) if word else np.zeros(0, np.int32), np.array(first), np.array(owner, int))

    def worst(self, part: np.ndarray) -> np.ndarray:
        """The word with the largest part in each sentence, -1 for sentences without words."""
        sentence = np.repeat(np.arange(len(self.owner)), np.diff(self.first))
        order = np.lexsort((self.word, -part[self.word], sentence))
        out = np.full(len(self.owner), -1)
        some, at = np.unique(sentence[order], return_index=True)
        out[some] = self.word[order[at]]
        return out


def stems(w: str) -> list[str]:
    """A word and its beginnings of three characters or more: inflected words have one in common."""
    return [w, *(w[:k] for k in range(STEM[0], min(len(w), STEM[1] + 1)))]


def choose_landmarks(sample: Sample, toxic: np.ndarray, marks: int, others: int) -> tuple[list[str], list[str]]:
    """Words and stems whose presence tells toxic documents from others, the strongest first and none the beginning of another, and words drawn by hash."""
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    size = max(1, len(sample.words))
    pair = np.unique(np.repeat(sample.owner, np.diff(sample.first)) * size + sample.word)
    edges = np.searchsorted(pair, np.arange(len(toxic) + 1) * size)
    held = lambda d: {x for i in pair[edges[d] : edges[d + 1]] % size for x in stems(sample.words[i])}
    seen1: Counter = Counter()
    for d in np.flatnonzero(toxic):
        seen1.update(held(d))
    some = {w for w, c in seen1.items() if c >= 3}
    seen0: Counter = Counter()
    for d in np.flatnonzero(toxic == 0):
        seen0.update(some & held(d))
    share, strength = n1 / (n1 + n0), {}
    for w in some:
        c, d = seen1[w], seen0[w]
        if c / n1 > 4 * d / n0:
            ratio = 2 * (c * np.log(c / ((c + d) * share)) + (d * np.log(d / ((c + d) * (1 - share))) if d else 0.0))
            if ratio > SIGNIFICANT:
                strength[w] = ratio
    chosen: list[str] = []
    for w in sorted(strength, key=lambda w: (-strength[w], -len(w), w)):
        if len(chosen) < marks and not any(w.startswith(c) or c.startswith(w) for c in chosen):
            chosen.append(w)
    rest = sorted(set(sample.words) - set(chosen), key=lambda w: (draw(w), w))
    return chosen, rest[:others]


def with_insertion(w: str, seed: int) -> str:
    """``w`` with one letter set between two of its own."""
    at = 1 + seed % max(1, len(w) - 1)
    return w[:at] + "abcdefghijklmnopqrstuvwxyz"[seed // 64 % 26] + w[at:]


def svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps; y is -1 or 1, the last column of x is constant."""
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3
    for _ in range(rounds):
        slack = 1 - y * (x @ w)
        on = slack > 0
        a = x[on] * cost[on, None]
        step = np.linalg.solve(np.diag(ridge) + 2 * a.T @ x[on], ridge * w - 2 * a.T @ (y * slack)[on])
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def inverse_root(gram: np.ndarray) -> np.ndarray:
    """Inverse square root of a positive semidefinite matrix on the directions that count."""
    value, vector = np.linalg.eigh(gram)
    keep = value > 1e-6 * value.max()
    return (vector[:, keep] / np.sqrt(value[keep])) @ vector[:, keep].T


def fit(texts: list[str] | list[list[list[str]]], toxic: np.ndarray, landmarks: int = LANDMARKS, others: int = OTHERS) -> Model:
    """Landmarks, Nystroem map, SVM on sentences and calibration from labelled documents, whole or as their ``sentences``.

    A toxic document's sentences carry its label only where they are its worst
    or stand out by themselves: the SVM is trained three times, each time on the
    worst words that the one before found, at first those nearest to a word that
    marks toxic documents. Words that mark them are also learnt with one more
    letter set in. Without labels of both kinds, or without such words, nothing
    is toxic: every text scores 0.25.
    """
    toxic = np.asarray(toxic, int)
    none = Model(["none"], np.zeros(1), 0.0, 0.0, float(np.log(0.25 / 0.75)))
    if not 0 < toxic.sum() < len(toxic):
        return none
    sample = Sample.of([sentences(t) if isinstance(t, str) else t for t in texts])
    marks, drawn = choose_landmarks(sample, toxic, landmarks, others)
    if not marks:
        return none
    kernel = Kernel(marks)
    calm = np.unique(sample.word[np.repeat(toxic[sample.owner] == 0, np.diff(sample.first))])
    clean, near, nearest = np.isin(np.arange(len(sample.words)), calm), np.zeros(len(sample.words)), np.zeros(len(marks))
    for i in range(0, len(sample.words), CHUNK_WINDOWS):
        some = kernel.of(sample.words[i : i + CHUNK_WINDOWS])
        near[i : i + len(some)] = some.max(1)
        nearest = np.maximum(nearest, np.where(clean[i : i + len(some), None] & (some < 1 - 1e-9), some, 0.0).max(0))
    calm = calm[near[calm] < 1 - 1e-9]
    hard = [sample.words[i] for i in calm[np.lexsort((calm, -near[calm]))[:others]]]
    names = list(dict.fromkeys([*marks, *hard, *drawn]))
    kernel = Kernel(names)
    root = inverse_root(kernel.of(names))

    worst = sample.worst(near)
    held = np.union1d(worst[worst >= 0], np.flatnonzero(near >= NEAR))  # the others are never worst
    x_held = kernel.of([sample.words[i] for i in held]) @ root
    varied = [with_insertion(w, draw(w) + i) for w in marks for i in range(8)]
    x_varied = kernel.of(varied) @ root
    part, least, label = near, 0.9, toxic[sample.owner]

    def most(margin: np.ndarray) -> np.ndarray:
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, sample.owner, margin)
        return out

    for _ in range(3):
        worst = sample.worst(part)
        margin = np.where(worst >= 0, part[worst], 0.0)
        use = (worst >= 0) & ((label == 0) | (margin >= most(margin)[sample.owner] - 1e-9) | (margin >= least))
        pair, n = np.unique(worst[use] * 2 + label[use], return_counts=True)  # equal instances once, with their number
        x = np.vstack([x_held[np.searchsorted(held, pair // 2)], x_varied])
        y = np.append(2.0 * (pair % 2) - 1, np.ones(len(varied)))
        n = np.append(n, np.full(len(varied), max(1.0, n[pair % 2 == 1].sum() / 4 / len(varied))))
        cost = n * np.where(y > 0, 0.5 / n[y > 0].sum(), 0.5 / max(1.0, n[y < 0].sum())) * 1000
        w, b = svm(np.hstack([x, np.ones((len(x), 1))]), y, cost)
        part, least = np.full(len(near), -np.inf), -b
        part[held] = x_held @ w
    worst = sample.worst(part)
    margin = most(np.where(worst >= 0, part[worst], 0.0)).clip(0.0) + b
    slope, offset = calibrate(np.append(margin, x_varied @ w + b), np.append(toxic, np.ones(len(varied), int)), np.append(np.ones(len(texts)), np.full(len(varied), toxic.sum() / 4 / len(varied))))
    own = kernel.of(marks) @ (root @ w)
    reach = np.where(slope * (own + b) + offset >= 0, np.maximum(nearest + REACH * (1 - nearest), FLOOR), np.inf)
    return Model(names, root @ w, b, slope, offset, reach, own)


def calibrate(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve that crosses a half amid the margins where hardly more labels are missed than need be; its slope is the likeliest."""
    order = np.argsort(margin)
    m, y, weight = margin[order], y[order], weight[order]
    missed = np.concatenate([[0.0], np.cumsum(weight * y)]) + np.concatenate([np.cumsum((weight * (1 - y))[::-1])[::-1], [0.0]])
    missed[1:-1][m[1:] == m[:-1]] = np.inf
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    best = np.flatnonzero(missed <= missed.min() + SLACK * n1)
    edge = np.concatenate([[m[0] - 1.0], (m[1:] + m[:-1]) / 2, [m[-1] + 1.0]])[best].take([0, -1]).mean()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = 1.0
    for _ in range(50):
        d = m - edge
        p = 1 / (1 + np.exp(-np.clip(a * d, -30, 30)))
        a = float(np.clip(a - (weight * d * (p - target)).sum() / ((weight * d * d * p * (1 - p)).sum() + 1e-6), a / 2, a * 2))
    return a, -a * edge


def held_out(id_col: str) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> Model:
    """Fit on about ``rows`` whole labelled texts, drawn by a hash of their ids, none held out.

    Tasks turn the texts into their sentences' distinct words, TRAIN_SENTENCES
    sentences and words of each at most; one task fits on those of 2 * rows
    texts at most whatever the input, and the driver gets the model alone. Null labels and texts are left out; a repeated label counts
    again. Without labels of both kinds the model finds nothing toxic.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(id_col, label_col)
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(max(1, n))) < rows).limit(2 * rows)
    ids = F.broadcast(drawn)  # at most 2 * rows
    sample = docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).join(ids, id_col)
    sample = sample.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (F.col(label_col) == 1).cast("int").alias("y"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [pickle.dumps(sentences(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(told, pa.binary())], ["id", "y", "words"])

    def fitted(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["id", "words"]).head(2 * rows)
        return pd.DataFrame({"model": [pickle.dumps(fit([pickle.loads(w) for w in frame.words], frame.y.to_numpy(), landmarks))]})

    got = sample.mapInArrow(split, "id long, y int, words binary").groupBy().applyInPandas(fitted, "model binary").collect()
    return pickle.loads(got[0].model) if got else fit([], np.zeros(0, int), landmarks)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1, higher: more likely toxic).

    A null text scores as an empty one. Texts are read whole; other columns and
    repeated rows stay; a column named score is replaced; an empty table gives
    no rows. Of the table's columns the text alone goes to Python, and it does
    not come back.
    """
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # landmarks x landmarks numbers

    @F.pandas_udf("double")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            yield pd.Series(np.concatenate([own.scores(part) for part in chunks(texts)]) if texts else np.zeros(0))
        own._known.clear()

    return df.drop("score").withColumn("score", told(F.col(text_col)))
