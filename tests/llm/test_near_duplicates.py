from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftgrid.llm.components import components
from driftgrid.llm.near_duplicates import BINS, bucketed, estimated_recall, found_share, keep_one_of_each, near_duplicates, shortest, signatures
from tests.llm.data import documents, frame, words


def brute(rows, n=5):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)]) if w else frozenset())
    links, top = [0] * len(rows), list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
            links[i] += 1
            links[j] += 1
            a, b = top[i], top[j]
            top = [min(a, b) if t in (a, b) else t for t in top]
    least = {}
    for r, t in zip(rows, top):
        least[t] = min(least.get(t, r[0]), r[0])
    return sorted((r[0], least[t], k) for r, t, k in zip(rows, top, links))


@pytest.mark.parametrize("tile", [512, 4])
def test_equals_brute_force(spark, tile):
    rows = documents()[:-1]
    got = near_duplicates(frame(spark, [*rows, documents()[-1]]), tile=tile)
    assert got.columns == ["doc_id", "class_id", "n_links"]
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_family_larger_than_its_tiles(spark):
    rng = random.Random(5)
    base = words(rng, 120)
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"e{rng.random()}"
        rows.append((1000 - i, " ".join(w), "en", "s", 0, 0.0, 0, 0, 0, ""))
    assert sorted(map(tuple, near_duplicates(frame(spark, rows), tile=8).collect())) == brute(rows)


def test_keeping_one(spark):
    df = frame(spark)
    kept = keep_one_of_each(df)
    ids = [r.doc_id for r in kept.collect()]
    classes = {c for _, c, _ in brute(documents()[:-1])}
    assert set(ids) == classes | {None} and kept.columns == df.columns


def test_empty(spark):
    assert near_duplicates(frame(spark, [])).count() == 0


def test_prefix_lengths():
    d = shortest(0.8, 24, 0.999)
    assert found_share(0.8, 24, d) >= 0.999 > found_share(0.8, 24, d + 1)
    near, far = np.zeros(BINS), np.zeros(BINS)
    near[-1], far[0] = 100, 100
    # links between near copies are all found by long prefixes, links at the threshold are not
    assert estimated_recall(near, 0.8, 24, 8) > 0.999 > estimated_recall(far, 0.8, 24, 8)
    assert estimated_recall(far, 0.8, 24, d) >= 0.999 and estimated_recall(np.zeros(BINS), 0.8, 24, 8) == 0


def test_signatures_agree_as_often_as_sets_do():
    rng = np.random.default_rng(0)
    common, own = rng.integers(0, 1 << 63, 800).astype(np.uint64), rng.integers(0, 1 << 63, 200).astype(np.uint64)
    x = np.concatenate([np.concatenate([common, own[:100]]), np.concatenate([common, own[100:]])])
    sig = signatures(x, np.array([0, 900, 1800]), 200).view(np.uint64)
    byte = lambda s: s[:, None] >> np.arange(0, 64, 8, dtype=np.uint64) & np.uint64(255)
    share = (byte(sig[0]) == byte(sig[1])).mean()
    assert abs(share - (0.8 + 0.2 / 256)) < 0.05


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_neighbours_in_a_sorted_trie(size):
    rng = np.random.default_rng(1)
    tree = np.sort(rng.integers(0, 3, 200)).astype(np.int32)
    sig = rng.integers(0, 60, 200).astype(np.uint64) << np.uint64(16)
    order = np.lexsort((sig, tree))
    tree, sig = tree[order], sig[order]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(200)), pa.array(np.ones(200, np.int64)), pa.array(tree), pa.array(sig.view(np.int64))], ["node", "size", "tree", "sig"])
    got = [n for b in bucketed((batch.slice(i, size) for i in range(0, 200, size)), 6) for n in b.column(0).to_pylist()]
    prefixes = Counter(zip(tree.tolist(), (sig >> np.uint64(16)).tolist()))
    want = [i for i in range(200) if prefixes[int(tree[i]), int(sig[i] >> np.uint64(16))] > 1 or i in (0, 199)]
    assert got == want


def test_recall_at_the_threshold(spark):
    rng = random.Random(11)
    rows = []
    for i in range(150):
        base = words(rng, 204)
        copy = list(base)
        for k in rng.sample(range(20, 180, 10), 4):  # five grams each: about 180 of 220 are shared
            copy[k] = f"edit{i}x{k}"
        rows += [(2 * i, " ".join(base), "en", "s", 0, 0.0, 0, 0, 0, ""), (2 * i + 1, " ".join(copy), "en", "s", 0, 0.0, 0, 0, 0, "")]
    want = brute(rows)
    assert sum(n for _, _, n in want) == 300
    got = near_duplicates(frame(spark, rows)).collect()
    assert sum(r.n_links for r in got) >= 0.99 * 300


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(5, 5), (None, 3)]
    top = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a is not None and b is not None and a != b:
                top[a] = top[b] = min(top[a], top[b])
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(top.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize(("copies", "length", "tile"), [(3, 12_000, 1024), (5, 20_000, 1024), (5, 20_000, 2)])
def test_near_copies_of_long_texts(spark, copies, length, tile):
    rng = random.Random(11)
    base = words(rng, length)
    rows = [(i, " ".join([*base[:-1], f"last{i}"]), "en", "s", 0, 0.0, 0, 0, 0, "") for i in range(copies)]
    rows += [(100 + i, " ".join(words(rng, length)), "en", "s", 0, 0.0, 0, 0, 0, "") for i in range(2)]
    assert sorted(map(tuple, near_duplicates(frame(spark, rows), tile=tile).collect())) == brute(rows)


def test_two_thousand_near_copies_of_long_texts(spark):
    rng = random.Random(12)
    base = words(rng, 20_000)
    head, ids = " ".join(base[:-1]), spark.range(2000).select(F.col("id").alias("doc_id"))
    df = ids.select("doc_id", F.concat(F.lit(head + " last"), F.col("doc_id").cast("string")).alias("text"))
    got = near_duplicates(df)
    assert {tuple(r) for r in got.select("class_id", "n_links").distinct().collect()} == {(0, 1999)} and got.count() == 2000
