from __future__ import annotations

import random

import numpy as np
import pytest

from driftgrid.llm import substrings
from driftgrid.llm.substrings import pack_hashes, pack_ids, remove_repeats, unpack_hashes, unpack_ids
from tests.llm.data import documents, frame, words


def brute(rows, window=20):
    seen, out = set(), {}
    for r in sorted((r for r in rows), key=lambda r: (r[0] is None, r[0])):
        if (r[0], r[1]) in out:
            continue
        w = (r[1] or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            k = tuple(w[a : a + window])
            if k in seen:
                gone[a : a + window] = [True] * window
            seen.add(k)
        out[r[0], r[1]] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


@pytest.mark.parametrize(("flush", "block", "limit"), [(2_000_000, 2_000_000, 1 << 21), (50, 300, 1 << 10)])
def test_equals_brute_force(spark, monkeypatch, flush, block, limit):
    monkeypatch.setattr(substrings, "BLOCK_WINDOWS", block)
    run = substrings.seeds
    monkeypatch.setattr(substrings, "seeds", lambda *a: _flushing(run, flush, *a))
    rows = documents()
    rng = random.Random(3)
    tail = words(rng, 30)
    rows += [(100 + i, " ".join(words(rng, 5) + tail + words(rng, 3) + tail[:25]), "en", "s", 0, 0.0, 0, 0, 0, "") for i in range(30)]
    df = frame(spark, rows).repartition(5)
    out = remove_repeats(df)
    assert sorted(out.columns) == sorted([*df.columns, "n_removed"])
    want = brute(rows)
    got = sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_removed, r.text) for r in out.collect())
    assert got == sorted((r[0] is None, r[0], *want[r[0], r[1]]) for r in rows)


def _flushing(run, size, *args):
    substrings.FLUSH_WINDOWS = size
    return run(*args)


def test_empty(spark):
    assert remove_repeats(frame(spark, [])).count() == 0


def test_packed_hashes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 1000):
        h = np.sort(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (unpack_hashes(pack_hashes(h)) == h).all()
    dense = np.sort(rng.integers(0, 2**40, 500, dtype=np.uint64))
    assert len(pack_hashes(dense)) == 9 + 6 * 499 and (unpack_hashes(pack_hashes(dense)) == dense).all()


def test_packed_ids():
    for ids in ([5], [-(2**63), -3, 0, 0, 2**63 - 1], [1, 2, 2, 2**32 + 1], list(range(100))):
        x = np.array(ids, np.int64)
        assert (unpack_ids(pack_ids(x)) == x).all()


def test_factors_copy_earlier_words(spark):
    rows = [r for r in documents() if r[0] is not None and r[1]]
    rng = random.Random(3)
    tail = words(rng, 60)
    rows += [(100 + i, " ".join(tail[:40] + words(rng, 2) + tail[20:] + tail[:30]), "en", "s", 0, 0.0, 0, 0, 0, "") for i in range(12)]
    texts = {}
    for r in rows:
        texts.setdefault(r[0], r[1].encode().split())
    n = 0
    for r in substrings.repeated_factors(frame(spark, rows).repartition(4)).collect():
        last = -1
        for start, length, source, at in zip(r["__starts"], r["__lengths"], r["__sources"], r["__source_starts"]):
            assert length >= 20 and start > last and (source, at) < (r["__id"], start)
            assert texts[r["__id"]][start : start + length] == texts[source][at : at + length]
            last, n = start, n + 1
    assert n > 30


def test_rows_that_share_an_id(spark):
    rng = random.Random(7)
    passage = " ".join(words(rng, 30))
    rows = [(1, f"{passage} a", "en", "s", 0, 0.0, 0, 0, 0, ""), (1, f"b {passage}", "en", "s", 0, 0.0, 0, 0, 0, ""), (1, f"b {passage}", "en", "s", 0, 0.0, 0, 0, 0, ""), (2, passage, "en", "s", 0, 0.0, 0, 0, 0, "")]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in remove_repeats(frame(spark, rows)).collect())
    assert got == [(1, 31, 0), (1, 31, 30), (1, 31, 30), (2, 30, 30)]
