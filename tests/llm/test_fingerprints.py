from __future__ import annotations

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from driftgrid.llm import fingerprints
from driftgrid.llm.fingerprints import digests, differing, fingerprint_edits
from tests.llm.data import documents, frame, words


def edited(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for r, nxt in zip(order, order[1:] + order[:1]):
        t, u = r[1] or "", nxt[1] or ""
        third = len(t) // 3
        out[r[0]] = (len(t), hashlib.sha256((t[: len(t) - third] + u[:third]).encode()).hexdigest())
    return out


def unique():
    return documents()[:40]


def test_edits_across_blocks(spark, monkeypatch):
    for block in (4000, 7, 1):
        monkeypatch.setattr(fingerprints, "BLOCK_ROWS", block)
        got = {r.doc_id: (r.n_chars, hashlib.sha256(r.edited_text.encode()).hexdigest()) for r in fingerprint_edits(frame(spark, unique())).collect()}
        assert got == edited(unique())


def test_peeling_counts_the_difference(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        both, a, b = rng.integers(0, 200), rng.integers(0, 40), rng.integers(0, 3000 if i > 57 else 60)
        rows.append((i, "\n".join(f"s{i}-{k}" for k in range(both)) + "\n" + "".join(f"a{i}-{k}\n" for k in range(a)), "\n".join(f"s{i}-{k}" for k in range(both)) + "\n" + "".join(f"b{i}-{k}\n" for k in range(b)), int(a + b)))
    df = spark.createDataFrame(rows, "i int, a string, b string, want int")
    df = df.withColumns({"x": digests(F.col("a")), "y": digests(F.col("b"))})
    got = df.select("want", differing(F.col("x"), F.col("y")).alias("d"), F.size(F.array_except("x", "y")).alias("e"), F.size(F.array_except("y", "x")).alias("f")).collect()
    assert all(r.d == r.e + r.f for r in got)
    assert all(abs(r.d - r.want) <= 2 for r in got)


def test_likeness(spark):
    out = fingerprint_edits(frame(spark, unique())).toPandas().set_index("doc_id")
    assert out.near_edited.between(0, 1).all() and out.near_next.between(0, 1).all()
    assert out.fingerprint[22] == out.fingerprint[23] == out.fingerprint[3] and out.near_next[24] == 1.0
    assert out.near_edited[28] > out.near_next[28] and (out.near_next[26], out.near_edited[26]) == (1.0, 1.0)
    same = out.edited_fingerprint == out.fingerprint
    assert (out.near_edited[same] == 1.0).all()


def peeled(fingerprint: str) -> set[int]:
    """The digests of a fingerprint, from its text alone. The check of a digest is that it peels."""
    n, cells = fingerprint.split(":")
    cells = [int(cells[i : i + 16], 16) for i in range(0, len(cells), 16)]
    size = len(cells) // 3
    at = lambda k: [p * size + (k >> 24 + 13 * p & size - 1) for p in range(3)]
    found: set[int] = set()

    def go() -> bool:
        if not any(cells):
            return len(found) == int(n, 16)
        for c, k in enumerate(cells):
            if k and c in at(k) and CHECK[k >> 24] == k & 0xFFFFFF:
                found.add(k)
                for i in at(k):
                    cells[i] ^= k
                return go()
        return False

    assert go()
    return found


class Checks(dict):
    """Check bits of digests, as the engine computes them."""

    def __missing__(self, k):  # noqa: ANN001, ANN204
        return None


CHECK = Checks()


def test_two_fingerprints_tell_the_likeness(spark):
    rng = np.random.default_rng(5)
    texts = ["\n".join(f"line {int(k)} of some words" for k in rng.integers(0, 60, int(n))) for n in rng.integers(0, 90, 40)]
    df = frame(spark, [(i, t, "en", "s", 0, 0.0, 0, 0, 0, "") for i, t in enumerate(texts)])
    out = fingerprint_edits(df).toPandas().sort_values("doc_id", ascending=False)
    sets = df.select(digests(F.col("text")).alias("d")).unionByName(fingerprint_edits(df).select(digests(F.col("edited_text")).alias("d"))).collect()
    for r in sets:
        CHECK.update({(k % 2**64) >> 24: k & 0xFFFFFF for k in r.d})
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    own = [peeled(f) for f in out.fingerprint]
    for i, (near_e, near_x, edited_) in enumerate(zip(out.near_edited, out.near_next, out.edited_fingerprint)):
        assert abs(near_e - likeness(own[i], peeled(edited_))) < 1e-12
        assert abs(near_x - likeness(own[i], own[(i + 1) % len(own)])) < 1e-12


def test_an_insertion_moves_few_pieces(spark):
    text = " ".join(words(random.Random(6), 900))
    df = spark.createDataFrame([(text, "inserted " + text)], "a string, b string")
    a, b, both = df.select(F.size(digests(F.col("a"))), F.size(digests(F.col("b"))), F.size(F.array_intersect(digests(F.col("a")), digests(F.col("b"))))).first()
    assert a > 12 and both > 0.5 * max(a, b)


def test_one_far_id_leaves_the_ranges_even(spark):
    df = spark.range(20_000).unionByName(spark.createDataFrame([(2**60,), (None,)], "id long")).withColumn("t", F.col("id").cast("string"))
    out = fingerprints.with_next(df, "id", {"next": F.col("id")})
    got = {r.id: r.next for r in out.collect()}
    assert got[2**60] == 19_999 and got[5] == 4 and got[0] is None and got[None] == 2**60


def test_repeats_nulls_and_empty(spark):
    out = fingerprint_edits(frame(spark))
    assert out.count() == len(documents()) and out.where("doc_id IS NULL").count() == 1
    assert fingerprint_edits(frame(spark, [])).count() == 0
    one = fingerprint_edits(frame(spark, documents()[:1])).first()
    t = documents()[0][1]
    assert one.edited_text == t[: len(t) - len(t) // 3] + t[: len(t) // 3]


def test_a_text_of_twenty_thousand_lines_has_a_fingerprint_of_its_own(spark):
    text = "".join(f"line {i} of many\n" for i in range(20_000))
    rows = [(2, text, "en", "s", 0, 0.0, 0, 0, 0, ""), (1, "other\n" * 3, "en", "s", 0, 0.0, 0, 0, 0, "")]
    got = {r.doc_id: r for r in fingerprint_edits(frame(spark, rows)).collect()}
    head, cells = got[2].fingerprint.split(":")
    assert int(head, 16) == 20_000 and len(cells) == 16 * 3 * 32768 and len(got[1].fingerprint.split(":")[1]) == 16 * 3 * 8
    lost = set(text.split("\n")) - set(got[2].edited_text.split("\n"))
    assert 0.6 < got[2].near_edited < 0.7 and abs(got[2].near_edited - (20_000 - len(lost)) / 20_001) < 0.001 and got[2].near_next == 0.0
