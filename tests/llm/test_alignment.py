from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftgrid.llm.alignment import Aligned, ByteLevel, Csr, Pieces, aligned_tokens, alignment_scores, from_spans, gustavson, transposed
from driftgrid.llm.packing import bytes_of_characters
from driftgrid.llm.queries import op12_align
from tests.llm.data import documents, frame

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LEFT, RIGHT = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
LEFT.encode_special_tokens = True
OF = bytes_of_characters()
ODD = ["hello <|endoftext|> world", "<s> a </s> <unk>", "▁under", "a  b\n\n\tc ", "é漢字𝒳 ｱ①", "\x00\x01", "naïve café", "<0x41> 0x41", "don't stop"]


def dense(m: Csr) -> np.ndarray:
    out = np.zeros((len(m), m.width), np.int64)
    np.add.at(out, (m.row, m.col), m.value)
    return out


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 6), st.integers(1, 6), st.integers(1, 6), st.integers(0, 2**32 - 1), st.sampled_from([1, 3, 1000]))
def test_products_equal_dense_ones(n, k, m, seed, limit):
    rng = np.random.default_rng(seed)

    def sparse(rows, cols):
        d = rng.integers(0, 3, (rows, cols)) * rng.integers(0, 2, (rows, cols))
        first = np.concatenate([[0], np.cumsum((d > 0).sum(1))]).astype(np.int64)
        return Csr(first, np.nonzero(d)[1], d[d > 0], cols)

    a, b = sparse(n, k), sparse(k, m)
    got = gustavson(a, b, limit)
    assert (dense(got) == dense(a) @ dense(b)).all() and (got.value > 0).all() and len(got) == n
    assert (dense(transposed(a)) == dense(a).T).all() and len(set(zip(got.row.tolist(), got.col.tolist()))) == len(got.col)


def test_spans():
    assert dense(from_spans(np.array([0, 2, 2]), np.array([2, 2, 5]), 6)).tolist() == [[1, 1, 0, 0, 0, 0], [0] * 6, [0, 0, 1, 1, 1, 0]]


PIECES = Pieces(B_PATH)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"ab Z9.!'\n\t\r é漢𝒳언日ßñ _-|<>\u00a0\u3000\x1c\x00\u2581", "  ", "the", "ing", " a", "<0x41>", "<s>", "日本", "\ufffd"]), max_size=40).map("".join))
def test_ids_are_those_of_sentencepiece(text):
    assert PIECES.fast is not None and PIECES.encode(text).tolist() == RIGHT.encode(text)


@pytest.mark.parametrize("text", ["x" * 50_000, "é" * 100_000, " " * 20_000, "ab" * 100_000, "漢" * 30_000, "word " * 20_000])
def test_ids_of_long_texts(text):
    assert PIECES.encode(text).tolist() == RIGHT.encode(text)


def tokens(text):
    """((id, start, end) on both sides), or nothing where the bytes differ."""
    if not text:
        return [], []
    out = []
    for ids, raw in (
        (e := LEFT.encode(" " + text, add_special_tokens=False)).ids and (e.ids, [bytes(OF[c] for c in LEFT.id_to_token(i)) for i in e.ids]),
        (ids := RIGHT.encode(text), [bytes([int(RIGHT.id_to_piece(i)[3:5], 16)]) if RIGHT.is_byte(i) else RIGHT.id_to_piece(i).replace("▁", " ").encode() for i in ids]),
    ):
        if b"".join(raw) != (" " + text).encode():
            return [], []
        at, side = 0, []
        for i, r in zip(ids, raw):
            side.append((i, at, at + len(r)))
            at += len(r)
        out.append(side)
    return out


def linked(a, b, links):
    ends = sorted({x[2] for x in a} & {x[2] for x in b})
    group = lambda x: sum(e < x[2] for e in ends)
    meet = {"end": lambda x, y: x[2] == y[2], "overlap": lambda x, y: x[1] < y[2] and y[1] < x[2], "group": lambda x, y: group(x) == group(y)}[links]
    text = ";".join(",".join(str(x[0]) for x in a if group(x) == g) + "|" + ",".join(str(y[0]) for y in b if group(y) == g) for g in range(len(ends)))
    return len(ends), text, [(x[0], y[0]) for x in a for y in b if meet(x, y)]


def brute(rows, links="end"):
    each = [(r[0], *tokens(r[1] or "")) for r in rows]
    told = [(d, len(a), len(b), *linked(a, b, links)) for d, a, b in each]
    counts = Counter(p for t in told for p in t[5])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return [(d, na, nb, g, len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if na else "") for d, na, nb, g, text, pairs in told]


def rows_of(texts):
    return [(i, t, None, None, 0, None, None, None, None, None) for i, t in enumerate(texts)]


KEY = lambda r: tuple(map(str, r))


def test_query_equals_brute_force(spark, tmp_path):
    rows = [r for r in documents() if len(r[1] or "") < 3000] + [(500 + i, *r[1:]) for i, r in enumerate(rows_of(ODD))]
    frame(spark, rows).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = op12_align(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(brute(rows), key=KEY)


@pytest.mark.parametrize("links", ["end", "overlap", "group"])
def test_all_kinds_of_links_and_both_joins(spark, links):
    rows = rows_of(["the cat sat on the mat", "unbelievable antidisestablishmentarianism", *ODD, "", None])
    for most in (0, 1_000_000):
        got = alignment_scores(frame(spark, rows), A_PATH, B_PATH, links=links, broadcast_pairs=most, digest=True)
        assert sorted(map(tuple, got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=KEY) == sorted(brute(rows, links), key=KEY)


def test_groups_are_written_out(spark):
    rows = rows_of(["hello world", "▁", ""])
    got = {r.doc_id: r for r in aligned_tokens(frame(spark, rows), A_PATH, B_PATH).collect()}
    _, text, pairs = linked(*tokens("hello world"), "end")
    assert got[0].groups == text and Counter({(a, b): n for a, b, n in zip(got[0].a, got[0].b, got[0].n)}) == Counter(pairs)
    assert got[1].groups == got[2].groups == "" and got[1].n_a == 0 and got[2].a == []
    assert len({r.row_id for r in got.values()}) == 3


def test_long_texts(spark):
    texts = ["word " * 40_000, "é" * 100_000, " " * 20_000, "x" * 50_000]
    got = {r.doc_id: r for r in aligned_tokens(frame(spark, rows_of(texts)), A_PATH, B_PATH, digest=True).collect()}
    left, right = ByteLevel(A_PATH), Pieces(B_PATH)
    for i, t in enumerate(texts):
        one = Aligned([left.encode(t)], [right.encode(t)], left.vocabulary, right.vocabulary, "end")
        assert got[i].n_a == len(one.ids[0]) > 0 and got[i].n_links == got[i].n_groups == one.groups[0] and sum(got[i].n) == got[i].n_links


def test_empty_table_and_wrong_links(spark):
    assert alignment_scores(frame(spark, []), A_PATH, B_PATH).count() == 0
    with pytest.raises(ValueError):
        aligned_tokens(frame(spark, []), A_PATH, B_PATH, links="start")
