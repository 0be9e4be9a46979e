from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftgrid.llm.packing import Encoder, Filler, pack
from tests.llm.data import documents, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
AS_TEXT = Tokenizer.from_file(PATH)
AS_TEXT.encode_special_tokens = True
ENCODER, TEXT_ENCODER = Encoder(PATH), Encoder(PATH, special_as_text=True)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab Z9.!'\n\t\r é漢𝒳 _-|<>\u00a0\u3000\x1c", "'s", "'ll", "<|endoftext|>", "  ", " \n", "the", "word"]), max_size=40).map("".join))
def test_ids_are_those_of_tokenizers(text):
    for encoder, tokenizer in ((ENCODER, TOKENIZER), (TEXT_ENCODER, AS_TEXT)):
        assert np.frombuffer(encoder.encode(text), np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_special_tokens(spark):
    df = spark.createDataFrame([(1, "hello <|endoftext|> world")], "doc_id long, text string")
    ids = lambda **kw: np.frombuffer(pack(df, PATH, **kw).orderBy("start").agg(F.array_join(F.collect_list(F.hex("ids")), "").alias("x")).select(F.unhex("x")).first()[0], np.uint32).tolist()
    assert ids() == [31373, 220, 50256, 995, 1]
    assert ids(special_as_text=True) == [31373, 1279, 91, 437, 1659, 5239, 91, 29, 995, 1]


@pytest.mark.parametrize("text", [" " * 50_000, "x" * 50_000, "word " * 20_000 + "\n" * 3_000, "a" + " " * 5_000 + "b"])
def test_long_texts(text):
    assert np.frombuffer(ENCODER.encode(text), np.uint32).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 40), st.integers(1, 300)), max_size=120), st.sampled_from([1, 16, 64]))
def test_sequences_are_full_and_whole(sizes, capacity):
    filler, rows = Filler(capacity, 0), []
    for doc, n in enumerate(sizes):
        rows += filler.add(doc, np.arange(n, dtype=np.uint32).tobytes())
    rows += filler.finish()
    got, held = {}, {}
    for doc, start, n, total, raw, seq, at in rows:
        assert total == sizes[doc] and n == len(raw) // 4 > 0
        got.setdefault(doc, []).append((start, np.frombuffer(raw, np.uint32).tolist()))
        assert held.get(seq, 0) == at
        held[seq] = at + n
    assert all(n == capacity or n & (n - 1) == 0 for n in held.values())
    for doc, n in enumerate(sizes):
        assert sum((x for _, x in sorted(got[doc])), []) == list(range(n))
    assert sum(n < capacity for n in held.values()) <= capacity.bit_length()


def test_documents_stay_whole():
    rng = np.random.default_rng(0)
    filler, sizes = Filler(2048, 0), rng.integers(1, 2048, 4000)
    rows = [r for i, n in enumerate(sizes) for r in filler.add(i, bytes(4 * int(n)))] + list(filler.finish())
    whole = {r[0] for r in rows if r[2] == r[3]}
    assert len(whole) > 0.8 * len(sizes)


@pytest.mark.parametrize(("with_ids", "capacity"), [(True, 2048), (False, 64)])
def test_packing(spark, with_ids, capacity):
    rows = documents()
    got = pack(frame(spark, rows).repartition(3), PATH, capacity=capacity, with_ids=with_ids).toPandas()
    assert got.sequence_id.notna().all()
    got.loc[got.doc_id.isna(), "doc_id"] = -1
    seen = {}
    for r in rows:
        seen.setdefault(-1 if r[0] is None else r[0], []).append(TOKENIZER.encode(r[1] or "", add_special_tokens=False).ids + [1])
    for doc, copies in seen.items():
        ids, part = copies[0], got[got.doc_id == doc].sort_values("start")
        assert (part.doc_tokens == len(ids)).all() and part.length.sum() == len(ids) * len(copies)
        for p in part.itertuples():
            raw = np.array(ids[p.start : p.start + p.length], np.uint32).tobytes()
            assert p.ids == raw if with_ids else p.ids_crc32 == zlib.crc32(raw)
    padding = 0
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length.to_numpy())[:-1]])).all()
        n = int(g.length.sum())
        assert n <= capacity
        padding += 0 if n & (n - 1) == 0 else capacity - n
    assert padding == 0


def test_empty_and_wrong_capacity(spark):
    assert pack(frame(spark, []), PATH).count() == 0
    with pytest.raises(ValueError):
        pack(frame(spark, []), PATH, capacity=1000)
