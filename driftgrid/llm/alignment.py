"""Alignment of two tokenizers' tokens by products of sparse incidence matrices.

A text's tokens and bytes are an incidence matrix for each tokenizer: rows are
tokens, columns the bytes that a token covers, or the last of them alone. With
the matrices in compressed rows, row i of A times the transpose of B is the sum
of B's columns at the bytes of token i (Gustavson's product), so its entries are
the pairs of tokens that share bytes, and how many. Offsets where both have a
token's end cut the text into groups; tokens by groups are a third incidence,
whose product pairs all tokens of one group.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from driftgrid.llm.common import CHUNK_BYTES, cut, small_batches
from driftgrid.llm.packing import Encoder, bytes_of_characters
from driftgrid.llm.warc import run_folder

PRODUCT_ENTRIES = 1 << 20  # entries of a product made at a time
BROADCAST_PAIRS = 1_000_000
ROW_BITS = 33  # a row's number within its task
LINKS = ("end", "overlap", "group")
SPACE = "\u2581"


@dataclass
class Csr:
    """Compressed rows: row i has columns ``col[first[i]:first[i + 1]]`` with their values."""

    first: np.ndarray
    col: np.ndarray
    value: np.ndarray
    width: int

    def __len__(self) -> int:
        return len(self.first) - 1

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))


def from_spans(start: np.ndarray, end: np.ndarray, width: int) -> Csr:
    """Row i has a one in each of the columns start[i] to end[i] - 1."""
    first = np.concatenate([[0], np.cumsum(end - start)])
    col = np.arange(first[-1]) + np.repeat(start - first[:-1], end - start)
    return Csr(first, col, np.ones(len(col), np.int64), width)


def transposed(m: Csr) -> Csr:
    """Columns counted, then every entry put at its place: the rows of the transpose keep the order of m's rows."""
    first = np.concatenate([[0], np.cumsum(np.bincount(m.col, minlength=m.width))])
    order = np.argsort(m.col, kind="stable")
    return Csr(first, m.row[order], m.value[order], len(m))


def gustavson(a: Csr, b: Csr, limit: int = PRODUCT_ENTRIES) -> Csr:
    """a times b, row by row: row i is the sum of b's rows at the columns of a's row i, each times a's entry.

    Rows are taken in blocks of about ``limit`` terms, so what is held besides
    the result is bounded but for one row.
    """
    terms = np.diff(b.first)[a.col]
    upto = np.concatenate([[0], np.cumsum(terms)])[a.first]
    rows, cols, values, i = [], [], [], 0
    while i < len(a):
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + limit, "right")) - 1)
        at = slice(a.first[i], a.first[j])
        n = terms[at]
        place = np.arange(n.sum()) + np.repeat(b.first[a.col[at]] - np.cumsum(n) + n, n)
        row = np.repeat(np.repeat(np.arange(i, j), np.diff(a.first[i : j + 1])), n)
        key = row * b.width + b.col[place]
        order = np.argsort(key, kind="stable")
        key, value = key[order], (np.repeat(a.value[at], n) * b.value[place])[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        rows.append(key[new] // b.width)
        cols.append(key[new] % b.width)
        values.append(np.add.reduceat(value, new) if len(new) else value)
        i = j
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    count = np.bincount(row, minlength=len(a)) if len(row) else np.zeros(len(a), np.int64)
    return Csr(np.concatenate([[0], np.cumsum(count)]), np.concatenate(cols) if cols else row, np.concatenate(values) if values else row, b.width)


class Vocabulary:
    """The bytes of every id, end to end."""

    def __init__(self, entries: list[bytes]) -> None:
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of tokens."""
        n = self.size[ids]
        return self.data[np.arange(n.sum()) + np.repeat(self.start[ids] - np.cumsum(n) + n, n)]


class ByteLevel:
    """A byte-level BPE file. The strings of its special tokens are plain text."""

    def __init__(self, path: str) -> None:
        self.encoder = Encoder(path, special_as_text=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of, names = bytes_of_characters(), dict(spec["model"]["vocab"])
        names |= {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        entries = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            entries[i] = bytes(of[c] for c in name) if all(c in of for c in name) else name.encode()
        self.vocabulary = Vocabulary(entries)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoder.encode(" " + text), np.uint32).astype(np.int64)


class Pieces:
    """A sentencepiece model that puts a space before each text. U+2581 is a space, a byte piece its byte.

    Where the model is plain BPE with byte fallback, tiktoken merges by the same
    scores, twice as fast: bytes of a known character come first, then pieces.
    Texts that hold U+2581 itself go to sentencepiece.
    """

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        name, count = self.model.id_to_piece, self.model.get_piece_size()
        self.names = [name(i) for i in range(count)]
        self.byte_of = {i: int(self.names[i][3:5], 16) for i in range(count) if self.model.is_byte(i)}
        self.entries = [bytes([self.byte_of[i]]) if i in self.byte_of else self.names[i].replace(SPACE, " ").encode() for i in range(count)]
        self.vocabulary = Vocabulary(self.entries)
        self.fast = self.by_rank() if self.plain(path) else None

    def plain(self, path: str) -> bool:
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        before, how = spec.normalizer_spec, spec.trainer_spec
        kinds = {p.type for p in spec.pieces} <= {1, 2, 3, 6}  # normal, unknown, control, byte
        inner = any(SPACE in n.lstrip(SPACE) for n in self.names)
        same = not before.precompiled_charsmap and before.add_dummy_prefix and not before.remove_extra_whitespaces and before.escape_whitespaces
        return how.model_type == 2 and how.byte_fallback and not how.treat_whitespace_as_suffix and kinds and same and not inner and len(self.byte_of) == 256

    def by_rank(self) -> tiktoken.Encoding:
        """Ranks: bytes, then the beginnings of known characters, then pieces by score. ``self.ids`` has the piece of each rank, or -1 where its bytes stand for themselves."""
        normal = [i for i, n in enumerate(self.names) if not (i in self.byte_of or self.model.is_control(i) or self.model.is_unknown(i))]
        single = {self.entries[i]: i for i in normal if len(self.names[i]) == 1}
        ranks = {bytes([b]): b for b in range(256)}
        for c in sorted({c for i in normal for c in self.names[i].replace(SPACE, " ")}):
            raw = c.encode()
            for k in range(2, len(raw) + 1):
                ranks.setdefault(raw[:k], len(ranks))
        byte_id = {b: i for i, b in self.byte_of.items()}
        ids = [single.get(raw, byte_id[raw[0]] if len(raw) == 1 else -1) for raw in ranks]
        for i in sorted((i for i in normal if len(self.names[i]) > 1), key=lambda i: (-self.model.get_score(i), i)):
            ranks[self.entries[i]] = len(ranks)
            ids.append(i)
        self.ids, self.bytes_of = np.array(ids), {r: [byte_id[b] for b in raw] for raw, r in ranks.items() if ids[r] < 0}
        return tiktoken.Encoding("pieces", pat_str=r" *[^ ]+| +", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if not self.fast or not text or SPACE in text:
            return np.array(self.model.encode(text), np.int64)
        ranks = np.array(self.fast.encode_ordinary(" " + text))
        out = self.ids[ranks]
        if (out < 0).any():
            return np.array([i for r, k in zip(ranks.tolist(), out.tolist()) for i in (self.bytes_of[r] if k < 0 else (k,))], np.int64)
        return out


class Aligned:
    """Tokens of a run of texts, one text after the other: ids and byte spans on both sides, groups, and links."""

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], left: Vocabulary, right: Vocabulary, links: str) -> None:
        self.docs = len(a)
        none = np.zeros(0, np.int64)
        self.ids = [np.concatenate([none, *a]), np.concatenate([none, *b])]
        self.doc = [np.repeat(np.arange(self.docs), [len(x) for x in side]) for side in (a, b)]
        self.end = [np.cumsum(v.size[ids]) for v, ids in zip((left, right), self.ids)]
        start = [e - v.size[ids] for e, v, ids in zip(self.end, (left, right), self.ids)]
        width = int(self.end[0][-1]) if len(self.end[0]) else 0
        last = [from_spans(e - 1, e, width) for e in self.end]
        ends = gustavson(last[0], transposed(last[1]))
        cuts = self.end[0][ends.row]
        self.group = [np.searchsorted(cuts, e) for e in self.end]
        self.groups = np.bincount(self.doc[0][ends.row], minlength=self.docs)
        if links == "end":
            found = ends
        elif links == "overlap":
            found = gustavson(from_spans(start[0], self.end[0], width), transposed(from_spans(start[1], self.end[1], width)))
        else:
            member = [from_spans(g, g + 1, len(cuts)) for g in self.group]
            found = gustavson(member[0], transposed(member[1]))
        self.link = (found.row, found.col)

    def written(self) -> list[bytes]:
        """Groups of each text: ids of the left side, a bar, ids of the right; semicolons between groups."""
        ids, doc, group = (np.concatenate(x) for x in (self.ids, self.doc, self.group))
        side = np.repeat([0, 1], [len(x) for x in self.ids])
        order = np.argsort(group * 2 + side, kind="stable")
        ids, doc, group, side = ids[order], doc[order], group[order], side[order]
        wide = len(str(int(ids.max()))) if len(ids) else 1
        digits = np.empty((len(ids), wide + 1), np.uint8)
        rest = ids.copy()
        for k in range(wide - 1, -1, -1):
            digits[:, k] = rest % 10 + 48
            digits[rest == 0, k] = 48 if k == wide - 1 else 0
            rest //= 10
        after = np.full(len(ids), ord(","), np.uint8)
        after[:-1][side[1:] != side[:-1]] = ord("|")
        after[:-1][group[1:] != group[:-1]] = ord(";")
        after[:-1][doc[1:] != doc[:-1]] = 0
        after[-1:] = 0
        digits[:, wide] = after
        keep = digits != 0
        edges = np.concatenate([[0], np.cumsum(np.bincount(doc, keep.sum(1), minlength=self.docs))]).astype(np.int64)
        raw = digits[keep].tobytes()
        return [raw[i:j] for i, j in zip(edges, edges[1:])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first of each text, left ids, right ids, links) of the distinct linked pairs of ids."""
        doc, a, b = self.doc[0][self.link[0]], self.ids[0][self.link[0]], self.ids[1][self.link[1]]
        key, n = np.unique((doc << 42) | (a << 21) | b, return_counts=True)
        first = np.searchsorted(key, np.arange(self.docs + 1) << 42)
        return first, key >> 21 & 0x1FFFFF, key & 0x1FFFFF, n


def aligned_tokens(docs: DataFrame, byte_level_path: str, pieces_path: str, *, id_col: str = "doc_id", text_col: str = "text", links: str = "end", digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, ``groups`` or ``groups_sha256``, a, b, n, row_id.

    Left tokens are those of a space and the text, right ones those of a
    sentencepiece model that adds the space itself. ``groups`` has the ids as
    `a1,a2|b1;a3|b2`; with ``digest`` its SHA-256 is returned instead. Arrays a,
    b and n hold the distinct linked pairs of ids and how often the text links
    them: tokens that end together (``links`` "end"), that share a byte
    ("overlap") or a group ("group"). row_id numbers the rows.

    Null and empty texts, and texts that the tokens of a side don't spell out
    byte by byte, have no tokens: zeros, empty arrays and an empty string. Texts
    are read whole; repeated rows, rows without an id and other columns, of any
    name, do no harm; an empty table gives no rows.
    """
    if links not in LINKS:
        raise ValueError(f"links must be one of {LINKS}")
    small_batches(docs.sparkSession)
    name = "groups_sha256" if digest else "groups"
    count, ids = pa.int64(), pa.list_(pa.int32())
    schema = pa.schema([("doc_id", count), ("n_a", count), ("n_b", count), ("n_groups", count), ("n_links", count), (name, pa.string()), ("a", ids), ("b", ids), ("n", ids), ("row_id", count)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, none = ByteLevel(byte_level_path), Pieces(pieces_path), np.zeros(0, np.int64)
        number = TaskContext.get().partitionId() << ROW_BITS

        def tokens(text: str) -> tuple[np.ndarray, np.ndarray]:
            a, b, want = left.encode(text), right.encode(text), np.frombuffer(b" " + text.encode(), np.uint8)
            if np.array_equal(left.vocabulary.joined(a), want) and np.array_equal(right.vocabulary.joined(b), want):
                return a, b
            return none, none

        def told(rows: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            a, b = [r[1] for r in rows], [r[2] for r in rows]
            one = Aligned(a, b, left.vocabulary, right.vocabulary, links)
            groups = [(hashlib.sha256(g).hexdigest() if digest else g.decode()) if g else "" for g in one.written()]
            first, pa_, pb, n = one.pairs()
            listed = lambda x: pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, pa.int32()))
            of_doc = np.bincount(one.doc[0][one.link[0]], minlength=len(rows))
            columns = [pa.array([r[0] for r in rows], count), pa.array([len(x) for x in a], count), pa.array([len(x) for x in b], count), pa.array(one.groups), pa.array(of_doc), pa.array(groups), listed(pa_), listed(pb), listed(n), pa.array(np.arange(number, number + len(rows)))]
            number += len(rows)
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            rows, size = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                rows.append((doc, *(tokens(text) if text else (none, none))))
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield told(rows)
                    rows, size = [], 0
            if rows:
                yield told(rows)

    ddl = f"doc_id long, n_a long, n_b long, n_groups long, n_links long, {name} string, a array<int>, b array<int>, n array<int>, row_id long"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ddl)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, count (links of the pair over all texts), best (whether no left id has more links with that right id; ties all)."""
    each = aligned.select(F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("p.a", "p.b", "p.n")
    counts = cut(each.groupBy("a", "b").agg(F.sum(F.col("n").cast("long")).alias("count")))
    top = counts.groupBy("b").agg(F.max("count").alias("most"))  # a row for each right id
    return counts.join(top, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_scores(docs: DataFrame, byte_level_path: str, pieces_path: str, *, broadcast_pairs: int = BROADCAST_PAIRS, **settings: object) -> DataFrame:
    """The columns of ``aligned_tokens`` up to the groups, and n_best, count_sum for each text.

    n_best: links whose pair has the most links that its right id has with any
    left one in the corpus; count_sum: the pairs' counts, summed over links.
    Texts are tokenised once and written to the shared folder with their pairs.
    The table of pairs is broadcast up to ``broadcast_pairs`` rows; beyond that it
    is joined by a shuffle of each text's distinct pairs.
    """
    spark = docs.sparkSession
    path = f"{run_folder(spark, 'alignment')}/tokens"
    aligned_tokens(docs, byte_level_path, pieces_path, **settings).write.option("compression", "zstd").parquet(path)
    held = spark.read.parquet(path)
    counts = cut(pair_counts(held))
    small = counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs
    each = held.select("row_id", F.explode(F.arrays_zip("a", "b", "n")).alias("p")).select("row_id", "p.a", "p.b", F.col("p.n").cast("long").alias("n"))
    told = each.join(F.broadcast(counts) if small else counts, ["a", "b"]).groupBy("row_id").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    out = held.drop("a", "b", "n").join(told, "row_id", "left").drop("row_id")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
