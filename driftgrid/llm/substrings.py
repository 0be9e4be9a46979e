"""Removal of repeated passages by relative Lempel-Ziv parsing, with word windows as seeds.

The reference is all earlier text (a smaller document id, or the same document
further up). Its index holds every window of ``window`` words with the place
where it occurs first, in blocks by hash. Looking up a document's windows gives
the source of each that occurs earlier. The document is then parsed from left
to right: a factor begins at the first window that has a source, and goes on as
long as the next window has the next place of the same source; so a factor is
(start, length, source document, source start), at least ``window`` words long.
The windows across the end of a factor are looked up like all others, and where
one has another source, the next factor overlaps the end.

Windows are compared by 64-bit hashes. Seeds travel packed: sorted hashes as
differences, with document and position. A task sends a repeated hash once, so a
passage that a third of all documents share arrives once from each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.llm.common import cut, ngrams, small_batches, words

FLUSH_WINDOWS = 2_000_000
BLOCK_WINDOWS = 2_000_000
BYTES_PER_WORD = 7
MOST_TEXTS = (1 << 16) - 1  # numbers of texts that share an id travel in 16 bits
NULL_ID = 1 << 62  # rows without an id come after all others
SEED_SCHEMA = "key int, ids binary, tags binary, a binary, b binary, c binary"


def whole(x: np.ndarray, *kinds: type) -> bytes:
    """``x`` in the first of the unsigned types that holds it."""
    top = int(x.max(initial=0))
    return next(x.astype(k) for k in kinds if top <= np.iinfo(k).max).tobytes()


def read(raw: bytes, n: int) -> np.ndarray:
    """Numbers written by ``whole``; the width follows from how many there are."""
    return np.frombuffer(raw, f"<u{len(raw) // n if n else 1}").astype(np.int32)


def pack_hashes(h: np.ndarray) -> bytes:
    """Sorted uint64 as the first and 6-byte differences, or as they are where one difference is larger."""
    d = np.diff(h)
    if len(d) and int(d.max()) >> 48:
        return b"\x08" + h.tobytes()
    return b"\x06" + h[:1].tobytes() + d.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_hashes(raw: bytes) -> np.ndarray:
    if raw[0] == 8:
        return np.frombuffer(raw, np.uint64, offset=1)
    d = np.zeros(((len(raw) - 9) // 6, 8), np.uint8)
    d[:, :6] = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, 6)
    return np.cumsum(np.concatenate([np.frombuffer(raw[1:9], np.uint64), d.reshape(-1).view(np.uint64)]), dtype=np.uint64)


def pack_ids(ids: np.ndarray) -> bytes:
    """Ascending int64 as the first and 4-byte differences, or as they are where one difference is larger."""
    d = np.diff(ids)
    if len(d) and (int(d.min()) < 0 or int(d.max()) >> 32):
        return b"\x08" + ids.tobytes()
    return b"\x04" + ids[:1].tobytes() + d.astype(np.uint32).tobytes()


def unpack_ids(raw: bytes) -> np.ndarray:
    if raw[0] == 8:
        return np.frombuffer(raw, np.int64, offset=1)
    return np.cumsum(np.concatenate([np.frombuffer(raw[1:9], np.int64), np.frombuffer(raw, np.uint32, offset=9).astype(np.int64)]))


def firsts(start: np.ndarray) -> np.ndarray:
    """For each entry of sorted groups (``start`` marks the first of each) where its group begins."""
    return np.flatnonzero(start)[np.cumsum(start) - 1]


def by_document(group: np.ndarray, ids: np.ndarray, tags: np.ndarray, pos: np.ndarray, source: np.ndarray, at: np.ndarray) -> Iterator[tuple]:
    """Rows (key, ids, tags, counts, positions, sources) of found windows, one for each group of documents."""
    order = np.lexsort((pos, tags, ids, group))
    group, ids, tags, pos, source, at = (x[order] for x in (group, ids, tags, pos, source, at))
    edges = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, int)
    for a, b in zip(edges, np.append(edges[1:], len(group))):
        i, t, p = ids[a:b], tags[a:b], pos[a:b]
        doc = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (t[1:] != t[:-1])))
        yield -1 - int(group[a]), pack_ids(i[doc]), t[doc].astype(np.uint16).tobytes(), whole(np.diff(np.append(doc, b - a)), np.uint16, np.uint32), whole(p, np.uint16, np.uint32), source[a:b].tobytes() + (at[a:b] - p).astype(np.int32).tobytes()


def spread(ids: np.ndarray, groups: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % groups


def seeds(batches: Iterator[pa.RecordBatch], window: int, bits: int, groups: int) -> Iterator[pa.RecordBatch]:
    """Packed seeds of a task's documents by index block, and the windows already seen to repeat within the task."""
    held: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        ids, tags, counts = (np.concatenate([x[i] for x in held]) for i in range(3))
        h, pos = (np.concatenate([x[i] for x in held]) for i in (3, 4))
        order = np.lexsort((tags, ids))
        begin = np.cumsum(counts) - counts
        take = np.repeat(begin[order] - (np.cumsum(counts[order]) - counts[order]), counts[order]) + np.arange(len(h))
        ids, tags, rank = ids[order], tags[order], np.repeat(np.arange(len(ids), dtype=np.int32), counts[order])
        h, pos = h[take], pos[take]
        s = np.lexsort((pos, ids[rank], h)) if tags.any() else np.argsort(h, kind="stable")
        h, pos, rank = h[s], pos[s], rank[s]
        first = firsts(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, int)
        again = (ids[rank] != ids[rank[first]]) | (pos != pos[first])
        own = rank[again]
        rows = list(by_document(spread(ids[own], groups), ids[own], tags[own], pos[again], ids[rank[first[again]]], pos[first[again]]))
        h, pos, rank = h[~again], pos[~again], rank[~again]
        block = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        edges = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(h) else np.zeros(0, int)
        table, marks = pack_ids(ids), tags.astype(np.uint16).tobytes()
        for a, b in zip(edges, np.append(edges[1:], len(h))):
            used = np.unique(rank[a:b])
            few = len(used) < len(ids)
            where = np.searchsorted(used, rank[a:b]) if few else rank[a:b]
            rows.append((int(block[a]), pack_ids(ids[used]) if few else table, tags[used].astype(np.uint16).tobytes() if few else marks, pack_hashes(h[a:b]), whole(where, np.uint16, np.uint32), whole(pos[a:b], np.uint16, np.uint32)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows))], ["key", "ids", "tags", "a", "b", "c"])

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        tags = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j, w in words(batch.column(2)):
            n = np.diff(w.first)
            h = ngrams(w.hash, window)
            pos = (np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)).astype(np.int32)
            fits = (pos + window <= np.repeat(n, n))[: len(h)]
            held.append((ids[i:j], tags[i:j], np.maximum(n - window + 1, 0), h[fits], pos[: len(h)][fits]))
            size += int(fits.sum())
            if size >= FLUSH_WINDOWS:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def look_up(key: tuple, frame: pd.DataFrame, groups: int) -> pd.DataFrame:
    """One block of the index: the windows that occur earlier. Windows already found pass through."""
    names = list(frame.columns)
    if key[0] < 0:
        return frame
    h, ids, tags, pos = [], [], [], []
    for r in frame.itertuples(index=False):
        one = unpack_hashes(r.a)
        where = read(r.b, len(one))
        h.append(one), pos.append(read(r.c, len(one)))
        ids.append(unpack_ids(r.ids)[where]), tags.append(np.frombuffer(r.tags, np.uint16)[where])
    h, ids, tags, pos = map(np.concatenate, (h, ids, tags, pos))
    s = np.argsort(h)
    same = h[s][1:] == h[s][:-1]
    s = s[np.append(same, False) | np.append(False, same)]
    s = s[np.lexsort((pos[s], ids[s], h[s]))]
    if not len(s):
        return frame.iloc[:0]
    first = s[firsts(np.append(True, h[s][1:] != h[s][:-1]))]
    hit = (ids[s] != ids[first]) | (pos[s] != pos[first])
    again, first = s[hit], first[hit]
    return pd.DataFrame(list(by_document(spread(ids[again], groups), ids[again], tags[again], pos[again], ids[first], pos[first])), columns=names)


def factors(frame: pd.DataFrame, window: int) -> pd.DataFrame:
    """Factors of every document of a group: runs of windows whose sources run on too, in words."""
    ids, tags, pos, source, shift = [], [], [], [], []
    for r in frame.itertuples(index=False):
        one = unpack_ids(r.ids)
        n = read(r.a, len(one))
        total = int(n.sum())
        ids.append(np.repeat(one, n)), tags.append(np.repeat(np.frombuffer(r.tags, np.uint16).astype(np.int64), n)), pos.append(read(r.b, total))
        source.append(np.frombuffer(r.c, np.int64, total)), shift.append(np.frombuffer(r.c, np.int32, total, 8 * total))
    ids, tags, pos, source, shift = map(np.concatenate, (ids, tags, pos, source, shift))
    order = np.lexsort((pos, tags, ids))
    ids, tags, pos, source, shift = (x[order] for x in (ids, tags, pos, source, shift))
    new = np.append(True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))
    head = np.flatnonzero(new | np.append(True, (pos[1:] > pos[:-1] + 1) | (source[1:] != source[:-1]) | (shift[1:] != shift[:-1])))
    tail = np.append(head[1:], len(ids)) - 1
    start, length = pos[head].astype(np.int32), (pos[tail] - pos[head] + window).astype(np.int32)
    doc = np.flatnonzero(new[head])
    cuts = doc[1:]
    at = start + shift[head]
    return pd.DataFrame({"__id": ids[head[doc]], "__tag": tags[head[doc]].astype(np.int32), "__starts": np.split(start, cuts), "__lengths": np.split(length, cuts), "__sources": np.split(source[head], cuts), "__source_starts": np.split(at, cuts)})


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with __id and __tag, which tell its distinct (id, text) apart.

    A row without an id gets one from its text's hash, above all others. Texts
    that share an id are numbered; where ids are unique all numbers are 0 and
    nothing is joined.
    """
    text = F.xxhash64(F.coalesce(text_col, F.lit("")))
    own = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID) + F.shiftrightunsigned(text, 2))
    rows = df.withColumn("__id", own)
    known = rows.select("__id", text.alias("__text")).distinct()
    shared = known.groupBy("__id").agg(F.count("*").alias("__n")).where("__n > 1").select("__id")
    if not shared.limit(1).count():
        return rows.withColumn("__tag", F.lit(0))
    number = F.row_number().over(Window.partitionBy("__id").orderBy("__text")) - 1
    numbered = known.join(cut(shared), "__id").withColumn("__tag", number)
    if numbered.where(F.col("__tag") > MOST_TEXTS).limit(1).count():
        raise ValueError(f"more than {MOST_TEXTS + 1} texts share an id")
    return rows.withColumn("__text", text).join(numbered, ["__id", "__text"], "left").drop("__text").withColumn("__tag", F.coalesce("__tag", F.lit(0)))


def repeated_factors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """The factors of every document that has one: __id, __tag (see ``keyed``), __starts, __lengths (words), __sources (ids), __source_starts."""
    return factors_of(keyed(df, id_col, text_col), text_col, window)


def factors_of(rows: DataFrame, text_col: str, window: int) -> DataFrame:
    small_batches(rows.sparkSession)
    size = rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    bits = max(0, int(np.ceil(np.log2(max(1, size / BYTES_PER_WORD / BLOCK_WINDOWS)))))
    groups = 1 << bits
    packed = rows.select("__id", "__tag", text_col).mapInArrow(lambda b: seeds(b, window, bits, groups), SEED_SCHEMA)
    found = packed.repartition(2 * groups, "key").groupBy("key").applyInPandas(lambda k, f: look_up(k, f, groups), SEED_SCHEMA)
    schema = "__id long, __tag int, __starts array<int>, __lengths array<int>, __sources array<long>, __source_starts array<int>"
    return found.repartition(groups, "key").groupBy("key").applyInPandas(lambda f: factors(f, window), schema)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """``df`` with ``text_col`` reduced to its kept words, joined by one space, and n_words, n_removed (long).

    A word goes if a window of ``window`` words that covers it also starts
    earlier: in a document with a smaller id or further up in the same one. The
    windows are those of the input, not of what is left.

    A null text has no words and becomes empty. Null ids come after all others,
    in the order of their texts' hashes; ids are below 2**62. Repeated rows are one document; rows that share an id but not the text are
    not earlier than each other at the same position. Other columns stay;
    columns named n_words or n_removed are replaced. An empty table gives no rows.
    """
    rows = keyed(df.drop("n_words", "n_removed"), id_col, text_col)
    found = factors_of(rows, text_col, window).drop("__sources", "__source_starts")
    joined = rows.join(found, ["__id", "__tag"], "left").drop("__id", "__tag")
    kept = [c for c in df.columns if c not in ("n_words", "n_removed")]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts, lengths = (batch.column(batch.schema.get_field_index(c)) for c in (text_col, "__starts", "__lengths"))
            out, n_words, n_removed = [], [], []
            for t, s, n in zip(texts.to_pylist(), starts, lengths):
                w = (t or "").encode().split()
                gone = 0
                total = len(w)
                if s.is_valid:
                    edge = np.zeros(total + 1, np.int32)
                    begin, size = np.array(s.values), np.array(n.values)
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + size, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    w = [w[i] for i in np.flatnonzero(stay)]
                    gone = total - len(w)
                out.append(b" ".join(w).decode()), n_words.append(total), n_removed.append(gone)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if c == text_col else batch.column(batch.schema.get_field_index(c)) for c in kept] + [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], [*kept, "n_words", "n_removed"])

    schema = df.select(*kept).schema.add("n_words", "long").add("n_removed", "long")
    return joined.mapInArrow(reduce, schema)
