"""Packing of token sequences by reciprocal-capacity (harmonic) classes.

A document shorter than a sequence is of class k = capacity // length: its
length lies in (capacity / (k + 1), capacity / k], and k documents of one class
go whole into one sequence, whatever they are. What such a sequence lacks is
cut from longer documents, which are cut into whole sequences anyway, or from
the next document where no cut one is at hand. Every worker fills sequences by
itself; the fewer than k documents that it has left of each class are laid end
to end, and its last sequence is cut into powers of two, so nothing is padded.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftgrid.llm.common import small_batches

WORKER_BITS = 32  # the worker's number stands above its sequences' numbers
CHUNK_ROWS = 2_000  # pieces of a batch

# Fixed value: how byte-level BPE splits text into words.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space that is too long for tiktoken's matcher.
LONG_SPACE = re.compile(r"\s{1000}")


def bytes_of_characters() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of texts by a byte-level BPE file, as little-endian uint32 bytes.

    Where the file's merges come in the order of their ids, tiktoken encodes by
    the same vocabulary, several times faster than tokenizers; else, and for
    texts with very long white space, tokenizers does. A special token's string
    in a text becomes that token's id, as tokenizers encode it; with
    ``special_as_text`` it is ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        self.path, self.slow, self.special_as_text = path, None, special_as_text
        self.added: re.Pattern | None = None
        self.fast = self.by_rank(path)

    def by_rank(self, path: str) -> tiktoken.Encoding | None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if model.get("type") != "BPE" or not plain or spec.get("normalizer"):
            return None
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if made != sorted(made):
            return None
        of = bytes_of_characters()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        if special and not self.special_as_text:
            self.added = re.compile("|".join(map(re.escape, special)))
        ranks = {bytes(of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("vocabulary", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast and not LONG_SPACE.search(text) and not (self.added and self.added.search(text)):
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        if self.slow is None:
            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = self.special_as_text
        return array("I", self.slow.encode(text, add_special_tokens=False).ids).tobytes()


class Filler:
    """Fills the sequences of each class. A piece is (document, start, tokens of the document, ids); full sequences leave."""

    def __init__(self, capacity: int, base: int) -> None:
        self.capacity, self.next = capacity, base
        self.held: dict[int, list[tuple]] = {}  # documents of each class, fewer than its number
        self.lacking: deque[list[tuple]] = deque()  # sequences of a class that lack tokens
        self.lack = 0

    def leave(self, pieces: list[tuple]) -> Iterator[tuple]:
        """Rows (document, start, length, tokens of the document, ids, sequence, offset)."""
        at = 0
        for doc, start, total, raw in pieces:
            yield doc, start, len(raw) // 4, total, raw, self.next, at
            at += len(raw) // 4
        self.next += 1

    def keep(self, piece: tuple) -> Iterator[tuple]:
        """A piece below the capacity waits with its class; a full class becomes a sequence."""
        k = self.capacity // length(piece)
        held = self.held.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            self.held[k] = []
            lack = self.capacity - sum(map(length, held))
            if lack:
                self.lacking.append(held)
                self.lack += lack
            else:
                yield from self.leave(held)

    def cut(self, piece: tuple) -> Iterator[tuple]:
        """A piece is cut to what sequences lack, then into whole sequences; the rest waits with its class."""
        queue = deque([piece])
        while self.lacking and queue:
            held = self.lacking[0]
            lack = self.capacity - sum(map(length, held))
            took = take(queue, lack)
            held += took
            self.lack -= sum(map(length, took))
            if sum(map(length, held)) == self.capacity:
                yield from self.leave(self.lacking.popleft())
        while queue and length(queue[0]) >= self.capacity:
            yield from self.leave(take(queue, self.capacity))
        if queue:
            yield from self.keep(queue.popleft())

    def add(self, doc: int | None, raw: bytes) -> Iterator[tuple]:
        """A document at least as long as a sequence is cut; so is the next one where a whole sequence is lacking."""
        piece = (doc, 0, len(raw) // 4, raw)
        yield from self.cut(piece) if length(piece) >= self.capacity or self.lack >= self.capacity else self.keep(piece)

    def finish(self) -> Iterator[tuple]:
        """What is left goes end to end; the last sequence's tokens become sequences of powers of two."""
        queue = deque(p for held in [*self.lacking, *(self.held[k] for k in sorted(self.held))] for p in held)
        total = sum(map(length, queue))
        bits = range(self.capacity.bit_length() - 2, -1, -1)
        for size in [self.capacity] * (total // self.capacity) + [1 << b for b in bits if total % self.capacity >> b & 1]:
            yield from self.leave(take(queue, size))
        self.__init__(self.capacity, self.next)


def length(piece: tuple) -> int:
    return len(piece[3]) // 4


def take(queue: deque[tuple], size: int) -> list[tuple]:
    """Pieces of ``size`` tokens from the front of the queue, or all; the last is cut."""
    out = []
    while queue and size:
        doc, start, total, raw = queue.popleft()
        part, rest = raw[: 4 * size], raw[4 * size :]
        out.append((doc, start, total, part))
        size -= len(part) // 4
        if rest:
            queue.appendleft((doc, start + len(part) // 4, total, rest))
    return out


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, with_ids: bool = True, special_as_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, and ``ids`` or ``ids_crc32``.

    start and offset count tokens of the document and of the sequence; ``ids``
    are little-endian uint32 bytes. A document is its token ids, then ``end_id``;
    a null or empty text is that id alone. A sequence has ``capacity`` tokens,
    or, at the end of a worker's share, a smaller power of two, so no padding is
    needed. A special token's string in a text becomes that token's id; with
    ``special_as_text`` it is encoded as ordinary text.

    Repeated rows are packed each; a null id stays null; other columns, of any
    name, are ignored; an empty table gives no rows. ``capacity`` must be a
    power of two. Nothing is shuffled; a worker holds fewer tokens than two
    sequences for each class that it has met, and one text.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    small_batches(docs.sparkSession)
    what = pa.field("ids", pa.binary()) if with_ids else pa.field("ids_crc32", pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), what, ("sequence_id", pa.int64()), ("offset", pa.int64())])
    ddl = f"doc_id long, start long, length long, doc_tokens long, {'ids binary' if with_ids else 'ids_crc32 long'}, sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = Encoder(tokenizer_path, special_as_text), array("I", [end_id]).tobytes()
        filler = Filler(capacity, TaskContext.get().partitionId() << WORKER_BITS)

        def pieces() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in zip(batch.column(0), batch.column(1)):
                    yield from filler.add(doc.as_py(), enc.encode(text.as_py() or "") + tail)
            yield from filler.finish()

        rows: list[tuple] = []
        for doc, start, n, total, raw, seq, at in pieces():
            rows.append((doc, start, n, total, raw if with_ids else zlib.crc32(raw), seq, at))
            if len(rows) == CHUNK_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ddl)
