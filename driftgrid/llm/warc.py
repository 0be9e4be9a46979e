"""Dictionary-compressed WARC archives, written and read in parallel.

A Zstandard dictionary is built from a bounded sample of the records. Every
archive starts with the dictionary in a skippable frame and holds each record
as a frame of its own, so any record can be read with the dictionary alone.

Equal payloads are stored once: the row with the smallest id becomes a
``response`` record, the others ``revisit`` records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgrid.llm.common import cut, shared_dir, small_batches

# Magic number of the skippable frame that carries a dictionary, and WARC line ends.
SKIPPABLE = 0x184D2A5D
CRLF = b"\r\n"

SAMPLE_RECORDS = 1000
SAMPLE_CHARS = 16384
DICTIONARY_BYTES = 65536
ARCHIVE_BYTES = 64 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def train_dictionary(df: DataFrame, records: int = SAMPLE_RECORDS, chars: int = SAMPLE_CHARS, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from about ``records`` records of rows (page_id, url, html) drawn by hash, twice as many at most, ``chars`` characters of each payload.

    Zstandard can't train on a few samples: below 50, or 100,000 bytes, the
    records themselves are the dictionary.
    """
    rows = df.count()
    near = F.pmod(F.xxhash64("page_id", "html"), F.lit(max(1, rows))) < records
    some = df.where(F.length("html") > 0).where(near).select("page_id", "url", F.substring("html", 1, chars).alias("html")).limit(2 * records)
    samples = sorted(record("response", r.page_id, r.url, r.html.encode(), r.html.encode(), None) for r in some.collect())
    total = sum(map(len, samples))
    if len(samples) < 50 or total < 100_000:
        return b"".join(samples)[:size]
    return zstandard.train_dictionary(min(size, total // 10), samples, k=512, d=8).as_bytes()


def zdict(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, stored: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. The payload's digest and length are those of the full payload."""
    where = (url or "").replace("\r", "%0D").replace("\n", "%0A") or f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}').urn}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {where}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"Content-Length: {len(stored)}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Bytes: {len(payload)}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}').urn}>",
            f"X-Refers-To: {refers_to}",
        ]
    return CRLF.join(x.encode() for x in head) + CRLF * 2 + stored + CRLF * 2


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = raw.partition(CRLF * 2)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    return fields, body[: int(fields["Content-Length"])]


def with_first(df: DataFrame, id_col: str, payload_col: str, least_bytes: int) -> DataFrame:
    """``df`` with ``__first``: the smallest id that has an equal payload; null where the payload is below ``least_bytes`` or the row itself is that.

    Ids and digests alone are joined on the digest, so a common payload's rows
    are narrow there. Payloads are joined with what was found by id and digest
    and spread evenly, however often one occurs.
    """
    body = F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8")
    keyed = df.withColumn("__key", F.when(F.octet_length(body) >= least_bytes, F.unhex(F.sha2(body, 256))))
    again = keyed.where("__key IS NOT NULL").groupBy("__key").agg(F.min(id_col).alias("__first"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    later = keyed.select(F.col(id_col).alias("__id"), "__key").join(cut(again), "__key").where(~F.col("__id").eqNullSafe(F.col("__first"))).distinct()
    later = later.withColumnRenamed("__key", "__same")
    return keyed.join(later, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__same")), "left").drop("__id", "__same")


def write_archives(df: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> DataFrame:
    """Write every row as a WARC record to ``folder``; returns the manifest: path, records, bytes.

    ``folder`` is a URI of a store that all executors reach. An archive gets its
    final name, which holds the task's attempt, by a rename after it is complete.
    The manifest lists the archives of the attempts that counted; what a lost
    attempt has left is in none.

    A null payload is empty; a null id or URL is written as empty; of repeated
    rows with the smallest id each is a response. An empty table gives no archive.
    Columns other than the three named ones are ignored.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(payload_col).alias("html"))
    raw = train_dictionary(rows)
    rows = with_first(rows, "page_id", "html", least_bytes)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        packer = zstandard.ZstdCompressor(level=level, dict_data=zdict(raw), write_checksum=True)
        part, out, n, size, made = 0, None, 0, 0, []

        def close() -> None:
            nonlocal out, part
            out.close()
            final = f"{base}/part-{task.partitionId():06d}-{part:04d}-{task.taskAttemptId()}.warc.zst"
            fs.move(temp(), final)
            made.append((final, n, size))
            out, part = None, part + 1

        def temp() -> str:
            return f"{base}/.tmp-{task.taskAttemptId()}-{part}"

        for frame in frames:
            for page, url, html, first in zip(frame.page_id, frame.url, frame.html, frame["__first"]):
                if out is None:
                    out, n, size = fs.open_output_stream(temp(), compression=None), 0, 8 + len(raw)
                    out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
                page = None if pd.isna(page) else int(page)
                payload = html.encode() if isinstance(html, str) else b""
                again = not pd.isna(first) and int(first) != page
                frame_bytes = packer.compress(record("revisit" if again else "response", page, url if isinstance(url, str) else None, payload, b"" if again else payload, int(first) if again else None))
                out.write(frame_bytes)
                n, size = n + 1, size + len(frame_bytes)
                if size >= archive_bytes:
                    close()
        if out is not None:
            close()
        yield pd.DataFrame(made, columns=["path", "records", "bytes"])

    return cut(rows.select("page_id", "url", "html", "__first").mapInPandas(write, "path string, records long, bytes long"))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives: page_id, record_type, refers_to, url, payload_bytes, payload_digest, payload.

    The digest and length of a response are computed from the payload read;
    those of a revisit are the ones its record carries.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        names = ["page_id", "record_type", "refers_to", "url", "payload_bytes", "payload_digest", "payload"]
        for frame in frames:
            for path in frame.path:
                rows, held = [], 0
                for fields, body in records(fs, path):
                    kind, page, refers = fields["WARC-Type"], fields["X-Page-Id"], fields.get("X-Refers-To")
                    stored = (len(body), digest(body)) if kind == "response" else (int(fields["X-Payload-Bytes"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"))
                    rows.append((int(page) if page else None, kind, int(refers) if refers else None, fields["WARC-Target-URI"], *stored, body))
                    held += len(body)
                    if held > 8 << 20 or len(rows) >= 10_000:
                        yield typed(pd.DataFrame(rows, columns=names))
                        rows, held = [], 0
                if rows:
                    yield typed(pd.DataFrame(rows, columns=names))

    schema = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary"
    archives = max(1, manifest.count())
    return manifest.select("path").repartition(archives, "path").mapInPandas(read, schema)


def typed(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def records(fs: pafs.FileSystem, path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive, one frame at a time."""
    with fs.open_input_stream(path, compression=None) as f:
        magic, size = struct.unpack("<II", f.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path} doesn't start with a dictionary frame")
        unpacker = zstandard.ZstdDecompressor(dict_data=zdict(f.read(size)))
        held = b""
        one = None
        parts: list[bytes] = []
        while held or (held := f.read(1 << 20)):
            if one is None:
                one, parts = unpacker.decompressobj(), []
            parts.append(one.decompress(held))
            held = b""
            if one.eof:
                held, one = one.unused_data, None
                yield parse(b"".join(parts))


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
