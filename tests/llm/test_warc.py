from __future__ import annotations

import base64
import glob
import hashlib
import random
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from driftgrid.llm.warc import SKIPPABLE, parse, read_archives, run_folder, write_archives

SCHEMA = "page_id long, url string, html string, record_type string"


def pages():
    rng = random.Random(0)
    html = lambda: "<html><p>" + " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 999)) for _ in range(300)) + "</p></html>"
    rows = [(i, f"http://h{i % 3}.org/{i}", html(), "x") for i in range(80)]
    rows[10:40] = [(i, u, rows[50][2], "x") for i, u, _, _ in rows[10:40]]
    rows[60] = (60, "http://a.org/\r\nX-Evil: 1", None, None)
    rows[61] = (61, None, "", "x")
    rows[62] = (62, "http://long.org", "é𝒳 " * 200_000, "x")
    rows[63] = (63, "u", "WARC/1.1\r\n\r\nnot a record", "x")
    return [*rows, rows[5], rows[70], (None, "http://none.org", "no id", "x")]


def expected(rows, least=0):
    first = {}
    body = lambda h: (h or "").encode()
    for p, _, h, _ in rows:
        if p is not None and len(body(h)) >= least:
            first[body(h)] = min(first.get(body(h), p), p)
    out = []
    for p, _, h, _ in rows:
        f = first.get(body(h))
        again = f is not None and f != p and len(body(h)) >= least
        out.append((p, len(body(h)), base64.b32encode(hashlib.sha1(body(h)).digest()).decode(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("least", "size"), [(0, 1 << 16), (5, 64 << 20)])
def test_round_trip(spark, least, size):
    rows = pages()
    folder = run_folder(spark, "warc")
    manifest = write_archives(spark.createDataFrame(rows, SCHEMA), folder, least_bytes=least, archive_bytes=size)
    got = read_archives(manifest, folder)
    assert sorted(map(tuple, got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == expected(rows, least)
    texts = {r.page_id: bytes(r.payload).decode() for r in got.where("record_type = 'response'").collect()}
    assert texts[62] == rows[62][2] and texts[63] == rows[63][2] and texts[0] == rows[0][2]
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)


def test_any_record_opens_with_the_dictionary_alone(spark):
    folder = run_folder(spark, "warc")
    write_archives(spark.createDataFrame(pages(), SCHEMA), folder).collect()
    path = sorted(glob.glob(folder.removeprefix("file://") + "/part-*.warc.zst"))[0]
    raw = open(path, "rb").read()
    magic, n = struct.unpack("<II", raw[:8])
    assert magic == SKIPPABLE
    d = zstandard.ZstdCompressionDict(raw[8 : 8 + n])
    frames, rest = [], raw[8 + n :]
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=d).decompressobj()
        frames.append(one.decompress(rest))
        rest = one.unused_data
    assert all(f.startswith(b"WARC/1.1\r\n") for f in frames)
    fields, body = parse(frames[0])
    assert int(fields["Content-Length"]) == len(body)
    assert not glob.glob(folder.removeprefix("file://") + "/.tmp*")


def test_empty(spark):
    folder = run_folder(spark, "warc")
    assert read_archives(write_archives(spark.createDataFrame([], SCHEMA), folder), folder).count() == 0
