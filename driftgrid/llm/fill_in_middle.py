"""Fill-in-the-middle: a text is cut at two ranks and its parts reordered under markers.

Texts are cut between units (code points, words or lines). Ranks are looked up
in an indexable skip list over the units: every lane links some of the nodes of
the lane below, and each link carries its width in units and in code points.
Going down from the highest lane, widths add up to the rank exactly, and the
code points passed on the way are where to cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.common import mix, small_batches

#: Units, matched left to right; each text is covered by its units. None: single code points.
UNITS = {"code_point": None, "word": re.compile(r"\s*\S+(?:\s+\Z)?|\s+"), "line": re.compile(r"[^\n]*\n|[^\n]+")}
MARKERS = ("<P>", "<S>", "<M>")
LIFT = 4  # one node in so many goes up to the next lane


class SkipList:
    """Nodes 0 to n - 1, the first with the list's head; link k of a lane leads from its k-th node to its next one, or to the end.

    ``lanes`` holds, from the lowest, (width in units, width in code points,
    place in the lane below) of the links. Heights come from a hash of a node's
    number, so equal texts have equal lists.
    """

    def __init__(self, lengths: np.ndarray) -> None:
        node = np.arange(len(lengths))
        units, points, below = np.ones(len(node), np.int64), lengths.astype(np.int64), node
        self.lanes = [(units, points, below)]
        while len(node) > LIFT:
            lane = np.uint64(len(self.lanes)) << np.uint64(56)
            up = mix(node.astype(np.uint64) | lane) % np.uint64(LIFT) == 0
            up[0] = True
            below = np.flatnonzero(up)
            if len(below) == len(node):
                break
            node, units, points = node[below], np.add.reduceat(units, below), np.add.reduceat(points, below)
            self.lanes.append((units, points, below))

    def points_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""
        at = passed = points = 0
        for units, widths, below in reversed(self.lanes):
            while at < len(units) and passed + units[at] <= rank:
                passed += int(units[at])
                points += int(widths[at])
                at += 1
            if passed == rank:
                break
            at = int(below[at])
        return points


def lengths(text: str, unit: str) -> np.ndarray:
    """Code points of every unit."""
    pattern = UNITS[unit]
    return np.ones(len(text), np.int64) if pattern is None else np.fromiter((m.end() - m.start() for m in pattern.finditer(text)), np.int64)


def numbers(doc_id: int | None, seed: int) -> list[int]:
    """The first four groups of eight digits of the SHA-256 of `seed:id`."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(doc_id: int | None, text: str, unit: str, seed: int, kept: int, suffix_first: int, markers: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and of the middle, output)."""
    h1, h2, h3, h4 = numbers(doc_id, seed)
    sizes = lengths(text, unit)
    n = len(sizes)
    if not text or h3 % 100 >= 100 - kept or any(m in text for m in markers):
        return n, "plain", None, None, text
    held = SkipList(sizes)
    i, j = (held.points_before(rank) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    p, s, m = markers
    if h4 % 100 < suffix_first:
        return n, "spm", i, j - i, s + text[j:] + p + text[:i] + m + text[i:j]
    return n, "psm", i, j - i, p + text[:i] + s + text[j:] + m + text[i:j]


def check_markers(markers: tuple[str, ...]) -> None:
    """A marker's first character may stand nowhere else in a marker but at another's start, and none may begin another.

    Then what stands around a marker never makes up another one, so an output
    that is split at markers gives the parts back.
    """
    first = {m[:1] for m in markers}
    if "" in first or any(c in m[1:] for c in first for m in markers) or any(a is not b and a.startswith(b) for a in markers for b in markers):
        raise ValueError("markers must be told apart wherever they stand")


def fill_in_middle(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "code_point", seed: int = 1, plain_percent: int = 10, suffix_first_percent: int = 20, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """One row per row of ``df``: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``form`` is `psm` (prefix marker, prefix, suffix marker, suffix, middle
    marker, middle), `spm` (suffix, prefix, middle, each after its marker) or
    `plain`, the text as it is: empty texts, texts that hold a marker, and
    ``plain_percent`` of the others. ``suffix_first_percent`` of the transformed
    ones are `spm`. Both, and the cuts, follow from the seed and the id alone. Either cut
    may lie at an end, and both at one place: parts may be empty.

    Null texts are empty ones; rows without an id share their cuts' numbers; so
    do repeated rows. Other columns, of any name, are ignored; an empty table
    gives no rows. Texts are read whole, one at a time. Nothing is shuffled.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    check_markers(markers)
    small_batches(df.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, *transform(doc, text.as_py() or "", unit, seed, plain_percent, suffix_first_percent, markers)) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    ddl = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, ddl)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text behind an output of ``fill_in_middle``."""
    p, s, m = markers
    parts = F.split(output, "|".join(re.escape(x) for x in (p, s, m)), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
