"""Near-duplicate join on word n-grams: a MinHash LSH forest, then exact verification.

A document is the set of its word n-grams. Documents with equal sets are one
class and go on as one node. A node has a signature of eight min-hash bytes in
each of ``trees`` trees. Sorting a tree's signatures makes it a prefix trie: a
trie node is a run of signatures with a common prefix, and signatures without a
neighbour that shares the shortest prefix in question leave at once.

Prefixes start at their full length. Pairs below one trie node are verified
exactly on the whole sets, each pair in one tree and at one depth only. From
the similarities of the links found follows how many links prefixes of this
length have missed; prefixes are shortened byte by byte until the share found
reaches ``recall``. At the latest that is so where a pair at the threshold
itself is found with that chance.

Near copies are sent as what tells them from one of them: a family is a trie
node of the full length, its base one member's set, and each member is held as
the symmetric difference from it. The size of an intersection follows exactly
from those of two sets and of their differences' intersection, so what is sent
for a family grows with its edits, not with its texts.

No pair is ever a row. The sets below a trie node are dealt into tiles of
bounded size, so that one of any size spreads over many tasks, and only counts
and a spanning forest of the verified links leave a pair of tiles.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.llm.common import Words, cut, mix, ngrams, small_batches, words
from driftgrid.llm.components import components

TREES = 24
DEPTH = 8  # bytes of a signature; it is sorted as one number
RECALL = 0.999
TILE = 4096
SQUARE = 1024  # rows of a block of pairs that is checked at a time
FAMILY = 8  # members that make near copies a family
BASES_BYTES = 32 << 20
TILE_BYTES = 8 << 20
BATCH_BYTES = 2 << 20  # sets below small trie nodes that one group holds
COLUMNS = 8192
BINS = 50


def found_share(similarity: np.ndarray | float, trees: int, depth: int) -> np.ndarray | float:
    """The chance that a pair shares a prefix of ``depth`` bytes in one of the trees; unequal minima share a byte once in 256."""
    return 1 - (1 - (similarity + (1 - similarity) / 256) ** depth) ** trees


def shortest(similarity: float, trees: int, recall: float) -> int:
    """The longest prefix that finds a pair at ``similarity`` itself with the chance ``recall``."""
    return next((d for d in range(DEPTH, 1, -1) if found_share(similarity, trees, d) >= recall), 1)


def estimated_recall(found: np.ndarray, similarity: float, trees: int, depth: int) -> float:
    """Share of all links found by prefixes of ``depth`` bytes, from the numbers of links found in BINS steps of similarity."""
    lower = similarity + (1 - similarity) * np.arange(BINS) / BINS
    return float(found.sum() / (found / found_share(lower, trees, depth)).sum()) if found.sum() else 0.0


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first of each document) of the distinct n-grams; a shorter text is one gram of all its words."""
    out, first = [], [0]
    h = ngrams(w.hash, n)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= n:
            one = np.unique(h[a : b - n + 1])
        else:
            one = ngrams(w.hash[a:b], b - a) if b > a else h[:0]
        out.append(one)
        first.append(first[-1] + len(one))
    return np.concatenate(out) if out else h[:0], np.array(first)


def set_keys(x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every document's set."""
    total = lambda v: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)])[first])
    return total(x).view(np.int64), total(mix(x + np.uint64(1))).view(np.int64)


def signatures(x: np.ndarray, first: np.ndarray, trees: int, seed: int = 3) -> np.ndarray:
    """A number for every (non-empty) document and tree: DEPTH min-hash bytes, the first the highest."""
    rng = np.random.default_rng(seed)
    low = (x >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(first) - 1, trees), np.uint64)
    for t in range(trees):
        for _ in range(DEPTH):
            a, b = (np.uint32(v) for v in rng.integers(0, 1 << 32, 2))
            least = np.minimum.reduceat(low * (a | np.uint32(1)) + b, first[:-1])
            byte = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
            out[:, t] = (out[:, t] << np.uint64(8)) | byte.astype(np.uint64)
    return out.view(np.int64)


def bucketed(batches: Iterator[pa.RecordBatch], floor: int) -> Iterator[pa.RecordBatch]:
    """Of rows (node, size, tree, sig) sorted by tree and sig those with a neighbour that shares ``floor`` bytes; a partition's ends stay."""
    shift = np.uint64(8 * (DEPTH - floor))
    last: tuple | None = None  # prefix of the last row
    held: pa.RecordBatch | None = None  # the last row, while it has no such neighbour
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, sig = batch.column(2).to_numpy(), batch.column(3).to_numpy().view(np.uint64) >> shift
        like = np.zeros(batch.num_rows + 1, bool)  # whether a row is like the one before
        like[1:-1] = (tree[1:] == tree[:-1]) & (sig[1:] == sig[:-1])
        like[0] = last is None or last == (tree[0], sig[0])
        if held is not None and (like[0] or last is None):
            yield held
        keep = like[:-1] | like[1:]
        keep[-1] = like[-2]
        yield batch.filter(pa.array(keep))
        last = (tree[-1], sig[-1])
        held = None if keep[-1] else batch.slice(batch.num_rows - 1, 1)
    if held is not None:
        yield held


def fresh(sig: np.ndarray, kept: np.ndarray, tree: int, depth: int) -> np.ndarray:
    """Pairs whose place is this trie node: no earlier tree keeps one for both, and no tree has them together one byte deeper."""
    m, trees = sig.shape
    new = np.ones((m, m), bool)
    at = sig.view(np.uint64) >> np.uint64(8 * (DEPTH - depth))
    for t in range(tree):
        held = (kept >> t & 1).astype(bool)
        if held.any():
            new &= ~((at[:, t, None] == at[None, :, t]) & held[:, None])
    if depth < DEPTH:
        at = sig.view(np.uint64) >> np.uint64(8 * (DEPTH - depth - 1))
        for t in range(trees):
            new &= at[:, t, None] != at[None, :, t]
    return new


def differences(sets: list[np.ndarray], base: list[int | None], bases: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Differences from each row's own base as differences from the base that most rows have; no base is the empty set."""
    main = max(dict.fromkeys(base), key=base.count)
    from_main = {}
    for b in dict.fromkeys(base):
        if b != main:
            mine, its = (bases[k] if k is not None else np.zeros(0, np.uint64) for k in (b, main))
            from_main[b] = np.setxor1d(mine, its, assume_unique=True)
    return [s if b == main else np.setxor1d(s, from_main[b], assume_unique=True) for s, b in zip(sets, base)]


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two sets, in blocks of COLUMNS grams that occur more than once."""
    m, size = len(sets), [len(s) for s in sets]
    x, doc = np.concatenate(sets), np.repeat(np.arange(m), size)
    order = np.argsort(x)
    x, doc = x[order], doc[order]
    code = np.cumsum(np.append(True, x[1:] != x[:-1])[: len(x)]) - 1
    shared = np.bincount(code, minlength=1)[code] > 1
    code, doc = code[shared], doc[shared]
    code = np.cumsum(np.append(True, code[1:] != code[:-1])) - 1 if len(code) else code
    both = np.zeros((m, m), np.int32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        a, b = np.searchsorted(code, [at, at + COLUMNS])
        block = np.zeros((m, min(COLUMNS, int(code[-1]) + 1 - at)), np.float32)
        block[doc[a:b], code[a:b] - at] = 1
        both += (block @ block.T).astype(np.int32)  # a block's counts are exact in float32
    return both


def verify(new: np.ndarray, ids: np.ndarray, weights: np.ndarray, size: np.ndarray, sets: list[np.ndarray], similarity: Fraction) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """(summed weights of each row's links, spanning forest of the links, links by similarity) among the pairs of ``new``.

    ``sets`` are differences from one base, ``size`` the sizes of the sets
    themselves: what two sets share is half of what their sizes exceed the size
    of the difference between them, which is that of their two differences.
    """
    m = len(ids)
    p, q = similarity.numerator, similarity.denominator
    new = new & (np.minimum(size[:, None], size[None, :]) * q >= np.maximum(size[:, None], size[None, :]) * p)
    none = np.zeros(BINS, np.int64)
    if not new.any():
        return np.zeros(m, np.int64), [], none
    apart = np.array([len(s) for s in sets])
    if m == 2:
        met = np.full((2, 2), len(np.intersect1d(sets[0], sets[1], assume_unique=True)), np.int64)
    else:
        met = shared_counts(sets).astype(np.int64)
    total = size[:, None] + size[None, :]
    both = (total - (apart[:, None] + apart[None, :] - 2 * met)) // 2
    link = new & (both * (p + q) >= p * total)
    i, j = np.nonzero(np.triu(link))
    like = both[i, j] / (total[i, j] - both[i, j])
    step = np.clip(((like - p / q) / (1 - p / q) * BINS).astype(int), 0, BINS - 1) if p < q else np.zeros(len(i), int)
    forest, seen = [], np.zeros(m, bool)
    for root in np.flatnonzero(link.any(1)):
        if not seen[root]:
            seen[root] = True
            todo = [root]
            while todo:
                k = todo.pop()
                more = np.flatnonzero(link[k] & ~seen)
                seen[more] = True
                todo.extend(more.tolist())
                forest.extend((int(ids[k]), int(ids[n])) for n in more)
    return link @ weights, forest, np.bincount(step, minlength=BINS)


def spanning(edges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The edges that join two parts for the first time."""
    top: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := top.setdefault(x, x)) != x:
            top[x] = top[y]
            x = y
        return x

    out = []
    for a, b in edges:
        if (ra := root(a)) != (rb := root(b)):
            top[rb] = ra
            out.append((a, b))
    return out


def prefix(depth: int) -> Column:
    return F.shiftrightunsigned("sig", 8 * (DEPTH - depth))


def trie_nodes(forest: DataFrame, depth: int, tile: int) -> DataFrame:
    """tree, prefix, tiles, bytes of the trie nodes at ``depth`` that hold pairs of their own; of those with the same members the first."""
    deeper = prefix(min(depth + 1, DEPTH))
    own = F.lit(True) if depth == DEPTH else F.col("lo") != F.col("hi")
    members = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"m{k}") for k in range(2)]
    based = forest.groupBy("tree", prefix(depth).alias("prefix"), "base").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("base_bytes").alias("base_bytes"), F.min(deeper).alias("lo"), F.max(deeper).alias("hi"), *members)
    whole = [F.bit_xor(m).alias(m) for m in ("m0", "m1")]
    each = based.groupBy("tree", "prefix").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.sum("base_bytes").alias("base_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), *whole).where("n > 1").where(own)
    one = each.groupBy("n", "m0", "m1").agg(F.min(F.struct("tree", "prefix")).alias("at"), F.first("bytes").alias("bytes"), F.first("base_bytes").alias("base_bytes"))
    tiles = F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int")
    return cut(one.select("at.tree", "at.prefix", tiles.alias("tiles"), (F.col("bytes") * tiles + F.col("base_bytes")).alias("bytes")))


def squares(own: np.ndarray, within: bool, square: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Rows of a node in blocks: (block, None) for the pairs within one, (block, block) for those between two."""
    sides = [np.arange(len(own))] if within else [np.flatnonzero(own == own.min()), np.flatnonzero(own != own.min())]
    blocks = [[rows[i : i + square] for i in range(0, len(rows), square)] for rows in sides]
    if within:
        for k, a in enumerate(blocks[0]):
            yield a, None
            yield from ((a, b) for b in blocks[0][k + 1 :])
    else:
        yield from ((a, b) for a in blocks[0] for b in blocks[1])


def links_at(forest: DataFrame, sets: DataFrame, bases: DataFrame, depth: int, exact: Fraction, tile: int, square: int = SQUARE) -> DataFrame:
    """Verified links of the pairs that share ``depth`` bytes and no more: rows (a, links), (a, b) of a spanning forest, and (bin, n)."""
    small_batches(forest.sparkSession)
    nodes = trie_nodes(forest, depth, tile)
    tasks = max(1, (nodes.agg(F.sum("bytes")).first()[0] or 0) // BATCH_BYTES)
    held = cut(forest.withColumn("prefix", prefix(depth)).join(nodes.drop("bytes"), ["tree", "prefix"]).select("node", "tree", "prefix", "tiles", "base"))
    kept = held.groupBy("node").agg(F.bit_or(F.expr("shiftleft(1L, tree)")).alias("kept"))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    placed = held.join(kept, "node").withColumn("own", own).withColumn("other", other)
    bucket = F.xxhash64("tree", "prefix")
    task = ["task", "lo", "hi", "large"]
    placed = placed.select("node", "tree", "prefix", "own", "kept", "base", F.when(F.col("tiles") == 1, F.pmod(bucket, F.lit(tasks))).otherwise(bucket).alias("task"), F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("tiles") > 1).alias("large"))
    needed = placed.where("base IS NOT NULL").select("base", *task).distinct().join(bases, "base").select(*task, F.col("base").alias("node"), F.col("grams"))
    rows = placed.join(sets.drop("base"), "node").unionByName(needed, allowMissingColumns=True)  # a base has no copies

    def check(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own_rows = frame.copies.notna()
        bases_ = {int(n): np.frombuffer(g, np.uint64) for n, g in zip(frame.node[~own_rows], frame.grams[~own_rows])}
        frame = frame[own_rows].drop_duplicates(["tree", "prefix", "node"]).sort_values(["tree", "prefix", "node"])
        tree, place = frame.tree.to_numpy(np.int64), frame.prefix.to_numpy(np.int64)
        edges = np.flatnonzero(np.append(True, (tree[1:] != tree[:-1]) | (place[1:] != place[:-1]))).tolist() + [len(tree)]
        ids, copies, own, kept_, size = (frame[c].to_numpy(np.int64) for c in ("node", "copies", "own", "kept", "size"))
        raw, sig, base = frame.grams.tolist(), frame.sigs.tolist(), [None if pd.isna(b) else int(b) for b in frame.base]
        linked, tied, counted = np.zeros(len(ids), np.int64), [], np.zeros(BINS, np.int64)
        for i, j in zip(edges, edges[1:]):
            if j - i < 2 or (key[1] != key[2] and (own[i:j] == own[i]).all()):
                continue
            sets_, sigs, within = None, np.array(sig[i:j], np.int64), key[1] == key[2]
            for some, others in squares(own[i:j], within, square):
                rows_ = some if others is None else np.concatenate([some, others])
                side = np.arange(len(rows_)) < len(some)
                new = fresh(sigs[rows_], kept_[i:j][rows_], int(tree[i]), depth) & ~np.eye(len(rows_), dtype=bool)
                new &= True if others is None else side[:, None] != side[None, :]
                if not new.any():
                    continue
                sets_ = sets_ or differences([np.frombuffer(g, np.uint64) for g in raw[i:j]], base[i:j], bases_)
                n, forest_, by = verify(new, ids[i:j][rows_], copies[i:j][rows_], size[i:j][rows_], [sets_[k] for k in rows_], exact)
                linked[i + rows_] += n
                tied += forest_
                counted += by
        hit, some, tied = np.flatnonzero(linked), np.flatnonzero(counted), spanning(tied)
        a, b = ids[hit].tolist() + [x for x, _ in tied], [None] * len(hit) + [y for _, y in tied]
        links = linked[hit].tolist() + [0] * len(tied)
        told = {"a": a + [None] * len(some), "b": b + [None] * len(some), "links": links + counted[some].tolist(), "bin": [None] * len(a) + some.tolist()}
        return pd.DataFrame({k: pd.array(v, "Int64") for k, v in told.items()})

    return cut(rows.groupBy(*task).applyInPandas(check, "a long, b long, links long, bin long"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, n: int = 5, similarity: float = 0.8, recall: float = RECALL, trees: int = TREES, tile: int = TILE) -> DataFrame:
    """One row per document: ``id_col``, class_id (smallest id of its class), n_links (documents whose similarity reaches the threshold).

    Links join documents whose n-gram sets have a Jaccard similarity of
    ``similarity`` or more; classes are what links connect. Texts with fewer
    than n words are one gram of all their words. Null and empty texts have no
    grams and link to nothing. Rows without an id are left out; repeated rows
    count as documents; an empty table gives no rows; other columns are ignored.
    Grams are compared by 64-bit hashes, sets by 128 bits.
    """
    small_batches(df.sparkSession)
    exact = Fraction(similarity).limit_denominator(1000)
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, w in words(batch.column(1)):
                x, first = grams(w, n)
                size = np.diff(first)
                s1, s2 = set_keys(x, first)
                full = np.flatnonzero(size)
                sig = signatures(x, np.append(first[:-1][full], len(x)), trees) if len(full) else np.zeros((0, trees), np.int64)
                at = np.zeros(j - i + 1, np.int32)
                at[1:] = np.cumsum(size > 0) * trees
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s1), pa.array(s2), pa.array(size.astype(np.int32)), pa.ListArray.from_arrays(pa.array(at), pa.array(sig.reshape(-1)))], ["id", "s1", "s2", "size", "sigs"])

    signed = cut(docs.mapInArrow(sign, "id long, s1 long, s2 long, size int, sigs array<long>"))
    full = signed.where("size > 0")
    nodes = full.groupBy("s1", "s2", "size").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("sigs").alias("sigs"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))

    floor = shortest(similarity, trees, recall)
    every = nodes.select("node", F.col("size").cast("long").alias("size"), F.posexplode("sigs").alias("tree", "sig"))
    every = every.repartitionByRange("tree", "sig", "node").sortWithinPartitions("tree", "sig")
    forest = cut(every.mapInArrow(lambda b: bucketed(b, floor), "node long, size long, tree int, sig long"))
    some = forest.groupBy("tree", prefix(floor).alias("prefix")).count().where("count > 1")
    forest = cut(forest.withColumn("prefix", prefix(floor)).join(cut(some.select("tree", "prefix")), ["tree", "prefix"], "left_semi").drop("prefix"))

    held = ["node", "copies", "sigs", "size", "base"]

    def reshingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c: batch.column(batch.schema.get_field_index(c))
            bases_ = {k: v.as_py() for k, v in dict(zip(col("base").to_pylist(), col("of_base"))).items()}
            for i, j, w in words(col("text")):
                x, first = grams(w, n)
                s1, s2 = set_keys(x, first)
                same = np.flatnonzero((col("s1").slice(i, j - i).to_numpy() == s1) & (col("s2").slice(i, j - i).to_numpy() == s2))
                if len(same):
                    raw = []
                    for k, b in zip(same, col("base").slice(i, j - i).take(pa.array(same)).to_pylist()):
                        one = x[first[k] : first[k + 1]]
                        raw.append((one if bases_[b] is None else np.setxor1d(one, np.frombuffer(bases_[b], np.uint64), assume_unique=True)).tobytes())
                    yield pa.RecordBatch.from_arrays([*(col(c).slice(i, j - i).take(pa.array(same)) for c in held), pa.array(raw, pa.binary())], [*held, "grams"])

    def shingled(member: DataFrame) -> DataFrame:
        return cut(docs.join(member, "id").select("text", "s1", "s2", *held, "of_base").mapInArrow(reshingle, "node long, copies long, sigs array<long>, size int, base long, grams binary"))

    families = forest.groupBy("tree", "sig").agg(F.count("*").alias("n"), F.min("node").alias("base")).where(F.col("n") >= FAMILY)
    largest = forest.join(cut(families), ["tree", "sig"]).groupBy("node").agg(F.max(F.struct("n", "tree", "sig", "base")).alias("f"))
    member = nodes.join(forest.select("node").distinct(), "node", "left_semi").join(largest.select("node", "f.base"), "node", "left")
    member = cut(member.select("id", "s1", "s2", *held))
    of_base = F.lit(None).cast("binary").alias("of_base")
    sources = member.join(member.where("base IS NOT NULL").select(F.col("base").alias("node")).distinct(), "node", "left_semi")
    bases = shingled(sources.withColumns({"base": F.lit(None).cast("long"), "of_base": of_base})).select(F.col("node").alias("base"), "grams").dropDuplicates(["base"])
    few = (bases.agg(F.sum(F.octet_length("grams"))).first()[0] or 0) <= BASES_BYTES
    known = bases.withColumnRenamed("grams", "of_base")
    sets = shingled(member.join(F.broadcast(known) if few else known, "base", "left"))
    bytes_ = sets.select("node", "base", F.octet_length("grams").cast("long").alias("bytes")).dropDuplicates(["node"]).join(bases.select("base", F.octet_length("grams").cast("long").alias("base_bytes")), "base", "left")
    forest = cut(forest.select("node", "tree", "sig").join(bytes_, "node").withColumn("base_bytes", F.coalesce("base_bytes", F.lit(0).cast("long"))))

    checked, found = [], np.zeros(BINS, np.int64)
    for depth in range(DEPTH, floor - 1, -1):
        checked.append(links_at(forest, sets, bases, depth, exact, tile))
        for r in checked[-1].where("bin IS NOT NULL").groupBy("bin").agg(F.sum("links").alias("n")).collect():  # BINS rows
            found[r.bin] += r.n
        if estimated_recall(found, float(exact), trees, depth) >= recall:
            break
    links = reduce(DataFrame.unionByName, checked).where("a IS NOT NULL")
    counts = links.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    linked = components(links.where("b IS NOT NULL"))
    named = linked.join(nodes.select("node", "id"), "node")
    least = named.groupBy("component").agg(F.min("id").alias("class_id"))
    told = nodes.select("node", "s1", "s2", "size", "copies", "id").join(linked.join(cut(least), "component").select("node", "class_id"), "node", "left").join(counts, "node", "left")
    told = told.select("s1", "s2", "size", F.coalesce("class_id", "id").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = full.select("id", "s1", "s2", "size").join(told, ["s1", "s2", "size"]).select("id", "class_id", "n_links")
    none = signed.where("size = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.unionByName(none).withColumnRenamed("id", id_col)


def keep_one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings: object) -> DataFrame:
    """The rows of ``df`` without the near duplicates: of each class the smallest id stays.

    Rows without an id stay. Rows that share an id and its fate stay together.
    """
    gone = near_duplicates(df, id_col, text_col, **settings).where(F.col("class_id") != F.col(id_col)).select(F.col(id_col)).distinct()
    return df.join(gone, id_col, "left_anti").select(*df.columns)
