"""Document fingerprints by invertible Bloom lookup sketches. DataFrame functions only.

A text is a set of paragraph digests: its lines, long ones in pieces that end
where their content says so, so that an insertion moves few of them. A digest
has 40 bits and 24 check bits computed from them. It is added, by xor, to one
cell of each of three parts of the sketch. The cells of two versions are
subtracted (xor again); what they share cancels out, and peeling (a cell whose
check bits are right holds one digest; taking it out frees others) recovers the
digests that differ. That is tried with few cells first; if it stalls, both
sketches are made again four times larger. Sizes are data: one expression is
folded over their array, so the plan is as large for ten sizes as for one.

A fingerprint has as many cells as its own digests need, so that it can be
peeled by itself: two fingerprints alone tell how alike their texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 400
LEAST_PIECE = 160
SIZES = (8, 32, 128, 512, 2048, 8192, 32768, 131072, 524288, 2097152)
#: So many digests a sketch of each size holds and still peels by itself.
HOLDS = (8, 32, 192, 768, 4000, 18000, 72000, 288000, 1150000, 4600000)
QUANTILES = 1000
ROUNDS = 16
BLOCK_ROWS = 4000
BROADCAST_BLOCKS = 100_000
CHECK_BITS, FIELD_BITS = 24, 13
CHECK_MASK = (1 << CHECK_BITS) - 1


def check(k: Column) -> Column:
    return F.xxhash64(F.shiftrightunsigned(k, CHECK_BITS), F.lit(1)).bitwiseAND(F.lit(CHECK_MASK))


def digests(text: Column, piece: int = PIECE, least: int = LEAST_PIECE) -> Column:
    """Distinct digests of the lines of a text.

    A line of more than ``least`` characters is cut after its first sentence
    end, or before its first word with g to k, beyond so many, at the latest
    after ``piece`` characters.
    """
    short, long = f"[^\n]{{0,{least}}}\n", f"[^\n]{{{least},{piece - 1}}}?(?:[.!?] |(?= [g-k]))"
    lines = F.regexp_extract_all(text, F.lit(f"{short}|{long}|[^\n]{{1,{piece}}}+\n?+"), F.lit(0))

    def digest(x: Column) -> Column:
        bits = F.shiftleft(F.shiftrightunsigned(F.xxhash64(x), CHECK_BITS), CHECK_BITS)
        return bits.bitwiseOR(check(bits))

    return F.array_distinct(F.transform(lines, digest))


def shape(size: int) -> Column:
    """A size, and of how many cells a run is: about sqrt(size)."""
    return F.struct(F.lit(size).cast("long").alias("size"), F.lit(1 if size <= 8 else 1 << (size.bit_length() // 2)).cast("long").alias("run"))


def cell(k: Column, part: int, size: Column) -> Column:
    """Each part reads its own bits of the digest, or of a hash of it where they are too few; sizes are powers of two."""
    own = F.when(size <= 1 << FIELD_BITS, F.shiftrightunsigned(k, CHECK_BITS + FIELD_BITS * part)).otherwise(F.xxhash64(k, F.lit(part + 2)))
    return own.bitwiseAND(size - 1)


def build(items: Column, s: Column) -> Column:
    """The cells of the three parts, one after the other, of a sketch of shape ``s``.

    Items are first dealt into the runs of cells, so that a cell looks at the
    items of its run only.
    """
    return F.concat(*(part_cells(items, p, s) for p in range(3)))


def part_cells(items: Column, part: int, s: Column) -> Column:
    zero = F.lit(0).cast("long")
    placed = F.transform(items, lambda k: F.struct(k.alias("k"), cell(k, part, s["size"]).alias("c")))
    xor = lambda own, i: F.aggregate(own, zero, lambda a, x: F.when(x.c == i, a.bitwiseXOR(x.k)).otherwise(a))

    def of_run(all_: Column, r: Column) -> Column:
        first = r * s["run"]
        mine = F.filter(all_, lambda x: x.c.between(first, first + s["run"] - 1))
        cells = lambda own: F.transform(F.sequence(first, first + s["run"] - 1), lambda i: F.when(F.size(own) > 0, xor(own, i)).otherwise(zero))
        return F.element_at(F.transform(F.array(mine), cells), 1)

    one_by_one = lambda all_: F.transform(F.sequence(zero, s["size"] - 1), lambda i: xor(all_, i))
    by_runs = lambda all_: F.flatten(F.transform(F.sequence(zero, F.floor(s["size"] / s["run"]) - 1), lambda r: of_run(all_, r)))
    return F.element_at(F.transform(F.array(placed), lambda all_: F.when(s["run"] == 1, one_by_one(all_)).otherwise(by_runs(all_))), 1)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def peel(cells: Column, shape_: Column) -> Column:
    """How many digests differ, or null where peeling stalls."""
    pure = lambda cs: F.array_distinct(F.filter(cs, lambda k: (k != 0) & (check(k) == k.bitwiseAND(F.lit(CHECK_MASK)))))

    def step(s: Column, _: Column) -> Column:
        def taken(new: Column) -> Column:
            return F.when(F.size(new) == 0, F.struct(s["cells"].alias("cells"), s["found"].alias("found"), F.lit(True).alias("over"))).otherwise(
                F.struct(subtract(s["cells"], build(new, shape_)).alias("cells"), (s["found"] + F.size(new)).alias("found"), F.lit(False).alias("over"))
            )

        return F.when(s["over"], s).otherwise(F.element_at(F.transform(F.array(pure(s["cells"])), taken), 1))

    start = F.struct(cells.alias("cells"), F.lit(0).alias("found"), F.lit(False).alias("over"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.when(F.forall(s["cells"], lambda k: k == 0), s["found"]))


def differing(a: Column, b: Column) -> Column:
    """Digests in one of two sets only: peeled from the sketches, retried larger; counted from the sets beyond the largest."""
    step = lambda d, s: F.when(d.isNotNull(), d).otherwise(peel(subtract(build(a, s), build(b, s)), s))
    tried = F.aggregate(F.array(*map(shape, SIZES)), F.lit(None).cast("int"), step)
    return F.coalesce(tried, F.size(F.array_except(a, b)) + F.size(F.array_except(b, a)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two digest sets from their sizes and what differs; 1 for two empty ones."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.element_at(F.transform(F.array(differing(a, b)), lambda x: (both - x) / (both + x).cast("double")), 1))


def own_cells(items: Column) -> Column:
    """The cells of the smallest size that holds all items."""
    fits = F.filter(F.array(*(F.struct(F.lit(h).alias("holds"), shape(s).alias("shape")) for s, h in zip(SIZES, HOLDS))), lambda x: x.holds >= F.size(items))
    chosen = F.coalesce(F.get(fits, 0)["shape"], shape(SIZES[-1]))
    return F.element_at(F.transform(F.array(chosen), lambda s: build(items, s)), 1)


def text_of(digest_set: Column, cells: Column) -> Column:
    """Fingerprint as text: how many digests, then every cell in hex."""
    return F.lower(F.concat(F.hex(F.size(digest_set).cast("long")), F.lit(":"), F.array_join(F.transform(cells, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def with_next(df: DataFrame, id_col: str, carried: dict[str, Column]) -> DataFrame:
    """``df`` with columns of the next row by descending id; after the last comes the first.

    Ids are cut at quantiles, and between these evenly, into ranges of about
    BLOCK_ROWS rows; the first rows of each range are also guests at the end of
    the range before it, so every row finds its successor within its own range
    and no task sees more than one. Rows that share an id are in one range.
    """
    n = df.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    cuts = min(blocks, QUANTILES)
    own = F.col(id_col).cast("long")
    shares = F.array(*[F.lit(k / cuts) for k in range(cuts, -1, -1)])
    edges = df.agg(F.percentile_approx(own, shares, 10_000), F.min(own)).first()
    tops = sorted(set(edges[0] or [0]), reverse=True)  # the largest id of each part, from the top
    lowest = (tops[-1] if edges[1] is None else edges[1]) - 1  # null ids come last
    each = -(-blocks // len(tops))
    widths = [max(1, -(-(top - low) // each)) for top, low in zip(tops, [*tops[1:], lowest - 1])]
    array = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    rows = df.withColumn("__id", F.coalesce(own, F.lit(lowest))).withColumn("__part", F.greatest(F.size(F.filter(array(tops), lambda x: x >= F.col("__id"))), F.lit(1)))
    inside = F.floor((F.element_at(array(tops), F.col("__part")) - F.col("__id")) / F.element_at(array(widths), F.col("__part")))
    rows = rows.withColumn("__block", F.col("__part") * F.lit(each).cast("long") + F.least(F.greatest(inside, F.lit(0)), F.lit(each - 1))).drop("__part")
    blocks = rows.groupBy("__block").agg(F.max("__id").alias("__id"))
    ring = Window.partitionBy(F.lit("ring")).orderBy("__block")
    last = F.max("__block").over(Window.partitionBy(F.lit("ring")))
    edges = blocks.select("__block", "__id", F.coalesce(F.lag("__block").over(ring), last).alias("__guest"))
    edges = F.broadcast(edges) if n / BLOCK_ROWS <= BROADCAST_BLOCKS else edges
    told = rows.join(edges, ["__block", "__id"], "left").withColumn("__tie", F.xxhash64(*[c for c in df.columns]))
    placed = told.withColumn("__in", F.explode(F.when(F.col("__guest").isNull(), F.array(F.struct(F.col("__block").alias("b"), F.lit(0).alias("g")))).otherwise(F.array(F.struct(F.col("__block").alias("b"), F.lit(0).alias("g")), F.struct(F.col("__guest").alias("b"), F.lit(1).alias("g"))))))
    placed = placed.withColumns({"__b": F.col("__in.b"), "__g": F.col("__in.g")}).drop("__in", "__guest", "__block")
    order = Window.partitionBy("__b").orderBy("__g", F.desc("__id"), "__tie")
    out = placed.withColumns({name: F.lead(c).over(order) for name, c in carried.items()})
    return out.where("__g = 0").drop("__b", "__g", "__id", "__tie")


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited version, and how alike they and the next row's are.

    The edited text is the text with its last third (rounded down) replaced by
    as many characters from the start of the next row's text by descending id,
    or all of them if it has fewer. Columns: ``id_col``, n_chars, edited_text,
    fingerprint, edited_fingerprint, near_edited, near_next.

    near_* is the Jaccard likeness of the digest sets; they are recovered from
    the two fingerprints alone up to 4,600,000 digests a text (above, sets are
    compared). Null texts are empty. Null ids come last; repeated ids keep one order by
    their contents. Other columns are ignored. An empty table gives no rows.
    """
    docs = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    docs = with_next(docs, id_col, {"__next": F.col("__text")})
    third = F.floor(F.length("__text") / 3).cast("int")
    out = docs.withColumn("n_chars", F.length("__text").cast("long"))
    out = out.withColumn("edited_text", F.concat(F.substring("__text", F.lit(1), F.length("__text") - third), F.substring("__next", F.lit(1), third)))
    for name, text in (("a", "__text"), ("e", "edited_text"), ("x", "__next")):
        out = out.withColumn(f"__{name}", digests(F.col(text)))
    near = lambda n: likeness(F.col("__a"), F.col(f"__{n}"))
    told = lambda n: text_of(F.col(f"__{n}"), own_cells(F.col(f"__{n}")))
    return out.select(id_col, "n_chars", "edited_text", told("a").alias("fingerprint"), told("e").alias("edited_fingerprint"), near("e").alias("near_edited"), near("x").alias("near_next"))
