"""Grid-to-grid joins: nearest, inverse-distance and bilinear, as reusable weight tables.

A weight table (target cell, source cell, weight) is made once per pair of grids
and joined to any number of time steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from driftgrid.operators.fields import with_grid
from driftgrid.session import cut

TINY = 1e-10
MOST_BINS = 10_000  # along an axis


def _placed(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col("cell_id").alias(name), "lat", "lon")


def _extent(df: DataFrame) -> Row:
    return df.agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"), F.count("*").alias("n")).first()


def nearest_weights(target: DataFrame, source: DataFrame, *, k: int = 1, bin_degrees: float | None = None) -> DataFrame:
    """target_id, source_id, weight, distance, rank of the k nearest sources in (lat, lon) degrees; ties to the smaller source.

    Both sides are binned, by default so that a bin has about two to k sources;
    a target looks at the bins around its own. A result is certain once the k-th
    distance is within the rings looked at, where sources lie beyond them; the
    other targets look again, at eight times as many rings. So every target has
    its k nearest, or all sources if there are fewer. Each round is computed
    once. Weights are 1 / (distance + 1e-10), normalised.
    """
    s, t = _placed(source, "source_id"), _placed(target, "target_id")
    here, there = _extent(s), _extent(t)
    if not here.n or not there.n:
        return t.join(s.withColumnsRenamed({"lat": "slat", "lon": "slon"})).where("false").select("target_id", "source_id", F.lit(0.0).alias("weight"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
    wide, high = here.east - here.west, here.north - here.south
    area = max(wide, high / here.n, 1e-9) * max(high, wide / here.n, 1e-9)
    whole = max(max(here.east, there.east) - min(here.west, there.west), max(here.north, there.north) - min(here.south, there.south))
    size = bin_degrees or max(math.sqrt(area * max(k, 2) / here.n), whole / MOST_BINS) or 1.0
    bin_of = lambda x: math.floor(x / size)
    i0, i1, j0, j1 = bin_of(here.south), bin_of(here.north), bin_of(here.west), bin_of(here.east)
    reach = max(1, i1 - bin_of(there.south), bin_of(there.north) - i0, j1 - bin_of(there.west), bin_of(there.east) - j0)
    binned = lambda df, i, j: df.withColumns({i: F.floor(F.col("lat") / size).cast("int"), j: F.floor(F.col("lon") / size).cast("int")})
    s = binned(s, "bi", "bj").withColumnsRenamed({"lat": "slat", "lon": "slon"})
    left, done, rings = binned(t, "ti", "tj"), None, 1
    by = Window.partitionBy("target_id")

    def around(b: str, low: int, high: int) -> Column:
        first, last = F.greatest(F.col(b) - rings, F.lit(low)), F.least(F.col(b) + rings, F.lit(high))
        return F.explode(F.when(first <= last, F.sequence(first, last)))

    def sides(x: str, b: str, low: int, high: int) -> list[Column]:
        """Distances to the edges of the rings; an edge that no source lies beyond is far away."""
        far = F.lit(float("inf"))
        down = F.when(F.col(b) - rings <= low, far).otherwise(F.col(x) - (F.col(b) - rings) * size)
        up = F.when(F.col(b) + rings >= high, far).otherwise((F.col(b) + rings + 1) * size - F.col(x))
        return [down, up]

    while True:
        near = left.withColumn("bi", around("ti", i0, i1)).withColumn("bj", around("tj", j0, j1))
        met = near.join(s, ["bi", "bj"]).withColumn("distance", F.sqrt(F.pow(F.col("lat") - F.col("slat"), 2) + F.pow(F.col("lon") - F.col("slon"), 2)))
        best = met.withColumn("rank", F.row_number().over(by.orderBy("distance", "source_id"))).where(F.col("rank") <= k)
        w = 1 / (F.col("distance") + TINY)
        within = F.max("distance").over(by) <= F.least(*sides("lat", "ti", i0, i1), *sides("lon", "tj", j0, j1))
        sure = F.lit(True) if rings >= reach else ((F.count("*").over(by) == k) & within) | (F.least(*sides("lat", "ti", i0, i1), *sides("lon", "tj", j0, j1)) == float("inf"))
        best = cut(best.withColumns({"weight": w / F.sum(w).over(by), "__sure": sure}).select("target_id", "source_id", "weight", "distance", "rank", "__sure"))
        certain = best.where("__sure").drop("__sure")
        done = certain if done is None else done.unionByName(certain)
        if rings >= reach:
            return done
        left = cut(left.join(certain.where("rank = 1").select("target_id"), "target_id", "left_anti"))
        if left.isEmpty():
            return done
        rings = min(rings * 8, reach)


def bilinear_weights(target: DataFrame, source: DataFrame) -> DataFrame:
    """target_id, source_id, weight over the four corners of the rectilinear source cell around each target; targets outside have none.

    The sorted axes come from the distinct latitudes and longitudes of the
    source; a target finds its interval on each axis by a search in the axis
    array, which is one row. A source far from the product of its axes raises.
    """
    rows, lats, lons = source.agg(F.count("*"), F.approx_count_distinct("lat", 0.01), F.approx_count_distinct("lon", 0.01)).first()
    if lats * lons > 4 * rows:  # some cells may be missing
        raise ValueError("the source grid isn't rectilinear")
    axes = source.agg(F.array_sort(F.collect_set("lat")).alias("__lats"), F.array_sort(F.collect_set("lon")).alias("__lons"))
    t = target.select(F.col("cell_id").alias("target_id"), "lat", "lon").join(F.broadcast(axes))

    def place(x: Column, axis: Column) -> tuple[Column, Column]:
        i = F.greatest(F.least(F.size(F.filter(axis, lambda v: v <= x)), F.size(axis) - 1), F.lit(1))
        lo, hi = F.element_at(axis, i), F.element_at(axis, i + 1)
        return lo, hi

    la, lb = place(F.col("lat"), F.col("__lats"))
    oa, ob = place(F.col("lon"), F.col("__lons"))
    t = t.withColumns({"la": la, "lb": lb, "oa": oa, "ob": ob}).where(F.col("lat").between(F.col("la"), F.col("lb")) & F.col("lon").between(F.col("oa"), F.col("ob")))
    fy, fx = (F.col("lat") - F.col("la")) / (F.col("lb") - F.col("la")), (F.col("lon") - F.col("oa")) / (F.col("ob") - F.col("oa"))
    corner = lambda lat, lon, w: F.struct(F.col(lat).alias("lat"), F.col(lon).alias("lon"), w.alias("weight"))
    corners = F.array(corner("la", "oa", (1 - fy) * (1 - fx)), corner("la", "ob", (1 - fy) * fx), corner("lb", "oa", fy * (1 - fx)), corner("lb", "ob", fy * fx))
    out = t.select("target_id", F.explode(corners).alias("c")).select("target_id", "c.lat", "c.lon", "c.weight")
    return out.join(source.select(F.col("cell_id").alias("source_id"), "lat", "lon"), ["lat", "lon"]).select("target_id", "source_id", "weight")


def regridded(cells: DataFrame, weights: DataFrame, *, keys: list[str], value: str = "value", corners: int | None = None) -> DataFrame:
    """keys, cell_id, value on the target grid: weighted sums. With ``corners``, NULL where one of so many is missing."""
    w = weights.select(F.col("source_id").alias("cell_id"), F.col("target_id"), F.col("weight").alias("__w"))
    v = F.col(value).cast("double")
    out = with_grid(cells, w).groupBy(*keys, F.col("target_id")).agg(F.sum(v * F.col("__w")).alias("value"), F.count(v).alias("__n"), F.sum(F.when(v.isNotNull(), F.col("__w"))).alias("__sw"))
    total = F.when(F.col("__n") == corners, F.col("value")) if corners else F.try_divide(F.col("value"), F.col("__sw"))
    return out.select(*keys, F.col("target_id").alias("cell_id"), total.alias("value"))


def valid_weights(present: DataFrame, target: DataFrame, source: DataFrame, *, by: list[str], k: int = 1, first: int = 8) -> DataFrame:
    """by, target_id, source_id, weight of the k nearest sources among the cells that ``present`` (by, cell_id) has for each mask ``by``.

    A target's sources are ranked once, whatever the number of masks: lists of
    the ``first`` nearest meet the present cells of each mask, and the first k
    of those stay. Lists grow, eight times a round, only for the targets that
    have too few present ones in some mask. A mask with fewer than k cells gives
    them all.
    """
    need = cut(present.groupBy(*by).agg(F.least(F.count("*"), F.lit(k)).alias("__need")))
    placed = cut(_placed(target, "target_id"))
    targets, sources = placed.count(), _placed(source, "cell_id").count()
    pair = [*by, "target_id"]
    of_pair = Window.partitionBy(*pair)
    n, open_, done = max(first, 2 * k), None, None
    while True:
        n = min(n, sources)
        some = placed if open_ is None else placed.join(open_.select("target_id").distinct(), "target_id", "left_semi")
        lists = nearest_weights(some.withColumnRenamed("target_id", "cell_id"), source, k=max(n, 1)).select("target_id", F.col("source_id").alias("cell_id"), "distance")
        met = present.join(lists, "cell_id")
        met = met if open_ is None else met.join(open_, pair, "left_semi")
        ranked = met.withColumn("__rank", F.row_number().over(of_pair.orderBy("distance", "cell_id"))).where(F.col("__rank") <= k)
        w = 1 / (F.col("distance") + TINY)
        ranked = ranked.withColumns({"weight": w / F.sum(w).over(of_pair), "__found": F.count("*").over(of_pair)}).join(need, by)
        ranked = cut(ranked.select(*pair, F.col("cell_id").alias("source_id"), "weight", "__rank", (F.col("__found") == F.col("__need")).alias("__full")))
        told = ranked if n == sources else ranked.where("__full")
        done = told if done is None else done.unionByName(told)
        full = told.where("__rank = 1").select(*pair)
        if n < sources and open_ is None:
            filled = full.groupBy(*by).agg(F.count("*").alias("__filled"))
            short = need.join(filled, by, "left").where(F.coalesce("__filled", F.lit(0)) < targets).select(*by)
            bins = max(1, targets // 1000)
            every = short.withColumn("__bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1)))).join(placed.select("target_id", F.pmod(F.xxhash64("target_id"), F.lit(bins)).cast("int").alias("__bin")), "__bin").drop("__bin")
            open_ = cut(every.join(full, pair, "left_anti"))
        elif n < sources:
            open_ = cut(open_.join(full, pair, "left_anti"))
        if n == sources or open_.isEmpty():
            return done.drop("__rank", "__full")
        n *= 8


def regridded_valid(cells: DataFrame, target: DataFrame, source: DataFrame, *, keys: list[str], value: str = "value", k: int = 1, first: int = 8) -> DataFrame:
    """keys, cell_id, value on the target grid from each step's present cells only: where a cell is missing, the next present ones step in.

    Steps with the same cells present share their weights; masks are known by
    two hashes of their ids and their size, and any number of them is one plan.
    Rows with a null key are left out; a step without cells has no rows.
    """
    held = cells.where(F.col(value).isNotNull())
    mask = ["__m0", "__m1", "__n"]
    masks = cut(held.groupBy(*keys).agg(*(F.bit_xor(F.xxhash64("cell_id", F.lit(i))).alias(m) for i, m in enumerate(mask[:2])), F.count("*").alias("__n")))
    one_each = masks.groupBy(*mask).agg(F.min(F.struct(*keys)).alias("__at")).select("__at.*", *mask)
    w = valid_weights(cut(held.join(one_each, keys).select(*mask, "cell_id")), target, source, by=mask, k=k, first=first)
    w = w.select(*mask, F.col("source_id").alias("cell_id"), F.col("target_id").alias("__to"), F.col("weight").alias("__w"))
    out = held.join(masks, keys).join(w, [*mask, "cell_id"]).groupBy(*keys, "__to").agg(F.sum(F.col(value).cast("double") * F.col("__w")).alias("value"))
    return out.select(*keys, F.col("__to").alias("cell_id"), "value")


def overlap_join(a: DataFrame, b: DataFrame, *, t: str = "t", names: tuple[str, str] = ("a", "b"), value: str = "value") -> DataFrame:
    """Rows of the common time span of two series; raises if there is none."""
    both = a.select(t, F.col(value).alias(names[0])).join(b.select(t, F.col(value).alias(names[1])), t)
    if not both.limit(1).count():
        raise ValueError("the series don't overlap")
    return both
