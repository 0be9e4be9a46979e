"""Exact percentiles without a task that holds all values of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgrid.session import cut

HELD = 65_536  # values of a key that one task may hold
STEPS = 256  # ranges of a round
ACCURACY = 20_000
BROADCAST_TARGETS = 100_000


def exact_percentiles(df: DataFrame, qs: list[float], *, keys: list[str], value: str | Column = "value", held: int = HELD, name: str = "percentiles") -> DataFrame:
    """keys, ``name``: an array with the exact percentile of each q of a key's values, with linear interpolation; nulls don't count.

    A key with up to ``held`` values is one aggregate. For larger ones the ranks
    in question are closed in on: a mergeable sketch proposes a range around a
    rank, values below, at and within it are counted, and the next round looks
    within, until a rank lies on a repeated value or few values are left. So a
    key with all rows of a table takes a few passes, each an aggregate.
    """
    v = F.col(value).cast("double") if isinstance(value, str) else value.cast("double")
    each = df.select(F.struct(F.lit(0), *keys).alias("__k"), v.alias("__v")).where("__v IS NOT NULL")
    sizes = cut(each.groupBy("__k").agg(F.count("*").alias("__n")))
    large = sizes.where(F.col("__n") > held)
    key = [F.col("__k")[k].alias(k) for k in keys]
    wanted = F.array(*(F.lit(float(q)) for q in qs))
    if large.isEmpty():
        return each.groupBy("__k").agg(F.percentile("__v", wanted).alias(name)).select(*key, name)
    small = each.join(sizes.where(F.col("__n") <= held).select("__k"), "__k", "left_semi").groupBy("__k").agg(F.percentile("__v", wanted).alias(name))
    place = F.posexplode(F.transform(wanted, lambda q: q * (F.col("__n") - 1)))
    places = cut(large.select("__k", "__n", place.alias("i", "at")).withColumns({"low": F.floor("at"), "high": F.ceil("at")}))
    ranks = places.select("__k", "__n", F.explode(F.array("low", "high")).alias("rank")).distinct()
    found = order_statistics(each, ranks, held)
    got = lambda end: found.select("__k", F.col("rank").alias(end), F.col("value").alias(f"v_{end}"))
    both = places.join(got("low"), ["__k", "low"]).join(got("high"), ["__k", "high"])
    between = F.col("v_low") + (F.col("v_high") - F.col("v_low")) * (F.col("at") - F.col("low"))
    told = both.groupBy("__k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", between.alias("p")))), lambda x: x.p).alias(name))
    return small.unionByName(told).select(*key, name)


def order_statistics(each: DataFrame, ranks: DataFrame, held: int) -> DataFrame:
    """__k, rank, value: the values at ranks (from 0) of ``ranks`` (__k, __n, rank) among those of ``each`` (__k, __v)."""
    null = F.lit(None).cast("double")
    open_ = cut(ranks.select("__k", "rank", null.alias("lo"), null.alias("hi"), F.lit(0).cast("long").alias("below"), F.col("__n").alias("n")))
    state, done = ["__k", "rank", "lo", "hi", "below"], None
    v = F.col("__v")

    def inside(of: DataFrame) -> DataFrame:
        small = of.limit(BROADCAST_TARGETS + 1).count() <= BROADCAST_TARGETS
        return each.join(F.broadcast(of) if small else of, "__k").where((F.col("lo").isNull() | (v > F.col("lo"))) & (F.col("hi").isNull() | (v < F.col("hi"))))

    while True:
        few, many = open_.where(F.col("n") <= held), open_.where(F.col("n") > held)
        last = inside(few).groupBy("__k", "rank", "below").agg(F.sort_array(F.collect_list(v)).alias("s"))
        last = last.select("__k", "rank", F.element_at("s", (F.col("rank") - F.col("below") + 1).cast("int")).alias("value"))
        done = last if done is None else done.unionByName(last)
        if many.isEmpty():
            return done
        marks = F.percentile_approx(v, [i / STEPS for i in range(STEPS + 1)], ACCURACY).alias("marks")
        at = F.floor((F.col("rank") - F.col("below")) / F.col("n") * STEPS)
        mark = lambda i: F.when(i.between(0, STEPS), F.get("marks", i.cast("int")))
        near = cut(inside(many).groupBy(*state, "n").agg(marks).select(*state, mark(at - 1).alias("a"), mark(at + 2).alias("b")))
        a, b = F.col("a"), F.col("b")
        low, high = F.coalesce(a, F.lit(float("-inf"))), F.coalesce(b, F.lit(float("inf")))
        counted = {"lt": v < low, "ea": v == low, "mid": (v > low) & (v < high), "eb": (v == high) & (high > low)}
        told = inside(near).groupBy(*state, "a", "b").agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in counted.items()))
        lt, ea, mid, eb = (F.col(k) for k in counted)
        r = F.col("rank") - F.col("below")
        step = lambda value, lo, hi, below, n: F.struct(value.alias("value"), lo.alias("lo"), hi.alias("hi"), below.alias("below"), n.alias("n"))
        below, lo, hi = F.col("below"), F.col("lo"), F.col("hi")
        case = (
            F.when(r < lt, step(null, lo, a, below, lt))
            .when(r < lt + ea, step(a, lo, hi, below, F.col("n")))
            .when(r < lt + ea + mid, step(null, F.coalesce(a, lo), F.coalesce(b, hi), below + lt + ea, mid))
            .when(r < lt + ea + mid + eb, step(b, lo, hi, below, F.col("n")))
            .otherwise(step(null, b, hi, below + lt + ea + mid + eb, F.col("n") - lt - ea - mid - eb))
        )
        told = cut(told.select("__k", "rank", case.alias("s")).select("__k", "rank", "s.*"))
        done = done.unionByName(told.where("value IS NOT NULL").select("__k", "rank", "value"))
        open_ = cut(told.where("value IS NULL").select(*state, "n"))
