"""Mixing sources to target weights by hierarchical budgeting. DataFrame operations only.

A token budget flows down a tree of levels (domain, language, source). At each
node it is shared among the children by weight; a child never gets more than
its subtree can give, and what it cannot take goes to its siblings first. Only
when all of them are full does the shortage show at the node above, because a
node's own share is capped by what its subtree can give.

A leaf spends its budget on whole epochs of its documents and then on a prefix
of one more, each epoch in an order of its own given by a seeded hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgrid.llm.common import cut

NONE = "(none)"
BROADCAST_LEAVES = 100_000
PREFIX = 3  # hex digits: 4096 hash ranges for each leaf


def order_hash(id_col: str, epoch: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))


def level_weight(level: str, table: dict[str, int]) -> Column:
    """Weight of a level's value: from the table, else its "*" entry, else 1."""
    out = F.lit(table.get("*", 1))
    for value, weight in table.items():
        if value != "*":
            out = F.when(F.col(level) == value, weight).otherwise(out)
    return out.cast("long")


def share_out(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``share`` of every child from ``budget``: w * level, capped by ``cap``, where the level uses the budget up.

    Children are filled in order of cap / w; the first that can't be filled sets
    the level for itself and all after it. Integer arithmetic throughout.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit("root"))
    order = by.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), child)
    out = children.where("w > 0 AND cap > 0")
    out = out.withColumn("__left", F.col("budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("__w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))).withColumn("__n", F.row_number().over(order))
    full = "CAST(__left AS DECIMAL(38,0)) * w >= CAST(cap AS DECIMAL(38,0)) * __w"
    out = out.withColumn("__at", F.min(F.expr(f"IF({full}, NULL, __n)")).over(by))
    out = out.withColumn("__l", F.max(F.expr("IF(__n = __at, __left, NULL)")).over(by)).withColumn("__lw", F.max(F.expr("IF(__n = __at, __w, NULL)")).over(by))
    share = F.expr("IF(__at IS NULL OR __n < __at, cap, CAST(CAST(w AS DECIMAL(19,0)) * __l div __lw AS BIGINT))")
    return out.withColumn("share", share).drop("__left", "__w", "__n", "__at", "__l", "__lw")


def plan(df: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], *, tokens: Column, id_col: str, budget: tuple[int, int], max_epochs: int, seed: int) -> DataFrame:
    """One row per leaf that gets a budget: levels, share, epochs (whole ones), cut (last order hash of the epoch after them)."""
    rows = cut(df.select(*levels, F.col(id_col).alias("__id"), tokens.cast("long").alias("__t")))
    tree = rows.groupBy(*levels).agg(F.sum("__t").alias("supply")).withColumn("cap", F.col("supply") * max_epochs)
    tree = cut(tree)
    total = tree.agg(F.sum("supply").alias("s")).select(F.expr(f"coalesce(s, 0) * {budget[0]} div {budget[1]}").alias("budget"))
    budgets = total
    for depth, level in enumerate(levels):
        path, parent = levels[: depth + 1], levels[:depth]
        nodes = tree.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", level_weight(level, weights.get(level, {})))
        held = nodes.join(budgets, parent) if parent else nodes.withColumn("__one", F.lit(1)).join(budgets.withColumn("__one", F.lit(1)), "__one").drop("__one")
        budgets = share_out(held, parent, level).select(*path, F.col("share").alias("budget"))
    leaves = budgets.where("budget > 0").join(tree.select(*levels, "supply"), levels)
    leaves = cut(leaves.select(*levels, "supply", F.col("budget").alias("share"), F.expr("budget div supply").alias("epochs"), F.expr("budget % supply").alias("__rest")))
    # the cut of the unfinished epoch: hash ranges first, then the rows of one range
    some = attach(rows, leaves.where("__rest > 0"), levels).withColumn("__h", order_hash("__id", F.col("epochs"), seed)).withColumn("__b", F.substring("__h", 1, PREFIX))
    ranges = cut(some.groupBy(*levels, "__b").agg(F.sum("__t").alias("__bt")))
    edge = leaves.where("__rest > 0").select(*levels, "__rest", F.lit("").alias("__at"), F.lit(0).cast("long").alias("__from"))
    for depth in range(1, PREFIX + 1):  # one digit of the range after the other, so a window has 16 rows
        own = attach(ranges, edge, levels).where(F.col("__b").startswith(F.col("__at")))
        digit = own.groupBy(*levels, F.substring("__b", 1, depth).alias("__next"), "__rest", "__from").agg(F.sum("__bt").alias("__bt"))
        digit = digit.withColumn("__to", F.col("__from") + F.sum("__bt").over(Window.partitionBy(*levels).orderBy("__next")))
        digit = digit.withColumn("__from", F.col("__to") - F.col("__bt")).where("__from <= __rest AND __rest < __to")
        edge = cut(digit.groupBy(*levels).agg(F.max("__rest").alias("__rest"), F.min_by("__next", "__from").alias("__at"), F.min("__from").alias("__from")))
    edge = edge.select(*levels, F.col("__at").alias("__b"), "__from")
    inside = attach(some, edge.withColumnRenamed("__b", "__cut_b"), levels).where("__b = __cut_b")
    running = F.sum("__t").over(Window.partitionBy(*levels).orderBy("__h").rangeBetween(Window.unboundedPreceding, 0))
    last = inside.withColumn("__sum", F.col("__from") + running).where("__sum <= __rest").groupBy(*levels).agg(F.max("__h").alias("__last"))
    cuts = edge.join(last, levels, "left").select(*levels, F.coalesce("__last", "__b").alias("cut"))
    return cut(leaves.join(cuts, levels, "left").select(*levels, "share", "supply", "epochs", F.coalesce("cut", F.lit("")).alias("cut")))


def attach(df: DataFrame, leaves: DataFrame, levels: list[str]) -> DataFrame:
    """Join a table of leaves: broadcast up to BROADCAST_LEAVES of them, a shuffled join beyond."""
    return df.join(F.broadcast(leaves) if leaves.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES else leaves, levels)


def mix_sources(df: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, int]], *, tokens: Column, id_col: str = "doc_id", budget: tuple[int, int] = (1, 1), max_epochs: int = 4, seed: int = 0) -> DataFrame:
    """Rows of ``df``, each as often as it is drawn, with ``epoch`` (int, from 0) and ``mix_tokens``.

    ``levels`` names the tree's levels, root first. ``weights`` has integers for
    each level's values ("*" for the others, else 1; 0 leaves a value out).
    ``budget`` is a fraction of all tokens. A leaf is repeated at most
    ``max_epochs`` times. Document bodies never move: rows are chosen by the
    plan of their leaf, which is broadcast up to 100,000 leaves.

    A null level counts as "(none)"; a null text or id is a row like any other;
    rows that share an id are drawn together; an empty table gives no rows.
    """
    names = [f"__level_{x}" for x in levels]
    told = df.withColumns({n: F.coalesce(c.cast("string"), F.lit(NONE)) for n, c in zip(names, levels.values())})
    leaves = plan(told, names, {f"__level_{k}": v for k, v in weights.items()}, tokens=tokens, id_col=id_col, budget=budget, max_epochs=max_epochs, seed=seed)
    out = attach(told, leaves.select(*names, F.col("epochs").alias("__epochs"), F.col("cut").alias("__cut")), names)
    copies = F.col("__epochs") + (order_hash(id_col, F.col("__epochs"), seed) <= F.col("__cut")).cast("long")
    out = out.withColumn("mix_tokens", tokens.cast("long")).withColumn("__n", copies).where("__n > 0")
    return out.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("__n").cast("int") - 1))).drop("__n", "__epochs", "__cut", *names)
