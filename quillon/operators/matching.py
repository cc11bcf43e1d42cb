"""User-product matching of the greatest size: each product to one user, each user at most capacity products.

Users place products in parallel first (a maximal matching by rounds of offers),
then shortest augmenting paths enlarge it.  A phase grows alternating paths level
by level from all users with a free place: a user reaches products over edges
that aren't matched, a product its present user.  Each level is a join of the
frontier with the edges; a vertex keeps one predecessor, the first level that
reaches it, so a phase's paths form a forest.  Free products that were reached end
paths; walking back, a vertex with several paths keeps one, so the paths of a phase
share no product and take no place twice.  When a phase finds no path, the matching is maximum.

Every step is a join or an aggregation over edges or narrower tables, written to
the shared folder, so lost executors cost little; no graph is collected.

Defined cases: null users or products are no edges; repeated edges count once;
an empty table gives an empty result; a lower capacity than 1 raises ValueError.
Which of several maximum matchings results is set by ids alone, not by partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.storage import writer


def match(edges: DataFrame, capacity: int = 3, max_phases: int = 1000) -> DataFrame:
    """(user_id, asin): a matching of the greatest size over edges (user_id, asin)."""
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    write = writer(edges.sparkSession, "matching")
    edges = write(edges.select("user_id", "asin").where("user_id IS NOT NULL AND asin IS NOT NULL").distinct())
    matched = greedy(edges, capacity, write)
    for _ in range(max_phases):
        grown = augmented(edges, matched, capacity, write)
        if grown is None:
            return matched
        matched = grown
    raise RuntimeError(f"matching did not end in {max_phases} phases")


def _free_users(edges: DataFrame, matched: DataFrame, capacity: int) -> DataFrame:
    """(user_id, places) of users with places left."""
    held = matched.groupBy("user_id").agg(F.count("*").alias("held"))
    users = edges.select("user_id").distinct().join(held, "user_id", "left")
    return users.select("user_id", (F.lit(capacity) - F.coalesce("held", F.lit(0))).alias("places")).where("places > 0")


def greedy(edges: DataFrame, capacity: int, write: Callable[[DataFrame], DataFrame], rounds: int = 8) -> DataFrame:
    """A matching by rounds of offers: products that nobody has go to the asking user with the fewest choices."""
    options = write(edges.groupBy("user_id").agg(F.count("*").alias("options")))
    matched = write(edges.where("false"))
    for _ in range(rounds):
        open_edges = edges.join(matched.select("asin"), "asin", "left_anti").join(_free_users(edges, matched, capacity), "user_id").join(options, "user_id")
        asked = open_edges.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.xxhash64("asin", "user_id"), "asin"))).where("place <= places")
        won = write(asked.groupBy("asin").agg(F.min(F.struct("options", "user_id")).alias("w")).select("w.user_id", "asin"))
        if won.isEmpty():
            break
        matched = write(matched.unionByName(won))
    return matched


def augmented(edges: DataFrame, matched: DataFrame, capacity: int, write: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """The matching after one phase of augmenting paths; None if there is none."""
    free = _free_users(edges, matched, capacity)
    frontier = write(free.select("user_id", F.col("user_id").alias("root")))
    seen_users, seen_products = frontier.select("user_id"), None
    levels: list[DataFrame] = []
    while True:
        # Products reached for the first time, each from one user.
        reached = frontier.join(edges, "user_id").join(matched, ["user_id", "asin"], "left_anti")
        if seen_products is not None:
            reached = reached.join(seen_products, "asin", "left_anti")
        step = write(reached.groupBy("asin").agg(F.min(F.struct(F.xxhash64("user_id", "asin").alias("h"), "user_id", "root")).alias("b")).select("asin", "b.user_id", "b.root"))
        if step.isEmpty():
            return None
        levels.append(step)
        ends = write(step.join(matched.select("asin"), "asin", "left_anti"))
        if not ends.isEmpty():
            return _applied(edges, matched, levels, ends, capacity, write)
        seen_products = step.select("asin") if seen_products is None else write(seen_products.union(step.select("asin")))
        owners = step.select("asin", "root").join(matched, "asin").join(seen_users, "user_id", "left_anti")
        frontier = write(owners.groupBy("user_id").agg(F.min(F.struct(F.xxhash64("asin").alias("h"), "root")).alias("b")).select("user_id", "b.root"))
        if frontier.isEmpty():
            return None
        seen_users = write(seen_users.union(frontier.select("user_id")))


def _applied(edges: DataFrame, matched: DataFrame, levels: list[DataFrame], ends: DataFrame, capacity: int, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """matched with the edges of paths that end in ends turned over: back along the levels, no vertex but a path's last user in two paths."""
    free = _free_users(edges, matched, capacity)
    taken = None
    # A path: its free product (name) and the product whose new user is sought.
    paths = ends.select(F.col("asin").alias("name"), "asin")
    for level in reversed(range(len(levels))):
        found = paths.join(levels[level].select("asin", "user_id"), "asin")
        if level:
            # One path may pass a user: it gives up the product over which the user was reached.
            one = found.groupBy("user_id").agg(F.min(F.struct(F.xxhash64("name").alias("h"), "name", "asin")).alias("b"))
            found = write(one.select("user_id", "b.name", "b.asin"))
            before = levels[level - 1].select(F.col("asin").alias("given")).join(matched.select("user_id", F.col("asin").alias("given")), "given")
            given = before.groupBy("user_id").agg(F.min(F.struct(F.xxhash64("given").alias("h"), "given")).alias("b")).select("user_id", F.col("b.given").alias("given"))
            found = write(found.join(given, "user_id"))
            step = found.select("name", "user_id", F.col("asin").alias("gained"), F.col("given").alias("lost"))
            paths = found.select("name", F.col("given").alias("asin"))
        else:
            # A root takes as many paths as it has places.
            order = Window.partitionBy("user_id").orderBy(F.xxhash64("name"), "name")
            found = found.join(free, "user_id").withColumn("place", F.row_number().over(order)).where("place <= places")
            step = write(found.select("name", "user_id", F.col("asin").alias("gained"), F.lit(None).cast(edges.schema["asin"].dataType).alias("lost")))
        taken = step if taken is None else taken.unionByName(step)
    # Only paths that went all the way to a root count.
    whole = write(taken.join(step.select("name"), "name"))
    lost = whole.where("lost IS NOT NULL").select("user_id", F.col("lost").alias("asin"))
    return write(matched.join(lost, ["user_id", "asin"], "left_anti").unionByName(whole.select("user_id", F.col("gained").alias("asin"))))
