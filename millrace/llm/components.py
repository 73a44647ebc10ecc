"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import shuffle_partitions, stored


def _least(edges: DataFrame) -> DataFrame:
    """k, its least neighbour m, and its number of neighbours; counted before the shuffle and after."""
    return edges.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))


def _met(edges: DataFrame, least: DataFrame, heavy: int) -> DataFrame:
    """Edges (a, b) with m of their a. Edges of a hub, a node of more than ``heavy``, stay where they are and
    its m comes to them; there are no more hubs than shuffle partitions."""
    hubs = F.broadcast(least.filter(F.col("n") > heavy).select(F.col("k").alias("_h"), F.col("m").alias("_m")))
    tagged = edges.join(hubs, F.col("a") == F.col("_h"), "left")
    light = tagged.filter("_h is null").select("a", "b").join(least.filter(F.col("n") <= heavy), F.col("a") == F.col("k")).select("a", "b", "m")
    return tagged.filter("_h is not null").select("a", "b", F.col("_m").alias("m")).unionByName(light)


def _large_star(edges: DataFrame, heavy: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    met = _met(both.filter("b > a"), _least(both), heavy)
    return met.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, heavy: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(down)
    moved = _met(down, least, heavy).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame, tag: str = "cc", rounds: int = 60) -> DataFrame:
    """node, root (smallest node reached) for every node of the edges (a, b: long).

    Rounds are stored, so a lost executor costs one round; the number of rounds grows
    with the logarithm of the longest chain. A node with more neighbours than two partitions
    have edges is a hub: its minimum is broadcast to its edges.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(now)
    for _ in range(rounds):
        if not before[0]:
            break
        heavy = max(64, 2 * before[0] // shuffle_partitions(edges.sparkSession))  # both ways there are 2 * before[0] rows
        # The small star reads its edges five times; were the large one not stored, its whole plan would stand there as often.
        now = stored(_small_star(stored(_large_star(now, heavy), tag), heavy), tag)
        after = mark(now)
        if tuple(after) == tuple(before):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root"))
            ).distinct()
        before = after
    if before[0]:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def link_report(rows: DataFrame, classes: DataFrame, found: DataFrame, tag: str) -> DataFrame:
    """Ends a join whose tasks gave link counts and forests.

    rows: id, node (null: links with nothing); classes: node, first_id, copies; found:
    (a = node, b = null, links) and (a, b) edges. Gives id, component_id, n_links,
    first_id (of the row's class).
    """
    links = found.filter("b is null").groupBy(F.col("a").alias("_l")).agg(F.sum("links").alias("links"))
    joined = components(found.filter("b is not null").select("a", "b"), f"{tag}-linked")
    info = (
        classes.select("node", "first_id", "copies")
        .join(links, F.col("node") == F.col("_l"), "left")
        .join(joined.select(F.col("node").alias("_r"), "root"), F.col("node") == F.col("_r"), "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    info = stored(info.select("node", "first_id", "copies", "links", "root"), f"{tag}-roots")
    # A root of many classes is a hub like those of the stars: its least id is broadcast to its classes.
    heavy = max(64, info.count() // shuffle_partitions(info.sparkSession))
    least = info.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(least.filter(F.col("n") > heavy).select(F.col("root").alias("_h"), F.col("component_id").alias("_c")))
    tagged = info.join(hubs, F.col("root") == F.col("_h"), "left")
    light = least.filter(F.col("n") <= heavy).select(F.col("root").alias("_root"), "component_id")
    shown = lambda df, c: df.select(
        F.col("node").alias("_node"), "first_id", F.col(c).alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    found_by_root = tagged.filter("_h is null").join(light, F.col("root") == F.col("_root"))
    info = stored(shown(tagged.filter("_h is not null"), "_c").unionByName(shown(found_by_root, "component_id")), f"{tag}-info")
    return rows.join(info, F.col("node") == F.col("_node"), "left").select(
        "id",
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("first_id", "id").alias("first_id"),
    )
