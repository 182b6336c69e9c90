"""Traversals as level-wise joins.

A variable-length pattern enumerates trails (no edge twice).  Where only the
distinct ends matter, a level-synchronous search with a visited table gives the
same ends; where trails are counted, acyclic input is counted by summing
multiplicities, and cyclic input carries its edge ids.  Each level is written to
the shared folder, so plans stay short and an executor may be lost.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import materialize

MAX_DEPTH = 64
#: Ids of a frontier that are broadcast; depth up to which a search reads the edges as they are instead of a prepared table.
SENT, PREPARED = 200_000, 4
#: Edges up to which trails are walked in one plan, unwritten and uncounted: as many as a pattern of fixed steps has.
PLAIN = 2
#: Trails that are broadcast; a row holds two lists of at most MAX_DEPTH ids.
SENT_TRAILS = 50_000


def _steps(edges: DataFrame, direction: str = "out") -> DataFrame:
    """``a, b, eid`` in walking direction."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "eid")
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "eid")
    return {"out": lambda: out, "in": lambda: back, "both": lambda: out.unionByName(back.where("a <> b"))}[direction]()


def levels(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out", allowed: DataFrame | None = None) -> DataFrame:
    """``id, depth`` of every node first reached at ``depth`` >= 1 from any of ``seeds(id)``.

    A seed is reached too if a walk of at least one edge returns to it.
    ``allowed(id)`` restricts every node after the seeds, level by level.
    """
    steps = _steps(edges, direction).select("a", "b").where("a is not null and b is not null")
    if allowed is not None:
        steps = steps.join(allowed.select(F.col("id").alias("b")), "b", "left_semi")
    if depth > PREPARED:
        steps = materialize(steps.distinct(), "steps")
    found: DataFrame | None = None
    frontier = materialize(seeds.select("id").where("id is not null").distinct(), "seeds")
    for at in range(1, min(depth, MAX_DEPTH) + 1):
        rows = frontier.count()
        if not rows:
            break
        # a small frontier is sent to the edges, which are scanned where they lie
        near = F.broadcast(frontier) if rows <= SENT else frontier
        reached = steps.join(near, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct()
        if found is not None:
            reached = reached.join(found, "id", "left_anti")
        level = materialize(reached.withColumn("depth", F.lit(at)), f"level{at}")
        found = level if found is None else found.unionByName(level)
        frontier = level.select("id")
    return found if found is not None else frontier.withColumn("depth", F.lit(0)).where("false")


def reach(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """Distinct ids at the end of a trail of 1 to ``depth`` edges."""
    return levels(edges, seeds, depth, direction).select("id")


def node_depths(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """Every distinct (id, length) of walks of 1 to ``depth`` edges; on acyclic edges these are the trails' (lineage)."""
    steps = materialize(_steps(edges, direction).select("a", "b").distinct(), "steps")
    frontier, found = seeds.select("id").distinct(), None
    for at in range(1, min(depth, MAX_DEPTH) + 1):
        frontier = materialize(frontier.join(steps, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct(), "frontier")
        if frontier.isEmpty():
            break
        level = frontier.withColumn("depth", F.lit(at))
        found = level if found is None else found.unionByName(level)
    return found if found is not None else frontier.withColumn("depth", F.lit(0)).where("false")


def trails(edges: DataFrame, seeds: DataFrame, low: int, high: int, direction: str = "out", max_rows: int = 50_000_000) -> DataFrame:
    """``seed, id, nodes, eids`` of every trail of ``low`` to ``high`` edges; more than ``max_rows`` in a level is an error, not a hang."""
    steps = _steps(edges, direction)
    if high > PREPARED:
        steps = materialize(steps, "steps")
    now = materialize(seeds.select(F.col("id").alias("seed"), "id", F.array("id").alias("nodes"), F.array().cast("array<bigint>").alias("eids")), "seeds")
    out, rows = now if low == 0 else None, now.count()
    for at in range(1, min(high, MAX_DEPTH) + 1):
        # few trails are sent to the edges, which are scanned where they lie
        near = F.broadcast(now) if rows <= SENT_TRAILS else now
        grown = steps.join(near, F.col("id") == F.col("a")).where(~F.array_contains("eids", F.col("eid")))
        now = materialize(grown.select("seed", F.col("b").alias("id"), F.array_append("nodes", F.col("b")).alias("nodes"), F.array_append("eids", F.col("eid")).alias("eids")), f"trails{at}")
        rows = now.count()
        if rows > max_rows:
            raise ValueError(f"{rows} trails of {at} edges; the limit is {max_rows}")
        if at >= low:
            out = now if out is None else out.unionByName(now)
        if not rows:
            break
    return out if out is not None else now


def short_trails(edges: DataFrame, seeds: DataFrame, low: int, high: int, direction: str = "out") -> DataFrame:
    """What ``trails`` gives, for ``high`` up to ``PLAIN``, as plain joins: nothing is written, no number of rows is refused."""
    steps = _steps(edges, direction)
    now = seeds.select(F.col("id").alias("seed"), "id", F.array("id").alias("nodes"), F.array().cast("array<bigint>").alias("eids"))
    out = now if low == 0 else None
    for at in range(1, high + 1):
        grown = now.join(steps, F.col("id") == F.col("a"))
        grown = grown if at == 1 else grown.where(~F.array_contains("eids", F.col("eid")))
        now = grown.select("seed", F.col("b").alias("id"), F.array_append("nodes", F.col("b")).alias("nodes"), F.array_append("eids", F.col("eid")).alias("eids"))
        if at >= low:
            out = now if out is None else out.unionByName(now)
    return out if out is not None else now


def count_walks(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "out") -> DataFrame:
    """``id, n``: walks of exactly ``hops`` edges ending at each node, by summing multiplicities (trails, if edges are acyclic)."""
    steps = materialize(_steps(edges, direction).groupBy("a", "b").agg(F.count(F.lit(1)).alias("m")), "steps")
    now = seeds.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    for at in range(hops):
        now = materialize(now.join(steps, F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(F.sum(F.col("n") * F.col("m")).alias("n")), f"walks{at}")
    return now


def frontier_profile(edges: DataFrame, start: int, depth: int) -> DataFrame:
    """``depth, frontier_size, edges_crossed, cumulative_nodes`` of a search from ``start``, itself counted at depth 0."""
    spark = edges.sparkSession
    seed = spark.createDataFrame([(start,)], "id bigint")
    reached = levels(edges, seed, depth).where(F.col("id") != start)
    sizes = reached.groupBy("depth").agg(F.count(F.lit(1)).alias("frontier_size"))
    everyone = reached.unionByName(seed.withColumn("depth", F.lit(0)))
    crossed = everyone.where(F.col("depth") < depth).join(edges.select(F.col("src").alias("id")), "id").groupBy((F.col("depth") + 1).alias("depth")).agg(F.count(F.lit(1)).alias("edges_crossed"))
    total = F.sum("frontier_size").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)) + 1
    # one row per level: the window is over at most MAX_DEPTH rows
    return sizes.join(crossed, "depth", "left").select(F.col("depth").cast("bigint").alias("depth"), "frontier_size", F.coalesce("edges_crossed", F.lit(0)).alias("edges_crossed"), total.alias("cumulative_nodes"))


def shortest_path(edges: DataFrame, start: int, end: int, depth: int = 16, direction: str = "both", budget_ms: float | None = None) -> list[int] | None:
    """Node ids of a shortest path, ties to the lowest parent; None if there is none within the depth or the time."""
    if start == end:
        return [start]
    began = time.monotonic()
    steps = materialize(_steps(edges, direction).select("a", "b").where("a <> b").distinct(), "steps")
    spark = edges.sparkSession
    seen = spark.createDataFrame([(start, None, 0)], "id bigint, parent bigint, depth int")
    frontier = seen
    for at in range(1, depth + 1):
        if budget_ms is not None and (time.monotonic() - began) * 1000 > budget_ms:
            return None
        grown = frontier.join(steps, F.col("id") == F.col("a")).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent"))
        frontier = materialize(grown.join(seen, "id", "left_anti").withColumn("depth", F.lit(at)), f"path{at}")
        if frontier.isEmpty():
            return None
        seen = seen.unionByName(frontier)
        if not frontier.where(F.col("id") == end).isEmpty():
            break
    else:
        return None
    path = [end]
    while path[-1] != start:  # one point look-up for each step of the path
        path.append(seen.where(F.col("id") == path[-1]).select("parent").first()[0])
    return path[::-1]


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """``a, b, ids_``: the node ids of a shortest path of at most ``depth`` edges for each of ``pairs(a, b)`` that has one.

    One search for all starts at once, keyed by start; each reached node holds
    its smallest path.  A start is dropped when all of its ends are found.
    """
    steps = materialize(_steps(edges, direction).select(F.col("a").alias("from_"), F.col("b").alias("to_")).where("from_ <> to_").distinct(), "steps")
    now = materialize(pairs.select("a", F.col("a").alias("id"), F.array("a").alias("ids_")).distinct(), "starts")
    left, seen, found = pairs, now.select("a", "id"), None
    for at in range(min(depth, MAX_DEPTH) + 1):
        hit = left.join(now, (left["a"] == now["a"]) & (left["b"] == now["id"])).select(left["a"], "b", "ids_")
        hit = materialize(hit, f"found{at}")
        found = hit if found is None else found.unionByName(hit)
        left = materialize(left.join(hit, ["a", "b"], "left_anti"), f"left{at}")
        if left.isEmpty():
            break
        grown = now.join(left.select("a").distinct(), "a", "left_semi").join(steps, F.col("id") == F.col("from_"))
        grown = grown.groupBy("a", F.col("to_").alias("id")).agg(F.min(F.concat("ids_", F.array("to_"))).alias("ids_"))
        now = materialize(grown.join(seen, ["a", "id"], "left_anti"), f"level{at}")
        if now.isEmpty():
            break
        seen = seen.unionByName(now.select("a", "id"))
    return found


def distances(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both") -> DataFrame:
    """``id, hops`` of every node within ``depth``, seeds at 0."""
    zero = seeds.select("id").distinct().withColumn("hops", F.lit(0))
    rest = levels(edges, seeds, depth, direction).join(zero.select("id"), "id", "left_anti").withColumnRenamed("depth", "hops")
    return zero.unionByName(rest)


def constrained(edges: DataFrame, nodes: DataFrame, start: int, depth: int, condition: Column, direction: str = "out") -> DataFrame:
    """``id, hops`` of every (node, length) of walks all of whose nodes meet ``condition`` (pushed into every hop)."""
    allowed = materialize(nodes.where(condition).select("id"), "allowed")
    seed = allowed.where(F.col("id") == start)
    ends = allowed.select(F.col("id").alias("dst"))
    inside = edges.join(ends, "dst", "left_semi").join(allowed.select(F.col("id").alias("src")), "src", "left_semi")
    return node_depths(inside, seed, depth, direction).withColumnRenamed("depth", "hops")

