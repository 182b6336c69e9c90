"""Shortest routes over edge weights by delta-stepping.

Tentative distances fall into buckets of width ``delta``.  The lowest bucket is
worked off: its nodes relax their edges until no node of the bucket improves.
What is known is one table; a step joins its open nodes of the bucket with the
edges, keeps the smallest distance of every node and writes the table anew,
with the nodes that were improved open again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.storage import discard, materialize

#: Nodes of a frontier that are broadcast.
SENT = 200_000


def shortest_routes(edges: DataFrame, seeds: DataFrame, weight: str = "weight", delta: float | None = None, limit: float | None = None, paths: bool = False, direction: str = "out", max_steps: int = 10_000) -> DataFrame:
    """``seed, id, cost`` (and ``nodes``, the route, with ``paths``) of every node within ``limit`` of each of ``seeds(id)``.

    Weights are 0 or more; a negative one is an error, an edge without weight is
    no way.  Ties go to the route with the smaller list of nodes where ``paths``
    are kept.  ``delta`` is twice the mean weight by default: smaller ones relax
    edges less often, larger ones need fewer steps.
    """
    own = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col(weight).cast("double").alias("w")).where("w IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL")
    if direction != "out":
        turned = own.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
        own = turned if direction == "in" else own.unionByName(turned)
    least, mean = own.agg(F.min("w"), F.avg("w")).first()
    if least is not None and least < 0:
        raise ValueError("weights must not be negative")
    delta = delta or 2 * (mean or 0.5)
    # of parallel edges the lightest
    steps = materialize(own.where("a <> b").groupBy("a", "b").agg(F.min("w").alias("w")), "steps")
    start = seeds.select(F.col("id").alias("seed"), "id", F.lit(0.0).alias("cost"), F.array("id").alias("nodes")).where("id IS NOT NULL").distinct()
    if not paths:
        start = start.drop("nodes")
    key = ["seed", "id"]
    value = F.struct("cost", "nodes") if paths else F.struct("cost")
    state = materialize(start.withColumn("open", F.lit(True)), "known")
    end = None
    for _ in range(max_steps):
        bucket = F.count(F.when(F.col("cost") < end, 1)) if end is not None else F.lit(0)
        lowest, rows = state.where("open").agg(F.min("cost"), bucket).first()
        if lowest is None:
            return state.drop("open")
        if end is None or lowest >= end:
            end = (lowest // delta + 1) * delta
            rows = state.where(F.col("open") & (F.col("cost") < end)).count()
        now = F.col("open") & (F.col("cost") < end)
        found = _relaxed(state.where(now).drop("open"), rows, steps, limit, paths).select(*key, value.alias("v"))
        old = state.select(*key, value.alias("v"), value.alias("old"), (F.col("open") & ~now).alias("waits"))
        new = found.withColumns({"old": F.lit(None).cast(old.schema["old"].dataType), "waits": F.lit(False)})
        merged = old.unionByName(new).groupBy(*key).agg(F.min("v").alias("v"), F.min("old").alias("old"), F.max("waits").alias("waits"))
        is_open = F.col("waits") | F.col("old").isNull() | (F.col("v") < F.col("old"))
        then = materialize(merged.select(*key, "v.*", is_open.alias("open")), "known")
        discard(state)
        state = then
    raise ValueError(f"not done after {max_steps} steps; give a larger delta")


def _relaxed(front: DataFrame, rows: int, steps: DataFrame, limit: float | None, paths: bool) -> DataFrame:
    """Nodes at the ends of the front's edges, with what they cost that way."""
    near = front.withColumnsRenamed({"id": "at", "cost": "so_far"})
    if paths:
        near = near.withColumnRenamed("nodes", "way")
    joined = steps.join(F.broadcast(near) if rows <= SENT else near, F.col("a") == F.col("at"))
    cost = F.col("so_far") + F.col("w")
    found = joined.select("seed", F.col("b").alias("id"), cost.alias("cost"), *([F.concat("way", F.array("b")).alias("nodes")] if paths else []))
    return found if limit is None else found.where(F.col("cost") <= limit)


def with_lengths(edges: DataFrame, nodes: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``edges`` with ``meters``, the great-circle distance of their ends; null where an end has no place."""
    from tessera.functions import geo

    at = lambda end, k: nodes.select(F.col("id").alias(end), F.col(lat).alias(f"lat{k}_"), F.col(lon).alias(f"lon{k}_"))
    joined = edges.join(at("src", 1), "src").join(at("dst", 2), "dst")
    return joined.withColumn("meters", geo.haversine_distance("lat1_", "lon1_", "lat2_", "lon2_")).select(*edges.columns, "meters")
