"""Seeded graph generators: rows are functions of (seed, row number), so equal seeds give equal tables at any layout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *keys) -> Column:
    """A double in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *[k if isinstance(k, Column) else F.lit(k) for k in keys]), F.lit(1 << 52)) / float(1 << 52)


def pick(seed: int, n: Column | int, *keys) -> Column:
    """An integer in 0..n-1."""
    return F.floor(uniform(seed, *keys) * n).cast("bigint")


def chain(spark: SparkSession, length: int) -> DataFrame:
    """0 -> 1 -> …; empty below two nodes."""
    return spark.range(max(length - 1, 0)).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))


def hub(spark: SparkSession, hubs: int, spokes: int) -> DataFrame:
    """Every hub to its own spokes, numbered after the hubs."""
    return spark.range(hubs * spokes).select(F.floor(F.col("id") / spokes).alias("source"), (F.col("id") + hubs).alias("target"))


def power_law(spark: SparkSession, n: int, m: int, seed: int = 42, exponent: float = 3.0) -> DataFrame:
    """Preferential attachment by shape: a clique of m + 1 nodes, then m edges of each node to earlier ones, both directions.

    Node v's k-th target is floor(v u^e) for a hashed uniform u, which makes the
    expected degree of node i fall as a power of i with the wanted exponent.
    """
    if n <= m:
        raise ValueError("needs more nodes than edges a node")
    clique = spark.range((m + 1) * (m + 1)).select(F.floor(F.col("id") / (m + 1)).alias("source"), (F.col("id") % (m + 1)).alias("target")).where("source <> target")
    shape = 1 / max(1e-6, 1 - 1 / (exponent - 1))
    out = spark.range((n - m - 1) * m).select((F.floor(F.col("id") / m) + m + 1).alias("source"), (F.col("id") % m).alias("k"))
    # the k-th target comes from the k-th of m equal slices of the earlier nodes' weights, so targets differ
    u = (F.col("k") + uniform(seed, F.col("source"), F.col("k"))) / m
    out = out.withColumn("target", F.floor(F.pow(u, F.lit(shape)) * F.col("source")).cast("bigint"))
    out = out.select("source", "target")
    return clique.unionByName(out).unionByName(out.select(F.col("target").alias("source"), F.col("source").alias("target")))


def power_law_edges(n: int, m: int) -> int:
    return (m + 1) * m + 2 * m * (n - m - 1)


def community(spark: SparkSession, communities: int, size: int, intra: float, inter: float, seed: int = 42) -> DataFrame:
    """Blocks with max(1, floor(size * intra)) edges a node inside, and floor(c (c-1) size inter) between blocks; no self loops."""
    own = max(1, math.floor(size * intra))
    inside = spark.range(communities * size * own).withColumn("source", F.floor(F.col("id") / own))
    inside = inside.withColumn("base", F.floor(F.col("source") / size) * size).withColumn("at", pick(seed, max(size - 1, 1), "in", F.col("id")))
    inside = inside.select("source", (F.col("base") + (F.col("source") - F.col("base") + 1 + F.col("at")) % size).alias("target")).where("source <> target")
    across = spark.range(math.floor(communities * (communities - 1) * size * inter)).withColumn("source", pick(seed, communities * size, "s", F.col("id")))
    shift = 1 + pick(seed, max(communities - 1, 1), "c", F.col("id"))
    block = (F.floor(F.col("source") / size) + shift) % communities
    across = across.select("source", (block * size + pick(seed, size, "t", F.col("id"))).cast("bigint").alias("target"))
    return inside.unionByName(across)


def deep(spark: SparkSession, roots: int, fanout: list[int], cross: float = 0.05, seed: int = 42, most: int = 10_000_000) -> DataFrame:
    """Trees level by level, plus a share of edges within levels; a level is cut at ``most`` nodes."""
    out, first, width = None, 0, roots
    for f in fanout:
        below = min(width * f, most)
        tree = spark.range(below).select((F.floor(F.col("id") / f) + first).alias("source"), (F.col("id") + first + width).alias("target"))
        extra = math.ceil(below * cross)
        side = spark.range(extra).select((pick(seed, below, "a", first, F.col("id")) + first + width).alias("source"), (pick(seed, below, "b", first, F.col("id")) + first + width).alias("target")).where("source <> target")
        level = tree.unionByName(side)
        out = level if out is None else out.unionByName(level)
        first, width = first + width, below
    return out if out is not None else chain(spark, 0)


def deep_nodes(roots: int, fanout: list[int]) -> int:
    total, width = roots, roots
    for f in fanout:
        width *= f
        total += width
    return total


def nodes(spark: SparkSession, n: int, properties: dict[str, str | dict], label: str = "Node", seed: int = 42) -> DataFrame:
    """``id, labels`` and properties: ``int``, ``float``, ``text``, ``bool``, or a dict with ``type``, ``range``, ``categories`` or ``null_share``."""
    cols = [F.col("id"), F.array(F.lit(label)).alias("labels")]
    for name, spec in properties.items():
        spec = {"type": spec} if isinstance(spec, str) else spec
        low, high = spec.get("range", (0, 1))
        u = uniform(seed, name, F.col("id"))
        kind = spec["type"]
        if "categories" in spec:
            value = F.concat(F.lit("cat_"), pick(seed, spec["categories"], name, F.col("id")).cast("string"))
        elif kind == "int":
            value = (low + F.floor(u * (high - low if "range" in spec else 1_000_000))).cast("bigint")
        elif kind == "float":
            value = low + u * (high - low)
        elif kind == "bool":
            value = u < 0.5
        else:
            value = F.concat(F.lit(f"{name}_"), F.col("id").cast("string"))
        if spec.get("null_share"):
            value = F.when(uniform(seed, name, "null", F.col("id")) >= spec["null_share"], value)
        cols.append(value.alias(name))
    return spark.range(n).select(*cols)


def wide_nodes(spark: SparkSession, n: int, width: int, seed: int = 42) -> DataFrame:
    kinds = ("int", "float", "text")
    return nodes(spark, n, {f"prop_{k + 1}": kinds[k % 3] for k in range(width)}, seed=seed)


def geo_nodes(spark: SparkSession, n: int, lat: tuple[float, float] = (-90, 90), lon: tuple[float, float] = (-180, 180), label: str = "GeoPoint", seed: int = 42) -> DataFrame:
    return nodes(spark, n, {"lat": {"type": "float", "range": lat}, "lon": {"type": "float", "range": lon}}, label, seed)


def edges(spark: SparkSession, n: int, m: int, seed: int = 42, weight: bool = False) -> DataFrame:
    """Uniform edges without self loops."""
    rows = spark.range(m).withColumn("source", pick(seed, n, "s", F.col("id")))
    rows = rows.withColumn("target", (F.col("source") + 1 + pick(seed, n - 1, "t", F.col("id"))) % n)
    return rows.select("source", "target", *([uniform(seed, "w", F.col("id")).alias("weight")] if weight else []))


def code_graph(spark: SparkSession, functions: int, per_file: int = 20, calls: int = 4, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Functions in files: ``nodes(id, labels, name, complexity, module)``, ``edges(source, target, type)``; calls prefer near functions, some are hot."""
    files = -(-functions // per_file)
    fn = spark.range(functions).select("id", F.array(F.lit("Function")).alias("labels"), F.when(F.col("id") == 0, "main").otherwise(F.concat(F.lit("fn_"), F.col("id").cast("string"))).alias("name"), (1 + F.floor(40 * F.pow(uniform(seed, "x", F.col("id")), 3))).cast("bigint").alias("complexity"), F.floor(F.col("id") / per_file).alias("module"))
    fl = spark.range(files).select((F.col("id") + functions).alias("id"), F.array(F.lit("File")).alias("labels"), F.concat(F.lit("file_"), F.col("id").cast("string")).alias("name"), F.lit(None).cast("bigint").alias("complexity"), F.col("id").alias("module"))
    call = spark.range(functions * calls).withColumn("source", F.floor(F.col("id") / calls))
    near = F.pmod(F.col("source") + 1 + pick(seed, per_file, "n", F.col("id")), F.lit(functions))
    hot = F.floor(F.pow(uniform(seed, "h", F.col("id")), 4) * functions)
    call = call.select("source", F.when(uniform(seed, "l", F.col("id")) < 0.8, near).otherwise(hot).cast("bigint").alias("target"), F.lit("CALLS").alias("type")).where("source <> target").distinct()
    place = fn.select(F.col("id").alias("source"), (F.col("module") + functions).alias("target"), F.lit("DEFINED_IN").alias("type"))
    holds = place.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("CONTAINS").alias("type"))
    imports = call.select((F.floor(F.col("source") / per_file) + functions).alias("source"), (F.floor(F.col("target") / per_file) + functions).alias("target"), F.lit("IMPORTS").alias("type")).where("source <> target").distinct()
    return fn.unionByName(fl), call.unionByName(place).unionByName(holds).unionByName(imports)


def provenance(spark: SparkSession, stages: int, width: int, fan_in: int = 3, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Acyclic lineage: artifacts (even stages) and processes (odd stages); edges lead only to the next stage."""
    n = stages * width
    stage = F.floor(F.col("id") / width)
    node = spark.range(n).select("id", F.array(F.when(stage % 2 == 0, "Artifact").otherwise("Process")).alias("labels"), stage.alias("stage"))
    edge = spark.range((n - width) * fan_in).withColumn("target", F.floor(F.col("id") / fan_in) + width)
    before = F.floor(F.col("target") / width) - 1
    edge = edge.select((before * width + pick(seed, width, "p", F.col("id"))).alias("source"), "target", F.when(before % 2 == 0, "CONSUMED_BY").otherwise("PRODUCED_BY").alias("type")).distinct()
    return node, edge


#: Sizes by name.
TIERS = {
    "small": {"kind": "power_law", "n": 10_000, "m": 5},
    "medium": {"kind": "power_law", "n": 100_000, "m": 8},
    "large": {"kind": "power_law", "n": 1_000_000, "m": 10},
    "skewed": {"kind": "hub", "hubs": 100, "spokes": 1000},
    "deep": {"kind": "deep", "roots": 1, "fanout": [10, 10, 10, 10, 5]},
}


def tier(spark: SparkSession, name: str, seed: int = 42) -> DataFrame:
    t = dict(TIERS[name])
    kind = t.pop("kind")
    if kind == "power_law":
        return power_law(spark, t["n"], t["m"], seed)
    return hub(spark, t["hubs"], t["spokes"]) if kind == "hub" else deep(spark, t["roots"], t["fanout"], seed=seed)
