"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.storage import discard, materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` of every id in ``links``; component is the smallest id reachable.

    Links with a null end or equal ends are ignored; repeated links count once.
    An empty table gives an empty result.  Each round links every node to its
    smallest neighbour (large star, then small star), so the number of rounds
    grows with the logarithm of the longest path.  Minima are aggregated before
    the shuffle and the way back to a node's neighbours is a plain equi-join,
    which the runtime splits for a node with very many links.  Each round's
    links are a table in the shared folder: no lineage grows and nothing is
    collected but whether a link is left to contract.
    """
    links = links.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").distinct()
    now = materialize(links, "links")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.join(least, "u").where("v > u").select(F.col("m").alias("u"), "v").where("u < v").distinct(), "large-star")
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.select(F.col("m").alias("u"), "v").unionByName(joined.select(F.col("m").alias("u"), F.col("u").alias("v"))).where("u < v").distinct()
        then = materialize(small, "small-star")
        discard(large)
        discard(now)
        now = then
    roots = now.select(F.col("u").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("v").alias("id"), F.col("u").alias("component")).unionByName(roots)


def _stars(links: DataFrame) -> bool:
    """Whether every id is either a root or linked to one root only, so that nothing is left to contract."""
    ends = links.select(F.col("v").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("u").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 or up > 0 and down > 0").isEmpty()
