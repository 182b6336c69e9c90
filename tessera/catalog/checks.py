"""Comparison forms of results, binary files, and the multi-join questions of the social benchmark on the order graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.catalog.numbers import _hav
from tessera.functions import sql
from tessera.graph import order_graph
from tessera.operators import checksum, traversal
from tessera.sources import readers, writers
from tessera.storage import scratch_path


@query("WITH {graph} SELECT count(*) AS rows, count(*) FILTER (id % 50 = 0 OR id % 70 = 0) * 2 - count(*) FILTER (id % 50 = 0 AND id % 70 = 0) - count(*) FILTER (id % 50 <> 0 AND id % 70 = 0) AS differing FROM n")
def exact_match(spark, d):
    """A value is changed in every fiftieth row (two differing rows each), every seventieth row is missing."""
    n = order_graph(spark, d).nodes.select("id", "name", "value")
    other = n.where("id % 70 <> 0").withColumn("value", F.when(F.col("id") % 50 == 0, F.col("value") + 1).otherwise(F.col("value")))
    found = checksum.exact_differences(n, other)
    return n.agg(F.count(F.lit(1)).alias("rows")).crossJoin(found.agg(F.count(F.lit(1)).alias("differing")))


@query("SELECT count(*) AS documents, count(*) FILTER (text <> nfc_normalize(text)) AS decomposed, 0::BIGINT AS differing FROM (SELECT replace(text, 'é', 'e' || chr(769)) AS text FROM documents WHERE text IS NOT NULL)")
def composed_texts(spark, d):
    """Texts with their accents apart differ from the composed ones in bytes and in nothing else."""
    own = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    apart = own.withColumn("text", F.replace("text", F.lit("\u00e9"), F.lit("e\u0301")))
    whole = checksum.normalised(apart).withColumnRenamed("text", "whole")
    counts = apart.join(whole, "doc_id").agg(F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("text") != F.col("whole"), 1)).alias("decomposed"))
    return counts.crossJoin(checksum.exact_differences(checksum.normalised(own), apart, composed=True).agg(F.count(F.lit(1)).alias("differing")))


_PAIRS = "p AS (SELECT a.src AS x, a.dst AS y, b.dst AS z, count(*) AS n FROM e a JOIN e b ON b.src = a.dst AND b.eid <> a.eid WHERE a.src < 200 GROUP BY 1, 2, 3)"


@query(f"WITH {{graph}}, {_PAIRS} SELECT 'allowed' AS duplicates, count(*) FILTER (n > 1) AS differing FROM p UNION ALL SELECT 'deduplicated', count(*) FILTER (n > 1) FROM p UNION ALL SELECT 'unspecified', 0 FROM e WHERE eid = (SELECT min(eid) FROM e)")
def path_forms(spark, d):
    """Ways of two edges against the same ways without repeats, under each meaning of repeats."""
    g = order_graph(spark, d)
    ways = traversal.trails(g.edges, g.nodes.where("id < 200").select("id"), 2, 2).select("nodes")
    once = ways.distinct()
    parts = [checksum.path_differences(ways, once, kind).agg(F.count(F.lit(1)).alias("differing")).select(F.lit(kind).alias("duplicates"), "differing") for kind in checksum.DUPLICATES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("WITH {graph} SELECT degree, count(*) AS nodes FROM (SELECT src, count(*) AS degree FROM e GROUP BY 1) GROUP BY 1")
def degree_distribution(spark, d):
    return checksum.degree_distribution(order_graph(spark, d).edges)


@query("WITH {graph}, w AS (SELECT a.src AS start, a.dst AS y, 2 AS length FROM e a WHERE a.src IN (7, 8) UNION ALL SELECT a.src, b.dst, 3 FROM e a JOIN e b ON b.src = a.dst AND b.eid <> a.eid WHERE a.src IN (7, 8)) SELECT fault, count(*) AS n FROM (SELECT 'length' AS fault FROM w WHERE length > 2 UNION ALL SELECT 'seed' FROM w WHERE start <> 7) GROUP BY 1")
def structural_oracle(spark, d):
    """Ways of one or two edges from two starts, of which one is wrong and paths of three nodes are too long."""
    g = order_graph(spark, d)
    ways = traversal.trails(g.edges, g.nodes.where("id IN (7, 8)").select("id"), 1, 2).select(F.col("seed").alias("start"), F.col("nodes").alias("path"))
    return checksum.structural_faults(ways, max_depth=2, seed_id=7).groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


@query("WITH {graph} SELECT src AS source, dst AS target, count(*) AS n FROM e GROUP BY 1, 2")
def binary_edge_ranges(spark, d):
    """Binary files, read by many tasks in small byte ranges."""
    g = order_graph(spark, d)
    path = scratch_path(spark, "pairs")
    writers.binary_edge_files(g.edges.select(F.col("src").alias("source"), F.col("dst").alias("target")), path)
    return readers.binary_edges(spark, f"{path}/*.bin", range_bytes=4096).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


_CIRCLE = "f AS (SELECT DISTINCT id FROM (SELECT dst AS id FROM e WHERE src = 7 UNION ALL SELECT b.dst FROM e a JOIN e b ON b.src = a.dst WHERE a.src = 7) WHERE id <> 7)"
_BUYS = "buys AS (SELECT o_custkey AS id, l_suppkey AS place, min(l_shipdate) AS since, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN f ON f.id = o_custkey GROUP BY 1, 2)"


def _circle(spark, d, hops: int = 2):
    """Those within two hops of person 7."""
    g = order_graph(spark, d)
    return traversal.reach(g.edges, spark.createDataFrame([(7,)], "id bigint"), hops).where("id <> 7")


def _memberships(spark, d):
    """``id, place, since, n``: where a friend is a member (buys from a supplier), since when, and how much they contribute."""
    rows = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id")).join(_circle(spark, d), "id", "left_semi")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("place"), "l_shipdate")
    return rows.join(lines, "o_orderkey").groupBy("id", "place").agg(F.min("l_shipdate").alias("since"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {{graph}}, {_CIRCLE}, {_BUYS} SELECT place, sum(n)::BIGINT AS posts FROM buys WHERE since > TIMESTAMP '1996-01-01' GROUP BY 1 ORDER BY posts DESC, place LIMIT 20")
def new_groups_of_friends(spark, d):
    """Places that friends and their friends joined after a day, by what those members contributed there."""
    return _memberships(spark, d).where("since > TIMESTAMP_NTZ '1996-01-01'").groupBy("place").agg(F.sum("n").alias("posts")).orderBy(F.desc("posts"), "place").limit(20)


@query(f"WITH {{graph}}, {_CIRCLE}, {_BUYS} SELECT buys.id, s_name AS company, year(since)::INTEGER AS since FROM buys JOIN supplier ON s_suppkey = place WHERE s_nationkey < 8 AND year(since) < 1998 ORDER BY since, buys.id, company DESC LIMIT 10")
def friends_at_companies(spark, d):
    """Friends and their friends who have been with a company of some countries since before a year, longest first."""
    own = table(spark, d, "supplier").where("s_nationkey < 8").select(F.col("s_suppkey").alias("place"), F.col("s_name").alias("company"))
    out = _memberships(spark, d).join(own, "place").select("id", "company", F.year("since").alias("since")).where("since < 1998")
    return out.orderBy("since", "id", F.desc("company")).limit(10)


@query("WITH {graph}, f AS (SELECT DISTINCT dst AS id FROM e WHERE src = 7 AND dst <> 7) SELECT f.id, count(*) AS replies, list(DISTINCT p_brand ORDER BY p_brand) AS tags FROM f JOIN orders ON o_custkey = f.id JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE p_type = 'ECONOMY' GROUP BY 1 ORDER BY replies DESC, f.id LIMIT 20")
def experts_among_friends(spark, d):
    """Friends by how often they touch things of one class, with the tags of those."""
    mine = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("id")).join(_circle(spark, d, 1), "id", "left_semi")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    things = table(spark, d, "part").where("p_type = 'ECONOMY'").select("p_partkey", "p_brand")
    found = mine.join(lines, "o_orderkey").join(things, "p_partkey").groupBy("id").agg(F.count(F.lit(1)).alias("replies"), F.array_sort(F.collect_set("p_brand")).alias("tags"))
    return found.orderBy(F.desc("replies"), "id").limit(20)


@query("WITH {graph} SELECT id, round(" + _hav("lat", "lon", "40.7", "-74.0") + ", 2) AS meters FROM n WHERE " + _hav("lat", "lon", "40.7", "-74.0") + " < 3000000")
def sql_scalar_functions(spark, d):
    sql.register(order_graph(spark, d))
    return spark.sql("SELECT id, round(haversine_distance(lat, lon, 40.7, -74.0), 2) AS meters FROM nodes WHERE haversine_distance(lat, lon, 40.7, -74.0) < 3000000")


@query("WITH {graph}, w AS (SELECT b.dst AS id, count(*) AS ways FROM e a JOIN e b ON b.src = a.dst AND b.eid <> a.eid WHERE a.src = 7 GROUP BY 1), g AS (SELECT src AS id, count(*) AS degree FROM e GROUP BY 1) SELECT id, ways, degree FROM w JOIN g USING (id) WHERE degree >= 12")
def sql_table_functions(spark, d):
    sql.register(order_graph(spark, d))
    return spark.sql("SELECT w.id, w.ways, g.degree FROM two_hops(7) w JOIN nodes_of_degree(12) g ON g.id = w.id")


@query("WITH RECURSIVE {graph}, r(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 3), f AS (SELECT id, min(depth) AS depth FROM r GROUP BY 1) SELECT depth::BIGINT AS depth, count(*) AS n FROM f WHERE id <> 1 GROUP BY 1")
def sql_procedure_view(spark, d):
    g = order_graph(spark, d)
    sql.procedure_view(g, "frontier", "frontier_profile", 1, 3)
    return spark.sql("SELECT depth, frontier_size AS n FROM frontier WHERE depth > 0")
