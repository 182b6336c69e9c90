"""Files, writing clauses, paths, ranks and sketches: operators whose results are rows of their own, and the query languages' further forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.graph import order_graph
from tessera.operators import checksum, statistics
from tessera.plans import cypher, gfql
from tessera.plans.mutate import Session
from tessera.sources import readers, writers
from tessera.storage import scratch_path


def _pairs(spark, d):
    return order_graph(spark, d).edges.select(F.col("src").alias("source"), F.col("dst").alias("target"))


# files


@query("WITH {graph} SELECT src AS source, dst AS target FROM e")
def csv_edge_files(spark, d):
    path = scratch_path(spark, "edges-csv")
    writers.csv_edges(_pairs(spark, d), path)
    return readers.csv_edges(spark, path)


@query("WITH {graph} SELECT src AS source, dst AS target FROM e")
def text_edge_files(spark, d):
    path = scratch_path(spark, "edges-text")
    lines = _pairs(spark, d).select(F.concat_ws("\t", "source", "target").alias("value"))
    lines.unionByName(spark.createDataFrame([("# comment",), ("",), ("one two",)], "value string")).write.text(path)
    return readers.text_edges(spark, path)


@query("WITH {graph} SELECT src AS id FROM e UNION SELECT dst FROM e")
def endpoint_nodes(spark, d):
    return readers.endpoint_nodes(_pairs(spark, d))


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def piped_table_files(spark, d):
    path = scratch_path(spark, "piped")
    table(spark, d, "supplier").select("s_suppkey", "s_name").write.option("sep", "|").option("header", True).csv(path)
    return readers.piped(spark, path)


@query("WITH {graph} SELECT id, lat AS \"at.lat\", lon AS \"at.lon\", '[\"' || category || '\"]' AS tags FROM n")
def parquet_export(spark, d):
    n = order_graph(spark, d).nodes.select("id", F.struct("lat", "lon").alias("at"), F.array("category").alias("tags"))
    path = scratch_path(spark, "export")
    writers.export(n, path, "parquet")
    return spark.read.parquet(path)


@query("SELECT count(*) AS n, count(*) > 0 AS split FROM supplier")
def batched_writes(spark, d):
    path = scratch_path(spark, "batches")
    rows = table(spark, d, "supplier").repartition(1)
    writers.batched(rows, path, 3)
    back = spark.read.parquet(path)
    return back.select(F.input_file_name().alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n"), (F.max("n") <= 3).alias("split"))


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders")
def loaded_csv(spark, d):
    path = scratch_path(spark, "loaded")
    table(spark, d, "orders").select("o_orderkey", "o_totalprice").write.option("header", True).csv(path)
    return cypher.query(order_graph(spark, d), f"LOAD CSV WITH HEADERS FROM '{path}' AS row RETURN toInteger(row.o_orderkey) AS id, toFloat(row.o_totalprice) AS price")


# writing clauses


def _run(spark, d, *texts):
    session, out = Session(order_graph(spark, d)), None
    for text in texts:
        out = session.run(text)
    return out


@query("WITH {graph} SELECT count(*) AS n FROM e WHERE type <> '1-URGENT'")
def deleted_edges(spark, d):
    g = order_graph(spark, d)
    session = Session(type(g)(g.nodes, g.edges.withColumn("type", F.regexp_replace("type", r"^\d-|\W", ""))))
    session.run("MATCH ()-[r:URGENT]->() DELETE r")
    return session.run("MATCH ()-[r]->() RETURN count(r) AS n")


@query("SELECT 1000000000::BIGINT + x AS id, x * x AS square FROM range(1, 6) t(x)")
def foreach_creates(spark, d):
    return _run(spark, d, "FOREACH (x IN [1, 2, 3, 4, 5] | CREATE (n:Square {id: 1000000000 + x, square: x * x}))", "MATCH (n:Square) RETURN n.id AS id, n.square AS square")


@query("SELECT 7::BIGINT AS writes")
def unwound_creates(spark, d):
    return _run(spark, d, "UNWIND range(1, 7) AS x CREATE (n:Batch {id: 1000000000 + x}) WITH count(*) AS writes RETURN writes")


# paths and patterns


@query("WITH {graph} SELECT count(*) AS n, count(DISTINCT eid) AS m FROM e")
def cypher_edge_counts(spark, d):
    return cypher.query(order_graph(spark, d), "MATCH ()-[r]->() RETURN count(r) AS n, count(DISTINCT r) AS m")


@query("WITH {graph}, two AS (SELECT a.dst AS x, 1 AS depth FROM e a WHERE a.src = 3 UNION SELECT b.dst, 2 FROM e a JOIN e b ON b.src = a.dst AND b.eid <> a.eid WHERE a.src = 3) SELECT id, name, depth::BIGINT AS depth FROM two JOIN n ON n.id = x WHERE category = 'BUILDING'")
def cypher_path_lengths(spark, d):
    return cypher.query(order_graph(spark, d), "MATCH path = (start {id: $s})-[*1..2]->(b) WHERE b:SegmentBUILDING RETURN DISTINCT b.id AS id, b.name AS name, length(path) AS depth", s=3)


@query("WITH {graph} SELECT b.dst AS id, 2::BIGINT AS hops, count(*) AS n FROM e a JOIN e b ON b.src = a.dst AND b.eid <> a.eid JOIN n x ON x.id = a.src JOIN n y ON y.id = a.dst JOIN n z ON z.id = b.dst WHERE a.src = 3 AND x.lat > -85 AND y.lat > -85 AND z.lat > -85 GROUP BY 1")
def cypher_paths_where_all(spark, d):
    return cypher.query(order_graph(spark, d), "MATCH path = (a {id: $s})-[*2..2]->(b) WHERE ALL(n IN nodes(path) WHERE n.lat > -85) RETURN b.id AS id, length(path) AS hops, count(*) AS n", s=3)


@query("WITH RECURSIVE {graph}, s AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT s.b, r.depth + 1 FROM r JOIN s ON s.a = r.id WHERE r.depth < 5) SELECT min(depth)::BIGINT AS hops FROM r WHERE id = 100")
def cypher_shortest_path(spark, d):
    return cypher.query(order_graph(spark, d), "MATCH p = shortestPath((a {id: 1})-[*]-(b {id: 100})) RETURN length(p) AS hops")


@query("WITH {graph} SELECT n.id, coalesce(list(x.dst ORDER BY x.dst), []) AS ends FROM n LEFT JOIN (SELECT DISTINCT eid, src, dst FROM e WHERE weight > 300000) x ON x.src = n.id WHERE n.nation = 3 GROUP BY 1".replace("list(x.dst ORDER BY x.dst)", "list(x.dst ORDER BY x.dst) FILTER (x.dst IS NOT NULL)"))
def cypher_pattern_comprehension(spark, d):
    return cypher.query(order_graph(spark, d), "MATCH (a) WHERE a.nation = 3 RETURN a.id AS id, [(a)-[r]->(b) WHERE r.weight > 300000 | b.id] AS ends")


@query("WITH {graph}, t AS (SELECT type, count(*) AS n FROM e GROUP BY 1) SELECT n.id, t.type, t.n FROM n, t WHERE n.value > 9900")
def cypher_call_after_match(spark, d):
    return cypher.query(order_graph(spark, d), "MATCH (x) WHERE x.value > 9900 CALL edge_aggregate() YIELD type, count RETURN x.id AS id, type, count AS n")


@query("WITH {graph} SELECT id, value FROM n WHERE value > 5000 ORDER BY value DESC, id LIMIT 20")
def gfql_lines(spark, d):
    return gfql.parse(order_graph(spark, d), 'chain()\n  .n({"label": "Customer"})\n  .filter("value", ">", $least)\n  .sort_by("value", True)\n  .limit(20)\n  .map("id", "value")', {"least": 5000}).run()


@query("WITH {graph} SELECT id FROM n WHERE nation = 3")
def gfql_set_context(spark, d):
    return gfql.parse(order_graph(spark, d), "SET GFQL_CONTEXT nation = 3;\nchain().n().map(id)").run()


@query("WITH {graph}, t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM e a JOIN e b ON b.src = a.dst WHERE a.src = 3) SELECT 'length' AS fault, 0::BIGINT AS n WHERE false UNION ALL SELECT 'no edge', count(*) FROM (SELECT DISTINCT x, y, z FROM t WHERE (z, y) NOT IN (SELECT src, dst FROM e)) HAVING count(*) > 0")
def path_faults(spark, d):
    """Of the two-hop paths from a node with their last step turned round, those whose step is no edge."""
    e = order_graph(spark, d).edges
    two = e.where("src = 3").select("src", F.col("dst").alias("y")).join(e.select(F.col("src").alias("y"), F.col("dst").alias("z")), "y").distinct()
    back = e.select(F.col("src").alias("source"), F.col("dst").alias("target"))
    turned = two.select(F.array("z", "y").alias("nodes"), "src").distinct()
    faults = checksum.path_faults(turned.select("nodes"), back.select(F.col("source").alias("src"), F.col("target").alias("dst")), low=1, high=1).where("fault = 'no edge'")
    return faults.groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


# ranks, quarters, sketches


@query("SELECT o_orderkey, row_number() OVER w AS place, ntile(4) OVER w AS quarter, lead(o_totalprice) OVER w AS following, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS level FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
def ranking_functions(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    level = F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(w).cast("bigint").alias("place"), F.ntile(4).over(w).cast("bigint").alias("quarter"), F.lead("o_totalprice").over(w).alias("following"), level.cast("bigint").alias("level"))


@query("WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS pos, count(*) OVER (PARTITION BY user_id) AS n, value < 5 AS gap FROM events) SELECT user_id, coalesce(max(n) >= 4 AND coalesce(bool_or(gap) FILTER (pos <= n // 4), false) AND NOT coalesce(bool_or(gap) FILTER (pos > n - n // 4), false), false) AS recovered FROM t GROUP BY 1")
def recovered_series(spark, d):
    e = table(spark, d, "events").withColumn("seen", F.when(F.col("value") >= 5, F.col("value")))
    return statistics.recovered(e, "event_id", "seen", ["user_id"])


@query("SELECT event_type, count(*) AS n, true AS close FROM events WHERE value IS NOT NULL GROUP BY 1")
def digest_quantiles(spark, d):
    """Whether every quantile of a digest stands within a hundredth of its rank."""
    e = table(spark, d, "events").where("value is not null")
    points = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = statistics.digest_quantiles(statistics.digests(e, "value", ["event_type"]), list(points.values()), ["event_type"])
    rows = e.join(F.broadcast(found), "event_type").groupBy("event_type", *points).agg(F.count(F.lit(1)).alias("n"), *[F.avg((F.col("value") <= F.col(c)).cast("double")).alias(f"r_{c}") for c in points])
    near = [F.abs(F.col(f"r_{c}") - p) <= 0.01 + 1 / F.col("n") for c, p in points.items()]
    return rows.select("event_type", "n", (near[0] & near[1] & near[2] & near[3]).alias("close"))


@query("SELECT event_type, true AS close FROM events GROUP BY 1")
def approximate_distinct(spark, d):
    # a sketch sees no repeats; beside a distinct count in one aggregation Spark would keep a sketch for every user
    users = table(spark, d, "events").select("event_type", "user_id").distinct()
    got = users.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("rough"), F.count("user_id").alias("n"))
    return got.select("event_type", (F.abs(F.col("rough") - F.col("n")) <= 0.1 * F.col("n") + 1).alias("close"))


@query("SELECT x, d, CASE WHEN x >= 0.05 THEN 'Inconclusive' WHEN abs(d) < 5 THEN 'NoChange' WHEN d < 0 THEN 'Improvement' ELSE 'Regression' END AS change FROM (SELECT (o_orderkey % 20) / 200.0::DOUBLE AS x, (o_custkey % 21 - 10)::DOUBLE AS d FROM orders)")
def change_classes(spark, d):
    t = table(spark, d, "orders").select((F.col("o_orderkey") % 20 / 200.0).alias("x"), (F.col("o_custkey") % 21 - 10).cast("double").alias("d"))
    return t.select("x", "d", statistics.classify_change(F.col("x"), F.col("d")).alias("change"))
