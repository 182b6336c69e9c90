"""Versioned storage: upserts, deletions, snapshots and look-ups by a written index."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.graph import order_graph
from tessera.plans import cypher
from tessera.plans.mutate import Session
from tessera.sources.graphstore import Changes, GraphStore
from tessera.storage import scratch_path


def _store(spark, d) -> GraphStore:
    return GraphStore.create(order_graph(spark, d), scratch_path(spark, "store"))


@query("WITH {graph} SELECT id, CASE WHEN nation = 3 THEN value + 1000 ELSE value END AS value, category FROM n WHERE nation <> 5 UNION ALL SELECT id + 1000000, 0.0::DOUBLE, 'NEW' FROM n WHERE nation = 3")
def stored_upserts(spark, d):
    """Known keys are replaced, new ones added, some deleted, in three versions."""
    store = _store(spark, d)
    own = order_graph(spark, d).nodes
    some = own.where("nation = 3")
    store.upsert_nodes(some.withColumn("value", F.col("value") + 1000))
    store.upsert_nodes(some.withColumn("id", F.col("id") + 1_000_000).withColumn("value", F.lit(0.0)).withColumn("category", F.lit("NEW")))
    store.commit(Changes().delete("nodes", own.where("nation = 5")))
    return store.graph().nodes.select("id", F.col("value").cast("double").alias("value"), "category")


@query("WITH {graph} SELECT 0::BIGINT AS version, count(*) AS n, round(sum(value), 2) AS total FROM n UNION ALL SELECT 1, count(*), round(sum(value * 2), 2) FROM n UNION ALL SELECT 2, count(*), round(sum(value * 2), 2) FROM n WHERE category <> 'BUILDING'")
def stored_snapshots(spark, d):
    """Each version keeps its answer after later writes and after compaction."""
    store = _store(spark, d)
    session = Session(store)
    session.run("MATCH (n) SET n.value = n.value * 2")
    session.run("MATCH (n:SegmentBUILDING) DETACH DELETE n")
    store.compact()
    parts = [store.graph(v).nodes.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).cast("double").alias("total")).select(F.lit(v).cast("bigint").alias("version"), "n", "total") for v in (0, 1, 2)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("WITH {graph} SELECT id, value FROM n WHERE name = 'Customer#000000042' OR id = 77")
def indexed_lookup(spark, d):
    """A look-up by a written index, after a change that the index does not know."""
    store = _store(spark, d)
    session = Session(store)
    session.run("CREATE INDEX ON :Customer(name)")
    session.run("MATCH (n {id: 77}) SET n.name = 'Customer#000000042'")
    return cypher.query(store.graph(), "MATCH (n:Customer {name: 'Customer#000000042'}) RETURN n.id AS id, n.value AS value")


@query("WITH {graph} SELECT src, count(*) AS n, round(sum(weight * 2), 2) AS total FROM e WHERE type = '1-URGENT' GROUP BY 1")
def edge_properties(spark, d):
    session = Session(order_graph(spark, d))
    session.run("MATCH ()-[r]->() WHERE type(r) = '1-URGENT' SET r.twice = r.weight * 2, r.weight = 0")
    out = cypher.query(session.graph, "MATCH (a)-[r]->() WHERE r.twice IS NOT NULL RETURN a.id AS src, count(r) AS n, sum(r.twice + r.weight) AS total")
    return out.withColumn("total", F.round("total", 2).cast("double"))


@query("WITH {graph}, k AS (SELECT DISTINCT nation, category FROM n WHERE nation < 5) SELECT 'Nation' || nation AS place, count(*) AS n FROM k GROUP BY 1")
def merged_patterns(spark, d):
    """One edge between each segment and place that occur together; the pattern's nodes are made once."""
    session = Session(order_graph(spark, d))
    session.run("MATCH (n) WHERE n.nation < 5 WITH DISTINCT n.category AS c, n.nation AS k UNWIND [1, 2] AS twice MERGE (s:Trade {name: c + k})-[:IN]->(p:Place {name: 'Nation' + k})")
    return cypher.query(session.graph, "MATCH (s:Trade)-[:IN]->(p:Place) RETURN p.name AS place, count(DISTINCT s) AS n")
