"""Versioned graph tables: snapshots, lost writes, bounded plans and look-ups that open few files."""

from __future__ import annotations

import os

import pytest

from tessera.graph import PropertyGraph
from tessera.plans import cypher
from tessera.plans.mutate import Session
from tessera.sources import graphstore
from tessera.sources.graphstore import Changes, Conflict, GraphStore


@pytest.fixture
def store(spark, tmp_path):
    nodes = spark.range(0, 400, 1, 4).selectExpr("id", "array(if(id % 2 = 0, 'Even', 'Odd')) AS labels", "concat('n', id) AS name", "id * 10 AS age")
    edges = spark.range(0, 400).selectExpr("id AS eid", "id AS src", "(id * 7) % 400 AS dst", "'NEXT' AS type", "id / 2 AS weight")
    return GraphStore.create(PropertyGraph(nodes, edges), f"file://{tmp_path}/g")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upserts_and_snapshots(spark, store):
    new = spark.createDataFrame([(3, ["Odd"], "three", 1), (1000, ["New"], "far", 2)], "id bigint, labels array<string>, name string, age bigint")
    store.upsert_nodes(new)
    store.upsert_edges(spark.createDataFrame([(0, 3, 1000, "LEAP", 9.0)], "eid bigint, src bigint, dst bigint, type string, weight double"))
    store.commit(Changes().delete("nodes", spark.range(10, 20)))
    now = store.graph()
    assert now.counts() == (391, 400) and now.snapshot == 3
    assert rows(cypher.query(now, "MATCH (a)-[r:LEAP]->(b) RETURN a.name AS a, b.name AS b, r.weight AS w")) == [("three", "far", 9.0)]
    assert store.graph(0).counts() == (400, 400) and rows(store.graph(1).node(3).select("name")) == [("three",)]
    assert rows(store.graph(0).node(3).select("name")) == [("n3",)]
    m = store.compact()
    assert store.graph().counts() == (391, 400) and not m.nodes.deltas
    assert store.expire(1) > 0 and store.versions() == [m.version] and store.graph().counts() == (391, 400)


def test_fifty_writes_keep_plans_small(store):
    session = Session(store)

    def size():
        return len(session.graph.nodes._jdf.queryExecution().optimizedPlan().toString().splitlines())

    sizes = []
    for k in range(50):
        session.run("MATCH (n {id: $id}) SET n.age = $age, n.step = $k", id=k, age=-k, k=k)
        sizes.append(size())
    assert max(sizes) == sizes[1]
    assert rows(session.run("MATCH (n) WHERE n.step IS NOT NULL RETURN count(*) AS n, sum(n.age) AS s, max(n.step) AS k")) == [(50, -1225, 49)]
    assert len(store.manifest().nodes.deltas) <= graphstore.DELTAS and len(store.versions()) == 51


def test_a_lost_write_leaves_the_old_version(spark, store):
    bad = spark.range(3).selectExpr("id", "array('X') AS labels", "if(id = 2, raise_error('lost'), 'x') AS name", "id AS age")
    with pytest.raises(Exception, match="lost"):
        store.upsert_nodes(bad)
    assert store.versions() == [0] and store.graph().counts() == (400, 400)
    seen = store.manifest()
    store.commit(Changes().delete("nodes", spark.range(1)), seen)
    with pytest.raises(Conflict):
        store.commit(Changes().delete("nodes", spark.range(2)), seen)
    assert store.graph().nodes.count() == 399 and not [f for f in os.listdir(store.path[7:] + "/versions") if f.startswith(".") and not f.endswith(".crc")]


def test_transactions_make_one_version(store):
    session = Session(store)
    session.run("BEGIN")
    session.run("CREATE (:Odd {id: 5000, name: 'x'})")
    session.run("MATCH (n {id: 5000}) SET n.age = 7")
    assert store.versions() == [0]
    session.run("COMMIT")
    assert store.versions() == [0, 1] and rows(store.graph().node(5000).select("name", "age")) == [("x", 7)]
    session.run("BEGIN")
    session.run("MATCH (n) DETACH DELETE n")
    session.run("ROLLBACK")
    assert store.graph().counts() == (401, 400)


def scanned(df):
    """(files, rows) that the scans of a query read."""
    df.collect()
    out, plan = [0, 0], df._jdf.queryExecution().executedPlan()

    def walk(p):
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        if kind == "FileSourceScanExec":
            out[0] += p.metrics().get("numFiles").get().value()
            out[1] += p.metrics().get("numOutputRows").get().value()
        for k in range(p.children().size()):
            walk(p.children().apply(k))

    walk(plan)
    return tuple(out)


def test_an_index_opens_few_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    nodes = spark.range(0, 4000, 1, 4).selectExpr("id", "array('P') AS labels", "concat('n', lpad((id * 37) % 4000, 4, '0')) AS name", "id % 5 AS age")
    edges = spark.range(10).selectExpr("id AS eid", "id AS src", "id + 1 AS dst", "'E' AS type")
    store = GraphStore.create(PropertyGraph(nodes, edges), f"file://{tmp_path}/g")
    ask = "MATCH (p:P {name: 'n0370'}) RETURN p.id AS id"
    before = scanned(cypher.query(store.graph(), ask))
    session = Session(store)
    session.run("CREATE INDEX ON :P(name)")
    after = scanned(cypher.query(store.graph(), ask))
    assert rows(cypher.query(store.graph(), ask)) == [(10,)]
    assert before[0] >= 4 and after[0] == 1 and after[1] < before[1] / 3
    session.run("MATCH (p:P {id: 10}) SET p.name = 'other'")
    session.run("MATCH (p:P {id: 11}) SET p.name = 'n0370'")
    assert rows(cypher.query(store.graph(), ask)) == [(11,)]
    assert rows(store.by_id([10, 11]).select("id", "name")) == [(10, "other"), (11, "n0370")]
    store.compact()
    assert rows(cypher.query(store.graph(), ask)) == [(11,)]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
