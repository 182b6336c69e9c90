"""Shapes of query text in both languages, against answers worked out by hand."""

from __future__ import annotations

import math

import pytest

from tessera.graph import PropertyGraph
from tessera.operators import procedures
from tessera.plans import cypher, gfql
from tessera.plans.mutate import Session


@pytest.fixture(scope="module")
def graph(spark):
    rows = [(i, ["Artifact" if i != 3 else "Process", "GeoPoint"], f"n{i}", float(i), float(i) / 2, [1.0, float(i)], i % 2) for i in range(6)]
    nodes = spark.createDataFrame(rows, "id bigint, labels array<string>, name string, lat double, lon double, embedding array<double>, group bigint")
    links = [(0, 0, 1, "A"), (1, 1, 2, "B"), (2, 2, 3, "A"), (3, 0, 2, "A"), (4, 3, 4, "C")]
    return PropertyGraph(nodes, spark.createDataFrame([(*x, 1.0) for x in links], "eid bigint, src bigint, dst bigint, type string, weight double"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_counting_edges(graph):
    assert rows(cypher.query(graph, "MATCH ()-[r]->() RETURN count(r) AS n")) == [(5,)]
    assert rows(cypher.query(graph, "MATCH ()-[r:A]->() RETURN count(DISTINCT r) AS n")) == [(3,)]
    assert rows(cypher.query(graph, "MATCH (a {id: 0})-[r]->() RETURN id(r) AS n")) == [(0,), (3,)]


def test_longest_ways_to_a_label(graph):
    text = "MATCH way = (n)-[:A|B*1..$most]->(m) WHERE m:Process RETURN n.name, max(length(way)) AS longest ORDER BY n.name"
    assert [tuple(r) for r in cypher.query(graph, text, most=3).collect()] == [("n0", 3), ("n1", 2), ("n2", 1)]
    fixed = "MATCH p = (a {id: 0})-[]->(b)-[]->(c) RETURN length(p) AS hops, [n IN nodes(p) | n.id] AS ids"
    assert rows(cypher.query(graph, fixed)) == [(2, [0, 1, 2]), (2, [0, 2, 3])]


def test_ways_that_keep_near_two_depots(graph):
    text = """MATCH (east {id: 3}), (west {id: 1}) MATCH way = (west)-[*2..3]->(town)
      WHERE ALL(stop IN nodes(way) WHERE HAVERSINE_DISTANCE(stop.lat, stop.lon, east.lat, east.lon) < $far)
        AND NONE(stop IN nodes(way) WHERE stop.lat < west.lat)
      RETURN town.name AS town, round(HAVERSINE_DISTANCE(town.lat, town.lon, east.lat, east.lon) / 1000) AS km"""
    # n1-n2-n3 and on to n4; a degree of latitude with half a degree of longitude is 124 km
    assert rows(cypher.query(graph, text, far=260_000.0)) == [("n3", 0.0), ("n4", 124.0)]
    assert rows(cypher.query(graph, text, far=200_000.0)) == []


def test_longest_leg_of_a_shortest_way(graph):
    text = """MATCH way = shortestPath((a {id: $a})-[*]-(b {id: $b})) WITH nodes(way) AS stops, length(way) AS legs UNWIND range(1, size(stops) - 1) AS k
    WITH legs, stops[k - 1].name AS here, stops[k].name AS there, HAVERSINE_DISTANCE(stops[k - 1].lat, stops[k - 1].lon, stops[k].lat, stops[k].lon) AS m
    RETURN legs, here, there, m ORDER BY m DESC LIMIT 1"""
    ((legs, here, there, m),) = cypher.query(graph, text, a=4, b=0).collect()
    assert (legs, here, there) == (3, "n2", "n0") and math.isclose(m, 248_600, rel_tol=0.01)
    assert cypher.query(graph, text, a=1, b=5).count() == 0


def test_pattern_comprehension_and_exists(graph):
    text = "MATCH (a:Artifact) WHERE exists((a)-[]->()) RETURN a.id AS id, [(a)-[]->(b) | b.id] AS xs"
    assert rows(cypher.query(graph, text)) == [(0, [1, 2]), (1, [2]), (2, [3])]
    assert rows(cypher.query(graph, "MATCH (a) WHERE NOT exists((a)-[]->()) RETURN a.id AS id")) == [(4,), (5,)]


def test_calls_after_reading_clauses(graph):
    text = "MATCH (n:Process) CALL edge_aggregate() YIELD type, count RETURN n.id AS id, type, count"
    assert rows(cypher.query(graph, text)) == [(3, "A", 3), (3, "B", 1), (3, "C", 1)]
    text = "MATCH (n) WHERE n.id > 2 CALL vector_similarity(n, 'embedding', $like) YIELD score AS s WITH n.group AS side, max(s) AS best RETURN side, best > 0.98 AS close"
    assert rows(cypher.query(graph, text, like=[0.0, 1.0])) == [(0, False), (1, True)]
    text = "CALL vector_search('embedding_index', $like, 3) YIELD node AS n, score WITH n WHERE n.id > 0 MATCH (n)-[r]->() RETURN n.id AS id, count(r) AS out"
    assert rows(cypher.query(graph, text, like=[1.0, 0.0])) == [(1, 1), (2, 1)]
    assert rows(cypher.query(graph, "CALL cluster_similar(0.99) YIELD cluster_id, members RETURN max(size(members)) > 1 AS some")) == [(True,)]
    assert rows(cypher.query(graph, "CALL semantic_search('n2', 1) YIELD node, score RETURN node.id AS id")) == [(2,)]


def test_budget_and_cache_procedures(spark, graph):
    assert rows(cypher.query(graph, "CALL query_budget(500)")) == [(500.0, True)]
    assert procedures.budget_of(spark) == 500.0
    cypher.query(graph, "CALL query_budget(0)").collect()
    assert procedures.budget_of(spark) is None
    assert rows(cypher.query(graph, "CALL clear_cache()")) == [(True,)]
    assert {r[0] for r in cypher.query(graph, "CALL emergent_cache_stats() YIELD name, value RETURN name, value").collect()} >= {"hits", "misses"}


def test_profile_and_index(graph):
    session = Session(graph)
    got = session.run("PROFILE MATCH (n) WHERE n.id > 2 RETURN n.group AS g, count(*) AS n").collect()
    assert got and got[0]["step"] == 0 and any(r["rows"] for r in got)
    session.run("CREATE INDEX by_side IF NOT EXISTS FOR (p:Process) ON (p.group)")
    session.run("CREATE INDEX ON :GeoPoint(lat)")
    assert rows(session.run("SHOW INDEX INFO")) == [("GeoPoint", "lat"), ("Process", "group")]


def test_load_csv(graph, tmp_path):
    (tmp_path / "x.csv").write_text("id,name\n1,one\n2,two\n")
    assert rows(cypher.query(graph, f"LOAD CSV WITH HEADERS FROM 'file://{tmp_path}/x.csv' AS row RETURN toInteger(row.id) AS id, row.name AS name")) == [(1, "one"), (2, "two")]


def test_chains_over_lines(graph):
    text = 'chain()\n  .n({"label": "Artifact"})\n  .filter("id", ">", $least)\n  .map("id")'
    assert rows(gfql.parse(graph, text, {"least": 1}).run()) == [(2,), (4,), (5,)]
    text = 'chain()\n  .n({"id": $module_id})\n  .e_forward({"type": "A", "max_hops": $max_depth})\n  .n()\n  .sort_by("id")'
    assert [r["id"] for r in gfql.parse(graph, text, {"module_id": 0, "max_depth": 3}).run().collect()] == [1, 2, 3]
    assert rows(gfql.parse(graph, "SET GFQL_CONTEXT group = 1;\nchain()\n.n()\n.map(id)").run()) == [(1,), (3,), (5,)]


def test_batches(graph):
    session = Session(graph)
    batch = [{"id": 100 + i, "name": f"b{i}"} for i in range(3)]
    assert rows(session.run("UNWIND $batch AS row CREATE (n:BatchNode {id: row.id, name: row.name}) WITH count(*) AS writes RETURN writes", batch=batch)) == [(3,)]
    session.run("UNWIND $batch AS row MATCH (src {id: row.a}) MATCH (dst {id: row.b}) CREATE (src)-[:CONNECTS {weight: row.w}]->(dst)", batch=[{"a": 100, "b": 101, "w": 0.5}])
    assert rows(session.run("MATCH (a)-[r:CONNECTS]->(b) RETURN a.id AS a, b.id AS b, r.weight AS w")) == [(100, 101, 0.5)]
