"""Writing clauses of the query language."""

from __future__ import annotations

import pytest

from tessera.graph import PropertyGraph
from tessera.plans.mutate import Session


@pytest.fixture
def session(spark):
    nodes = spark.createDataFrame([(0, ["Person"], "Ann", 30), (1, ["Person"], "Bob", 40)], "id bigint, labels array<string>, name string, age bigint")
    edges = spark.createDataFrame([(0, 0, 1, "KNOWS")], "eid bigint, src bigint, dst bigint, type string")
    return Session(PropertyGraph(nodes, edges))


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_create_and_connect(session):
    session.run("CREATE (c:Person:Admin {id: 7, name: 'Cy', age: 50})")
    session.run("MATCH (a {id: 0}), (b {name: 'Cy'}) CREATE (a)-[:KNOWS]->(b)")
    assert rows(session.run("MATCH (a {id: 0})-[:KNOWS]->(b) RETURN b.name AS n")) == [("Bob",), ("Cy",)]
    session.run("UNWIND [1, 2, 3] AS x CREATE (n:Item {id: 100 + x, age: x * 2})")
    assert rows(session.run("MATCH (n:Item) RETURN n.id AS id, n.age AS a")) == [(101, 2), (102, 4), (103, 6)]
    session.run("FOREACH (x IN [5, 6] | CREATE (f:Loop {age: x}))")
    assert rows(session.run("MATCH (n:Loop) RETURN n.age AS a")) == [(5,), (6,)]
    assert session.graph.snapshot > 0


def test_set_and_remove(session):
    session.run("MATCH (n {id: 0}) SET n.age = n.age + 1, n:Old")
    assert rows(session.run("MATCH (n:Old) RETURN n.age AS a")) == [(31,)]
    session.run("MATCH (n {id: 0}) REMOVE n.name, n:Old")
    assert rows(session.run("MATCH (n) WHERE n.name IS NULL RETURN n.id AS id")) == [(0,)] and rows(session.run("MATCH (n:Old) RETURN n.id AS id")) == []
    session.run("MATCH (n {id: 1}) SET n = {age: 5}")
    assert rows(session.run("MATCH (n {id: 1}) RETURN n.name AS n, n.age AS a")) == [(None, 5)]


def test_delete(session):
    with pytest.raises(ValueError):
        session.run("MATCH (n {id: 0}) DELETE n")
    session.run("MATCH (a)-[r:KNOWS]->(b) DELETE r")
    session.run("MATCH (n {id: 0}) DELETE n")
    assert session.graph.counts() == (1, 0)
    session.run("MATCH (n) DETACH DELETE n")
    assert session.graph.counts() == (0, 0)


def test_merge(session):
    text = "UNWIND $visits AS v MERGE (p:Place {name: v}) ON CREATE SET p.age = 1 ON MATCH SET p.age = p.age + 1"
    session.run(text, visits=["pier", "mill"])
    session.run(text, visits=["mill", "dock", "dock"])
    assert rows(session.run("MATCH (p:Place) RETURN p.name AS n, p.age AS a")) == [("dock", 1), ("mill", 2), ("pier", 1)]
    session.run("MATCH (a {id: 0}), (b {id: 1}) MERGE (a)-[:KNOWS]->(b)")
    assert session.graph.edges.count() == 1


def test_transactions_and_schema(session):
    session.run("CREATE CONSTRAINT ON (p:Person) ASSERT p.name IS UNIQUE")
    session.run("CREATE INDEX ON :Person(age)")
    assert session.graph.show_indexes().count() == 1
    session.run("BEGIN")
    session.run("MATCH (n) SET n.name = 'same'")
    with pytest.raises(ValueError):
        session.run("COMMIT")
    assert rows(session.run("MATCH (n {id: 1}) RETURN n.name AS n")) == [("Bob",)]
    session.run("BEGIN")
    session.run("CREATE (n:Person {name: 'Eve'})")
    session.run("ROLLBACK")
    assert session.graph.nodes.count() == 2
    assert "Match" in session.run("EXPLAIN MATCH (n) RETURN n.id AS id").first()[0]


def test_properties_of_edges(session):
    session.run("MATCH (a)-[r:KNOWS]->(b) SET r.since = a.age + b.age, r.kind = 'old'")
    assert rows(session.run("MATCH (a)-[r]->(b) RETURN a.id AS a, r.since AS s, r.kind AS k")) == [(0, 70, "old")]
    session.run("MATCH ()-[r]->() REMOVE r.kind SET r.since = r.since / 2.0")
    assert rows(session.run("MATCH ()-[r]->() RETURN r.since AS s, r.kind AS k")) == [(35.0, None)]


def test_merge_of_patterns(session):
    text = "MERGE (a:Person {name: 'Ann'})-[:OWNS]->(b:Boat {name: $boat})"
    for boat in ("Gull", "Gull", "Tern"):
        session.run(text, boat=boat)
    # the whole pattern is matched or made: another boat brings another Ann
    assert rows(session.run("MATCH (a)-[:OWNS]->(b) RETURN a.name AS a, b.name AS b")) == [("Ann", "Gull"), ("Ann", "Tern")]
    assert rows(session.run("MATCH (p:Person {name: 'Ann'}) RETURN count(*) AS n")) == [(3,)]
    session.run("MATCH (p:Person {id: 1}) MERGE (p)-[:OWNS]->(b:Boat {name: 'Skua'}) ON CREATE SET b.age = 3 ON MATCH SET b.age = 4")
    assert rows(session.run("MATCH (p {id: 1})-[:OWNS]->(b) RETURN b.name AS b, b.age AS a")) == [("Skua", 3)]
    session.run("MATCH (p:Person {id: 1}) MERGE (p)-[:OWNS]->(b:Boat {name: 'Skua'}) ON CREATE SET b.age = 3 ON MATCH SET b.age = 4")
    assert rows(session.run("MATCH (p {id: 1})-[:OWNS]->(b) RETURN b.name AS b, b.age AS a")) == [("Skua", 4)]
