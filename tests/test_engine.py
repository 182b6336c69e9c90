"""Golden values, properties and edge cases of the core engine."""

from __future__ import annotations

import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.catalog import graphs, numbers
from tessera.functions import cypher as fn
from tessera.functions import geo, science
from tessera.graph import PropertyGraph, order_graph
from tessera.harness import load, runner, spec
from tessera.harness.cache import MODES, ResultCache, allows
from tessera.operators import algorithms, checksum, procedures, statistics, traversal
from tessera.plans import cypher, gfql
from tessera.sources import generators, readers, writers
from tessera.streaming import events


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(i, ["P"] + (["Q"] if i % 2 else []), f"n{i}", float(i), i == 0) for i in range(6)], "id bigint, labels array<string>, name string, value double, entry boolean")
    edges = spark.createDataFrame([(0, 0, 1, "A", 1.0), (1, 1, 2, "A", 2.0), (2, 2, 0, "B", 3.0), (3, 2, 3, "A", 4.0), (4, 0, 1, "B", 5.0), (5, 4, 4, "A", 6.0)], "eid bigint, src bigint, dst bigint, type string, weight double")
    return PropertyGraph(nodes, edges)


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


def seeds(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "id bigint")


def test_reach_returns_start_on_a_cycle(spark, graph):
    assert ids(traversal.reach(graph.edges, seeds(spark, 0), 2)) == [1, 2]
    assert ids(traversal.reach(graph.edges, seeds(spark, 0), 3)) == [0, 1, 2, 3]
    assert ids(traversal.reach(graph.edges, seeds(spark, 4), 2)) == [4]
    assert ids(traversal.reach(graph.edges, seeds(spark), 2)) == []


def test_trails_never_repeat_an_edge(spark, graph):
    got = traversal.trails(graph.edges, seeds(spark, 0), 1, 4).collect()
    edges = {r.eid: (r.src, r.dst) for r in graph.edges.collect()}
    want = []

    def walk(at, used):
        for e, (a, b) in edges.items():
            if a == at and e not in used and len(used) < 4:
                want.append((b, *used, e))
                walk(b, (*used, e))

    walk(0, ())
    assert sorted((r.id, *r.eids) for r in got) == sorted(want)
    with pytest.raises(ValueError):
        traversal.trails(graph.edges, seeds(spark, 0), 1, 4, max_rows=1)


def test_undirected_trail_does_not_go_back(spark):
    e = spark.createDataFrame([(0, 0, 1, "A")], "eid bigint, src bigint, dst bigint, type string")
    assert traversal.trails(e, seeds(spark, 0), 2, 2, "both").count() == 0


def test_walk_counts_on_a_multigraph(spark, graph):
    got = {r["id"]: r["n"] for r in traversal.count_walks(graph.edges.where("src < dst"), seeds(spark, 0), 2).collect()}
    assert got == {2: 2}


def test_shortest_path(graph):
    assert traversal.shortest_path(graph.edges, 0, 3) == [0, 2, 3]
    assert traversal.shortest_path(graph.edges, 0, 5) is None
    assert traversal.shortest_path(graph.edges, 3, 3) == [3]
    assert traversal.shortest_path(graph.edges, 0, 3, budget_ms=0) is None


def test_algorithms_against_plain_python(spark):
    draw = random.Random(3)
    pairs = [(draw.randrange(40), draw.randrange(40)) for _ in range(60)]
    nodes = seeds(spark, *range(40))
    e = spark.createDataFrame([(i, a, b, "E") for i, (a, b) in enumerate(pairs)], "eid bigint, src bigint, dst bigint, type string")
    near = {i: set() for i in range(40)}
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    triangles = sum(1 for a, b, c in itertools.combinations(range(40), 3) if b in near[a] and c in near[a] and c in near[b])
    assert algorithms.triangle_count(e).first()["triangles"] == triangles
    root = {}
    for i in range(40):
        todo, seen = [i], {i}
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        root[i] = min(seen)
    assert {r["id"]: r["component"] for r in algorithms.connected_components(nodes, e).collect()} == root
    assert abs(algorithms.pagerank(nodes, e, 10).agg(F.sum("rank")).first()[0] - 1) < 1e-9
    place = algorithms.louvain(nodes, e, 4, 2)
    assert place.count() == 40 and algorithms.modularity(place, e) > algorithms.modularity(nodes.withColumn("community", F.col("id")), e)
    # betweenness from every source
    out = {i: {b for a, b in pairs if a == i and b != i} for i in range(40)}
    score = dict.fromkeys(range(40), 0.0)
    for s in range(40):
        dist, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in out[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        credit = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for w in out[v]:
                if dist[w] == dist[v] + 1:
                    credit[v] += paths[v] / paths[w] * (1 + credit[w])
            if v != s:
                score[v] += credit[v]
    got = {r["id"]: r["betweenness"] for r in algorithms.betweenness(nodes, e, 40).collect()}
    assert all(abs(got[i] - score[i]) < 1e-6 for i in score)


def test_changes_make_new_versions(spark, graph):
    g = graph.create_nodes(spark.createDataFrame([(9, "x")], "id bigint, name string"))
    assert g.snapshot == 1 and g.nodes.count() == 7 and graph.nodes.count() == 6
    g2 = g.create_edges(spark.createDataFrame([(9, 0), (9, 77)], "src bigint, dst bigint"), "NEW")
    assert g2.edges.count() == 7 and g2.edges.agg(F.max("eid")).first()[0] > 5
    with pytest.raises(ValueError):
        graph.delete(F.col("id") == 0)
    assert graph.delete(F.col("id") == 5).nodes.count() == 5
    assert graph.delete(F.col("id") == 0, detach=True).counts() == (5, 3)
    assert graph.set_properties(F.col("id") == 1, {"value": F.lit(7.0)}).node(1).first()["name"] is None
    assert graph.violations("P", "entry", "unique").count() == 5 and graph.violations("P", "name", "exists").count() == 0
    with pytest.raises(ValueError):
        graph.add_constraint("P", "entry", "unique")
    t = graph.add_constraint("P", "name", "unique").transaction().apply("set_property", F.col("id") < 2, "name", F.lit("same"))
    with pytest.raises(ValueError):
        t.commit()
    assert t.rollback().snapshot == 0
    assert graph.create_index("P", "value").show_indexes().count() == 1
    assert graph.degree(0) == 2 and graph.counts_by_label().first()["n"] == 6


def test_cypher_values(spark, graph):
    one = lambda text, **kw: cypher.query(graph, text, **kw).first()[0]
    assert one("RETURN 15 / 3 AS x") == 5 and one("RETURN 2 ^ 10 AS x") == 1024.0 and one("RETURN 7 % 4 AS x") == 3
    assert one("RETURN round(2.5) AS x") == 3.0 and one("RETURN sign(-3.5) AS x") == -1
    assert one("RETURN [1, 2, 3][5] AS x") is None and one("RETURN head([]) AS x") is None
    assert one("RETURN size('abc') AS x") == 3 and one("RETURN split('a.b.c', '.') AS x") == ["a", "b", "c"]
    assert one("RETURN $p AS x", p="it's") == "it's"
    assert one("RETURN 'a' + 'b' AS x") == "ab" and one("RETURN NOT true OR true AND false AS x") is False
    assert one("MATCH (n) RETURN sum(n.value) AS s") == 15.0
    assert one("MATCH (n) WHERE n.nothing IS NULL RETURN count(*) AS c") == 6
    assert one("MATCH (n:Q) RETURN count(n) AS c") == 3
    assert [r.x for r in cypher.query(graph, "MATCH (n) RETURN n.value AS x ORDER BY n.id DESC SKIP 1 LIMIT 2").collect()] == [4.0, 3.0]
    assert ids(cypher.query(graph, "MATCH (a {id: 0})-[:A|B*1..3]->(b) RETURN DISTINCT b.id AS id")) == [0, 1, 2, 3]
    assert cypher.query(graph, "MATCH (a)-[]->(b)-[]->(c) RETURN a.id AS a, c.id AS c").count() == 6
    assert cypher.query(graph, "MATCH (a)-[x]->(b)-[y]->(c) WHERE a.id = 4 RETURN c.id AS c").count() == 0  # a loop is one edge
    for bad in ("RETURN nope(1)", "MATCH (n RETURN n", "FLY (n)"):
        with pytest.raises(SyntaxError):
            cypher.query(graph, bad)


def test_both_languages_agree(graph):
    a = cypher.query(graph, "MATCH (a {id: 0})-[:A*1..2]->(b) RETURN DISTINCT b.id AS id")
    b = gfql.parse(graph, "chain().n({id: 0}).e_forward({type: 'A', max_hops: 2}).n().map(id)").run()
    assert ids(a) == ids(b) == [1, 2]
    assert "Match" in gfql.parse(graph, "chain().n()").explain() and "Match" in cypher.explain(graph, "MATCH (n) RETURN n.id AS id")
    with pytest.raises(SyntaxError):
        gfql.parse(graph, "__import__('os').system('true')")
    assert gfql.parse(graph, "chain().n().group_by(entry).count_by(id).sort_by('count_id').limit(1)").run().first()["count_id"] == 1


def test_procedures(spark, graph):
    assert [tuple(r) for r in procedures.call("frontier_profile", graph, 0, 3).orderBy("depth").collect()] == [(1, 1, 2, 2), (2, 1, 1, 3), (3, 1, 2, 4)]
    assert ids(procedures.call("dead_code", graph), "name") == ["n4", "n5"]
    assert procedures.call("find_path_budgeted", graph, 0, 3, 60000).first()["hops"] == 2
    with pytest.raises(KeyError):
        procedures.call("nope", graph)
    assert procedures.procedures(spark).count() == len(procedures.REGISTRY)
    with procedures.Budget(spark, 200) as b:
        spark.range(10**13).select(F.sum(F.col("id") % 7)).collect()
    assert b.spent


def test_functions(spark):
    assert value(spark, fn.value_type(F.lit(1.5))) == "FLOAT" and value(spark, fn.value_type(F.lit(None))) == "NULL"
    assert value(spark, fn.plus_duration(F.lit("2024-01-31").cast("date"), "P1DT2H")).hour == 2
    assert fn.duration("P1Y2M3DT4H") == (14, 3 * 86400 + 4 * 3600)
    with pytest.raises(ValueError):
        fn.duration("1 day")
    assert abs(value(spark, fn.normal_cdf(F.lit(1.96))) - 0.975) < 1e-4 and abs(value(spark, fn.probit(F.lit(0.975))) - 1.96) < 1e-3
    assert value(spark, fn.range_list(F.lit(3).cast("bigint"), F.lit(1).cast("bigint"))) == []
    assert abs(value(spark, geo.haversine_distance(0, 0, 0, 180)) - np.pi * 6371000) < 1
    assert value(spark, geo.to_mgrs(40.7128, -74.0060))[:5] == "18TWL" and value(spark, geo.to_utm(40.7128, -74.0060))["zone"] == 18
    utm = value(spark, geo.to_utm(40.7128, -74.0060))
    assert abs(utm["easting"] - 583959.37) < 0.5 and abs(utm["northing"] - 4507350.99) < 0.5
    assert value(spark, geo.utm_zone(60.0, 5.0)) == 32 and value(spark, geo.utm_zone(78.0, 10.0)) == 33 and value(spark, geo.to_utm(89.0, 0.0)) is None
    lat, lon = value(spark, geo.destination(50.0, 5.0, 30.0, 100000.0))
    assert abs(value(spark, geo.haversine_distance(50.0, 5.0, lat, lon)) - 100000) < 400
    assert value(spark, geo.is_ahead(0.0, 0.0, 0.0, 10.0, 0.0)) and not value(spark, geo.is_ahead(0.0, 0.0, 180.0, 10.0, 0.0))
    assert abs(value(spark, science.orbital_velocity(6771000.0, science.EARTH_MASS)) - 7672) < 5
    assert abs(value(spark, science.escape_velocity(7e6, 6e24) / science.orbital_velocity(7e6, 6e24)) - 2**0.5) < 1e-12
    assert abs(value(spark, science.gps_correction(20200000.0, 3874.0)) - 0.446) < 0.003
    assert abs(value(spark, science.radar_horizon(30.0, 10.0)) - 35600) < 100 and abs(value(spark, science.ballistic_range(900.0, 45.0)) - 82600) < 50
    assert value(spark, science.lorentz(3e8)) is None and value(spark, science.sound_speed(10.0, 35.0, 0.0)) > 1480
    assert abs(value(spark, science.hohmann(6.678e6, 4.2164e7))[0] - 2425) < 15


def test_bounding_box_never_loses_a_point(spark):
    draw = random.Random(1)
    pts = spark.createDataFrame([(draw.uniform(-90, 90), draw.uniform(-180, 180)) for _ in range(3000)], "lat double, lon double")
    for lat, lon, r in ((0, 0, 2e6), (85, 10, 1e6), (-30, 179, 3e6), (40, -179.5, 5e5), (89, 0, 5e6)):
        near = pts.where(geo.haversine_distance("lat", "lon", lat, lon) <= r)
        assert near.count() == near.where(geo.bounding_box("lat", "lon", lat, lon, r)).count()


def test_statistics_golden(spark):
    xs = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    assert statistics.percentiles(xs, "v", [0.5]).first()["p50"] == 50.5
    d = statistics.descriptive(spark.createDataFrame([(float(i),) for i in (2, 4, 4, 4, 5, 5, 7, 9)], "v double"), "v").first()
    assert d["n"] == 8 and d["mean"] == 5.0
    out = statistics.outliers(spark.createDataFrame([(i, 10.0 if i < 100 else 1e6) for i in range(101)], "i int, v double"), "v")
    assert [r["i"] for r in out.where("outlier").collect()] == [100]

    def two(a, b):
        return spark.createDataFrame([(float(x), False) for x in a] + [(float(x), True) for x in b], "v double, later boolean")

    assert statistics.mann_whitney(two(range(100), range(100)), "v", "later").first()["p_value"] > 0.9
    assert statistics.mann_whitney(two(range(100), range(1000, 1100)), "v", "later").first()["p_value"] < 0.001
    assert statistics.mann_whitney(two([1], [2]), "v", "later").first()["p_value"] is None
    r = statistics.compare_metric(two([100 + i % 3 for i in range(30)], [50 + i % 3 for i in range(30)]), "v", "later").first()
    assert r["change"] == "Improvement" and r["percent"] < -40
    assert statistics.compare_metric(two([50 + i % 3 for i in range(30)], [100 + i % 3 for i in range(30)]), "v", "later").first()["change"] == "Regression"
    series = spark.createDataFrame([(i, 10.0 if i < 50 else 2.0) for i in range(100)], "i int, v double")
    assert statistics.acceleration_point(series, "i", "v", 10, 0.5).first()["point"] == 47
    gaps = spark.createDataFrame([("a", i, None if i == 1 else 1.0) for i in range(8)] + [("b", i, None if i == 7 else 1.0) for i in range(8)], "k string, i int, v double")
    assert {r["k"]: r["recovered"] for r in statistics.recovered(gaps, "i", "v", ["k"]).collect()} == {"a": True, "b": False}
    assert statistics.enough_samples([10.0] * 10) and not statistics.enough_samples([1.0, 100.0] * 5)
    state = statistics.SteadyState()
    steady, changes = state.extend(np.array([50.0] * 5 + [9.0] * 12))
    # the drop starts a regime; nine values of it are five calm ones in a row
    assert state.changes == 1 and state.steady_at == steady.argmax() == 13 and changes.tolist() == [0] * 5 + [1] * 12
    assert not statistics.SteadyState().extend(np.array([1.0, 100.0, 3.0, 77.0] * 20))[0].any()
    rng = np.random.default_rng(3)
    for _ in range(20):  # in blocks of any size
        x = np.concatenate([rng.normal(m, rng.uniform(0.1, 40), int(rng.integers(1, 60))) for m in rng.uniform(1, 90, 4)])
        whole = statistics.SteadyState()
        want = whole.extend(x)
        parts = statistics.SteadyState()
        got = [parts.extend(p) for p in np.split(x, np.sort(rng.integers(0, len(x), 5)))]
        assert (np.concatenate([g[0] for g in got]) == want[0]).all() and (np.concatenate([g[1] for g in got]) == want[1]).all()
        assert parts.steady_at == whole.steady_at and abs(parts.mean - whole.mean) < 1e-9
    flat = spark.createDataFrame([(i, v) for i, v in enumerate([3.0] * 9 + [4.0, 100.0])], "i int, v double")
    scores = {r["i"]: (round(r["score"], 4), r["outlier"]) for r in statistics.outliers(flat, "v").collect()}
    assert scores[10] == (round(0.6745 * 97 / (98 / 11), 4), True) and scores[0] == (0.0, False)
    drawn = spark.range(400).select((F.col("id") % 100).cast("double").alias("v"), F.when(F.col("id") < 390, "big").otherwise("small").alias("k"), "id")
    found = {r["k"]: r for r in statistics.bca_interval(drawn, "v", ["k"], 600, row="id").collect()}
    big = found["big"]
    assert big["lower"] < 48.7 < big["upper"] and 4 < big["upper"] - big["lower"] < 7.5 and abs(big["bias"]) < 0.5
    assert found["small"]["n"] == 10 and statistics.bca_interval(drawn.where("id < 2"), "v", ["k"]).count() == 0
    many = spark.range(20000).select(F.col("id").cast("double").alias("v"), (F.col("id") % 2).alias("k"))
    got = {r["k"]: r for r in statistics.digest_quantiles(statistics.digests(many, "v", ["k"]), [0.01, 0.5, 0.99], ["k"]).collect()}
    for k in (0, 1):
        assert all(abs(got[k][n] - 20000 * p) < 60 for n, p in (("p1", 0.01), ("p50", 0.5), ("p99", 0.99)))
    sizes = statistics.digests(many, "v").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w")).first()
    assert sizes["w"] == 20000 and sizes["n"] < 600
    kind = spark.createDataFrame([(0.01, -10.0), (0.01, 1.0), (0.5, 50.0), (None, 1.0)], "p double, d double").select(statistics.classify_change(F.col("p"), F.col("d")).alias("c"))
    assert [r["c"] for r in kind.collect()] == ["Improvement", "NoChange", "Inconclusive", "Inconclusive"]


def test_checksums(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (2, None, -0.0)], "i bigint, s string, d double")
    b = spark.createDataFrame([(2, None, 0.0), (1, "x", 0.5)], "i bigint, s string, d double")
    c = spark.createDataFrame([(2, None, 0.0), (1, "y", 0.5)], "i bigint, s string, d double")
    assert checksum.set_hash(a) == checksum.set_hash(b) != checksum.set_hash(c)
    assert checksum.fast_hash(c) != checksum.fast_hash(b)
    rows = {r["row"] for r in checksum.canonical_rows(a).collect()}
    assert rows == {checksum.encode_row(r).hex() for r in [(1, "x", 0.5), (2, None, -0.0)]}
    assert checksum.ulp_equal(0.1 + 0.2, 0.3) and not checksum.ulp_equal(1.0, 1.1) and checksum.ulp_equal(float("nan"), float("nan")) and checksum.ulp_equal(0.0, -0.0)
    x = spark.createDataFrame([(0, 0.3), (1, 1.0)], "ordinal bigint, v double")
    y = spark.createDataFrame([(0, 0.1 + 0.2), (1, 1.1), (2, 0.0)], "ordinal bigint, v double")
    assert ids(checksum.differing_rows(x, y), "ordinal") == [1, 2]
    with pytest.raises(TypeError):
        checksum.differing_rows(x, y.withColumn("v", F.col("v").cast("string")))
    paths = spark.createDataFrame([([0, 1, 2],), ([2, 1, 0],), ([0, 2],)], "nodes array<bigint>")
    edges = spark.createDataFrame([(0, 1), (1, 2)], "src bigint, dst bigint")
    faults = {(tuple(r["path"]), r["fault"]) for r in checksum.path_faults(paths, edges, 0, 1, 5, directed=False).collect()}
    assert faults == {((0, 1, 2), "duplicate"), ((0, 2), "no edge")}
    assert checksum.check(a, {"type": "row_count", "expected": 2}) and checksum.check(a, {"type": "invariant", "condition": "i > 0"}) and not checksum.check(a, {"type": "row_count_range", "min": 3})


def test_generators(spark):
    assert generators.chain(spark, 100).count() == 99 and generators.chain(spark, 1).count() == 0
    h = generators.hub(spark, 5, 100)
    assert h.count() == 500 and readers.endpoint_nodes(h).count() == 505
    d = generators.deep(spark, 1, [3, 2])
    assert readers.endpoint_nodes(d).count() == 10 and d.count() >= 9 and generators.deep_nodes(1, [10, 5, 3]) == 1 + 10 + 50 + 150
    assert generators.power_law(spark, 100, 2).count() == generators.power_law_edges(100, 2) == 394
    p = generators.power_law(spark, 2000, 3)
    top = p.groupBy("source").count().agg(F.max("count")).first()[0]
    assert top > 60 and p.where("source = target").count() == 0
    c = generators.community(spark, 4, 50, 0.1, 0.01)
    assert c.where("source = target").count() == 0 and c.where("floor(source / 50) <> floor(target / 50)").count() == 6
    n, e = generators.provenance(spark, 6, 10)
    assert e.where("floor(target / 10) <> floor(source / 10) + 1").count() == 0 and n.count() == 60
    cn, ce = generators.code_graph(spark, 100)
    assert {r["type"] for r in ce.select("type").distinct().collect()} == {"CALLS", "DEFINED_IN", "CONTAINS", "IMPORTS"} and cn.count() == 105
    assert generators.edges(spark, 50, 500).where("source = target").count() == 0
    assert checksum.fast_hash(generators.wide_nodes(spark, 50, 6).repartition(3).drop("labels")) == checksum.fast_hash(generators.wide_nodes(spark, 50, 6).drop("labels"))
    assert generators.geo_nodes(spark, 200, lat=(10, 20)).where("lat < 10 or lat >= 20").count() == 0
    nulls = generators.nodes(spark, 2000, {"x": {"type": "float", "null_share": 0.05}}).where("x is null").count()
    assert 50 < nulls < 150


def test_files(spark, tmp_path):
    e = generators.chain(spark, 4).withColumnRenamed("source", "source")
    assert writers.binary_edges(e, str(tmp_path / "e.bin")) == 48
    assert ids(readers.binary_edges(spark, str(tmp_path / "e.bin")), "target") == [1, 2, 3]
    (tmp_path / "bad.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="whole pairs"):
        readers.binary_edges(spark, str(tmp_path / "bad.bin")).collect()
    (tmp_path / "e.csv").write_text("source,target\n 1 , 2\n3,4\n")
    assert ids(readers.csv_edges(spark, str(tmp_path / "e.csv")), "source") == [1, 3]
    (tmp_path / "e.txt").write_text("# c\n\n1 2\nx y\n3\t4\n")
    assert ids(readers.text_edges(spark, str(tmp_path / "e.txt")), "target") == [2, 4]
    with pytest.raises(Exception):  # noqa: B017
        readers.text_edges(spark, str(tmp_path / "e.txt"), strict=True).collect()
    (tmp_path / "p.csv").write_text("id|id|name\n1|2|x\n")
    assert readers.piped(spark, str(tmp_path / "p.csv"), "a bigint, b bigint, name string").first()["b"] == 2
    made = writers.manifest(spark, str(tmp_path), "t")
    assert writers.verify(spark, str(tmp_path), made) == []
    (tmp_path / "e.csv").write_text("changed")
    (tmp_path / "p.csv").unlink()
    assert writers.verify(spark, str(tmp_path), made) == ["e.csv: differs", "p.csv: missing"]
    edges, nodes = readers.arrays_graph(spark, np.array([[0, 1], [1, 2]]), np.eye(3))
    assert edges.count() == 2 and nodes.first()["feature"] == [1.0, 0.0, 0.0]


def test_harness(spark, graph, tmp_path):
    s = {"name": "scan", "query": "MATCH (n) WHERE n.value > $threshold RETURN n.id AS id", "parameters": {"selectivity": {"default": 0.5}}, "oracle": {"type": "row_count", "expected": 5}, "warm_runs": 2}
    (tmp_path / "s.json").write_text(json.dumps(s))
    (tmp_path / "t.json").write_text("{}")
    found = spec.discover(tmp_path)
    assert found[0][1].name == "scan" and "missing" in found[1][2]
    record = runner.run(graph, found[0][1])
    assert record["outcome"] == "success" and record["rows"] == 5 and len(record["samples"]) == 2 and record["parameters"] == {"threshold": 0.5}
    assert runner.run(graph, found[0][1], {"threshold": 3.5})["outcome"] == "correctness_mismatch"
    assert runner.run(graph, spec.Spec("x", "FLY"))["outcome"] == "unsupported"
    runner.write(record, tmp_path)
    p = runner.profile(graph.edges.groupBy("src").count())
    assert "Exchange" in p["breakers"] and p["segments"] >= 2 and runner.healthy(spark)
    assert spec.literal("[1, 2]") == [1, 2] and spec.literal("true") is True and spec.literal("abc") == "abc"
    out = load.throughput(spark, {"lookup": lambda: graph.node(1).collect(), "expand": lambda: 1 / 0}, 2, 2.0, {"lookup": 3, "expand": 1})
    assert out.latencies and out.failed and 0 < out.error_rate < 1 and out.percentile(0.95, 20) is not None
    assert load.templates(["a", "b"], 4, "round_robin") == ["a", "b", "a", "b"]
    assert load.time_series(lambda: 1 / 0, 2) == [None, None]
    assert load.phases([load.Phase("w", lambda: None, 3)])["w"]["min"] >= 0
    assert load.ingest([spark.range(5), spark.range(5)], str(tmp_path / "in"), 2)[1]["rows"] == 10
    assert runner.transpile_ms(graph, "MATCH (n) RETURN n.id AS id", "cypher", 2) >= 0


def test_results_are_filtered_and_compared(spark, tmp_path):
    for k, (folder, base) in enumerate((("a", 100.0), ("b", 50.0))):
        (tmp_path / folder).mkdir()
        for name, engine in (("scan", "one"), ("sort" if k else "join", "two")):
            record = {"benchmark": name, "engine": engine, "warm_ms": base, "samples": [base + i % 3 for i in range(30)]}
            (tmp_path / folder / f"{name}.json").write_text(json.dumps(record))
    a, b = (str(tmp_path / x) for x in "ab")
    assert [r["benchmark"] for r in readers.results(spark, a).collect()] == ["join", "scan"]
    assert [r["benchmark"] for r in readers.results(spark, a, engine="one").collect()] == ["scan"]
    assert readers.results(spark, a, benchmark="sort").count() == 0
    (row,) = statistics.compare_results(readers.results(spark, a), readers.results(spark, b)).collect()
    assert row["benchmark"] == "scan" and row["change"] == "Improvement" and row["line"].startswith("scan: 101.000 -> 51.000 ms (-49.5 %)")


def test_cache(spark, graph):
    cache = ResultCache(spark, promote=2)
    make = lambda: graph.nodes.select("id")
    for _ in range(5):
        assert cache.get("q", 0, make).count() == 6
    assert cache.stats["hits"] == 3 and cache.stats["promotions"] == 1
    cache.get("q", 1, make)
    assert cache.commit(1) == 1 and cache.hit_rate() == 0.5
    assert allows("approximate", "strict") and not allows("strict", "ranked") and len(MODES) == 5
    cache.get("r", 1, make)
    cache.get("r", 1, make)
    assert cache.audit(1.0) == 0 and cache.as_table().count() == 8


def test_streaming_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, "ab"[i % 2], float(i)) for i in range(60)], "event_id bigint, t string, user_id bigint, event_type string, value double")
    rows = rows.withColumn("ts", F.to_timestamp("t")).drop("t")
    src = str(tmp_path / "src")
    rows.repartition(3).write.parquet(src)
    stream = events.stream(spark, src, 10)
    for name, df, mode in (("win", events.windowed(stream, "10 minutes"), "complete"), ("state", events.steady_state(stream), "update"), ("dup", events.deduplicated(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(map(tuple, spark.table("win").collect())) == sorted(map(tuple, events.windowed(rows, "10 minutes").collect()))
    assert spark.table("state").agg(F.max("n")).first()[0] > 0 and spark.table("dup").count() == 60


def test_registered_betweenness_is_from_fifty_sources(spark):
    data = "/root/testdata/sf0.001"
    g = order_graph(spark, data)
    out = {}
    for a, b in g.edges.where("src <> dst").select("src", "dst").distinct().collect():
        out.setdefault(a, set()).add(b)
    score = dict.fromkeys((r["id"] for r in g.nodes.collect()), 0.0)
    sources = [r["id"] for r in g.nodes.orderBy(F.xxhash64("id"), "id").limit(50).collect()]
    assert len(set(sources)) == 50
    for s in sources:
        dist, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in out.get(v, ()):
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        credit = dict.fromkeys(order, 0.0)
        for v in reversed(order):
            for w in out.get(v, ()):
                if dist[w] == dist[v] + 1:
                    credit[v] += paths[v] / paths[w] * (1 + credit[w])
            if v != s:
                score[v] += credit[v]
    got = {r["id"]: r["betweenness"] for r in graphs.betweenness(spark, data).collect()}
    assert got.keys() == score.keys() and all(abs(got[i] - score[i]) < 1e-5 for i in score)


def test_bootstrap_interval_reads_all_events(spark):
    data = "/root/testdata/sf0.01"
    groups = {}
    for kind, x in spark.read.parquet(f"{data}/events.parquet").select("event_type", "value").where("value is not null").collect():
        groups.setdefault(kind, []).append(float(x))
    got = {r["event_type"]: r for r in numbers.bootstrap_interval(spark, data).collect()}
    assert {k: r["n"] for k, r in got.items()} == {k: len(x) for k, x in groups.items()} and sum(map(len, groups.values())) > 2000
    for k, x in groups.items():
        # as drawn 10000 times, one resample after the other
        x, rng = np.sort(np.array(x)), np.random.default_rng(42)
        means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(10000)])
        error = x.std() / len(x) ** 0.5
        assert abs(got[k]["lower"] - np.quantile(means, 0.025)) < 0.3 * error and abs(got[k]["upper"] - np.quantile(means, 0.975)) < 0.3 * error
        # the bias is how far the resampled means lie from the mean
        assert abs(got[k]["bias"] - (means.mean() - x.mean())) < 1e-5
