"""Joins by distance, time and weight, comparison forms, budgets and binary ranges, on awkward small tables."""

from __future__ import annotations

import heapq
import itertools
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph
from tessera.operators import checksum, procedures, routes, spatial, temporal
from tessera.plans import cypher
from tessera.sources import readers, writers


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("radius", [90_000.0, 1_500_000.0, 9_000_000.0])
def test_distance_joins_equal_every_pair(spark, radius):
    draw = random.Random(int(radius))
    points = [(draw.uniform(-90, 90), draw.uniform(-180, 180)) for _ in range(60)]
    points += [(draw.choice([89.9, -89.9, 90.0, -90.0]), draw.uniform(-180, 180)) for _ in range(20)]  # poles
    points += [(draw.uniform(-2, 2), draw.choice([-1, 1]) * draw.uniform(179.5, 180)) for _ in range(30)]  # the date line
    points += [(10 + draw.gauss(0, 0.2), 20 + draw.gauss(0, 0.2)) for _ in range(60)] + [(10.0, 20.0)] * 5  # a crowd
    rows = [(i, *p) for i, p in enumerate(points)] + [(900, None, 1.0), (901, 1.0, None), (902, float("nan"), 0.0)]
    df = spark.createDataFrame(rows, "id bigint, lat double, lon double")
    near = {(i, j) for (i, a), (j, b) in itertools.product(enumerate(points), repeat=2) if metres(a, b) <= radius}
    assert {(r["id"], r["other"]) for r in spatial.near_pairs(df, df, radius).collect()} == near
    root = list(range(len(points)))
    for _ in points:
        new = [min(root[j] for j in range(len(points)) if (i, j) in near) for i in range(len(points))]
        if new == root:
            break
        root = new
    got = {r["id"]: r["component"] for r in spatial.components(df, radius).collect()}
    assert got == {**dict(enumerate(root)), 900: 900, 901: 901, 902: 902}


def test_routes_equal_dijkstra(spark):
    draw = random.Random(4)
    links = [(draw.randrange(40), draw.randrange(40), draw.choice([0.0, 1.0, 2.5, draw.uniform(0, 20)])) for _ in range(150)] + [(1, 2, None)]
    edges = spark.createDataFrame(links, "src bigint, dst bigint, weight double")

    def costs(start):
        best, heap = {}, [(0.0, (start,))]
        while heap:
            c, way = heapq.heappop(heap)
            if way[-1] in best:
                continue
            best[way[-1]] = (c, way)
            for a, b, w in links:
                if a == way[-1] and w is not None and b not in best:
                    heapq.heappush(heap, (c + w, (*way, b)))
        return best

    seeds = spark.createDataFrame([(0,), (7,), (None,)], "id bigint")
    want = {(s, i): c for s in (0, 7) for i, (c, _) in costs(s).items()}
    got = {(r["seed"], r["id"]): r for r in routes.shortest_routes(edges, seeds, paths=True).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k]["cost"], c, abs_tol=1e-9) for k, c in want.items())
    weight = {}
    for a, b, w in links:
        if w is not None:
            weight[a, b] = min(w, weight.get((a, b), math.inf))
    assert all(math.isclose(sum(weight[s] for s in itertools.pairwise(r["nodes"])), r["cost"], abs_tol=1e-9) and r["nodes"][-1] == r["id"] for r in got.values())
    near = routes.shortest_routes(edges, seeds, delta=3.0, limit=9.0).collect()
    assert {(r["seed"], r["id"]) for r in near} == {k for k, c in want.items() if c <= 9.0}
    with pytest.raises(ValueError, match="negative"):
        routes.shortest_routes(edges.withColumn("weight", -F.col("weight")), seeds)


@pytest.mark.parametrize(("strict", "forward"), list(itertools.product([False, True], repeat=2)))
def test_asof_joins_equal_plain_python(spark, strict, forward):
    draw = random.Random(6)
    key = lambda: draw.choices(["hot", "a", "b", None, "lone"], [60, 10, 10, 5, 1])[0]
    left = [(i, key(), draw.choice([*range(80), None])) for i in range(200)]
    right = [(key(), draw.choice([*range(0, 80, 3), None]), draw.randrange(9)) for _ in range(90)] + [("hot", 30, 3)] * 4
    a, b = spark.createDataFrame(left, "i bigint, k string, t bigint"), spark.createDataFrame(right, "k string, t bigint, v bigint")

    def partner(k, t):
        sign = -1 if forward else 1
        fit = [(sign * u, v) for c, u, v in right if c == k and c is not None and None not in (t, u) and (sign * u < sign * t or u == t and not strict)]
        best = max((u for u, _ in fit), default=None)
        return None if best is None else (sign * best, max(v for u, v in fit if u == best))

    want = sorted((i, *(partner(k, t) or (None, None))) for i, k, t in left)
    got = temporal.asof_join(a, b, "t", ["k"], strict=strict, forward=forward)
    assert sorted((r["i"], r["asof_t"], r["asof_v"]) for r in got.collect()) == want
    close = temporal.asof_join(a, b, "t", ["k"], how="inner", strict=strict, forward=forward, tolerance=F.lit(2))
    times = {i: t for i, _, t in left}
    assert sorted(r["i"] for r in close.collect()) == [i for i, u, _ in want if u is not None and abs(times[i] - u) <= 2]


def test_interval_joins_equal_plain_python(spark):
    draw = random.Random(9)
    spans = [(i, draw.choice("ab"), s, s + draw.choice([0, 1, 7, 60, 3000, 100_000])) for i, s in enumerate(draw.randrange(-5000, 5000) for _ in range(60))]
    points = [(i, draw.choice("ab"), draw.randrange(-6000, 6000)) for i in range(150)] + [(999, "a", None)]
    s = spark.createDataFrame(spans, "span bigint, k string, since bigint, until bigint")
    p = spark.createDataFrame(points, "p bigint, k string, t bigint")
    want = sorted((i, j) for i, k, t in points for j, c, a, b in spans if t is not None and k == c and a <= t < b)
    for unit in (1.0, 50.0):
        assert sorted((r["p"], r["span"]) for r in temporal.points_in_spans(p, s, "t", "since", "until", ["k"], unit).collect()) == want
    other = s.select("k", *[F.col(c).alias(f"{c}2") for c in ("span", "since", "until")])
    both = sorted((i, j) for (i, k, a, b), (j, c, x, y) in itertools.product(spans, repeat=2) if k == c and a < b and x < y and a < y and x < b)
    assert sorted((r["span"], r["span2"]) for r in temporal.overlapping(s, other, ("since", "since2"), ("until", "until2"), ["k"], 10.0).collect()) == both


def test_comparison_forms(spark):
    a = spark.createDataFrame([(1, "é", 0.0), (1, "é", 0.0), (2, None, float("nan"))], "x bigint, s string, d double")
    b = spark.createDataFrame([(1, "e\u0301", -0.0), (1, "e\u0301", 0.0), (2, None, float("nan"))], "x bigint, s string, d double")
    assert checksum.exact_differences(a, b).count() == 2 and checksum.exact_differences(a, b, composed=True).isEmpty()
    assert checksum.exact_differences(a, a.distinct()).select("times_left", "times_right").collect() == [(2, 1)]
    ways = spark.createDataFrame([([1, 2, 3],), ([3, 2, 1],), ([5],)], "nodes array<bigint>")
    once = spark.createDataFrame([([1, 2, 3],), ([5],)], "nodes array<bigint>")
    counts = {(kind, directed): checksum.path_differences(ways, once, kind, directed).count() for kind in checksum.DUPLICATES for directed in (True, False)}
    assert counts == {("allowed", True): 1, ("allowed", False): 1, ("deduplicated", True): 1, ("deduplicated", False): 1, ("unspecified", True): 1, ("unspecified", False): 0}
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src bigint, dst bigint")
    assert sorted(map(tuple, checksum.degree_distribution(edges).collect())) == [(1, 1), (2, 1)]
    expected = spark.createDataFrame([(2, 3), (7, 1)], "degree bigint, nodes bigint")
    assert sorted(map(tuple, checksum.degree_faults(edges, expected, "both").collect())) == [(7, 0, 1)]
    found = spark.createDataFrame([(4, [1, 2]), (4, [1, 2, 3])], "seed bigint, path array<bigint>")
    assert checksum.check(found, {"type": "structural", "max_depth": 3, "seed_id": 4})
    assert not checksum.check(found, {"type": "structural", "max_depth": 2}) and not checksum.check(found, {"type": "structural", "seed_id": 5})
    assert checksum.check(found, {"type": "invariant", "invariants": ["all_paths_length_le:3"], "expected_row_count_min": 1, "expected_row_count_max": 2})
    assert not checksum.check(found, {"type": "invariant", "invariants": ["all_paths_length_le:2"]}) and not checksum.check(found, {"type": "invariant", "invariants": ["another:2"]})


def test_a_budget_stops_a_query_text(spark):
    graph = PropertyGraph(spark.range(2000).selectExpr("id", "array('N') AS labels"), spark.range(1).selectExpr("id AS eid", "id AS src", "id AS dst", "'E' AS type"))
    assert cypher.query(graph, "CALL procedures() YIELD name WITH name WHERE name = 'pagerank' RETURN count(*) AS n").first()[0] == 1
    assert cypher.query(graph, "CALL functions() YIELD name RETURN count(*) > 20 AS many").first()[0]
    cypher.query(graph, "CALL query_budget(60)").collect()
    try:
        with pytest.raises(TimeoutError):
            cypher.query(graph, "MATCH (a), (b), (c) WHERE a.id + b.id + c.id = 3 RETURN count(*) AS n")
        cypher.query(graph, "CALL query_budget(60000)").collect()
        assert cypher.query(graph, "MATCH (a) RETURN count(*) AS n").first()[0] == 2000
    finally:
        procedures.query_budget(graph, 0).collect()


def test_binary_files_are_read_in_ranges(spark, tmp_path):
    pairs = spark.range(5000).selectExpr("id AS source", "id * 3 AS target").repartition(3)
    writers.binary_edge_files(pairs, f"file://{tmp_path}/out")
    writers.binary_edge_files(pairs, f"file://{tmp_path}/out")  # again: files are replaced
    back = readers.binary_edges(spark, f"file://{tmp_path}/out/*.bin", range_bytes=1000)
    assert back.rdd.getNumPartitions() >= 80 and back.exceptAll(pairs).isEmpty() and back.count() == 5000
    (tmp_path / "odd.bin").write_bytes(b"123")
    with pytest.raises(ValueError, match="whole pairs"):
        readers.binary_edges(spark, f"file://{tmp_path}/odd.bin")
    (tmp_path / "none.bin").write_bytes(b"")
    assert readers.binary_edges(spark, f"file://{tmp_path}/none.bin").count() == 0
    (tmp_path / "big.bin").write_bytes(struct.pack("<QQ", 1 << 63, 1))
    with pytest.raises(Exception, match="beyond"):
        readers.binary_edges(spark, f"file://{tmp_path}/big.bin").collect()
