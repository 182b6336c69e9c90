"""Steps whose work or memory once grew faster than their input."""

from __future__ import annotations

import collections
import contextlib
import io
import itertools
import math
import random
import struct

from tessera.catalog import graphs, more, patterns
from tessera.graph import PropertyGraph, order_graph
from tessera.operators import algorithms, routes, spatial, temporal, traversal, vector
from tessera.plans import cypher, logical
from tessera.sources import readers
from tests.conftest import DATA


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue().lower()


def test_forward_asof_frames_grow_from_their_start(spark):
    draw = random.Random(3)
    left = [(i, draw.choice("ab"), draw.randrange(400)) for i in range(300)]
    right = [(i, draw.choice("ab"), draw.randrange(400)) for i in range(200)]
    a, b = spark.createDataFrame(left, "i bigint, k string, t bigint"), spark.createDataFrame(right, "j bigint, k string, t bigint")
    out = temporal.asof_join(a, b.select("k", "t", "j"), "t", ["k"], strict=True, forward=True)
    # a frame that ends at the partition's last row is evaluated anew for each of its rows
    assert "currentrow$(), unboundedfollowing$()" not in plan_of(out)
    want = {i: min(((u, -j) for j, m, u in right if m == k and u > t), default=(None, None)) for i, k, t in left}
    assert {r["i"]: (r["asof_t"], r["asof_j"]) for r in out.collect()} == {i: (u, -j if u is not None else None) for i, (u, j) in want.items()}


def _vectors(spark):
    draw = random.Random(5)
    rows = [(i, i % 2, [draw.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(100 + i, 0, [1.0, 2.0, 3.0, 4.0]) for i in range(30)]  # copies
    rows += [(200 + i, 1, [0.0] * 4) for i in range(3)] + [(210, 1, None), (211, 1, [1.0, None, 1.0, 1.0]), (212, 1, [1.0, 2.0]), (213, None, [1.0] * 4)]

    def cosine(a, b):
        if a is None or b is None or None in a + b or len(a) != len(b):
            return None
        below = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b, strict=True)) / below if below else None

    pairs = [(a[0], b[0], cosine(a[2], b[2])) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] is not None]
    return spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>"), pairs


def test_pairs_are_compared_in_blocks_and_copies_once(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 7)
    table, pairs = _vectors(spark)
    found = [s for _, _, s in pairs if s is not None and s >= 0.6]
    got = vector.similar_pairs(table, 0.6).first()
    assert got["pairs"] == len(found) > 435 and abs(got["total"] - sum(found)) < 1e-9
    assert vector.similar_pairs(table, 1.5).first().asDict() == {"pairs": 0, "total": None}


def test_similar_clusters_expand_no_copies(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 7)
    table, pairs = _vectors(spark)
    links = [(a, b, s) for a, b, s in pairs if s is not None and s >= 0.9]
    root = {i: i for i in {x for a, b, _ in links for x in (a, b)}}
    for _ in root:
        for a, b, _ in links:
            root[a] = root[b] = min(root[a], root[b])
    want = {}
    for c in set(root.values()):
        own = [s for a, _, s in links if root[a] == c]
        want[c] = (sorted(i for i in root if root[i] == c), sum(own) / len(own))
    got = {r["cluster_id"]: (r["members"], r["avg_similarity"]) for r in vector.similar_clusters(table, 0.9, listed=True).collect()}
    assert got.keys() == want.keys() and any(len(m) > 29 for m, _ in got.values())
    assert all(got[c][0] == want[c][0] and abs(got[c][1] - want[c][1]) < 1e-9 for c in want)


def test_clusters_keep_no_row_for_every_link(spark, monkeypatch):
    monkeypatch.setattr(vector, "BLOCK", 40)
    draw = random.Random(7)
    rows = [(i, 0, [1 + draw.gauss(0, 0.01) for _ in range(4)]) for i in range(150)] + [(150 + i, 0, [float(i == k) for k in range(4)]) for i in range(4)]
    kept = {}
    monkeypatch.setattr(vector, "materialize", lambda df, name, old=vector.materialize: kept.setdefault(name, old(df, name)))
    got = vector.similar_clusters(spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>"), 0.9).collect()
    pairs = list(itertools.combinations(rows[:150], 2))
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    mean = sum(sum(x * y for x, y in zip(a[2], b[2], strict=True)) / norm(a[2]) / norm(b[2]) for a, b in pairs) / len(pairs)
    assert [(r["cluster_id"], r["members"]) for r in got] == [(0, 150)] and abs(got[0]["avg_similarity"] - mean) < 1e-9
    assert kept["links"].count() < len(pairs) / 5


def test_pairs_of_edges_are_counted_without_a_limit_of_rows(spark, monkeypatch):
    links = [(i, i % 5, (i * 3 + 1) % 5) for i in range(20)] + [(20, 2, 2)]
    g = PropertyGraph(spark.createDataFrame([(i, ["N"]) for i in range(5)], "id bigint, labels array<string>"), spark.createDataFrame([(*x, "T") for x in links], "eid bigint, src bigint, dst bigint, type string"))

    def refused(*args, **kw):
        raise ValueError("more trails than the limit")

    monkeypatch.setattr(traversal, "trails", refused)
    for low, hops in ((2, (2,)), (0, (0, 1, 2))):
        got = {r["x"]: r["n"] for r in cypher.query(g, f"MATCH (a)-[*{low}..2]->(b) RETURN a.id AS x, count(b) AS n").collect()}
        ways = [a for _, a, _ in links] * (1 in hops) + [a for e, a, b in links for f, c, _ in links if b == c and e != f] + list(range(5)) * (0 in hops)
        assert got == {x: ways.count(x) for x in set(ways)}


def _metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000.0 * math.asin(math.sqrt(min(1.0, h)))


def _points():
    draw = random.Random(8)
    crowd = [(10 + draw.gauss(0, 0.01), 20 + draw.gauss(0, 0.01)) for _ in range(80)] + [(10.0, 20.0)] * 40
    rest = [(draw.uniform(-90, 90), draw.uniform(-180, 180)) for _ in range(40)] + [(90.0, 5.0), (-90.0, 0.0), (0.0, 180.0), (0.0, -180.0)]
    return list(enumerate(crowd + rest))


def test_nearest_search_places_once_and_widen(spark, monkeypatch):
    monkeypatch.setattr(spatial, "CROWD", 5)
    points = _points()
    df = spark.createDataFrame([(i, *p) for i, p in points] + [(900, None, 1.0)], "id bigint, lat double, lon double")
    rows, sites = df.where("id % 3 <> 0"), df.where("id % 3 = 0")
    searched = []
    monkeypatch.setattr(spatial, "_met", lambda a, b, grid, radius, parts, met=spatial._met: searched.append((radius, a.count())) or met(a, b, grid, radius, parts))
    got = {(r["id"], r["rank"]): (r["other"], round(r["meters"], 3)) for r in spatial.nearest(rows, sites, 8_000_000.0, 3).collect()}
    want = {}
    for i, p in points:
        if i % 3:
            near = sorted((m, j) for j, q in points if j % 3 == 0 and (m := _metres(p, q)) <= 8_000_000)[:3]
            want |= {(i, k + 1): (j, round(m, 3)) for k, (m, j) in enumerate(near)}
    assert got == want
    # points of one place are searched once, and only the rest goes on to greater distances
    places = len({p for i, p in points if i % 3})
    assert searched[0][1] <= places + 1 < len([i for i, _ in points if i % 3]) and searched[-1][1] < places / 2 and searched[0][0] < searched[-1][0]


def test_near_pairs_compare_places_and_spread_them(spark, monkeypatch):
    monkeypatch.setattr(spatial, "HELD", 7)
    points = _points()
    df = spark.createDataFrame([(i, *p) for i, p in points], "id bigint, lat double, lon double")
    met = []
    monkeypatch.setattr(spatial, "_met", lambda *args, old=spatial._met: met.append(old(*args)) or met[-1])
    got = [(r["id"], r["other"]) for r in spatial.near_pairs(df, df, 1000.0).collect()]
    assert sorted(got) == [(i, j) for i, p in points for j, q in points if _metres(p, q) <= 1000]
    assert met[0].count() < len(got) / 2


def test_tiny_ranges_of_binary_files_are_joined(tmp_path):
    (tmp_path / "a.bin").write_bytes(b"".join(struct.pack("<QQ", i, i + 1) for i in range(5000)))
    reader = readers.PairReader([(f"file://{tmp_path}/a.bin", 80_000)], 16)
    parts = reader.partitions()
    assert 100 <= len(parts) <= readers.TASKS
    assert [x for p in parts for batch in reader.read(p) for x in batch.column(0).to_pylist()] == list(range(5000))
    # never beyond the bytes of a task, however many ranges there are
    assert {p.value[2] for p in readers.PairReader([("b", 1 << 40)], 1 << 20).partitions()} == {readers.RANGE_BYTES}


def test_no_sketch_for_every_user(spark):
    plan = plan_of(more.approximate_distinct(spark, DATA)).split("== physical plan ==")[1]
    sketches = [line for line in plan.splitlines() if "approx_count_distinct" in line]
    assert sketches and not any("keys=[event_type#" in line and "user_id" in line.split("functions=")[0] for line in sketches)


def test_pairs_of_a_basket_are_dealt_out_before_they_are_counted(spark, tmp_path):
    rows = [(order, part) for order in range(300) for part in random.Random(order).choices(range(60), k=4)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = graphs.cooccurrence(spark, str(tmp_path))
    plan = plan_of(out).split("== physical plan ==")[1]
    # both steps of the aggregation stand above the exchange by pairs, whose partitions are not merged
    assert plan.rindex("hashaggregate(keys=[a#") < plan.index("repartition_by_num")
    want = {}
    for a, b in itertools.product(rows, rows):
        if a[0] == b[0] and a[1] < b[1]:
            want[a[1], b[1]] = want.get((a[1], b[1]), 0) + 1
    assert {(r["a"], r["b"]): r["n"] for r in out.collect()} == {k: n for k, n in want.items() if n > 1}


def test_groups_by_node_carry_only_its_id(spark):
    plan = plan_of(patterns.cypher_match_after_aggregate(spark, DATA)).split("== physical plan ==")[1]
    assert "c_custkey" in plan and "c_name" not in plan and "c_mktsegment" not in plan
    g = order_graph(spark, DATA)
    rows = cypher.query(g, "MATCH (a) OPTIONAL MATCH (a)-[]->(b) WITH b, count(a) AS n RETURN b, b.name AS name, n").collect()
    names = {r["id"]: r["name"] for r in g.nodes.collect()}
    into = [r["dst"] for r in g.edges.collect()]
    assert all(r["name"] == (names[r["b"]["id"]] if r["b"] is not None else None) for r in rows)
    assert {r["b"]["id"]: r["n"] for r in rows if r["b"] is not None} == {x: into.count(x) for x in set(into) if x in names}


def test_louvain_sends_no_table_through_the_driver(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(algorithms, "materialize", lambda df, name, old=algorithms.materialize: plans.append(plan_of(df)) or old(df, name))
    g = order_graph(spark, DATA)
    place = algorithms.louvain(g.nodes, g.edges, rounds=1, passes=1)
    assert place.count() == g.nodes.count() and any("sortmergejoin" in p for p in plans) and not any("broadcast" in p for p in plans)


def test_louvain_moves_an_edge_once_a_round(spark, monkeypatch):
    draw = random.Random(9)
    links = [(g + draw.randrange(8), g + draw.randrange(8)) for g in range(0, 48, 8) for _ in range(30)] + [(draw.randrange(48), draw.randrange(48)) for _ in range(30)]
    links += [(3, k) for k in range(50, 120)] + [(7, 300), (300, 301), (5, 5), (None, 6)]  # a hub, ends that are no nodes, loops
    monkeypatch.setattr(algorithms, "BLOCK", 30)
    plans, old = {}, algorithms.materialize
    monkeypatch.setattr(algorithms, "materialize", lambda df, name: plans.setdefault(name, plan_of(df).split("== physical plan ==")[1]) and old(df, name))
    nodes = spark.createDataFrame([(i,) for i in range(130)], "id bigint")
    got = {r["id"]: r["community"] for r in algorithms.louvain(nodes, spark.createDataFrame(links, "src bigint, dst bigint"), 3, 2).collect()}

    pairs = collections.Counter((min(ends), max(ends)) for ends in ([x for x in link if x is not None] for link in links))
    ids = sorted({x for pair in pairs for x in pair})
    turns = {(r["v"], r["t"]): r["may"] for r in spark.createDataFrame([(v, t) for v in ids for t in (0, 1, 2, 100, 101, 102)], "v bigint, t int").selectExpr("v", "t", "pmod(xxhash64(v, t), 2) = 0 AS may").collect()}
    place, m2 = {i: i for i in range(130)}, 2 * sum(pairs.values())
    for level in range(2):
        near, k = collections.defaultdict(collections.Counter), collections.Counter()
        for (a, b), w in pairs.items():
            k[a] += w
            k[b] += w
            if a != b:
                near[a][b] += w
                near[b][a] += w
        label = {v: v for v in k}
        for at in range(3):
            size, new = collections.Counter(), {}
            for v, c in label.items():
                size[c] += k[v]
            for v, own in label.items():
                into = collections.Counter()
                for b, w in near[v].items():
                    into[label[b]] += w
                gain = {c: n - k[v] * (size[c] - (k[v] if c == own else 0)) / m2 for c, n in into.items()}
                loss, best = min(((-round(x, 9), c) for c, x in gain.items()), default=(0, own))
                new[v] = best if turns[v, level * 100 + at] and -loss > gain.get(own, 0) + 1e-9 else own
            label = new
        place = {i: label.get(c, c) for i, c in place.items()}
        merged = collections.Counter()
        for (a, b), w in pairs.items():
            merged[tuple(sorted((label[a], label[b])))] += w
        pairs = merged
    assert got == place and len(set(place.values())) < 60
    # only the strengths of communities are joined to nodes; edges meet nodes by block, and those of a large block in parts
    assert plans["label0"].count("sortmergejoin") <= 2 and "explode(" in plans["label0"]


def test_pagerank_joins_once_a_round(spark, monkeypatch):
    draw = random.Random(4)
    ids = range(12)
    links = [(draw.randrange(10), draw.randrange(12)) for _ in range(40)] + [(0, k) for k in range(1, 9)] + [(3, 99), (99, 3)]  # 10 and 11 have no way out, 99 is no node
    plans = []
    monkeypatch.setattr(algorithms, "LISTED", 3)
    monkeypatch.setattr(algorithms, "materialize", lambda df, name, old=algorithms.materialize: plans.append((name, plan_of(df).split("== physical plan ==")[1])) or old(df, name))
    got = {r["id"]: r["rank"] for r in algorithms.pagerank(spark.createDataFrame([(i,) for i in ids], "id bigint"), spark.createDataFrame(links, "src bigint, dst bigint"), 6).collect()}
    rank = dict.fromkeys(ids, 1 / 12)
    for _ in range(6):
        out = {i: [b for a, b in links if a == i] for i in ids}
        lost = sum(rank[i] for i in ids if not out[i])
        rank = {i: 0.15 / 12 + 0.85 * (sum(rank[a] * out[a].count(i) / len(out[a]) for a in ids if out[a]) + lost / 12) for i in ids}
    assert got.keys() == rank.keys() and all(abs(got[i] - rank[i]) < 1e-12 for i in ids)
    rounds = [p for name, p in plans if name != "steps"]
    # a round passes the table before it on once; it once summed it up a second time for what was lost
    assert len(rounds) == 6 and all(p.count("join ") + p.count("join(") <= 1 and "nestedloop" not in p for p in rounds)


def test_a_step_of_routes_writes_one_table(spark, monkeypatch):
    draw = random.Random(9)
    links = [(k, k + 1, 1.0) for k in range(8)] + [(draw.randrange(9), draw.randrange(12), draw.randrange(1, 30) / 4) for _ in range(30)] + [(2, 5, None)]
    written = []
    monkeypatch.setattr(routes, "materialize", lambda df, name, old=routes.materialize: written.append(name) or old(df, name))
    got = {(r["seed"], r["id"]): r["cost"] for r in routes.shortest_routes(spark.createDataFrame(links, "src bigint, dst bigint, weight double"), spark.createDataFrame([(0,), (4,)], "id bigint")).collect()}
    want = {(0, 0): 0.0, (4, 4): 0.0}
    for _ in range(12):
        for (s, a), c in list(want.items()):
            for x, b, w in links:
                if x == a and w is not None:
                    want[s, b] = min(want.get((s, b), c + w), c + w)
    assert got == want
    # a relaxation once took four tables, and each bucket five more
    assert len(written) < 20 and set(written) == {"steps", "known"}


def test_betweenness_moves_one_row_an_edge(spark, monkeypatch):
    draw = random.Random(9)
    links = {(draw.randrange(30), draw.randrange(30)) for _ in range(90)} | {(i, 0) for i in range(30)} | {(0, i) for i in range(20)}
    nodes, edges = spark.range(30), spark.createDataFrame(sorted(links), "src bigint, dst bigint")
    kept = {}
    monkeypatch.setattr(algorithms, "materialize", lambda df, name, old=algorithms.materialize: kept.setdefault(name, []).append(old(df, name)) or kept[name][-1])
    found = {r["id"]: r["betweenness"] for r in algorithms.betweenness(nodes, edges, 30).collect()}
    assert kept["layer2"][0].count() <= 30 and all(t.count() <= 30 for t in kept["credit"])
    # nodes of many edges, and sums of few numbers at a time
    monkeypatch.setattr(algorithms, "HUB", 5)
    monkeypatch.setattr(algorithms, "CELLS", 60)
    again = {r["id"]: r["betweenness"] for r in algorithms.betweenness(nodes, edges, 30).collect()}
    assert found[0] > 100 and all(abs(found[i] - again[i]) < 1e-9 for i in range(30))


def test_steps_that_an_edge_closes_are_cut_where_they_are_made(spark, monkeypatch):
    draw = random.Random(11)
    links = [(i, draw.randrange(20), draw.randrange(20)) for i in range(120)] + [(120 + i, 3, 3) for i in range(3)] + [(130 + i, i, 5) for i in range(20)]
    g = PropertyGraph(spark.createDataFrame([(i, ["N"]) for i in range(20)], "id bigint, labels array<string>"), spark.createDataFrame([(*x, "T") for x in links], "eid bigint, src bigint, dst bigint, type string"))
    threes = [t for t in itertools.permutations(links, 3) if t[0][2] == t[1][1] and t[1][2] == t[2][1]]
    for text, closes in (("(c)-[]->(a)", lambda t: t[2][2] == t[0][1]), ("(a)<-[]-(c)", lambda t: t[2][2] == t[0][1])):
        want = {}
        for t in filter(closes, threes):
            want[t[0][1]] = want.get(t[0][1], 0) + 1
        for most in (1000, 8):  # with nodes of more edges than are listed
            monkeypatch.setattr(logical, "ENDS", most)
            df = cypher.query(g, f"MATCH (a)-[]->(b)-[]->(c), {text} RETURN a.id AS id, count(*) AS n")
            assert "ends_" in plan_of(df) and {r["id"]: r["n"] for r in df.collect()} == want
    back = [t for t in itertools.permutations(links, 3) if t[0][2] == t[1][1] and t[1][2] == t[2][2] and t[2][1] == t[0][1]]
    assert cypher.query(g, "MATCH (a)-[]->(b)-[]->(c)<-[]-(a) RETURN count(*) AS n").first()["n"] == len(back)
