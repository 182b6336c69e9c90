"""The same questions through both query languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query
from tessera.graph import order_graph
from tessera.plans import cypher, gfql


@query("WITH {graph} SELECT id, value FROM n WHERE value > 5000")
def cypher_scan(spark, d):
    return cypher.query(order_graph(spark, d), "MATCH (n:Customer) WHERE n.value > $t RETURN n.id AS id, n.value AS value", t=5000)


@query("WITH {graph} SELECT src, count(*) AS deg FROM e WHERE src < 10000 GROUP BY 1 HAVING count(*) > 3 ORDER BY deg DESC, src LIMIT 100")
def cypher_segmentation(spark, d):
    return cypher.query(order_graph(spark, d), "MATCH (n)-[e]->(m) WHERE n.id < 10000 WITH n.id AS src, count(m) AS deg WHERE deg > 3 RETURN src, deg ORDER BY deg DESC, src LIMIT 100")


@query("WITH {graph} SELECT a.src AS x, b.dst AS z, count(*) AS n FROM e a JOIN e b ON a.dst = b.src AND a.eid <> b.eid GROUP BY 1, 2")
def cypher_two_hops(spark, d):
    return cypher.query(order_graph(spark, d), "MATCH (a)-[]->(b)-[]->(c) RETURN a.id AS x, c.id AS z, count(*) AS n")


@query("WITH RECURSIVE {graph}, r(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 3) SELECT DISTINCT id, category FROM r JOIN n USING (id) WHERE depth > 0")
def cypher_reach(spark, d):
    return cypher.query(order_graph(spark, d), "MATCH (a {id: 1})-[*1..3]->(b) RETURN DISTINCT b.id AS id, b.category AS category")


@query("WITH {graph} SELECT a.src AS x, count(*) AS n FROM e a JOIN e b ON a.dst = b.src AND a.eid <> b.eid GROUP BY 1")
def cypher_trail_counts(spark, d):
    return cypher.query(order_graph(spark, d), "MATCH (a)-[*2..2]->(b) RETURN a.id AS x, count(b) AS n")


@query("WITH {graph} SELECT n.id, count(e.eid) AS k FROM n LEFT JOIN e ON e.src = n.id AND e.type = '1-URGENT' GROUP BY 1")
def cypher_optional(spark, d):
    g = order_graph(spark, d)
    g = type(g)(g.nodes, g.edges.withColumn("type", F.regexp_replace("type", r"^\d-", "")))
    return cypher.query(g, "MATCH (n) OPTIONAL MATCH (n)-[e:URGENT]->(m) RETURN n.id AS id, count(m) AS k")


@query("WITH {graph} SELECT id FROM n WHERE EXISTS (SELECT 1 FROM e WHERE e.src = n.id) AND NOT EXISTS (SELECT 1 FROM e WHERE e.dst = n.id)")
def cypher_exists(spark, d):
    return cypher.query(order_graph(spark, d), "MATCH (n) WHERE EXISTS { MATCH (n)-[]->() } AND NOT EXISTS { MATCH (n)<-[]-() } RETURN n.id AS id")


@query("SELECT 5::BIGINT AS quotient, 8.0::DOUBLE AS power, 'ell' AS part, 3::BIGINT AS size_, 'b' AS kind, '4,6' AS xs, true AS both_, 2::BIGINT AS second")
def cypher_expressions(spark, d):
    out = cypher.query(order_graph(spark, d), "RETURN 15 / 3 AS quotient, 2 ^ 3 AS power, substring('hello', 1, 3) AS part, size([1, 2, 3]) AS size_, CASE WHEN 1 > 2 THEN 'a' ELSE 'b' END AS kind, [x IN [1, 2, 3] WHERE x > 1 | x * 2] AS xs, true XOR false AS both_, [1, 2, 3][1] AS second")
    return out.withColumn("xs", F.array_join(F.col("xs").cast("array<string>"), ","))


@query("SELECT x, 'odd' AS kind FROM (VALUES (1::BIGINT), (3)) t(x) UNION SELECT x, 'even' FROM (VALUES (2::BIGINT)) t(x)")
def cypher_union(spark, d):
    return cypher.query(order_graph(spark, d), "UNWIND [1, 3, 3] AS x RETURN x AS x, 'odd' AS kind UNION UNWIND [2] AS x RETURN x AS x, 'even' AS kind")


@query("WITH {graph} SELECT type, count(*) AS n FROM e GROUP BY 1")
def cypher_call(spark, d):
    return cypher.query(order_graph(spark, d), "CALL edge_aggregate() YIELD type, count AS n")


@query("WITH {graph} SELECT category, count(id) AS count_id, round(avg(value), 4) AS avg_value FROM n GROUP BY 1")
def gfql_aggregate(spark, d):
    out = gfql.parse(order_graph(spark, d), "chain().n({label: 'Customer'}).group_by(category).count_by(id).avg_by(value)").run()
    return out.withColumn("avg_value", F.round("avg_value", 4))


@query("WITH {graph} SELECT id, value FROM n WHERE value > 5000 AND nation = 3")
def gfql_scan_filter(spark, d):
    return gfql.parse(order_graph(spark, d), "chain().n({nation: 3}).filter('value', '>', 5000).map('id', 'value')").run()


@query("WITH RECURSIVE {graph}, r(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 2) SELECT DISTINCT id FROM r WHERE depth > 0")
def gfql_traversal(spark, d):
    return gfql.chain(order_graph(spark, d)).n({"id": 1}).e_forward({"max_hops": 2}).n().map("id").run()


@query("WITH {graph} SELECT DISTINCT src AS id FROM e WHERE dst = 7 ORDER BY id LIMIT 5")
def gfql_reverse(spark, d):
    return gfql.parse(order_graph(spark, d), "chain().n({'id': 7}).e_reverse().n().sort_by('id').limit(5).map('id')").run()


@query("WITH {graph} SELECT id FROM n WHERE nation = 3 AND category = 'BUILDING'")
def gfql_context(spark, d):
    return gfql.chain(order_graph(spark, d), nation=3).n({"category": "BUILDING"}).map("id").run()
