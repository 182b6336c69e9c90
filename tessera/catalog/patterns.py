"""Patterns of one MATCH whose edges differ, nested patterns, and values without alias."""

from __future__ import annotations

from tessera.catalog import query
from tessera.graph import order_graph
from tessera.plans import cypher

_TRAILS = "RECURSIVE {graph}, t(id, eids, hops) AS (SELECT dst, [eid], 1 FROM e WHERE src = 7 UNION ALL SELECT e.dst, list_append(t.eids, e.eid), t.hops + 1 FROM t JOIN e ON e.src = t.id AND NOT list_contains(t.eids, e.eid) WHERE t.hops < 4)"


def _ask(spark, d, text: str, **params):
    return cypher.query(order_graph(spark, d), text, **params)


@query("WITH {graph} SELECT r.src AS id, count(*) AS n FROM e r JOIN e t ON t.src = r.src AND t.eid <> r.eid WHERE r.weight > 200000 AND t.weight < 50000 GROUP BY 1")
def cypher_fork_pairs(spark, d):
    return _ask(spark, d, "MATCH (a)-[r]->(b), (a)-[t]->(c) WHERE r.weight > 200000 AND t.weight < 50000 RETURN a.id AS id, count(*) AS n")


@query("WITH {graph} SELECT least(r.src, t.src) AS low, greatest(r.src, t.src) AS high, count(*) AS n FROM e r JOIN e t ON t.dst = r.dst AND t.src > r.src WHERE r.dst < 200 GROUP BY 1, 2")
def cypher_common_targets(spark, d):
    return _ask(spark, d, "MATCH (a)-[]->(x), (b)-[]->(x) WHERE x.id < 200 AND a.id < b.id RETURN a.id AS low, b.id AS high, count(*) AS n")


@query("WITH {graph} SELECT a.src AS id, count(*) AS n FROM e a JOIN e b ON b.src = a.dst AND b.eid <> a.eid JOIN e c ON c.src = b.dst AND c.dst = a.src AND c.eid <> a.eid AND c.eid <> b.eid GROUP BY 1")
def cypher_cycles_of_three(spark, d):
    return _ask(spark, d, "MATCH (a)-[]->(b)-[]->(c), (c)-[]->(a) RETURN a.id AS id, count(*) AS n")


@query(f"WITH {_TRAILS} SELECT id, count(*) AS n FROM t WHERE hops IN (2, 3) GROUP BY 1")
def cypher_varied_then_fixed(spark, d):
    return _ask(spark, d, "MATCH (a {id: 7})-[*1..2]->(b)-[r]->(c) RETURN c.id AS id, count(*) AS n")


@query(f"WITH {_TRAILS} SELECT id, sum(CASE hops WHEN 3 THEN 2 ELSE 1 END)::BIGINT AS n FROM t WHERE hops >= 2 GROUP BY 1")
def cypher_two_varied(spark, d):
    return _ask(spark, d, "MATCH (a {id: 7})-[*1..2]->(b)-[*1..2]->(c) RETURN c.id AS id, count(*) AS n")


@query(f"WITH {_TRAILS} SELECT count(*) AS n, count(DISTINCT id) AS m FROM t WHERE hops <= 3")
def cypher_counts_beside_distinct(spark, d):
    return _ask(spark, d, "MATCH (a {id: 7})-[*1..3]->(b) RETURN count(b) AS n, count(DISTINCT b) AS m")


@query(f"WITH {_TRAILS} SELECT DISTINCT n FROM (SELECT count(*) AS n FROM t WHERE hops <= 3 GROUP BY id)")
def cypher_distinct_after_counting(spark, d):
    return _ask(spark, d, "MATCH (a {id: 7})-[*1..3]->(b) WITH b.id AS id, count(*) AS n RETURN DISTINCT n")


@query("WITH {graph} SELECT category, nation, count(*) AS n, round(sum(value), 2) AS total FROM n GROUP BY 1, 2")
def cypher_group_without_alias(spark, d):
    out = _ask(spark, d, "MATCH (n:Customer) RETURN n.category, n.nation, count(*), round(sum(n.value) * 100) / 100 ORDER BY count(*) DESC, n.category")
    return out.toDF("category", "nation", "n", "total")


@query("WITH {graph} SELECT min(value) AS low, round(avg(value), 6) AS mean, list(name ORDER BY name) AS names FROM n WHERE nation = 3")
def cypher_aggregates_without_alias(spark, d):
    out = _ask(spark, d, "MATCH (n) WHERE n.nation = 3 RETURN min(n.value), round(avg(n.value) * 1000000) / 1000000, collect(n.name)")
    return out.toDF("low", "mean", "names")


@query("WITH {graph}, reach AS (SELECT a.src AS id, count(DISTINCT b.dst) AS reach FROM e a JOIN e b ON b.src = a.dst AND b.eid <> a.eid GROUP BY 1 HAVING count(DISTINCT b.dst) > 5) SELECT id, reach, list(dst ORDER BY dst) AS neighbours FROM reach JOIN e ON e.src = id GROUP BY 1, 2")
def cypher_match_after_aggregate(spark, d):
    out = _ask(spark, d, "MATCH (a)-[]->(b)-[]->(c) WITH a, count(DISTINCT c) AS reach WHERE reach > $least MATCH (a)-[]->(x) RETURN a.id, reach, collect(x.id) AS neighbours ORDER BY reach DESC", least=5)
    return out.toDF("id", "reach", "neighbours")


@query("WITH {graph} SELECT count(*) AS n, min(id) AS low FROM n WHERE value > 1e9")
def cypher_optional_first(spark, d):
    return _ask(spark, d, "OPTIONAL MATCH (n) WHERE n.value > 1000000000 RETURN count(n) AS n, min(n.id) AS low")


@query("WITH {graph} SELECT n.id, a.dst AS b, t.dst AS c FROM n LEFT JOIN (e a JOIN e t ON t.src = a.dst AND t.eid <> a.eid AND t.weight > 250000) ON a.src = n.id WHERE n.nation = 3")
def cypher_optional_patterns(spark, d):
    return _ask(spark, d, "MATCH (n) WHERE n.nation = 3 OPTIONAL MATCH (n)-[]->(b), (b)-[t]->(c) WHERE t.weight > 250000 RETURN n.id AS id, b.id AS b, c.id AS c")


@query("WITH {graph} SELECT id FROM n WHERE value < -900 OR EXISTS (SELECT 1 FROM e JOIN n m ON m.id = e.dst WHERE e.src = n.id AND e.weight > 300000 AND m.value > n.value)")
def cypher_exists_or(spark, d):
    return _ask(spark, d, "MATCH (n) WHERE n.value < -900 OR EXISTS { MATCH (n)-[r]->(m) WHERE r.weight > 300000 AND m.value > n.value } RETURN n.id AS id")


@query("WITH {graph} SELECT id, (SELECT count(*) FROM e WHERE e.src = n.id AND e.weight > 100000) AS k FROM n WHERE nation = 3")
def cypher_count_of_pattern(spark, d):
    return _ask(spark, d, "MATCH (n) WHERE n.nation = 3 RETURN n.id AS id, COUNT { (n)-[r]->() WHERE r.weight > 100000 } AS k")


@query("WITH {graph} SELECT id FROM n WHERE regexp_full_match(name, 'Customer#0+1[0-9]*5') AND (nation = 3 AND value > 0 OR nation = 4)")
def cypher_regex_and_precedence(spark, d):
    return _ask(spark, d, "MATCH (n) WHERE n.name =~ 'Customer#0+1[0-9]*5' AND (n.nation = 3 AND n.value > 0 OR n.nation = 4) // both\nRETURN n.id AS id")
