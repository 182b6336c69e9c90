"""Joins by distance, time and interval, and routes by weight."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.catalog.numbers import _hav
from tessera.graph import order_graph
from tessera.operators import routes, spatial, temporal


@query("WITH {graph} SELECT a.id, b.id AS other, round(" + _hav("a.lat", "a.lon", "b.lat", "b.lon") + ", 1) AS meters FROM n a JOIN n b ON a.id < b.id WHERE " + _hav("a.lat", "a.lon", "b.lat", "b.lon") + " <= 150000")
def spatial_pairs(spark, d):
    n = order_graph(spark, d).nodes
    return spatial.near_pairs(n, n, 150_000).where("id < other").select("id", "other", F.round("meters", 1).alias("meters"))


@query("WITH RECURSIVE {graph}, l AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.id <> b.id WHERE " + _hav("a.lat", "a.lon", "b.lat", "b.lon") + " <= 400000), r(id, component) USING KEY (id) AS (SELECT id, id FROM n UNION SELECT l.b, min(r.component) FROM r JOIN l ON l.a = r.id JOIN recurring.r k ON k.id = l.b WHERE r.component < k.component GROUP BY l.b) SELECT id, component FROM r")
def spatial_components(spark, d):
    return spatial.components(order_graph(spark, d).nodes, 400_000)


@query("WITH {graph}, m AS (SELECT a.id, b.id AS other, " + _hav("a.lat", "a.lon", "b.lat", "b.lon") + " AS m FROM n a JOIN n b ON b.nation = 3 AND a.nation <> 3 WHERE " + _hav("a.lat", "a.lon", "b.lat", "b.lon") + " <= 1500000) SELECT id, other, round(m, 1) AS meters, row_number() OVER (PARTITION BY id ORDER BY m, other)::INTEGER AS rank FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY m, other) <= 2")
def spatial_nearest(spark, d):
    n = order_graph(spark, d).nodes
    return spatial.nearest(n.where("nation <> 3"), n.where("nation = 3"), 1_500_000, 2).select("id", "other", F.round("meters", 1).alias("meters"), "rank")


@query("WITH RECURSIVE {graph}, r(id, cost) USING KEY (id) AS (SELECT 1::BIGINT, 0::DOUBLE UNION SELECT e.dst, min(r.cost + e.weight) FROM r JOIN e ON e.src = r.id LEFT JOIN recurring.r k ON k.id = e.dst WHERE k.id IS NULL OR r.cost + e.weight < k.cost GROUP BY e.dst) SELECT id, round(cost, 2) AS cost FROM r")
def weighted_routes(spark, d):
    g = order_graph(spark, d)
    return routes.shortest_routes(g.edges, spark.createDataFrame([(1,)], "id bigint")).select("id", F.round("cost", 2).alias("cost"))


@query("WITH RECURSIVE {graph}, m AS (SELECT src, dst, " + _hav("a.lat", "a.lon", "b.lat", "b.lon") + " AS m FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst), r(id, cost) USING KEY (id) AS (SELECT 1::BIGINT, 0::DOUBLE UNION SELECT m.dst, min(r.cost + m) FROM r JOIN m ON m.src = r.id LEFT JOIN recurring.r k ON k.id = m.dst WHERE k.id IS NULL OR r.cost + m < k.cost GROUP BY m.dst) SELECT id, round(cost) AS meters FROM r WHERE cost <= 12000000")
def routes_by_distance(spark, d):
    g = order_graph(spark, d)
    out = routes.shortest_routes(routes.with_lengths(g.edges, g.nodes), spark.createDataFrame([(1,)], "id bigint"), "meters", limit=12_000_000.0, paths=True)
    return out.select("id", F.round("cost").alias("meters"))


@query("WITH a AS (SELECT * FROM events WHERE event_id % 3 = 0), b AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2) SELECT a.event_id, b.event_id AS before FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_events(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    out = temporal.asof_join(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0").select("user_id", "ts", "event_id"), "ts", ["user_id"])
    return out.select("event_id", F.col("asof_event_id").alias("before"))


@query("WITH a AS (SELECT * FROM events WHERE event_id % 3 = 0), b AS (SELECT event_type, ts, max(event_id) AS event_id FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2) SELECT a.event_id, b.event_id AS after FROM a ASOF JOIN b ON a.event_type = b.event_type AND a.ts < b.ts WHERE b.ts - a.ts <= INTERVAL 10 MINUTE")
def asof_next_of_kind(spark, d):
    """Few keys with many rows each, forward and strictly later, within ten minutes."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts")
    out = temporal.asof_join(e.where("event_id % 3 = 0"), e.where("event_id % 3 <> 0").select("event_type", "ts", "event_id"), "ts", ["event_type"], how="inner", strict=True, forward=True, tolerance=F.expr("INTERVAL 10 MINUTE"))
    return out.select("event_id", F.col("asof_event_id").alias("after"))


_VISITS = "v AS (SELECT event_id AS visit, user_id, ts AS since, ts + INTERVAL 1 MINUTE * (event_id % 300) AS until FROM events WHERE event_id % 4 = 0)"


def _visits(spark, d):
    e = table(spark, d, "events").where("event_id % 4 = 0")
    return e.select(F.col("event_id").alias("visit"), "user_id", F.col("ts").alias("since"), F.expr("ts + make_interval(0, 0, 0, 0, 0, event_id % 300)").alias("until"))


@query(f"WITH {_VISITS} SELECT visit, event_id FROM v JOIN events e ON e.user_id = v.user_id AND e.ts >= v.since AND e.ts < v.until")
def events_in_visits(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return temporal.points_in_spans(e, _visits(spark, d), "ts", "since", "until", ["user_id"]).select("visit", "event_id")


@query(f"WITH {_VISITS} SELECT a.visit, b.visit AS other FROM v a JOIN v b ON a.user_id = b.user_id AND a.since < b.until AND b.since < a.until AND a.since < a.until AND b.since < b.until WHERE a.visit < b.visit")
def overlapping_visits(spark, d):
    v = _visits(spark, d)
    other = v.select("user_id", *[F.col(c).alias(f"{c}2") for c in ("visit", "since", "until")])
    out = temporal.overlapping(v, other, ("since", "since2"), ("until", "until2"), ["user_id"])
    return out.where("visit < visit2").select("visit", F.col("visit2").alias("other"))
