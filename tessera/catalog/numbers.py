"""Geospatial and science functions, statistics, windows, checksums, generators and streaming-shaped aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import geo, science
from tessera.functions.cypher import normal_cdf, probit
from tessera.graph import order_graph
from tessera.operators import checksum, statistics
from tessera.sources import generators
from tessera.streaming import events as streaming


def _hav(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - ({b})) / 2), 2))))"


def _bear(a: str, b: str, c: str, d: str) -> str:
    x = f"degrees(atan2(sin(radians({d} - ({b}))) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - ({b})))))"
    return f"(({x} + 360) - 360 * floor(({x} + 360) / 360))"


@query("WITH {graph} SELECT id, round(" + _hav("lat", "lon", "40.7", "-74.0") + ", 2) AS meters FROM n ORDER BY " + _hav("lat", "lon", "40.7", "-74.0") + ", id LIMIT 10")
def geo_knn(spark, d):
    n = order_graph(spark, d).nodes
    m = geo.haversine_distance("lat", "lon", 40.7, -74.0)
    return n.select("id", m.alias("m")).orderBy("m", "id").limit(10).select("id", F.round("m", 2).alias("meters"))


@query("WITH {graph} SELECT id, round(" + _hav("lat", "lon", "10.0", "20.0") + ", 2) AS meters FROM n WHERE " + _hav("lat", "lon", "10.0", "20.0") + " <= 2000000")
def great_circle_range(spark, d):
    n = order_graph(spark, d).nodes
    m = geo.haversine_distance("lat", "lon", 10.0, 20.0)
    return n.where(geo.bounding_box("lat", "lon", 10.0, 20.0, 2_000_000)).withColumn("m", m).where("m <= 2000000").select("id", F.round("m", 2).alias("meters"))


@query("WITH {graph} SELECT id, round(" + _bear("lat", "lon", "51.5", "-0.1") + ", 6) AS bearing, abs((" + _bear("lat", "lon", "51.5", "-0.1") + " - 90 + 540) - 360 * floor((" + _bear("lat", "lon", "51.5", "-0.1") + " - 90 + 540) / 360) - 180) <= 90 AS ahead FROM n")
def bearing_navigation(spark, d):
    n = order_graph(spark, d).nodes
    return n.select("id", F.round(geo.bearing("lat", "lon", 51.5, -0.1), 6).alias("bearing"), geo.is_ahead("lat", "lon", 90.0, 51.5, -0.1).alias("ahead"))


@query(
    "WITH {graph}, t AS (SELECT id, radians(lat) AS a, radians(lon) AS o, radians(45.0) AS b, 500000 / 6371000.0::DOUBLE AS d FROM n WHERE abs(lat) < 80), u AS (SELECT *, asin(sin(a) * cos(d) + cos(a) * sin(d) * cos(b)) AS a2 FROM t), v AS (SELECT id, degrees(a2) AS lat, degrees(o + atan2(sin(b) * sin(d) * cos(a), cos(d) - sin(a) * sin(a2))) + 540 AS x FROM u) SELECT id, round(lat, 6) AS lat, round(x - 360 * floor(x / 360) - 180, 6) AS lon FROM v"
)
def destination_projection(spark, d):
    n = order_graph(spark, d).nodes.where("abs(lat) < 80")
    p = geo.destination_spherical("lat", "lon", 45.0, 500000.0)
    return n.select("id", p.alias("p")).select("id", F.round(F.col("p")[0], 6).alias("lat"), F.round(F.col("p")[1], 6).alias("lon"))


@query("WITH {graph} SELECT a.id, count(DISTINCT b.id) AS near FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE " + _hav("a.lat", "a.lon", "b.lat", "b.lon") + " <= 5000000 GROUP BY 1 HAVING count(DISTINCT b.id) >= 2")
def spatial_cluster(spark, d):
    g = order_graph(spark, d)
    at = lambda end, k: g.nodes.select(F.col("id").alias(end), F.col("lat").alias(f"lat{k}"), F.col("lon").alias(f"lon{k}"))
    j = g.edges.select("src", "dst").join(at("src", 1), "src").join(at("dst", 2), "dst")
    near = j.where(geo.haversine_distance("lat1", "lon1", "lat2", "lon2") <= 5_000_000)
    return near.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("near")).where("near >= 2")


@query("WITH {graph}, p AS (SELECT a.lat AS la, a.lon AS oa, b.lat AS lb, b.lon AS ob, c.lat AS lc, c.lon AS oc FROM n a, n b, n c WHERE a.id = 1 AND b.id = 20 AND c.id = 300), t AS (SELECT " + _hav("la", "oa", "lb", "ob") + " + " + _hav("lb", "ob", "lc", "oc") + " AS route, " + _hav("la", "oa", "lc", "oc") + " AS straight FROM p) SELECT round(route, 2) AS route, round(straight, 2) AS straight, round(route / straight, 6) AS ratio FROM t")
def route_distance(spark, d):
    rows = order_graph(spark, d).nodes.where("id in (1, 20, 300)").agg(F.array_sort(F.collect_list(F.struct("id", "lat", "lon"))).alias("xs"))
    pts = F.transform("xs", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon")))
    rows = rows.select(pts.alias("pts")).where(F.size("pts") == 3)  # no route where a waypoint is missing
    first, last = (F.get("pts", F.lit(k)) for k in (0, 2))
    rows = rows.select(geo.route_distance("pts").alias("route"), geo.haversine_distance(first["lat"], first["lon"], last["lat"], last["lon"]).alias("straight"))
    return rows.select(F.round("route", 2).alias("route"), F.round("straight", 2).alias("straight"), F.round(geo.detour_ratio("route", "straight"), 6).alias("ratio"))


@query()
def coordinate_conversion(spark, d):
    n = order_graph(spark, d).nodes
    return n.select("id", geo.utm_zone("lat", "lon").alias("zone"), geo.to_mgrs("lat", "lon").alias("mgrs"), F.round(geo.to_utm("lat", "lon")["easting"], 3).alias("easting"))


@query("WITH t AS (SELECT c_custkey AS id, 6.6e6::DOUBLE + c_custkey * 1000 AS r, 5.972e24::DOUBLE AS m FROM customer) SELECT id, round(sqrt(6.6743e-11 * m / r), 4) AS velocity, round(2 * pi() * sqrt(pow(r, 3) / (6.6743e-11 * m)), 3) AS period, round(sqrt(2 * 6.6743e-11 * m / r), 4) AS escape FROM t")
def orbital_mechanics(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.lit(6.6e6) + F.col("c_custkey") * 1000).alias("r"), F.lit(science.EARTH_MASS).alias("m"))
    return c.select("id", F.round(science.orbital_velocity("r", "m"), 4).alias("velocity"), F.round(science.orbital_period("r", "m"), 3).alias("period"), F.round(science.escape_velocity("r", "m"), 4).alias("escape"))


@query("WITH t AS (SELECT c_custkey AS id, (c_custkey % 299000) * 1000.0::DOUBLE AS v FROM customer) SELECT id, round(1 / sqrt(1 - (v / 299792458.0::DOUBLE) * (v / 299792458.0::DOUBLE)), 9) AS lorentz, round((6.6743e-11 * 5.972e24::DOUBLE / (299792458.0::DOUBLE * 299792458.0::DOUBLE) * (1 / 6371000.0::DOUBLE - 1 / (6371000.0::DOUBLE + 20200000)) - (id * 2.0) * (id * 2.0) / (2 * 299792458.0::DOUBLE * 299792458.0::DOUBLE)) * 1e9, 6) AS gps FROM t")
def physics_computation(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 299000 * 1000.0).alias("v"))
    return c.select("id", F.round(science.lorentz("v"), 9).alias("lorentz"), F.round(science.gps_correction(20200000.0, F.col("id") * 2.0), 6).alias("gps"))


@query("WITH t AS (SELECT c_custkey AS id, (c_custkey % 30)::DOUBLE AS t, 30 + (c_custkey % 10)::DOUBLE AS s, (c_custkey % 5000)::DOUBLE AS d FROM customer) SELECT id, round(1448.96 + 4.591 * t - 5.304e-2 * t * t + 2.374e-4 * t * t * t + 1.340 * (s - 35) + 1.630e-2 * d + 1.675e-7 * d * d - 1.025e-2 * t * (s - 35) - 7.139e-13 * t * d * d * d, 6) AS speed FROM t")
def ocean_computation(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("id"), (k % 30).cast("double").alias("t"), (30 + (k % 10)).cast("double").alias("s"), (k % 5000).cast("double").alias("d"))
    return c.select("id", F.round(science.sound_speed("t", "s", "d"), 6).alias("speed"))


@query("SELECT c_custkey AS id, round(sqrt(2 * (4.0::DOUBLE / 3) * 6371000) * (sqrt((c_custkey % 50)::DOUBLE) + sqrt(10.0::DOUBLE)), 3) AS horizon, round(pow(300 + c_custkey % 600, 2) * sin(2 * radians((c_custkey % 90)::DOUBLE)) / 9.80665, 3) AS range_ FROM customer")
def military_computation(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), F.round(science.radar_horizon((k % 50).cast("double"), F.lit(10.0)), 3).alias("horizon"), F.round(science.ballistic_range((300 + k % 600).cast("double"), (k % 90).cast("double")), 3).alias("range_"))


# statistics


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high, round(var_samp(value), 6) AS variance, round(stddev_samp(value), 6) AS stddev FROM events GROUP BY 1")
def descriptive(spark, d):
    s = statistics.descriptive(table(spark, d, "events"), "value", ["event_type"])
    return s.select("event_type", "n", F.round("mean", 6).alias("mean"), "low", "high", F.round("variance", 6).alias("variance"), F.round("stddev", 6).alias("stddev"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def percentiles(spark, d):
    s = statistics.percentiles(table(spark, d, "events"), "value", [0.5, 0.95, 0.99], ["event_type"])
    return s.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")])


@query("WITH t AS (SELECT s_nationkey AS g, list_sort(list(s_acctbal)) AS xs, max(s_acctbal) AS top, count(*) AS n FROM supplier GROUP BY 1) SELECT g::BIGINT AS g, CASE WHEN n < 4 THEN top ELSE xs[least(floor(n * 0.75)::BIGINT + 1, n)] END AS p75 FROM t")
def floor_percentile(spark, d):
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("bigint").alias("g")).agg(statistics.floor_index_percentile("s_acctbal", 0.75, 4).alias("p75"))


@query("SELECT event_type, round(median(value), 6) AS median, round(mad(value), 6) AS mad FROM events GROUP BY 1")
def median_mad(spark, d):
    return statistics.mad(table(spark, d, "events"), "value", ["event_type"]).select("event_type", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query("WITH m AS (SELECT event_type, median(value) AS med, mad(value) AS mad FROM events GROUP BY 1) SELECT e.event_id, round(0.6745 * abs(value - med) / mad, 6) AS score FROM events e JOIN m USING (event_type) WHERE abs(0.6745 * (value - med) / mad) > 3.5")
def outliers(spark, d):
    return statistics.outliers(table(spark, d, "events"), "value", ["event_type"]).where("outlier").select("event_id", F.round("score", 6).alias("score"))


@query("SELECT o_orderkey, rank() OVER (ORDER BY o_orderpriority) + (count(*) OVER (PARTITION BY o_orderpriority) - 1) / 2 AS rank FROM orders")
def average_ranks(spark, d):
    return statistics.average_ranks(table(spark, d, "orders"), "o_orderpriority").select("o_orderkey", "rank")


@query(
    "WITH r AS (SELECT user_id % 2 = 0 AS side, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS rank, value FROM events), s AS (SELECT count(*) FILTER (side) AS n1, count(*) FILTER (NOT side) AS n2, sum(rank) FILTER (side) AS r1 FROM r), t AS (SELECT sum(pow(c, 3) - c) AS tied FROM (SELECT count(*) AS c FROM events GROUP BY value)), u AS (SELECT *, least(r1 - n1 * (n1 + 1) / 2, n1 * n2 - (r1 - n1 * (n1 + 1) / 2)) AS u, n1 + n2 AS n FROM s, t) SELECT u, round((u - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n + 1 - tied / (n * (n - 1)))), 6) AS z FROM u"
)
def mann_whitney(spark, d):
    e = table(spark, d, "events").withColumn("side", F.col("user_id") % 2 == 0)
    return statistics.mann_whitney(e, "value", "side").select("u", F.round("z", 6).alias("z"))


@query("SELECT event_id, round((sum(value) OVER (PARTITION BY event_type) - value) / (count(*) OVER (PARTITION BY event_type) - 1), 6) AS left_out FROM events")
def jackknife(spark, d):
    return statistics.jackknife(table(spark, d, "events"), "value", ["event_type"]).select("event_id", F.round("left_out", 6).alias("left_out"))


@query(
    "WITH t AS (SELECT event_type, value, row_number() OVER w - 1 AS pos, avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS m, count(*) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY event_id)), f AS (SELECT event_type, max(m) AS head FROM t WHERE pos = 0 GROUP BY 1) SELECT t.event_type, min(pos) FILTER (k = 10 AND pos >= 1 AND head > 0 AND n >= 20 AND m < head * 0.5) AS point FROM t JOIN f USING (event_type) GROUP BY 1"
)
def acceleration_point(spark, d):
    return statistics.acceleration_point(table(spark, d, "events"), "event_id", "value", 10, 0.5, ["event_type"])


@query("SELECT event_type, round(stddev_samp(value) / avg(value), 6) AS cv, round(min(value) / max(value), 6) AS min_max_ratio FROM events GROUP BY 1")
def stability(spark, d):
    return statistics.stability(table(spark, d, "events"), "value", ["event_type"]).select("event_type", F.round("cv", 6).alias("cv"), F.round("min_max_ratio", 6).alias("min_max_ratio"))


@query("SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS total_cost FROM events")
def running_cost(spark, d):
    e = table(spark, d, "events").withColumn("saving", F.lit(1.0))
    return statistics.cumulative_cost(e, "event_id", "value", "saving", ["user_id"]).select("user_id", "event_id", F.round("total_cost", 4).alias("total_cost"))


@query("WITH a AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, count(*) AS n FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT user_id, a.n AS before, b.n AS after, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b USING (user_id)")
def snapshot_delta(spark, d):
    e = table(spark, d, "events")
    a, b = (e.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")) for k in (0, 1))
    return statistics.snapshot_delta(a, b, "user_id", "n")


@query("WITH p AS (SELECT event_type, count(value) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1), g AS (SELECT sum(n * m) / sum(n) AS grand, count(*) AS k, sum(n) AS t FROM p) SELECT round(sum(n * pow(m - grand, 2)) / (first(k) - 1), 4) AS between_, round(sum((n - 1) * v) / (first(t) - first(k)), 4) AS within_ FROM p, g")
def variance_parts(spark, d):
    v = statistics.variance_parts(table(spark, d, "events"), "value", "event_type")
    return v.select(F.round("between", 4).alias("between_"), F.round("within", 4).alias("within_"))


@query("SELECT x, CASE WHEN x = 0.25 THEN 'low' ELSE 'high' END AS side FROM (VALUES (0.25::DOUBLE), (0.75::DOUBLE)) t(x)")
def probit_sign(spark, d):
    t = spark.createDataFrame([(0.25,), (0.75,)], "x double")
    return t.select("x", F.when((probit(F.col("x")) < 0) & (normal_cdf(probit(F.col("x"))) < 0.5), "low").otherwise("high").alias("side"))


def _cdf(x: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({x}) / sqrt(2.0::DOUBLE)))"
    erf = f"(1 - ((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({x}) * ({x}) / 2))"
    return f"(CASE WHEN {x} >= 0 THEN 0.5 * (1 + {erf}) ELSE 0.5 * (1 - {erf}) END)"


def _bootstrap_sql(resamples: int, level: float = 0.95, seed: int = 42) -> str:
    """Every row's weight in every resample by the same hash, then the interval from the sorted means."""
    p = statistics.PRIME
    weight = " + ".join(f"(u >= {t!r})::INT" for t in statistics.POISSON)
    z = [statistics._quantile(q) for q in ((1 - level) / 2, (1 + level) / 2)]
    ends = "".join(f", least(greatest({_cdf(f'(z0 + (z0 + {q!r}) / (1 - acceleration * (z0 + {q!r})))')}, 0), 1) * (len(ms) - 1) AS at{k}" for k, q in enumerate(z))
    pick = lambda k: f"round(ms[floor(at{k})::INT + 1] + (ms[least(floor(at{k})::INT + 2, len(ms))] - ms[floor(at{k})::INT + 1]) * (at{k} - floor(at{k})), 6)"
    t = "sqrt(-2 * ln(least(below, 1 - below)))"
    probit = f"({t} - (2.515517 + 0.802853 * {t} + 0.010328 * {t} * {t}) / (1 + 1.432788 * {t} + 0.189269 * {t} * {t} + 0.001308 * {t} * {t} * {t}))"
    return f"""
WITH x AS (SELECT event_type, event_id, value::DOUBLE AS value FROM events WHERE value IS NOT NULL),
h AS (SELECT event_type, value, r, (event_id % {p} * 48271 % {p} + (r * 69621 + {seed * 16807}) % {p}) % {p} AS a FROM x, range({resamples}) t(r)),
h1 AS (SELECT event_type, value, r, (a * a + 40692) % {p} AS a FROM h), h2 AS (SELECT event_type, value, r, ((a * a + 81384) % {p}) / {p}::DOUBLE AS u FROM h1),
w AS (SELECT event_type, value, r, {weight} AS w FROM h2),
m AS (SELECT event_type, list_sort(list(m)) AS ms FROM (SELECT event_type, r, sum(w * value) / sum(w) AS m FROM w GROUP BY 1, 2 HAVING sum(w) > 0) GROUP BY 1),
c AS (SELECT event_type, count(*) AS n, avg(value) AS mean FROM x GROUP BY 1),
k AS (SELECT event_type, sum(pow(value - mean, 3)) / (6 * pow(sum(pow(value - mean, 2)), 1.5)) AS acceleration FROM x JOIN c USING (event_type) GROUP BY 1),
b AS (SELECT *, least(greatest(len(list_filter(ms, lambda v: v < mean)) / len(ms), 1e-6), 1 - 1e-6) AS below FROM m JOIN c USING (event_type) JOIN k USING (event_type)),
z AS (SELECT *, CASE WHEN below < 0.5 THEN -{probit} ELSE {probit} END AS z0 FROM b),
e AS (SELECT *{ends} FROM z)
SELECT event_type, n, {pick(0)} AS lower, {pick(1)} AS upper, round(list_sum(ms) / len(ms) - mean, 6) AS bias, round(acceleration, 6) AS acceleration FROM e
"""


@query(_bootstrap_sql(200))
def bootstrap_interval(spark, d):
    out = statistics.bca_interval(table(spark, d, "events"), "value", ["event_type"], 200, row="event_id")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("lower", "upper", "bias", "acceleration")])


_CUSUM = """
WITH RECURSIVE v AS (SELECT event_type, value::DOUBLE AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events WHERE value IS NOT NULL),
s(event_type, k, n, mean, m2, base, dev, up, down, calm, changes, steady) AS (
  SELECT DISTINCT event_type, 0::BIGINT, 0::BIGINT, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::BIGINT, 0::BIGINT, false FROM v
  UNION ALL
  SELECT event_type, k, CASE WHEN ended THEN 1 ELSE n END, CASE WHEN ended THEN x ELSE mean END, CASE WHEN ended THEN 0 ELSE m2 END, CASE WHEN ended THEN x WHEN still THEN base0 ELSE base END, CASE WHEN ended THEN 0 WHEN still THEN dev0 ELSE dev END,
    CASE WHEN ended THEN 0 WHEN still THEN up0 ELSE up END, CASE WHEN ended THEN 0 WHEN still THEN down0 ELSE down END, CASE WHEN ended THEN 0 WHEN still THEN calm0 ELSE calm END, changes + ended::INT, steady OR (NOT ended AND NOT still AND calm >= 5)
  FROM (SELECT *, NOT still AND greatest(up, down) > bound AS ended, CASE WHEN n < 5 THEN calm0 WHEN sd < 1e-9 OR (CASE WHEN abs(mean) > 1e-10 THEN sd / abs(mean) ELSE 0 END) <= 0.2 THEN calm0 + 1 ELSE 0 END AS calm
    FROM (SELECT *, greatest(0, up0 + x - base - allowance) AS up, greatest(0, down0 + base - x - allowance) AS down
      FROM (SELECT *, CASE WHEN dev > 1e-9 THEN dev / 4 ELSE greatest(abs(base) / 20, 1e-10) END AS allowance, CASE WHEN dev > 1e-9 THEN 4 * dev ELSE greatest(abs(base) / 5, 1e-9) END AS bound
        FROM (SELECT *, CASE WHEN changes = 0 AND n = 5 THEN mean ELSE base0 END AS base, CASE WHEN changes = 0 AND n = 5 THEN sd ELSE dev0 END AS dev, steady OR k < 5 AS still
          FROM (SELECT *, CASE WHEN n > 1 THEN sqrt(m2 / (n - 1)) ELSE 0 END AS sd
            FROM (SELECT *, m20 + (x - mean0) * (x - mean) AS m2
              FROM (SELECT s.event_type, v.k, v.x, s.n + 1 AS n, s.mean AS mean0, s.mean + (v.x - s.mean) / (s.n + 1) AS mean, s.m2 AS m20, s.base AS base0, s.dev AS dev0, s.up AS up0, s.down AS down0, s.calm AS calm0, s.changes, s.steady
                FROM s JOIN v ON v.event_type = s.event_type AND v.k = s.k + 1)))))))
)
SELECT event_type, max(changes)::INTEGER AS changes, count(*) FILTER (steady) AS steady FROM s WHERE k > 0 GROUP BY 1
"""


@query(_CUSUM)
def cusum_steady_state(spark, d):
    return statistics.cusum(table(spark, d, "events"), "event_id", "value", ["event_type"]).groupBy("event_type").agg(F.max("changes").alias("changes"), F.count(F.when(F.col("steady"), 1)).alias("steady"))


@query("WITH t AS (SELECT event_type AS metric, CASE WHEN user_id % 3 = 0 THEN 'a' WHEN user_id % 3 = 1 THEN 'b' ELSE 'c' END AS engine, value FROM events), m AS (SELECT metric, engine, avg(value) AS x FROM t GROUP BY 1, 2) SELECT l.metric, l.engine AS a, r.engine AS b, round(r.x - l.x, 6) AS delta FROM m l JOIN m r ON l.metric = r.metric AND l.engine < r.engine")
def pairwise_matrix(spark, d):
    e = table(spark, d, "events").select("event_type", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("user_id") % 3 + 1).cast("int")).alias("engine"), "value")
    return statistics.pairwise(e, "engine", "event_type", "value").select("metric", "a", "b", F.round("delta", 6).alias("delta"))


# checksums and generators


@query("SELECT count(*) AS n, count(*) FILTER (p_partkey % 7 = 0 OR p_partkey % 11 = 0) AS differing FROM part")
def row_equivalence(spark, d):
    """Prices a step of rounding apart are equal; every seventh price is another, every eleventh row is missing."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("ordinal"), "p_name", "p_retailprice")
    other = p.withColumn("p_retailprice", F.when(F.col("ordinal") % 7 == 0, F.col("p_retailprice") * 1.001).otherwise(F.col("p_retailprice") * (1 + 2.2e-16))).where("ordinal % 11 <> 0")
    return p.agg(F.count(F.lit(1)).alias("n")).crossJoin(checksum.differing_rows(p, other).agg(F.count(F.lit(1)).alias("differing")))


@query("SELECT n_nationkey::BIGINT AS k, '00000002' || '02' || lpad(lower(hex(n_nationkey)), 16, '0') || '04' || lpad(lower(hex(strlen(n_name))), 8, '0') || lower(hex(encode(n_name))) AS row FROM nation")
def canonical_encoding(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), "n_name")
    parts = [checksum.canonical(F.col("k"), n.schema["k"].dataType), checksum.canonical(F.col("n_name"), n.schema["n_name"].dataType)]
    return n.select("k", F.concat(F.lit("00000002"), *parts).alias("row"))


@query("SELECT x AS source, x + 1 AS target FROM range(999) t(x)")
def chain_graph(spark, d):
    return generators.chain(spark, 1000)


@query("SELECT x // 100 AS source, x + 5 AS target FROM range(500) t(x)")
def hub_graph(spark, d):
    return generators.hub(spark, 5, 100)


@query("SELECT (6 * 5 + 2 * 5 * (1000 - 5 - 1))::BIGINT AS edges, 0::BIGINT AS loops")
def power_law_graph(spark, d):
    return generators.power_law(spark, 1000, 5).agg(F.count(F.lit(1)).alias("edges"), F.count(F.when(F.col("source") == F.col("target"), 1)).alias("loops"))


@query("SELECT 1000::BIGINT AS n, true AS categories, true AS inside")
def uniform_node_table(spark, d):
    n = generators.nodes(spark, 1000, {"value": {"type": "float", "range": (5, 9)}, "category": {"type": "text", "categories": 100}})
    return n.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("category").between(95, 100).alias("categories"), F.every((F.col("value") >= 5) & (F.col("value") < 9)).alias("inside"))


# event time


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_events(spark, d):
    return streaming.windowed(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("WITH t AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM t) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, d):
    return streaming.sessions(table(spark, d, "events"))
