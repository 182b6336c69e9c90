"""Scans, filters, joins, aggregates, sorts, set operations and data changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.functions import cypher as fn
from tessera.graph import order_graph
from tessera.operators import procedures
from tessera.sources import readers, writers


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > 50000")
def scan_filter_project(spark, d):
    return table(spark, d, "lineitem").where("l_extendedprice > 50000").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_totalprice < 50000")
def range_scan(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 1000 and o_totalprice < 50000").select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40 AND l_discount < 0.05 AND l_returnflag = 'R'")
def multi_predicate(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 40 and l_discount < 0.05 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 77")
def point_lookup(spark, d):
    return table(spark, d, "customer").where("c_custkey = 77").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 20000 AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def filter_sort_limit(spark, d):
    rows = table(spark, d, "orders").where("o_totalprice > 20000 and o_orderstatus = 'F'")
    return rows.orderBy(F.col("o_totalprice").desc_nulls_first(), "o_orderkey").limit(1000).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size::BIGINT AS p_size, p_retailprice FROM part")
def full_projection(spark, d):
    return table(spark, d, "part").withColumn("p_size", F.col("p_size").cast("bigint"))


@query("SELECT s_suppkey, s_acctbal > 0 AND s_nationkey < 10 AS both_, s_acctbal > 0 OR s_nationkey < 10 AS any_, (s_acctbal > 0) <> (s_nationkey < 10) AS one_, NOT (s_acctbal > 0) AS none_, s_acctbal <> 0 AS ne_ FROM supplier")
def boolean_logic(spark, d):
    a, b = F.col("s_acctbal") > 0, F.col("s_nationkey") < 10
    return table(spark, d, "supplier").select("s_suppkey", (a & b).alias("both_"), (a | b).alias("any_"), fn.xor(a, b).alias("one_"), (~a).alias("none_"), (F.col("s_acctbal") != 0).alias("ne_"))


@query("SELECT count(*) FILTER (WHERE x IS NULL) AS nulls, count(*) FILTER (WHERE x IS NOT NULL) AS values_ FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS x FROM orders)")
def null_predicates(spark, d):
    x = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("x"))
    return x.agg(F.count(F.when(F.col("x").isNull(), 1)).alias("nulls"), F.count(F.when(F.col("x").isNotNull(), 1)).alias("values_"))


@query("SELECT n_name, n_regionkey IN (1, 3) AS hit FROM nation")
def in_list(spark, d):
    return table(spark, d, "nation").select("n_name", F.array_contains(F.array(F.lit(1), F.lit(3)), F.col("n_regionkey")).alias("hit"))


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def return_distinct(spark, d):
    return table(spark, d, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, CASE p_brand WHEN 'Brand#11' THEN 1 ELSE 0 END::BIGINT AS is_11 FROM part")
def case_expression(spark, d):
    size = F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "medium").otherwise("large")
    return table(spark, d, "part").select("p_partkey", size.alias("size_class"), F.when(F.col("p_brand") == "Brand#11", 1).otherwise(0).cast("bigint").alias("is_11"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END, 'none') AS p FROM orders")
def coalesce_null(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")), F.lit("none")).alias("p"))


@query("SELECT x::BIGINT AS x, x * x AS square FROM range(1, 11) t(x)")
def unwind_range(spark, d):
    return readers.unwind(spark.range(1).select(fn.range_list(F.lit(1).cast("bigint"), F.lit(10).cast("bigint")).alias("xs")), "xs", "x").select("x", (F.col("x") * F.col("x")).alias("square"))


@query("SELECT 1::BIGINT AS one, 'a' AS a, true AS yes")
def literal_row(spark, d):
    return spark.range(1).select(F.lit(1).cast("bigint").alias("one"), F.lit("a").alias("a"), F.lit(True).alias("yes"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'O'")
def parameters(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders_")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders_ WHERE o_totalprice > :low AND o_orderstatus = :status", args={"low": 300000, "status": "O"})


# joins


@query("SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'BUILDING'")
def inner_join(spark, d):
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return c.join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT s.s_suppkey AS hub, l.l_partkey AS spoke, p.p_retailprice AS spoke_weight, sum(l.l_quantity) AS edge_weight FROM supplier s JOIN lineitem l ON s.s_suppkey = l.l_suppkey JOIN part p ON p.p_partkey = l.l_partkey WHERE s.s_suppkey < 5 GROUP BY ALL")
def expand_high_fanout(spark, d):
    e = table(spark, d, "lineitem").where("l_suppkey < 5").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("edge_weight"))
    hubs = table(spark, d, "supplier").where("s_suppkey < 5").select("s_suppkey")
    out = e.join(hubs, F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part").select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey"))
    return out.select(F.col("s_suppkey").alias("hub"), F.col("l_partkey").alias("spoke"), F.col("p_retailprice").alias("spoke_weight"), "edge_weight")


@query("SELECT c.c_custkey, count(o.o_orderkey) AS orders, count(o.o_orderkey) = 0 AS none FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000 GROUP BY 1")
def optional_match(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 200000")
    out = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders"))
    return out.withColumn("none", F.col("orders") == 0)


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_totalprice > 300000)")
def exists_semi(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l_quantity > 45)")
def anti_join(spark, d):
    used = table(spark, d, "lineitem").where("l_quantity > 45")
    return table(spark, d, "part").join(used, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


@query("SELECT n.n_name, array_to_string(list_sort(list(s.s_name) FILTER (s.s_name IS NOT NULL)), ',') AS names FROM nation n LEFT JOIN supplier s ON n.n_nationkey = s.s_nationkey GROUP BY 1")
def pattern_comprehension(spark, d):
    out = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_name").agg(F.array_sort(F.collect_list("s_name")).alias("xs"))
    return out.select("n_name", F.when(F.size("xs") > 0, F.array_join("xs", ",")).alias("names"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def pair_join(spark, d):
    s = table(spark, d, "supplier")
    x, y = s.select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("n")), s.select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("n"))
    return x.join(y, "n").where("a < b").select("a", "b")


@query("SELECT r.r_name, n.n_name, count(*) AS customers FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2")
def foreign_key_edges(spark, d):
    j = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"))


@query("WITH t AS (SELECT o_orderstatus AS metric, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY 1), u AS (SELECT l_linestatus AS metric, round(avg(l_extendedprice), 4) AS b FROM lineitem GROUP BY 1) SELECT metric, a, b, round(b - a, 3) AS delta FROM t JOIN u USING (metric)")
def metric_diff(spark, d):
    a = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("metric")).agg(F.round(F.avg("o_totalprice"), 4).alias("a"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("metric")).agg(F.round(F.avg("l_extendedprice"), 4).alias("b"))
    return a.join(b, "metric").select("metric", "a", "b", F.round(F.col("b") - F.col("a"), 3).alias("delta"))


# aggregates


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1, 2 ORDER BY total DESC")
def aggregate_groupby(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total")).orderBy(F.desc("total"))


@query("SELECT count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem WHERE l_discount > 0.03")
def filtered_global_aggregate(spark, d):
    return table(spark, d, "lineitem").where("l_discount > 0.03").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("SELECT o_orderpriority, min(o_totalprice) AS low, max(o_totalprice) AS high, round(avg(o_totalprice), 4) AS mean, round(sum(o_totalprice), 2) AS total, count(o_totalprice) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def aggregate_functions(spark, d):
    c = "o_totalprice"
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.min(c).alias("low"), F.max(c).alias("high"), F.round(F.avg(c), 4).alias("mean"), F.round(F.sum(c), 2).alias("total"), F.count(c).alias("n"), F.count_distinct("o_custkey").alias("customers"))


@query("SELECT coalesce(sum(o_totalprice), 0) AS total, count(*) AS n FROM orders WHERE o_orderkey < 0")
def empty_sum(spark, d):
    return table(spark, d, "orders").where("o_orderkey < 0").agg(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)).alias("total"), F.count(F.lit(1)).alias("n"))


@query("SELECT s_nationkey::BIGINT AS s_nationkey, array_to_string(list_sort(list(s_suppkey)), ',') AS keys FROM supplier GROUP BY 1")
def collect_lists(spark, d):
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("bigint").alias("s_nationkey")).agg(F.array_join(F.array_sort(F.collect_list("s_suppkey")).cast("array<string>"), ",").alias("keys"))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS k FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) >= 4")
def collect_distinct_size(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.size(F.collect_set("o_orderpriority")).cast("bigint").alias("k")).where("k >= 4")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, round(count(*) FILTER (WHERE value > 50) / count(*), 6) AS hit_rate, count(*) AS total FROM events GROUP BY 1")
def hit_rate(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.count(F.when(F.col("value") > 50, 1)) / F.count(F.lit(1)), 6).alias("hit_rate"), F.count(F.lit(1)).alias("total"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def group_distinct_engines(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


# sorts and sets


@query("SELECT o_orderkey, o_totalprice, o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 100")
def sort_topk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey").orderBy(F.col("o_totalprice").desc_nulls_first(), F.col("o_orderkey").asc_nulls_last()).limit(100)


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice, o_orderkey LIMIT 50")
def sort_filtered_topk(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 1000").orderBy("o_totalprice", "o_orderkey").limit(50).select("o_orderkey")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 20 LIMIT 10")
def skip_limit(spark, d):
    return table(spark, d, "customer").orderBy("c_custkey").offset(20).limit(10).select("c_custkey")


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def full_sort(spark, d):
    return table(spark, d, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").select("s_suppkey", "s_acctbal")


@query("SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").cast("bigint").alias("k")).union(table(spark, d, "supplier").select(F.col("s_nationkey").cast("bigint"))).distinct()


@query("SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier")
def union_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).unionAll(table(spark, d, "supplier").select("s_suppkey"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey * 3 FROM supplier")
def intersect_keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, d, "supplier").select(F.col("s_suppkey") * 3))


@query("SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders WHERE o_totalprice > 250000")
def except_keys(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).exceptAll(table(spark, d, "orders").where("o_totalprice > 250000").select("o_custkey"))


@query("SELECT c_custkey AS id, c_name AS name, NULL::DOUBLE AS price FROM customer UNION ALL SELECT p_partkey, NULL, p_retailprice FROM part")
def heterogeneous_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return c.unionByName(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price")), allowMissingColumns=True)


# scalar functions


@query(
    "SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, trim('  ' || p_type || ' ') AS trimmed, replace(p_name, 'a', 'x') AS replaced, substring(p_name, 3, 4) AS sub, left(p_name, 3) AS l, right(p_name, 3) AS r, length(p_name) AS n, starts_with(p_name, 'P') AS s, ends_with(p_name, '1') AS e, contains(p_name, 'art') AS c, reverse(p_name) AS rev, array_to_string(string_split(p_brand, '#'), '/') AS parts FROM part"
)
def string_functions(spark, d):
    n = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", F.upper(n).alias("up"), F.lower("p_brand").alias("low"), F.trim(F.concat(F.lit("  "), F.col("p_type"), F.lit(" "))).alias("trimmed"), F.replace(n, F.lit("a"), F.lit("x")).alias("replaced"),
        fn.substring(n, F.lit(2), F.lit(4)).alias("sub"), F.left(n, F.lit(3)).alias("l"), F.right(n, F.lit(3)).alias("r"), fn.size(n, True).alias("n"), F.startswith(n, F.lit("P")).alias("s"), F.endswith(n, F.lit("1")).alias("e"),
        F.contains(n, F.lit("art")).alias("c"), F.reverse(n).alias("rev"), F.array_join(fn.split(F.col("p_brand"), "#"), "/").alias("parts"),
    )


@query(
    "SELECT o_orderkey, o_orderkey // 3 AS quotient, o_orderkey % 3 AS rest, round(pow(o_orderkey % 10, 2), 4) AS power, abs(50 - o_orderkey) AS a, ceil(o_totalprice) AS c, floor(o_totalprice) AS f, round(o_totalprice) AS r, sign(o_totalprice - 100000)::BIGINT AS s, round(sqrt(o_totalprice), 4) AS root, round(ln(o_totalprice), 6) AS log FROM orders"
)
def math_functions(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, d, "orders").select(
        "o_orderkey", fn.divide(k, F.lit(3), True).alias("quotient"), (k % 3).alias("rest"), F.round(F.pow(k % 10, F.lit(2.0)), 4).alias("power"), F.abs(50 - k).alias("a"), F.ceil(p).cast("double").alias("c"), F.floor(p).cast("double").alias("f"),
        fn.round_half_up(p).alias("r"), fn.sign(p - 100000).cast("bigint").alias("s"), F.round(F.sqrt(p), 4).alias("root"), F.round(F.log(p), 6).alias("log"),
    )


@query(
    "WITH t AS (SELECT o_custkey, list_sort(list(o_orderkey)) AS xs FROM orders GROUP BY 1) SELECT o_custkey, len(xs) AS n, xs[1] AS first, xs[-1] AS last_, xs[2] AS second, array_to_string(xs[2:], ',') AS rest, array_to_string(list_filter(xs, lambda x: x % 2 = 0), ',') AS even, array_to_string(list_transform(xs, lambda x: x * 2), ',') AS twice, list_contains(xs, 5) AS five FROM t"
)
def list_functions(spark, d):
    xs = F.col("xs")
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    t = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("xs"))
    return t.select("o_custkey", fn.size(xs, False).alias("n"), fn.head(xs).alias("first"), fn.last(xs).alias("last_"), F.get(xs, F.lit(1)).alias("second"), text(fn.tail(xs)).alias("rest"), text(F.filter(xs, lambda x: x % 2 == 0)).alias("even"), text(F.transform(xs, lambda x: x * 2)).alias("twice"), F.array_contains(xs, 5).alias("five"))


@query("SELECT o_orderkey, o_orderdate::DATE AS d, (o_orderdate::DATE + INTERVAL 1 DAY)::DATE AS next, (o_orderdate::DATE + INTERVAL 1 MONTH)::DATE AS month_, o_orderdate + INTERVAL 26 HOUR AS later, year(o_orderdate) AS y FROM orders")
def date_functions(spark, d):
    o = F.col("o_orderdate")
    day = o.cast("date")
    return table(spark, d, "orders").select("o_orderkey", day.alias("d"), fn.plus_duration(day, "P1D").alias("next"), fn.plus_duration(day, "P1M").alias("month_"), fn.plus_duration(o, "P1DT2H").alias("later"), F.year(o).cast("bigint").alias("y"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_functions(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"))


@query("SELECT o_orderkey, TRY_CAST(o_orderpriority[1:1] AS BIGINT) AS i, TRY_CAST(o_orderpriority AS DOUBLE) AS f FROM orders")
def casts(spark, d):
    p = F.col("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", fn.to_integer(F.left(p, F.lit(1))).alias("i"), fn.to_float(p).alias("f"))


@query("SELECT 'INTEGER' AS a, 'FLOAT' AS b, 'STRING' AS c, 'BOOLEAN' AS d, 'NULL' AS e, 'LIST' AS f, 'DATE' AS g")
def value_types(spark, d):
    xs = {"a": F.lit(1).cast("bigint"), "b": F.lit(1.5), "c": F.lit("x"), "d": F.lit(True), "e": F.lit(None).cast("string"), "f": F.array(F.lit(1)), "g": F.current_date()}
    return spark.range(1).select(*[fn.value_type(x).alias(n) for n, x in xs.items()])


@query("SELECT c_custkey AS id, c_custkey * 1.0::DOUBLE AS x, c_nationkey * 2.0::DOUBLE AS y, 7203::BIGINT AS srid FROM customer")
def points(spark, d):
    p = fn.point(F.col("c_custkey"), F.col("c_nationkey") * 2.0)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), p.alias("p")).select("id", "p.x", "p.y", F.col("p.srid").cast("bigint").alias("srid"))


@query("SELECT c_custkey AS \"a.id\", c_name AS \"a.name\", '[' || c_custkey || ',' || c_nationkey || ']' AS xs FROM customer")
def flatten_record(spark, d):
    rows = table(spark, d, "customer").select(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).alias("a"), F.array(F.col("c_custkey"), F.col("c_nationkey").cast("bigint")).alias("xs"))
    return writers.flattened(rows)


# data changes


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 1000000 + s_suppkey, s_name FROM supplier")
def create_nodes(spark, d):
    g = order_graph(spark, d).create_nodes(table(spark, d, "supplier").select((F.col("s_suppkey") + 1000000).alias("id"), F.col("s_name").alias("name"), F.array(F.lit("Supplier")).alias("labels")))
    return g.nodes.select("id", "name")


@query("WITH {graph} SELECT type, count(*) AS n FROM (SELECT type FROM e UNION ALL SELECT 'SAME_NATION' FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 25 WHERE a.c_custkey < 100) GROUP BY 1")
def create_edges(spark, d):
    pairs = spark.range(100).select(F.col("id").alias("src"), (F.col("id") + 25).alias("dst"))
    return order_graph(spark, d).create_edges(pairs, "SAME_NATION").counts_by_type()


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN 0.0 ELSE c_acctbal END AS value, c_nationkey = 3 AS marked FROM customer")
def set_property(spark, d):
    at = F.col("nation") == 3
    g = order_graph(spark, d).set_property(at, "value", F.lit(0.0)).add_label(at, "Marked")
    return g.nodes.select("id", "value", F.array_contains("labels", "Marked").alias("marked"))


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN NULL ELSE c_name END AS name, c_nationkey <> 3 AS labelled FROM customer")
def remove_property(spark, d):
    at = F.col("nation") == 3
    g = order_graph(spark, d).remove_property(at, "name").remove_label(at, "Customer")
    return g.nodes.select("id", "name", F.array_contains("labels", "Customer").alias("labelled"))


@query("WITH {graph} SELECT (SELECT count(*) FROM n WHERE id >= 50) AS nodes, (SELECT count(*) FROM e WHERE src >= 50 AND dst >= 50) AS edges")
def detach_delete(spark, d):
    g = order_graph(spark, d).delete(F.col("id") < 50, detach=True)
    return g.nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(g.edges.agg(F.count(F.lit(1)).alias("edges")))


@query("SELECT c_name AS name, CASE WHEN c_custkey < 10 THEN 1.0 ELSE c_acctbal END AS value FROM customer UNION ALL SELECT 'New#' || x, 2.0 FROM range(5) t(x)")
def merge_nodes(spark, d):
    g = order_graph(spark, d)
    old = g.nodes.where("id < 10").select("id", "labels", "name")
    new = spark.range(5).select((F.col("id") + 5000000).alias("id"), F.array(F.lit("Customer")).alias("labels"), F.concat(F.lit("New#"), F.col("id").cast("string")).alias("name"))
    out = g.merge(old.unionByName(new), "name", on_create={"value": F.lit(2.0)}, on_match={"value": F.lit(1.0)})
    return out.nodes.select("name", "value")


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def unique_violations(spark, d):
    g = order_graph(spark, d)
    return g.violations("Customer", "category", "unique").join(g.nodes, "id").groupBy(F.col("category").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'Customer' AS label, count(*) AS n FROM customer")
def counts_by_label(spark, d):
    return order_graph(spark, d).counts_by_label()


@query("WITH {graph} SELECT type, count(*) AS count, round(avg(weight), 4) AS avg_weight FROM e GROUP BY 1")
def edge_aggregate(spark, d):
    return procedures.call("edge_aggregate", order_graph(spark, d)).withColumn("avg_weight", F.round("avg_weight", 4))


@query("SELECT count(c_acctbal) AS count, round(sum(c_acctbal), 2) AS sum, round(avg(c_acctbal), 4) AS avg, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer")
def live_aggregate(spark, d):
    return procedures.call("live_aggregate", order_graph(spark, d), "Customer", "value").withColumn("sum", F.round("sum", 2)).withColumn("avg", F.round("avg", 4))
