"""Traversals, procedures, algorithms, vectors and code graphs over the order graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.catalog import query, table
from tessera.graph import PropertyGraph, order_graph
from tessera.operators import algorithms, procedures, traversal, vector


def _seed(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id bigint")


@query("WITH {graph} SELECT src, count(*) AS deg FROM e WHERE src < 10000 GROUP BY 1 HAVING count(*) > 3 ORDER BY deg DESC, src LIMIT 100")
def segmentation_medium(spark, d):
    e = order_graph(spark, d).edges.where("src < 10000")
    return e.groupBy("src").agg(F.count(F.lit(1)).alias("deg")).where("deg > 3").orderBy(F.desc("deg"), "src").limit(100)


@query(
    "WITH {graph}, two AS (SELECT a.src, count(DISTINCT b.dst) AS reach FROM e a JOIN e b ON a.dst = b.src AND a.eid <> b.eid WHERE a.src < 10000 GROUP BY 1 HAVING count(DISTINCT b.dst) > 20) SELECT t.src, t.reach, count(DISTINCT e.dst) AS neighbours FROM two t JOIN e ON e.src = t.src GROUP BY 1, 2"
)
def segmentation_complex(spark, d):
    e = order_graph(spark, d).edges.select("eid", "src", "dst")
    a = e.where("src < 10000")
    b = e.select(F.col("src").alias("dst"), F.col("dst").alias("end"), F.col("eid").alias("eid2"))
    two = a.join(b, "dst").where("eid <> eid2").groupBy("src").agg(F.count_distinct("end").alias("reach")).where("reach > 20")
    return two.join(e, "src").groupBy("src", "reach").agg(F.count_distinct("dst").alias("neighbours"))


@query("WITH {graph} SELECT a.src AS start, a.dst AS middle, b.dst AS finish FROM e a JOIN e b ON a.dst = b.src AND a.eid <> b.eid WHERE a.src = 1")
def two_hop_trails(spark, d):
    t = traversal.trails(order_graph(spark, d).edges, _seed(spark, 1), 2, 2)
    return t.select(F.col("seed").alias("start"), F.get("nodes", F.lit(1)).alias("middle"), F.col("id").alias("finish"))


_BFS = "WITH RECURSIVE {graph}, r(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < %d) "


@query(_BFS % 3 + "SELECT DISTINCT id FROM r WHERE depth > 0")
def bfs_reach(spark, d):
    return traversal.reach(order_graph(spark, d).edges, _seed(spark, 1), 3)


@query(_BFS % 4 + "SELECT id, min(depth)::BIGINT AS depth FROM r WHERE depth > 0 GROUP BY 1")
def bfs_levels(spark, d):
    return traversal.levels(order_graph(spark, d).edges, _seed(spark, 1), 4).withColumn("depth", F.col("depth").cast("bigint"))


@query("WITH RECURSIVE {graph}, r(id, depth) AS (SELECT id, 0 FROM n WHERE nation = 3 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 2) SELECT DISTINCT id FROM r WHERE depth > 0")
def portable_reachability(spark, d):
    g = order_graph(spark, d)
    return traversal.reach(g.edges, g.nodes.where("nation = 3"), 2)


@query("WITH RECURSIVE {graph}, f AS (SELECT * FROM e WHERE src < dst AND type IN ('1-URGENT', '2-HIGH')), r(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT f.dst, r.depth + 1 FROM r JOIN f ON f.src = r.id WHERE r.depth < 6) SELECT id, depth::BIGINT AS depth FROM r WHERE depth > 0")
def lineage_depths(spark, d):
    e = order_graph(spark, d).typed("1-URGENT", "2-HIGH").where("src < dst")
    return traversal.node_depths(e, _seed(spark, 1), 6).withColumn("depth", F.col("depth").cast("bigint"))


@query("WITH RECURSIVE {graph}, r(id, depth) AS (SELECT 7::BIGINT, 0 UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.id WHERE r.depth < 3) SELECT DISTINCT id FROM r WHERE depth > 0")
def reverse_reach(spark, d):
    return traversal.reach(order_graph(spark, d).edges, _seed(spark, 7), 3, "in")


@query("WITH {graph}, f AS (SELECT * FROM e WHERE src < dst) SELECT c.dst AS id, count(*) AS n FROM f a JOIN f b ON a.dst = b.src JOIN f c ON b.dst = c.src WHERE a.src = 1 GROUP BY 1")
def exact_depth_counts(spark, d):
    return traversal.count_walks(order_graph(spark, d).edges.where("src < dst"), _seed(spark, 1), 3)


@query("WITH {graph} SELECT a.src AS id, count(DISTINCT b.dst) AS n FROM e a JOIN e b ON a.dst = b.src AND a.eid <> b.eid GROUP BY 1")
def two_hop_distinct(spark, d):
    e = order_graph(spark, d).edges
    near = e.select(F.col("src").alias("id"), F.col("dst").alias("middle"), F.col("eid").alias("first"))
    far = e.select(F.col("src").alias("middle"), F.col("dst").alias("end"), "eid")
    # distinct ends before the count: partly in each task
    return near.join(far, "middle").where("first <> eid").select("id", "end").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"))


_PATH = "WITH RECURSIVE {graph}, s AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT s.b, r.depth + 1 FROM r JOIN s ON s.a = r.id WHERE r.depth < 5) "


@query(_PATH + "SELECT min(depth)::BIGINT AS hops FROM r WHERE id = 100")
def shortest_path_hops(spark, d):
    path = traversal.shortest_path(order_graph(spark, d).edges, 1, 100)
    return spark.createDataFrame([(len(path) - 1,)], "hops bigint")


@query(_PATH.replace("depth < 5", "depth < 3") + "SELECT id, min(depth)::BIGINT AS hops FROM r GROUP BY 1")
def undirected_distances(spark, d):
    return traversal.distances(order_graph(spark, d).edges, _seed(spark, 1), 3).withColumn("hops", F.col("hops").cast("bigint"))


@query("WITH RECURSIVE {graph}, ok AS (SELECT id FROM n WHERE value > 0), f AS (SELECT src, dst FROM e WHERE src IN (FROM ok) AND dst IN (FROM ok)), r(id, depth) AS (SELECT id, 0 FROM ok WHERE id = 5 UNION SELECT f.dst, r.depth + 1 FROM r JOIN f ON f.src = r.id WHERE r.depth < 3) SELECT id, depth::BIGINT AS hops FROM r WHERE depth > 0")
def constrained_traversal(spark, d):
    g = order_graph(spark, d)
    return traversal.constrained(g.edges, g.nodes, 5, 3, F.col("value") > 0).withColumn("hops", F.col("hops").cast("bigint"))


@query("WITH {graph} SELECT count(*) AS degree FROM e WHERE src = 7")
def degree(spark, d):
    return spark.createDataFrame([(order_graph(spark, d).degree(7),)], "degree bigint")


_LEVELS = _BFS % 4 + ", l AS (SELECT id, min(depth) AS depth FROM r GROUP BY 1)"


@query(_LEVELS.replace("WITH RECURSIVE", "WITH RECURSIVE", 1) + " SELECT depth::BIGINT AS depth, count(*) AS frontier_size, (SELECT count(*) FROM e JOIN l x ON e.src = x.id WHERE x.depth = l.depth - 1) AS edges_crossed, (SELECT count(*) FROM l y WHERE y.depth <= l.depth) AS cumulative_nodes FROM l WHERE depth > 0 GROUP BY depth")
def frontier_profile(spark, d):
    return procedures.call("frontier_profile", order_graph(spark, d), 1, 4)


_STATS = "WITH RECURSIVE {graph}, r(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 3), l AS (SELECT id, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY 1) "


@query(_STATS + "SELECT depth::BIGINT AS depth, count(value) AS count, round(avg(value), 4) AS avg, min(value) AS min, max(value) AS max FROM l JOIN n USING (id) GROUP BY 1")
def neighborhood_stats(spark, d):
    return procedures.call("neighborhood_stats", order_graph(spark, d), 1, "value", 3).withColumn("avg", F.round("avg", 4)).withColumn("depth", F.col("depth").cast("bigint"))


@query(_STATS + "SELECT id AS node_id, value, depth::BIGINT AS depth FROM l JOIN n USING (id) ORDER BY value DESC, id LIMIT 10")
def topk_reachable(spark, d):
    return procedures.call("topk_reachable", order_graph(spark, d), 1, "value", 10, 3).withColumn("depth", F.col("depth").cast("bigint"))


# code graph: parts as functions, suppliers' shared parts as calls


def _code(spark, d) -> PropertyGraph:
    p = table(spark, d, "part")
    n = p.count()
    nodes = p.select(F.col("p_partkey").alias("id"), F.array(F.lit("Function")).alias("labels"), F.concat_ws("#", "p_name", "p_partkey").alias("name"), F.col("p_size").cast("bigint").alias("complexity"), F.col("p_brand").alias("module"), (F.col("p_partkey") == 1).alias("entry"))
    calls = p.select((F.col("p_partkey") * 2).alias("eid"), F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + 3) % n).alias("dst"), F.lit("CALLS").alias("type"))
    more = p.where("p_size > 25").select((F.col("p_partkey") * 2 + 1).alias("eid"), F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 13 + 1) % n).alias("dst"), F.lit("CALLS").alias("type"))
    return PropertyGraph(nodes, calls.unionByName(more))


_CODE = "n AS (SELECT p_partkey AS id, p_name || '#' || p_partkey AS name, p_size AS complexity, p_brand AS module FROM part), e AS (SELECT p_partkey AS src, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) AS dst FROM part UNION ALL SELECT p_partkey, (p_partkey * 13 + 1) % (SELECT count(*) FROM part) FROM part WHERE p_size > 25)"
_GRADE = "CASE WHEN {x} <= 5 THEN 'A' WHEN {x} <= 10 THEN 'B' WHEN {x} <= 20 THEN 'C' WHEN {x} <= 30 THEN 'D' ELSE 'F' END"
_COUPLING = "ends AS (SELECT a.module AS ma, b.module AS mb FROM e JOIN n a ON e.src = a.id JOIN n b ON e.dst = b.id), x AS (SELECT least(ma, mb) AS module_a, greatest(ma, mb) AS module_b, count(*) AS calls FROM ends WHERE ma <> mb GROUP BY 1, 2), g AS (SELECT m, count(*) AS d FROM (SELECT ma AS m FROM ends UNION ALL SELECT mb FROM ends) GROUP BY 1), c AS (SELECT module_a, module_b, round(2 * calls / (p.d + q.d), 6) AS coupling_score FROM x JOIN g p ON p.m = module_a JOIN g q ON q.m = module_b)"
_DEAD = "alive(id) AS (SELECT 1::BIGINT UNION SELECT e.dst FROM alive JOIN e ON e.src = alive.id)"


@query(f"WITH {_CODE} SELECT name, complexity::BIGINT AS score, {_GRADE.format(x='complexity')} AS grade FROM n")
def complexity(spark, d):
    return procedures.call("complexity", _code(spark, d))


@query(f"WITH {_CODE}, {_COUPLING} SELECT * FROM c")
def coupling(spark, d):
    return procedures.call("coupling", _code(spark, d)).withColumn("coupling_score", F.round("coupling_score", 6))


@query(f"WITH RECURSIVE {_CODE}, {_DEAD} SELECT name, CASE WHEN id IN (SELECT dst FROM e WHERE src <> dst) THEN 'called only by dead code' ELSE 'never called' END AS reason, CASE WHEN id IN (SELECT dst FROM e WHERE src <> dst) THEN 0.8 ELSE 0.95 END::DOUBLE AS confidence FROM n WHERE id NOT IN (SELECT id FROM alive)")
def dead_code(spark, d):
    return procedures.call("dead_code", _code(spark, d))


@query(f"WITH RECURSIVE {_CODE}, {_DEAD}, {_COUPLING} SELECT {_GRADE.format(x='avg(complexity)')} AS grade, count(*) AS total_functions, round(avg(complexity), 6) AS avg_complexity, (SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM alive)) AS dead_code_count, (SELECT round(avg(coupling_score), 4) FROM c) AS coupling_score FROM n")
def health_report(spark, d):
    return procedures.call("health_report", _code(spark, d)).withColumn("avg_complexity", F.round("avg_complexity", 6)).withColumn("coupling_score", F.round("coupling_score", 4))


@query(f"WITH RECURSIVE {_CODE}, w(id, depth) AS (SELECT 10::BIGINT, 0 UNION ALL SELECT e.src, w.depth + 1 FROM w JOIN e ON e.dst = w.id WHERE w.depth < 3) SELECT name AS affected, min(depth)::BIGINT AS depth, count(*) AS path_count FROM w JOIN n USING (id) WHERE depth > 0 GROUP BY id, name")
def impact_analysis(spark, d):
    g = _code(spark, d)
    name = g.nodes.where("id = 10").first()["name"]
    return procedures.call("impact_analysis", g, name, 3).withColumn("depth", F.col("depth").cast("bigint"))


@query(f"WITH RECURSIVE {_CODE}, r(id, depth) AS (SELECT 4::BIGINT, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 4) SELECT DISTINCT n.name, n.module FROM r LEFT JOIN n USING (id) WHERE depth > 0")
def code_dependencies(spark, d):
    g = _code(spark, d)
    return traversal.reach(g.typed("CALLS"), _seed(spark, 4), 4).join(g.nodes, "id", "left").select("name", "module").distinct()


# algorithms


_RANK = ", ".join(f"r{k} AS MATERIALIZED (SELECT n.id, 0.15 / (SELECT count(*) FROM n) + 0.85 * (coalesce(s.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE id NOT IN (SELECT src FROM e)) / (SELECT count(*) FROM n)) AS rank FROM n LEFT JOIN (SELECT e.dst AS id, sum(r.rank / g.d) AS got FROM e JOIN r{k - 1} r ON r.id = e.src JOIN g ON g.src = e.src GROUP BY 1) s USING (id))" for k in range(1, 21))


@query("WITH {graph}, g AS (SELECT src, count(*) AS d FROM e GROUP BY 1), r0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS rank FROM n), " + _RANK + " SELECT id, round(rank, 9) AS rank FROM r20")
def pagerank(spark, d):
    g = order_graph(spark, d)
    return algorithms.pagerank(g.nodes, g.edges, 20).withColumn("rank", F.round("rank", 9))


@query("WITH {graph}, p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst) SELECT count(*) AS triangles FROM p x JOIN p y ON x.b = y.a JOIN p z ON z.a = x.a AND z.b = y.b")
def triangle_count(spark, d):
    return algorithms.triangle_count(order_graph(spark, d).edges)


@query("WITH RECURSIVE {graph}, s AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r(id, component) USING KEY (id) AS (SELECT id, id FROM n UNION (SELECT s.b, min(r.component) FROM r JOIN s ON s.a = r.id JOIN recurring.r AS old ON old.id = s.b WHERE r.component < old.component GROUP BY 1)) SELECT id, component FROM r")
def connected_components(spark, d):
    g = order_graph(spark, d)
    return algorithms.connected_components(g.nodes, g.edges)


def _vote(k: int) -> str:
    return f"v{k} AS MATERIALIZED (SELECT b AS id, community, count(*) AS c FROM l{k - 1} JOIN s ON s.a = l{k - 1}.id GROUP BY 1, 2), l{k} AS MATERIALIZED (SELECT l{k - 1}.id, coalesce(w.community, l{k - 1}.community) AS community FROM l{k - 1} LEFT JOIN (SELECT id, community FROM v{k} QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, community) = 1) w USING (id))"


@query("WITH {graph}, p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst), s AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p), l0 AS (SELECT id, id AS community FROM n), " + ", ".join(_vote(k) for k in range(1, 21)) + " SELECT id, community FROM l20")
def community_detection(spark, d):
    g = order_graph(spark, d)
    return algorithms.label_propagation(g.nodes, g.edges, 20)


@query()
def betweenness(spark, d):
    g = order_graph(spark, d)
    return algorithms.betweenness(g.nodes, g.edges).withColumn("betweenness", F.round("betweenness", 6))


@query()
def louvain(spark, d):
    g = order_graph(spark, d)
    return algorithms.louvain(g.nodes, g.edges)


# social queries on the order graph


@query("WITH {graph} SELECT f.dst AS friend, n.name, count(*) AS n FROM e f JOIN n ON n.id = f.dst WHERE f.src = 5 GROUP BY 1, 2 ORDER BY n DESC, friend LIMIT 20")
def friends(spark, d):
    g = order_graph(spark, d)
    return g.edges.where("src = 5").join(g.nodes.select(F.col("id").alias("dst"), "name"), "dst").groupBy(F.col("dst").alias("friend"), "name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "friend").limit(20)


@query("WITH {graph}, f AS (SELECT DISTINCT dst AS friend FROM e WHERE src = 5) SELECT o.o_orderkey AS message, o.o_custkey AS friend, o.o_orderdate AS created FROM f JOIN orders o ON o.o_custkey = f.friend ORDER BY created DESC, message LIMIT 20")
def messages_of_friends(spark, d):
    f = order_graph(spark, d).edges.where("src = 5").select(F.col("dst").alias("friend")).distinct()
    return table(spark, d, "orders").join(F.broadcast(f), F.col("o_custkey") == F.col("friend")).select(F.col("o_orderkey").alias("message"), "friend", F.col("o_orderdate").alias("created")).orderBy(F.desc("created"), "message").limit(20)


@query("SELECT a.l_partkey AS a, b.l_partkey AS b, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(*) > 1")
def cooccurrence(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("a"))
    # hardly any pair occurs twice in a task, so pairs are not counted before they are dealt out, and few enough to a partition
    parts = min(max(x.count() // 100_000, 1), 10_000)
    x = x.repartition(parts, "l_orderkey")
    y = x.select("l_orderkey", F.col("a").alias("b"))
    return x.join(y, "l_orderkey").where("a < b").repartition(parts, "a", "b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT l_partkey AS tag, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, tag LIMIT 25")
def tag_popularity(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("tag")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(25)


# vectors


def _query_vector(spark, d):
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


@query("SELECT e.vec_id AS node, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, node LIMIT 10")
def vector_topk(spark, d):
    return vector.vector_topk(table(spark, d, "embeddings"), _query_vector(spark, d), 10).withColumn("score", F.round("score", 6))


@query("WITH RECURSIVE {graph}, r(id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 3) SELECT v.vec_id AS node, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE v.vec_id IN (SELECT id FROM r WHERE depth > 0) ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, node LIMIT 10")
def graph_constrained_search(spark, d):
    return vector.constrained_topk(order_graph(spark, d).edges, 1, 3, table(spark, d, "embeddings"), _query_vector(spark, d), 10).withColumn("score", F.round("score", 6))


@query("WITH RECURSIVE {graph}, s AS (SELECT e.vec_id AS id FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id LIMIT 5), r(seed, id, depth) AS (SELECT id, id, 0 FROM s UNION SELECT r.seed, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 2) SELECT s.id AS seed, count(DISTINCT r.id) FILTER (r.depth > 0) AS n FROM s JOIN r ON r.seed = s.id GROUP BY 1")
def vector_to_graph(spark, d):
    top = vector.vector_topk(table(spark, d, "embeddings"), _query_vector(spark, d), 5).select(F.col("node").alias("id"))
    return vector.expand_from(order_graph(spark, d).edges, top, 2)


@query("WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id) SELECT count(*) AS pairs, round(avg(s), 6) AS mean FROM p WHERE s >= 0.3")
def similar_pairs(spark, d):
    found = vector.similar_pairs(table(spark, d, "embeddings"), 0.3)
    return found.select("pairs", F.round(F.try_divide("total", "pairs"), 6).alias("mean"))


@query("WITH RECURSIVE v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.label = b.label AND a.id < b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.4), s AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r(id, c) USING KEY (id) AS (SELECT id, id FROM v UNION (SELECT s.b, min(r.c) FROM r JOIN s ON s.a = r.id JOIN recurring.r AS old ON old.id = s.b WHERE r.c < old.c GROUP BY 1)) SELECT c AS cluster_id, (SELECT count(*) FROM r x WHERE x.c = r.c) AS members, round(avg(p.s), 6) AS avg_similarity FROM p JOIN r ON r.id = p.a GROUP BY 1, 2")
def similarity_clusters(spark, d):
    return vector.similar_clusters(table(spark, d, "embeddings"), 0.4).withColumn("avg_similarity", F.round("avg_similarity", 6))


@query()
def semantic_search(spark, d):
    return vector.semantic_search(table(spark, d, "documents"), "the license under version", 10).withColumn("score", F.round("score", 6))
