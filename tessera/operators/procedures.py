"""Named procedures: ``call(name, graph, …)`` returns a DataFrame."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph
from tessera.operators import algorithms, traversal, vector

#: Session setting that holds the time a measured query may take, in milliseconds.
BUDGET = "tessera.query.budget.ms"
#: Upper complexity of each grade; what is above the last is an F.
GRADES = (("A", 5), ("B", 10), ("C", 20), ("D", 30))


def _seed(graph: PropertyGraph, start: int) -> DataFrame:
    return graph.spark.createDataFrame([(start,)], "id bigint")


def frontier_profile(graph: PropertyGraph, start: int, depth: int) -> DataFrame:
    return traversal.frontier_profile(graph.edges, start, depth)


def neighborhood_stats(graph: PropertyGraph, start: int, prop: str, depth: int) -> DataFrame:
    reached = traversal.levels(graph.edges, _seed(graph, start), depth).join(graph.nodes.select("id", prop), "id")
    return reached.groupBy("depth").agg(F.count(prop).alias("count"), F.avg(prop).alias("avg"), F.min(prop).alias("min"), F.max(prop).alias("max"))


def topk_reachable(graph: PropertyGraph, start: int, prop: str, k: int, depth: int) -> DataFrame:
    reached = traversal.levels(graph.edges, _seed(graph, start), depth).join(graph.nodes.select("id", prop), "id")
    return reached.select(F.col("id").alias("node_id"), F.col(prop).alias("value"), "depth").orderBy(F.desc_nulls_last("value"), "node_id").limit(k)


def find_path_budgeted(graph: PropertyGraph, start: int, end: int, milliseconds: float) -> DataFrame:
    """No row or one: the clock is read between levels; the last whole level counts."""
    began = time.monotonic()
    path = traversal.shortest_path(graph.edges, start, end, budget_ms=milliseconds)
    rows = [(path, (time.monotonic() - began) * 1000, len(path) - 1)] if path else []
    return graph.spark.createDataFrame(rows, "path array<bigint>, cost_ms double, hops int")


def edge_aggregate(graph: PropertyGraph) -> DataFrame:
    return graph.edges.groupBy("type").agg(F.count(F.lit(1)).alias("count"), F.avg("weight").alias("avg_weight"))


def live_aggregate(graph: PropertyGraph, label: str | None, prop: str) -> DataFrame:
    return graph.labelled(label).agg(F.count(prop).alias("count"), F.coalesce(F.sum(prop), F.lit(0)).alias("sum"), F.avg(prop).alias("avg"), F.min(prop).alias("min"), F.max(prop).alias("max"))


def grade(score) -> F.Column:
    out = None
    for name, most in GRADES:
        out = F.when(score <= most, name) if out is None else out.when(score <= most, name)
    return out.otherwise("F")


def complexity(graph: PropertyGraph, prop: str = "complexity") -> DataFrame:
    return graph.nodes.where(F.col(prop).isNotNull()).select("name", F.col(prop).alias("score"), grade(F.col(prop)).alias("grade"))


def coupling(graph: PropertyGraph, module: str = "module") -> DataFrame:
    """Share of both modules' calls that cross between them."""
    place = graph.nodes.select("id", module)
    ends = graph.edges.join(place.select(F.col("id").alias("src"), F.col(module).alias("ma")), "src").join(place.select(F.col("id").alias("dst"), F.col(module).alias("mb")), "dst")
    across = ends.where("ma <> mb").groupBy(F.least("ma", "mb").alias("module_a"), F.greatest("ma", "mb").alias("module_b")).agg(F.count(F.lit(1)).alias("calls"))
    degree = ends.select(F.col("ma").alias("m")).unionAll(ends.select(F.col("mb").alias("m"))).groupBy("m").agg(F.count(F.lit(1)).alias("d"))
    scored = across.join(degree.select(F.col("m").alias("module_a"), F.col("d").alias("da")), "module_a").join(degree.select(F.col("m").alias("module_b"), F.col("d").alias("db")), "module_b")
    return scored.select("module_a", "module_b", (2 * F.col("calls") / (F.col("da") + F.col("db"))).alias("coupling_score"))


def entry_points(graph: PropertyGraph) -> DataFrame:
    """Nodes flagged ``entry`` or named ``main``."""
    marks = []
    if "entry" in graph.nodes.columns:
        marks.append(F.coalesce(F.col("entry"), F.lit(False)))
    if "name" in graph.nodes.columns:
        marks.append(F.col("name") == "main")
    condition = marks[0] if len(marks) == 1 else marks[0] | marks[1]
    return graph.nodes.where(condition).select("id")


def dead_code(graph: PropertyGraph, depth: int = traversal.MAX_DEPTH) -> DataFrame:
    """Nodes no entry point reaches; without callers they are surer to be dead."""
    entries = entry_points(graph)
    alive = entries.unionByName(traversal.reach(graph.edges, entries, depth))
    called = graph.edges.where("src <> dst").select(F.col("dst").alias("id")).distinct().withColumn("called", F.lit(True))
    dead = graph.nodes.join(alive, "id", "left_anti").join(called, "id", "left")
    return dead.select("name", F.when(F.col("called"), "called only by dead code").otherwise("never called").alias("reason"), F.when(F.col("called"), 0.8).otherwise(0.95).alias("confidence"))


def health_report(graph: PropertyGraph, prop: str = "complexity", module: str = "module") -> DataFrame:
    one = graph.nodes.agg(F.count(F.lit(1)).alias("total_functions"), F.avg(prop).alias("avg_complexity"))
    dead = dead_code(graph).agg(F.count(F.lit(1)).alias("dead_code_count"))
    score = coupling(graph, module).agg(F.coalesce(F.avg("coupling_score"), F.lit(0.0)).alias("coupling_score"))
    joined = one.crossJoin(dead).crossJoin(score)  # three single rows
    return joined.select(grade(F.col("avg_complexity")).alias("grade"), "total_functions", "avg_complexity", "dead_code_count", "coupling_score")


def impact_analysis(graph: PropertyGraph, name: str | int, depth: int = 5) -> DataFrame:
    """``affected, depth, path_count`` of callers, and callers of callers, of the node of an id or of all nodes of a name."""
    start = graph.nodes.where(F.col("name" if isinstance(name, str) else "id") == name).select("id")
    first = traversal.levels(graph.edges, start, depth, "in")
    paths = None
    for h in range(1, depth + 1):
        walks = traversal.count_walks(graph.edges, start, h, "in")
        paths = walks if paths is None else paths.unionByName(walks)
    counts = paths.groupBy("id").agg(F.sum("n").alias("path_count"))
    return first.join(counts, "id").join(graph.nodes.select("id", "name"), "id").select(F.col("name").alias("affected"), "depth", "path_count")


class Budget:
    """Cancels the jobs of a block of queries when its time is up.

    ``with Budget(spark, 500) as b: …`` ; ``b.spent`` tells afterwards.
    """

    def __init__(self, spark: SparkSession, milliseconds: float):
        self.sc, self.limit, self.spent = spark.sparkContext, milliseconds / 1000, False
        self.group = f"budget-{id(self)}"

    def _stop(self) -> None:
        self.spent = True
        self.sc.cancelJobGroup(self.group)

    def __enter__(self) -> Budget:
        self.sc.setJobGroup(self.group, "budgeted query", interruptOnCancel=True)
        self.timer = threading.Timer(self.limit, self._stop)
        self.timer.daemon = True
        self.timer.start()
        return self

    def __exit__(self, kind, value, trace) -> bool:
        self.timer.cancel()
        self.sc.setLocalProperty("spark.jobGroup.id", None)
        return self.spent and kind is not None


def query_budget(graph: PropertyGraph, milliseconds: float) -> DataFrame:
    """Sets the time that a measured query of this session may take; 0 lifts it."""
    graph.spark.conf.set(BUDGET, str(float(milliseconds)))
    return graph.spark.createDataFrame([(float(milliseconds), milliseconds > 0)], "budget_ms double, enforced boolean")


def budget_of(spark: SparkSession) -> float | None:
    """The session's budget in milliseconds, if it has one."""
    found = float(spark.conf.get(BUDGET, "0"))
    return found if found > 0 else None


def _vectors(graph: PropertyGraph, source) -> tuple[DataFrame, str, str]:
    """(table, id column, vector column) of a table, or of the nodes' property that an index is named after."""
    if isinstance(source, DataFrame):
        return source, "vec_id", "embedding"
    name = source if source in graph.nodes.columns else source.removesuffix("_index")
    return graph.nodes.where(F.col(name).isNotNull()), "id", name


def vector_search(graph: PropertyGraph, source, query: list[float], k: int) -> DataFrame:
    """``node, score``: the nearest vectors of a table or of an index of the nodes."""
    rows, id_col, name = _vectors(graph, source)
    return vector.vector_topk(rows, query, k, name, id_col)


def cluster_similar(graph: PropertyGraph, *args) -> DataFrame:
    """``cluster_id, members, avg_similarity``: with a table before the threshold of its vectors, else of the nodes' embeddings."""
    source, least = args if len(args) > 1 else ("embedding", args[0])
    rows, id_col, name = _vectors(graph, source)
    if "label" not in rows.columns:
        rows = rows.withColumn("label", F.lit(""))
    return vector.similar_clusters(rows, least, id_col=id_col, vector=name, listed=True)


def semantic_search(graph: PropertyGraph, *args) -> DataFrame:
    """``node, score, snippet`` of the texts of a table, or else of the nodes (property ``text`` or ``name``)."""
    if isinstance(args[0], DataFrame):
        return vector.semantic_search(*args)
    return vector.semantic_search(graph.nodes, *args, id_col="id", text_col="text" if "text" in graph.nodes.columns else "name")


def vector_similarity(node: F.Column, prop: str, query: F.Column) -> F.Column:
    """Cosine of a bound node's vector property with a query."""
    return vector.cosine(node.getField(prop), query)


#: Procedures that give a value for each bound row, and the columns of the others that hold node ids.
ROW_WISE = {"vector_similarity": vector_similarity}
YIELDS_NODES = {"vector_search": "node", "semantic_search": "node"}


def _caches(graph: PropertyGraph) -> DataFrame:
    """Drops every cached table of the session."""
    graph.spark.catalog.clearCache()
    return graph.spark.createDataFrame([(True,)], "cleared boolean")


def _cache_call(name: str) -> Callable[..., DataFrame]:
    """A procedure on the result cache that the graph's session learns into."""

    def call(graph: PropertyGraph, *args) -> DataFrame:
        from tessera.harness import cache

        return getattr(cache.of(graph.spark), name)(*args)

    call.__doc__ = f"The result cache's {name.replace('_', ' ')}."
    return call


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "frontier_profile": frontier_profile, "neighborhood_stats": neighborhood_stats, "topk_reachable": topk_reachable, "find_path_budgeted": find_path_budgeted,
    "edge_aggregate": edge_aggregate, "live_aggregate": live_aggregate, "complexity": complexity, "coupling": coupling, "dead_code": dead_code,
    "health_report": health_report, "impact_analysis": impact_analysis,
    "pagerank": lambda g, rounds=20: algorithms.pagerank(g.nodes, g.edges, rounds), "connected_components": lambda g: algorithms.connected_components(g.nodes, g.edges),
    "triangle_count": lambda g: algorithms.triangle_count(g.edges), "community_detection": lambda g, rounds=20: algorithms.label_propagation(g.nodes, g.edges, rounds),
    "betweenness": lambda g, sources=50: algorithms.betweenness(g.nodes, g.edges, sources), "louvain": lambda g: algorithms.louvain(g.nodes, g.edges),
    "bfs": lambda g, start, depth: traversal.levels(g.edges, _seed(g, start), depth),
    "vector_search": vector_search, "cluster_similar": cluster_similar, "semantic_search": semantic_search, "query_budget": query_budget,
    "clear_cache": _caches, "clear_plan_cache": _caches,
    "emergent_cache_stats": _cache_call("as_table"), "emergent_invalidation_stats": _cache_call("invalidations"), "emergent_config": _cache_call("settings"),
}


REGISTRY["procedures"] = lambda g: procedures(g.spark)
REGISTRY["functions"] = lambda g: functions(g.spark)


def call(name: str, graph: PropertyGraph, *args, **kw) -> DataFrame:
    if name not in REGISTRY:
        raise KeyError(f"no procedure {name}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name](graph, *args, **kw)


def procedures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, (f.__doc__ or "").strip().split("\n")[0]) for n, f in sorted(REGISTRY.items())], "name string, what string")


def functions(spark: SparkSession) -> DataFrame:
    from tessera.functions.cypher import REGISTRY as own

    return spark.createDataFrame([(n,) for n in sorted(own)], "name string")
