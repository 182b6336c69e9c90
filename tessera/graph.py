"""Property graphs: labelled node tables and typed edge tables, changed by making new versions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.storage import materialize


@dataclass(frozen=True)
class PropertyGraph:
    """``nodes``: ``id bigint, labels array<string>`` and properties.  ``edges``: ``eid, src, dst bigint, type string`` and properties.

    Every change returns a new graph with the next ``snapshot``; tables are
    never changed in place, so readers of an older version see no half write.
    """

    nodes: DataFrame
    edges: DataFrame
    snapshot: int = 0
    indexes: tuple[tuple[str, str], ...] = ()
    constraints: tuple[tuple[str, str, str], ...] = field(default=())
    #: (label, property, value) -> nodes by a written index, or None; a stored graph has one
    finder: Callable[[str, str, object], DataFrame | None] | None = field(default=None, compare=False)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    # scans

    def labelled(self, label: str | None = None) -> DataFrame:
        return self.nodes if label is None else self.nodes.where(F.array_contains("labels", label))

    def typed(self, *types: str) -> DataFrame:
        return self.edges if not types else self.edges.where(F.col("type").isin(*types))

    def node(self, id_: int) -> DataFrame:
        return self.nodes.where(F.col("id") == id_)

    def having(self, labels: tuple[str, ...], name: str, value) -> DataFrame | None:
        """Nodes with a label and a property's value by a written index; None without one."""
        for label in labels if self.finder else ():
            found = self.finder(label, name, value)
            if found is not None:
                return found
        return None

    def degree(self, id_: int) -> int:
        return self.edges.where(F.col("src") == id_).count()

    def counts(self) -> tuple[int, int]:
        return self.nodes.count(), self.edges.count()

    def counts_by_label(self) -> DataFrame:
        return self.nodes.groupBy(F.get("labels", F.lit(0)).alias("label")).agg(F.count(F.lit(1)).alias("n"))

    def counts_by_type(self) -> DataFrame:
        return self.edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))

    def _next(self, **changed) -> PropertyGraph:
        return replace(self, snapshot=self.snapshot + 1, finder=None, **changed)

    # changes

    def create_nodes(self, rows: DataFrame) -> PropertyGraph:
        """Adds nodes; a column the graph lacks is null for older nodes."""
        if "labels" not in rows.columns:
            rows = rows.withColumn("labels", F.array().cast("array<string>"))
        return self._next(nodes=self.nodes.unionByName(rows, allowMissingColumns=True))

    def numbered_edges(self, pairs: DataFrame, kind: str) -> DataFrame:
        """New edges, numbered once, for each row of ``pairs(src, dst, …)`` whose two ends exist."""
        ends = self.nodes.select("id")
        found = pairs.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
        top = self.edges.agg(F.coalesce(F.max("eid"), F.lit(-1)).alias("top"))
        numbered = found.withColumn("eid", F.monotonically_increasing_id()).crossJoin(F.broadcast(top)).withColumn("eid", F.col("eid") + F.col("top") + 1).drop("top").withColumn("type", F.lit(kind))
        return materialize(numbered, "new-edges")  # a plan run again would give other numbers

    def create_edges(self, pairs: DataFrame, kind: str) -> PropertyGraph:
        """Adds an edge for each row of ``pairs(src, dst, …)`` whose two ends exist; others create nothing."""
        return self._next(edges=self.edges.unionByName(self.numbered_edges(pairs, kind), allowMissingColumns=True))

    def set_property(self, where: Column, name: str, value: Column) -> PropertyGraph:
        old = F.col(name) if name in self.nodes.columns else F.lit(None)
        return self._next(nodes=self.nodes.withColumn(name, F.when(where, value).otherwise(old)))

    def set_properties(self, where: Column, values: dict[str, Column]) -> PropertyGraph:
        """Replaces all properties: those not named become null."""
        own = [c for c in self.nodes.columns if c not in ("id", "labels")]
        new = {c: F.when(where, values.get(c, F.lit(None))).otherwise(F.col(c)) for c in own}
        new |= {c: F.when(where, v) for c, v in values.items() if c not in own}
        return self._next(nodes=self.nodes.withColumns(new))

    def remove_property(self, where: Column, name: str) -> PropertyGraph:
        return self.set_property(where, name, F.lit(None))

    def add_label(self, where: Column, label: str) -> PropertyGraph:
        return self._next(nodes=self.nodes.withColumn("labels", F.when(where, F.array_union("labels", F.array(F.lit(label)))).otherwise(F.col("labels"))))

    def remove_label(self, where: Column, label: str) -> PropertyGraph:
        return self._next(nodes=self.nodes.withColumn("labels", F.when(where, F.array_remove("labels", label)).otherwise(F.col("labels"))))

    def delete(self, where: Column, detach: bool = False) -> PropertyGraph:
        """Deletes nodes; their edges go too if ``detach``, else such edges are an error."""
        gone = self.nodes.where(where).select("id")
        at = lambda c: gone.withColumnRenamed("id", c)
        kept_edges = self.edges.join(at("src"), "src", "left_anti").join(at("dst"), "dst", "left_anti").select(*self.edges.columns)
        if not detach:
            touching = self.edges.join(at("src"), "src", "left_semi").unionByName(self.edges.join(at("dst"), "dst", "left_semi"))
            if not touching.isEmpty():
                raise ValueError("nodes still have edges; detach them")
            kept_edges = self.edges
        return self._next(nodes=self.nodes.join(gone, "id", "left_anti").select(*self.nodes.columns), edges=kept_edges)

    def merge(self, rows: DataFrame, on: str, on_create: dict[str, Column] | None = None, on_match: dict[str, Column] | None = None) -> PropertyGraph:
        """Finds or creates one node per distinct key; ``on_create`` and ``on_match`` set properties.

        ``rows`` has the key column and, for nodes to be created, ``id`` and ``labels``.
        """
        keys = rows.select(on).distinct().withColumn("merge_", F.lit(True))
        hit = self.nodes.join(keys, on, "left")
        matched = hit.withColumns({c: F.when(F.col("merge_"), v).otherwise(F.col(c) if c in self.nodes.columns else F.lit(None)) for c, v in (on_match or {}).items()}).drop("merge_")
        created = rows.dropDuplicates([on]).join(self.nodes.select(on), on, "left_anti").withColumns(on_create or {})
        return self._next(nodes=matched.unionByName(created, allowMissingColumns=True))

    def create_index(self, label: str, name: str) -> PropertyGraph:
        """Records an index; the nodes are laid out by the property, so that file statistics prune."""
        if (label, name) in self.indexes:
            return self
        laid = self.nodes.repartitionByRange(name).sortWithinPartitions(name)
        return replace(self, nodes=laid, indexes=(*self.indexes, (label, name)))

    def show_indexes(self) -> DataFrame:
        return self.spark.createDataFrame(list(self.indexes), "label string, property string")

    def violations(self, label: str, name: str, kind: str) -> DataFrame:
        """Ids that break a constraint: ``exists`` (null property) or ``unique`` (repeated value)."""
        own = self.labelled(label)
        if kind == "exists":
            return own.where(F.col(name).isNull()).select("id")
        twice = own.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(name)
        return own.join(twice, name, "left_semi").select("id")

    def add_constraint(self, label: str, name: str, kind: str) -> PropertyGraph:
        if not self.violations(label, name, kind).isEmpty():
            raise ValueError(f"{label}.{name} is not {kind}")
        return replace(self, constraints=(*self.constraints, (label, name, kind)))

    def transaction(self) -> Transaction:
        return Transaction(self)


class Transaction:
    """Buffers changes; ``commit`` checks the constraints and returns the new graph, ``rollback`` the old one."""

    def __init__(self, graph: PropertyGraph):
        self.before = self.now = graph

    def apply(self, change, *args, **kw) -> Transaction:
        self.now = getattr(self.now, change)(*args, **kw)
        return self

    def commit(self) -> PropertyGraph:
        for label, name, kind in self.now.constraints:
            if not self.now.violations(label, name, kind).isEmpty():
                raise ValueError(f"{label}.{name} is not {kind}")
        return replace(self.now, snapshot=self.before.snapshot + 1)

    def rollback(self) -> PropertyGraph:
        return self.before


def order_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Customers as nodes, orders as edges between them by integer arithmetic (directed multigraph with cycles)."""
    customer, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "orders"))
    n = customer.count()
    nodes = customer.select(
        F.col("c_custkey").alias("id"), F.array(F.lit("Customer"), F.concat(F.lit("Segment"), F.col("c_mktsegment"))).alias("labels"),
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("category"), F.col("c_nationkey").alias("nation"),
        ((F.col("c_custkey") * 37) % 18000 / 100.0 - 90).alias("lat"), ((F.col("c_custkey") * 91) % 36000 / 100.0 - 180).alias("lon"),
    )
    edges = orders.select(
        F.col("o_orderkey").alias("eid"), F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 31 + F.col("o_orderkey") * 17) % n).alias("dst"),
        F.col("o_orderpriority").alias("type"), F.col("o_totalprice").alias("weight"),
    )
    return PropertyGraph(nodes, edges)
