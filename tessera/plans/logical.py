"""The logical pattern plan that both query languages build, and its lowering to DataFrames.

A bound node or edge is one struct column, whose unused fields Catalyst prunes.
Rewrites that Catalyst cannot make are made here: distinct ends of a
variable-length step become a search with visited sets instead of trails; a
node's table is joined only if more than its id is used; a chain is walked from
a node that is bound already or known by its id.  No edge is used twice by the
patterns of one MATCH, whatever their form: each new edge is compared with those
before that may be of its type.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.graph import PropertyGraph
from tessera.operators import traversal
from tessera.storage import materialize

#: Edges of a node up to which their ends are listed beside it.
ENDS = 1000


@dataclass
class Node:
    """A node of a pattern; ``where`` maps properties to values."""

    var: str
    labels: tuple[str, ...] = ()
    where: dict = field(default_factory=dict)


@dataclass
class Edge:
    var: str
    types: tuple[str, ...] = ()
    direction: str = "out"
    low: int = 1
    high: int = 1
    where: dict = field(default_factory=dict)
    varied: bool = False


@dataclass
class Op:
    """A step: ``kind`` and its arguments; steps form a list, each working on the one before."""

    kind: str
    args: dict

    def text(self) -> str:
        shown = {k: v for k, v in self.args.items() if not callable(v) and k != "fn"}
        return f"{self.kind}({', '.join(f'{k}={v}' for k, v in shown.items())})"


@dataclass
class Plan:
    graph: PropertyGraph
    steps: list[Op] = field(default_factory=list)
    #: properties used of each variable; "*" for all
    used: dict[str, set[str]] = field(default_factory=dict)

    def add(self, kind: str, **args) -> Plan:
        """Appends a step."""
        self.steps.append(Op(kind, args))
        return self

    def explain(self) -> str:
        return "\n".join(s.text() for s in self.steps)

    # lowering

    def run(self) -> DataFrame:
        df: DataFrame | None = None
        for step in self.steps:
            df = getattr(self, f"_{step.kind.lower()}")(df, **step.args)
        return df if df is not None else self.graph.spark.range(1).select()

    def _struct(self, node: Node) -> DataFrame:
        rows = self.graph.nodes
        for name, value in node.where.items():
            if not callable(value) and (found := self.graph.having(node.labels, name, value)) is not None:
                rows = found.select(*rows.columns)
                break
        for label in node.labels:
            rows = rows.where(F.array_contains("labels", label))
        for name, value in node.where.items():
            if not callable(value):
                rows = rows.where(F.col(name) == value if name in rows.columns else F.lit(False))
        return rows.select(F.struct(*rows.columns).alias(node.var))

    def _bound(self, df: DataFrame, node: Node) -> DataFrame:
        """Conditions of a property map that depend on what is bound: with the join before, equi-joins."""
        for name, value in node.where.items():
            if callable(value):
                df = df.where(F.col(f"{node.var}.{name}") == value(df))
        return df

    def _plain(self, node: Node) -> bool:
        """Whether the node's table is not needed: edges always have both ends."""
        return not node.labels and not node.where and self.used.get(node.var, set()) <= {"id"}

    def _match(
        self, df: DataFrame | None, chains: list[tuple[str | None, list, bool]], optional: bool = False,
        where: Callable[[DataFrame], Column] | None = None, distinct_ends: bool = False, each: bool = False,
    ) -> DataFrame:
        """All patterns ``(path variable, chain, whether the path's nodes are asked for)`` of one MATCH at once.

        ``distinct_ends``: nothing later depends on how often a row occurs, so a
        lone variable-length step may be searched; with ``each`` every such step.
        """
        if optional:
            first = df is None
            df = self._one() if first else df
            marked = materialize(df.withColumn("row_", F.monotonically_increasing_id()), "optional")
            inner = self._match(marked, chains, where=where, distinct_ends=distinct_ends, each=each)
            new = [c for c in inner.columns if c not in marked.columns]
            return marked.join(inner.select("row_", *new), "row_", "left").drop("row_", *(["one_"] if first else []))
        seen: list[Edge] = []
        left = list(chains)
        while left:
            bound = set(df.columns) if df is not None else set()
            # a chain that meets what is bound goes first, so that it is joined and not crossed
            at = next((k for k, (_, chain, _) in enumerate(left) if any(n.var in bound for n in chain[::2])), 0)
            path, chain, nodes = left.pop(at)
            df = self._chain(df, chain, seen, path is not None, distinct_ends and (each or sum(len(c) // 2 for _, c, _ in chains) == 1), [c for _, c, _ in left])
            if path is not None:
                df = self._path(df, chain, path, nodes)
        if where is not None:
            df = df.where(where(df))
        return df

    def _one(self) -> DataFrame:
        return self.graph.spark.range(1).select(F.lit(True).alias("one_"))

    def _chain(self, df: DataFrame | None, chain: list, seen: list[Edge], on_path: bool, distinct_ends: bool, later: list[list] = ()) -> DataFrame:
        """Walks a chain from its node that is bound, or else from one known by its id, to both sides; ``later``: the chains to come."""
        bound = set(df.columns) if df is not None else set()
        nodes = chain[::2]
        known = [k for k, n in enumerate(nodes) if n.var in bound] or [k for k, n in enumerate(nodes) if "id" in n.where and not callable(n.where["id"])] or [0]
        at = known[0]
        start = nodes[at]
        every = df is None and "id" not in start.where and self._alike()
        if df is None:
            df = self._struct(start)
        elif start.var not in bound:
            df = df.crossJoin(self._struct(start))
        elif start.labels or start.where:
            df = self._narrow(df, start)
        df = self._bound(df, start)
        for k in range(at, len(nodes) - 1):
            closing = self._closing(df, nodes[k + 1], [chain[2 * k + 2 :], *later]) if every and not chain[2 * k + 1].varied else None
            if closing:
                df = self._with_ends(df, *closing)
            df = self._expand(df, nodes[k], chain[2 * k + 1], nodes[k + 1], seen, on_path, distinct_ends)
            if closing:
                df = df.where(F.col("ends_").isNull() | F.array_contains("ends_", F.hash(F.col(f"{nodes[k + 1].var}.id")))).drop("ends_")
        for k in range(at, 0, -1):
            df = self._expand(df, nodes[k], chain[2 * k - 1], nodes[k - 1], seen, on_path, distinct_ends, back=True)
        return df

    def _alike(self) -> bool:
        """Whether ids of nodes and of edges' ends have one type, so that equal ones have equal hashes."""
        kinds = {dict(self.graph.nodes.dtypes)["id"], *(dict(self.graph.edges.dtypes)[c] for c in ("src", "dst"))}
        return len(kinds) == 1 and kinds <= {"int", "bigint", "string"}

    def _closing(self, df: DataFrame, node: Node, chains: list[list]) -> tuple[Node, Edge, str] | None:
        """A later step of one edge between ``node``, which is about to be bound, and a bound one: that one, the edge and its direction from there."""
        if node.var in df.columns:
            return None
        for chain in chains:
            for a, edge, b in zip(chain[:-2:2], chain[1::2], chain[2::2], strict=True):
                if edge.varied or edge.direction == "both" or edge.var in df.columns:
                    continue
                if a.var == node.var and b.var in df.columns:
                    return b, edge, {"out": "in", "in": "out"}[edge.direction]
                if b.var == node.var and a.var in df.columns:
                    return a, edge, edge.direction
        return None

    def _with_ends(self, df: DataFrame, near: Node, edge: Edge, direction: str) -> DataFrame:
        """``df`` with ``ends_``: hashes of the nodes that an edge of ``near`` leads to, null for nodes of very many edges.

        The step that this edge closes is then cut down where it is made, before its rows are sent to be joined with the edge.
        """
        edges = self.graph.typed(*edge.types)
        own, other = ("src", "dst") if direction == "out" else ("dst", "src")
        few = edges.groupBy(F.col(own).alias("of_")).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") <= ENDS).select("of_")
        ends = edges.select(F.col(own).alias("of_"), F.hash(other).alias("end_")).join(few, "of_").groupBy("of_").agg(F.collect_list("end_").alias("ends_"))
        return df.join(ends, F.col(f"{near.var}.id") == F.col("of_"), "left").drop("of_")

    def _path(self, df: DataFrame, chain: list, path: str, nodes: bool) -> DataFrame:
        """Struct column ``path``: ``hops``, ``eids`` and, if asked for, ``nodes`` with their properties."""
        ids, eids = F.array(F.col(f"{chain[0].var}.id")), F.array().cast("array<bigint>")
        for edge, node in zip(chain[1::2], chain[2::2], strict=True):
            if edge.varied:
                ids, eids = F.concat(ids, F.slice(F.col(f"{edge.var}.nodes"), 2, 1 << 20)), F.concat(eids, F.col(f"{edge.var}.eids"))
            else:
                ids, eids = F.concat(ids, F.array(F.col(f"{node.var}.id"))), F.concat(eids, F.array(F.col(f"{edge.var}.eid")))
        if not nodes:
            return df.withColumn(path, F.struct(F.size(eids).cast("bigint").alias("hops"), eids.alias("eids")))
        return self._with_nodes(df.withColumn("ids_", ids).withColumn("eids_", eids), path)

    def _with_nodes(self, df: DataFrame, path: str) -> DataFrame:
        """Turns ``ids_`` and ``eids_`` into the path column: a join for all nodes of all paths, and their order restored."""
        marked = materialize(df.withColumn("row_", F.monotonically_increasing_id()), "paths")
        own = self.graph.nodes
        steps = marked.select("row_", F.posexplode("ids_").alias("at_", "id")).join(own, "id")
        lists = steps.groupBy("row_").agg(F.array_sort(F.collect_list(F.struct("at_", F.struct(*own.columns).alias("n")))).alias("ns"))
        out = marked.join(lists, "row_").withColumn(path, F.struct(F.size("eids_").cast("bigint").alias("hops"), F.col("eids_").alias("eids"), F.transform("ns", lambda x: x["n"]).alias("nodes")))
        return out.drop("row_", "ns", "ids_", "eids_")

    def _shortest(self, df: DataFrame | None, chain: list, path: str | None, nodes: bool = False) -> DataFrame:
        """One shortest path between the two ends, ties to the smallest node ids; no row where there is none."""
        start, edge, end = chain
        for node in (start, end):
            if df is None:
                df = self._struct(node)
            elif node.var not in df.columns:
                df = df.crossJoin(self._struct(node))
            elif node.labels or node.where:
                df = self._narrow(df, node)
        edges = self.graph.typed(*edge.types)
        pairs = df.select(F.col(f"{start.var}.id").alias("a"), F.col(f"{end.var}.id").alias("b")).distinct()
        found = traversal.shortest_paths(edges, materialize(pairs, "pairs"), edge.high if edge.varied else 1, edge.direction)
        found = found.withColumnsRenamed({"a": "from_", "b": "to_"})
        out = df.join(found, (F.col(f"{start.var}.id") == F.col("from_")) & (F.col(f"{end.var}.id") == F.col("to_"))).drop("from_", "to_")
        if nodes:
            return self._with_nodes(out.withColumn("eids_", F.slice("ids_", 2, 1 << 20)), path)
        return out.withColumn(path or "path_", F.struct((F.size("ids_") - 1).cast("bigint").alias("hops"), F.col("ids_").alias("ids"))).drop("ids_")

    def _inner(self, df: DataFrame, chains: list, where: Callable | None, outer: set[str]) -> tuple[DataFrame, list[str], list[Column]]:
        """(matches of a nested pattern with key columns, their names, the keys of the rows of ``df``).

        The pattern sees what it shares with the row: its own bound variables
        and those that its condition names.
        """
        own = {p.var for _, chain, _ in chains for p in chain} | outer
        shared = [c for c in df.columns if c in own]
        keys = []
        for c in shared:
            kind = df.schema[c].dataType
            name = next((k for k in ("eid", "id") if isinstance(kind, T.StructType) and k in kind.names), None)
            keys.append(F.col(f"`{c}`").getField(name) if name else F.col(f"`{c}`"))
        names = [f"key{k}_" for k in range(len(keys))]
        start = df.select(*[F.col(f"`{c}`") for c in shared], *[k.alias(n) for k, n in zip(keys, names, strict=True)]).dropDuplicates(names) if shared else None
        return Plan(self.graph, used=self.used)._match(start, chains, where=where), names, keys

    def _keyed(self, df: DataFrame, found: DataFrame, names: list[str], keys: list[Column], how: str) -> DataFrame:
        if not names:  # the pattern shares nothing with the row
            return df.join(found, F.lit(True), how)
        same = [k == F.col(n) for k, n in zip(keys, names, strict=True)]
        return df.join(found, reduce(lambda a, b: a & b, same), how)

    def _comprehend(self, df: DataFrame, chains: list, where: Callable | None, fn: Callable, var: str, outer: set[str]) -> DataFrame:
        """Column ``var``: for each row the list of a pattern's values, from one grouped join on what the pattern shares with the row."""
        inner, names, keys = self._inner(df, chains, where, outer)
        lists = inner.groupBy(*names).agg(F.array_sort(F.collect_list(fn(inner))).alias(var))
        out = self._keyed(df, lists, names, keys, "left").drop(*names)
        return out.withColumn(var, F.coalesce(var, F.array().cast(out.schema[var].dataType)))

    def _counted(self, df: DataFrame, chains: list, where: Callable | None, var: str, outer: set[str]) -> DataFrame:
        """Column ``var``: how often the pattern occurs for each row."""
        inner, names, keys = self._inner(df, chains, where, outer)
        counts = inner.groupBy(*names).agg(F.count(F.lit(1)).alias(var))
        return self._keyed(df, counts, names, keys, "left").drop(*names).withColumn(var, F.coalesce(var, F.lit(0).cast("bigint")))

    def _marked(self, df: DataFrame, chains: list, where: Callable | None, var: str, outer: set[str]) -> DataFrame:
        """Column ``var``: whether the pattern occurs for the row."""
        inner, names, keys = self._inner(df, chains, where, outer)
        found = inner.select(*names, F.lit(True).alias(var)).distinct()
        return self._keyed(df, found, names, keys, "left").drop(*names).withColumn(var, F.coalesce(var, F.lit(False)))

    def _exists(self, df: DataFrame, chains: list, where: Callable | None, outer: set[str], negated: bool = False) -> DataFrame:
        inner, names, keys = self._inner(df, chains, where, outer)
        found = inner.select(*names).distinct() if names else inner.select(F.lit(True).alias("some_")).limit(1)
        return self._keyed(df, found, names, keys, "left_anti" if negated else "left_semi")

    def _load(self, df: DataFrame | None, path: str, var: str) -> DataFrame:
        """A row of text columns for each line of a file with a header."""
        rows = self.graph.spark.read.option("header", True).csv(path)
        rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias(var))
        return rows if df is None else df.crossJoin(rows)

    def _compute(self, df: DataFrame, fn: Callable, column: str) -> DataFrame:
        return df.withColumn(column, fn(df)).where(F.col(column).isNotNull())

    def _narrow(self, df: DataFrame, node: Node) -> DataFrame:
        fine = self._struct(node).select(F.col(f"{node.var}.id").alias("ok_"))
        return df.join(fine, F.col(f"{node.var}.id") == F.col("ok_"), "left_semi")

    def _expand(self, df: DataFrame, start: Node, edge: Edge, node: Node, seen: list[Edge], on_path: bool = False, distinct_ends: bool = False, back: bool = False) -> DataFrame:
        """Joins one step; ``back`` walks it from its end to its start."""
        edges = self.graph.typed(*edge.types)
        late = {}
        for name, value in edge.where.items():
            if callable(value):
                late[name] = value
            else:
                edges = edges.where(F.col(name) == value if name in edges.columns else F.lit(False))
        direction = {"out": "in", "in": "out", "both": "both"}[edge.direction] if back else edge.direction
        again = edge.var in df.columns
        column = f"{edge.var}again_" if again else edge.var
        if edge.varied:
            df = self._vary(df, start, edge, edges, direction, on_path, distinct_ends, back)
            if again:
                raise ValueError(f"{edge.var} is bound already")
        else:
            record = F.struct(*edges.columns).alias(column)
            out = edges.select(F.col("src").alias("from_"), F.col("dst").alias("to_"), record)
            into = edges.select(F.col("dst").alias("from_"), F.col("src").alias("to_"), record)
            steps = out if direction == "out" else into if direction == "in" else out.unionByName(into.where("from_ <> to_"))
            df = df.join(steps, F.col(f"{start.var}.id") == F.col("from_")).drop("from_")
            for name, value in late.items():
                df = df.where(F.col(f"{column}.{name}") == value(df) if name in edges.columns else F.lit(False))
        if again:  # an edge of an earlier clause
            df = df.where(F.col(f"{edge.var}.eid") == F.col(f"{column}.eid")).drop(column)
        if edge.var in df.columns:  # a search of distinct ends carries no edges
            for other in seen:
                if not edge.types or not other.types or set(edge.types) & set(other.types):
                    df = df.where(self._apart(edge, other))
            seen.append(edge)
        return self._land(df, node)

    @staticmethod
    def _apart(a: Edge, b: Edge) -> Column:
        """The two steps share no edge."""
        if a.varied and b.varied:
            return ~F.arrays_overlap(f"{a.var}.eids", f"{b.var}.eids")
        if not a.varied and not b.varied:
            return F.col(f"{a.var}.eid") != F.col(f"{b.var}.eid")
        many, one = (a, b) if a.varied else (b, a)
        return ~F.array_contains(F.col(f"{many.var}.eids"), F.col(f"{one.var}.eid"))

    def _land(self, df: DataFrame, node: Node) -> DataFrame:
        if node.var in df.columns:
            df = df.where(F.col(f"{node.var}.id") == F.col("to_")).drop("to_")
            return self._bound(self._narrow(df, node), node) if node.labels or node.where else df
        if self._plain(node):
            return df.withColumn(node.var, F.struct(F.col("to_").alias("id"))).drop("to_")
        return self._bound(df.join(self._struct(node), F.col("to_") == F.col(f"{node.var}.id")).drop("to_"), node)

    def _vary(self, df: DataFrame, start: Node, edge: Edge, edges: DataFrame, direction: str, on_path: bool, distinct_ends: bool, back: bool) -> DataFrame:
        seeds = df.select(F.col(f"{start.var}.id").alias("id")).distinct()
        if distinct_ends and edge.low == 1 and not on_path and edge.var not in self.used:
            pairs = keyed_reach(edges, seeds, edge.high, direction)
        else:
            walk = traversal.short_trails if edge.high <= traversal.PLAIN else traversal.trails
            walked = walk(edges, seeds, edge.low, edge.high, direction)
            turn = F.reverse if back else lambda c: c  # lists are in the pattern's order
            pairs = walked.select("seed", F.col("id").alias("to_"), F.struct(F.size("eids").cast("bigint").alias("hops"), turn(F.col("nodes")).alias("nodes"), turn(F.col("eids")).alias("eids")).alias(edge.var))
        pairs = pairs.withColumnRenamed("seed", "from_")
        return df.join(pairs, F.col(f"{start.var}.id") == F.col("from_")).drop("from_")

    def _where(self, df: DataFrame, fn: Callable[[DataFrame], Column], text: str = "") -> DataFrame:
        return df.where(fn(df))

    def _unwind(self, df: DataFrame | None, fn: Callable, var: str) -> DataFrame:
        df = df if df is not None else self.graph.spark.range(1).drop("id")
        return df.withColumn(var, F.explode(fn(df)))

    def _distinct(self, df: DataFrame) -> DataFrame:
        return df.distinct()

    def _project(self, df: DataFrame | None, items: list[tuple[str, Callable]], distinct: bool = False) -> DataFrame:
        df = df if df is not None else self.graph.spark.range(1)
        out = df.select(*[fn(df).alias(name) for name, fn in items])
        return out.distinct() if distinct else out

    def _aggregate(self, df: DataFrame, keys: list[tuple[str, Callable]], values: list[tuple[str, Callable]], order: list[str] | None = None) -> DataFrame:
        # a node is known by its id: its properties are joined to the groups and do not go along with the rows
        own = self.graph.nodes
        kinds = df.select(*[fn(df).alias(name) for name, fn in keys]).schema if keys else []
        nodes = [k.name for k in kinds if isinstance(k.dataType, T.StructType) and k.dataType.names == own.columns]
        out = df.groupBy(*[fn(df).getField("id").alias(name) if name in nodes else fn(df).alias(name) for name, fn in keys]).agg(*[fn(df).alias(name) for name, fn in values])
        for name in nodes:
            whole = own.select(F.col("id").alias("own_"), F.struct(*own.columns).alias("node_"))
            out = out.withColumnRenamed(name, "key_").join(whole, F.col("key_") == F.col("own_"), "left").drop("key_", "own_").withColumnRenamed("node_", name)
        return out.select(*[F.col(f"`{c}`") for c in order or [name for name, _ in [*keys, *values]]])

    def _sort(self, df: DataFrame, keys: list[tuple[Callable, bool]]) -> DataFrame:
        # null is the largest value of the language
        return df.orderBy(*[fn(df).desc_nulls_first() if down else fn(df).asc_nulls_last() for fn, down in keys])

    def _skip(self, df: DataFrame, n: int) -> DataFrame:
        return df.offset(n)

    def _limit(self, df: DataFrame, n: int) -> DataFrame:
        return df.limit(n)

    def _call(self, df: DataFrame | None, fn: Callable, columns: list[tuple[str, str]], nodes: str | None = None) -> DataFrame:
        """The procedure's rows, beside each row bound before; a column of node ids becomes one of nodes."""
        out = fn()
        out = out.select(*[F.col(c).alias(name) for c, name in columns]) if columns else out
        node = next((name for c, name in columns if c == nodes), None)
        if node:
            own = self.graph.nodes
            rest = [c for c in out.columns if c != node]
            out = out.withColumnRenamed(node, "id_").join(own.select(F.col("id").alias("id_"), F.struct(*own.columns).alias(node)), "id_").select(node, *rest)
        return out if df is None or not df.columns else df.crossJoin(out)


def keyed_reach(edges: DataFrame, seeds: DataFrame, depth: int, direction: str) -> DataFrame:
    """``seed, to_`` of every distinct end of a trail of 1 to ``depth`` edges, by one search keyed by seed."""
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    if direction == "both":  # out and back over one edge is no trail: carry edges
        walked = traversal.trails(edges, seeds, 1, depth, "both")
        return walked.select("seed", F.col("id").alias("to_")).distinct()
    steps = materialize((out if direction == "out" else back).distinct(), "steps")
    now, found = seeds.select(F.col("id").alias("seed"), F.col("id").alias("to_")), None
    for at in range(1, depth + 1):
        grown = now.join(steps, F.col("to_") == F.col("a")).select("seed", F.col("b").alias("to_")).distinct()
        if found is not None:
            grown = grown.join(found, ["seed", "to_"], "left_anti")
        now = materialize(grown, f"reach{at}")
        if now.isEmpty():
            break
        found = now if found is None else found.unionByName(now)
    return found if found is not None else now
