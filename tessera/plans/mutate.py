"""Writing clauses of the pattern query language; each text makes a new version of the graph.

A ``Session`` keeps the versions in a store: what a text changed is written as
one delta, and the next text reads the base and the deltas, so plans do not grow
with the number of writes.

CREATE, SET, REMOVE, [DETACH] DELETE, MERGE … ON CREATE SET / ON MATCH SET and
FOREACH after any reading clauses, CREATE INDEX and CREATE CONSTRAINT, and
BEGIN / COMMIT / ROLLBACK through ``Session``.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.graph import PropertyGraph
from tessera.plans.cypher import Expr, Parser, uncommented
from tessera.plans.logical import Edge, Node, Plan
from tessera.sources.graphstore import KEYS, Changes, GraphStore, ScratchStore
from tessera.storage import materialize

_WRITES = ("create", "set", "remove", "delete", "detach", "merge", "foreach")


class Writer(Parser):
    """Reads the clauses before the first write into a table of bindings, then applies the writes to the graph."""

    def __init__(self, text: str, graph: PropertyGraph, params: dict | None = None):
        super().__init__(text, graph, params)
        self.bound: DataFrame | None = None
        #: keys of the rows that were created, changed or deleted
        self.touched: dict[str, list[DataFrame]] = {"nodes": [], "edges": []}

    def touch(self, table: str, rows: DataFrame, column: str | None = None) -> None:
        key = KEYS[table]
        self.touched[table].append(rows.select(F.col(column or key).cast("bigint").alias(key)))

    def changes(self) -> Changes:
        """The touched rows as they are now, and the keys of those that are gone."""
        out = Changes()
        for table, parts in self.touched.items():
            if not parts:
                continue
            key, now = KEYS[table], getattr(self.graph, table)
            keys = reduce(DataFrame.unionByName, parts).distinct()
            rows = now.select(*[f.name for f in now.schema if not isinstance(f.dataType, T.NullType)]).withColumn("gone_", F.lit(False))
            out.puts[table].append(keys.join(rows, key, "left").withColumn("gone_", F.coalesce("gone_", F.lit(True))))
        return out

    def execute(self) -> tuple[PropertyGraph, DataFrame | None]:
        """(new graph, result of a final RETURN or None)."""
        result = None
        while self.peek():
            if self.word() in _WRITES:
                getattr(self, f"_{self.next().lower()}")()
            else:
                plan = self.current = Plan(self.graph)
                self.used = plan.used
                start, returned = self.bound, False
                while self.peek() and self.word() not in _WRITES:
                    returned = returned or self.word() == "return"
                    self.clause(plan)
                for step in plan.steps:  # a write may use any property of what is bound
                    for _, chain, _ in step.args.get("chains", []):
                        for p in chain:
                            if not p.var.startswith("_"):
                                plan.used.setdefault(p.var, set())
                for uses in plan.used.values():
                    uses.add("*")
                out = self.run_from(plan, start)
                if returned:
                    result = out
                else:
                    self.bound = materialize(out, "bindings") if out.columns else None
        return self.graph, result

    @staticmethod
    def run_from(plan: Plan, df: DataFrame | None) -> DataFrame:
        for step in plan.steps:
            df = getattr(plan, f"_{step.kind.lower()}")(df, **step.args)
        return df

    def clause(self, plan: Plan) -> None:
        """One reading clause."""
        if self.take("match"):
            self.match(plan, False)
        elif self.take("optional"):
            self.need("match")
            self.match(plan, True)
        elif self.take("unwind"):
            value = self.expr()
            self.need("as")
            plan.add("Unwind", fn=value, var=self.next())
        elif self.take("call"):
            self.call(plan)
        elif self.take("load"):
            self.load(plan)
        elif self.take("with"):
            self.projection(plan)
            if self.take("where"):
                self.where(plan)
        elif self.take("return"):
            self.projection(plan)
        else:
            raise SyntaxError(f"unexpected {self.peek()!r}")

    # writes

    def _rows(self) -> DataFrame:
        return self.bound if self.bound is not None else self.graph.spark.range(1).select(F.lit(True).alias("one_"))

    def _column(self, value, df: DataFrame):
        if isinstance(value, Expr):
            return value(df)
        return F.lit(value).cast("bigint") if isinstance(value, int) and not isinstance(value, bool) else F.lit(value)

    def _create(self) -> None:
        if self.take("index"):
            self._index()
            return
        if self.take("constraint"):
            self._constraint()
            return
        while True:
            self.create_chain(self.pattern()[1])
            if not self.take(","):
                return

    def create_chain(self, chain: list) -> None:
        rows = self._rows()
        top = (self.graph.nodes.agg(F.max("id")).first()[0] or 0) + 1
        rows = materialize(rows.withColumn("row_", F.monotonically_increasing_id()), "create")
        new = [n for n in chain[::2] if n.var not in rows.columns]
        for k, node in enumerate(new):
            id_ = self._column(node.where["id"], rows).cast("bigint") if "id" in node.where else F.lit(top + k) + F.col("row_") * len(new)
            props = {p: self._column(v, rows) for p, v in node.where.items() if p != "id"}
            rows = rows.withColumn(node.var, F.struct(id_.alias("id"), F.array(*map(F.lit, node.labels)).cast("array<string>").alias("labels"), *[v.alias(p) for p, v in props.items()]))
            self.graph = self.graph.create_nodes(rows.select(f"{node.var}.*"))
            self.touch("nodes", rows, f"{node.var}.id")
        for a, edge, b in zip(chain[:-2:2], chain[1::2], chain[2::2], strict=True):
            ends = (a, b) if edge.direction != "in" else (b, a)
            props = [self._column(v, rows).alias(p) for p, v in edge.where.items()]
            pairs = rows.select(F.col(f"{ends[0].var}.id").alias("src"), F.col(f"{ends[1].var}.id").alias("dst"), *props)
            self._connect(pairs, edge.types[0])
        self.bound = rows.drop("row_")

    def _connect(self, pairs: DataFrame, kind: str) -> None:
        new = self.graph.numbered_edges(pairs, kind)
        self.touch("edges", new)
        self.graph = replace(self.graph, edges=self.graph.edges.unionByName(new, allowMissingColumns=True), finder=None, snapshot=self.graph.snapshot + 1)

    def _assignments(self) -> list[tuple[str, str, object]]:
        """(variable, property or ``:label`` or ``*``, value)."""
        out: list[tuple[str, str, object]] = []
        while True:
            var = self.next()
            if self.take(":"):
                out.append((var, f":{self.next()}", None))
            elif self.take("."):
                name = self.next()
                self.need("=")
                out.append((var, name, self.expr()))
            else:
                self.need("=")
                out.append((var, "*", self.map() if self.peek() == "{" else self.expr()))
            if not self.take(","):
                return out

    def _set(self) -> None:
        for var, name, value in self._assignments():
            self.assign(self._rows(), var, name, value)

    def assign(self, rows: DataFrame, var: str, name: str, value) -> None:
        """Sets a property, a label or all properties of the nodes or edges that ``var`` is bound to; of several values for one the first counts."""
        kind = rows.schema[var].dataType
        table = "edges" if "eid" in kind.names else "nodes"
        key, own = KEYS[table], getattr(self.graph, table)
        rows = rows.where(F.col(var).isNotNull())
        keys = F.col(f"{var}.{key}").alias(key)
        if name.startswith(":"):
            self._label(rows.select(keys).distinct(), name[1:], True)
            return
        fixed = ("id", "labels") if table == "nodes" else ("eid", "src", "dst", "type")
        if name == "*":
            if isinstance(value, Expr):
                shown = rows.select(value(rows).alias("v")).schema["v"].dataType
                values = {f.name: value(rows).getField(f.name) for f in shown}
            else:
                values = {p: self._column(v, rows) for p, v in value.items()}
            values = {p: v for p, v in values.items() if p not in fixed}
            cleared = [c for c in own.columns if c not in fixed and c not in values]
        else:
            if name in fixed:
                raise ValueError(f"{name} cannot be set")
            values, cleared = {name: self._column(value, rows)}, []
        new = rows.select(keys, F.struct(F.lit(True).alias("set_"), *[v.alias(p) for p, v in values.items()]).alias("new_")).dropDuplicates([key])
        new = materialize(_unvoid(new), "set")
        joined, hit = own.join(new, key, "left"), F.col("new_").isNotNull()
        given = new.schema["new_"].dataType.names
        cols = {p: F.when(hit, F.col(f"new_.{p}") if p in given else F.lit(None)).otherwise(F.col(p) if p in own.columns else F.lit(None)) for p in [*values, *cleared]}
        self.touch(table, new)
        self.graph = replace(self.graph, **{table: joined.withColumns(cols).drop("new_")}, finder=None, snapshot=self.graph.snapshot + 1)

    def _label(self, ids: DataFrame, label: str, add: bool) -> None:
        ids = materialize(ids, "label")
        self.touch("nodes", ids)
        marked = self.graph.nodes.join(ids.withColumn("hit_", F.lit(True)), "id", "left")
        new = F.array_union("labels", F.array(F.lit(label))) if add else F.array_remove("labels", label)
        self.graph = replace(self.graph, nodes=marked.withColumn("labels", F.when(F.col("hit_"), new).otherwise(F.col("labels"))).drop("hit_"), finder=None, snapshot=self.graph.snapshot + 1)

    def _remove(self) -> None:
        while True:
            var = self.next()
            if self.take(":"):
                self._label(self._rows().select(F.col(f"{var}.id").alias("id")).distinct(), self.next(), False)
            else:
                self.need(".")
                self.assign(self._rows(), var, self.next(), Expr(lambda df: F.lit(None), "null"))
            if not self.take(","):
                return

    def _detach(self) -> None:
        self.need("delete")
        self._delete(True)

    def _delete(self, detach: bool = False) -> None:
        while True:
            var = self.next()
            ids = materialize(self._rows().where(F.col(var).isNotNull()).select(F.col(f"{var}.*")), "delete")
            if "eid" in ids.columns:
                self.touch("edges", ids)
                self.graph = replace(self.graph, edges=self.graph.edges.join(ids.select("eid"), "eid", "left_anti").select(*self.graph.edges.columns), snapshot=self.graph.snapshot + 1)
            else:
                gone = ids.select("id").distinct()
                edges = self.graph.edges
                at = [edges.join(gone.withColumnRenamed("id", c), c, "left_semi").select("eid") for c in ("src", "dst")]
                touching = materialize(at[0].unionByName(at[1]).distinct(), "touching")
                if not detach and not touching.isEmpty():
                    raise ValueError("nodes still have edges; detach them")
                self.touch("nodes", gone)
                self.touch("edges", touching)
                self.graph = replace(self.graph, nodes=self.graph.nodes.join(gone, "id", "left_anti").select(*self.graph.nodes.columns), edges=edges.join(touching, "eid", "left_anti").select(*edges.columns), finder=None, snapshot=self.graph.snapshot + 1)
            if not self.take(","):
                return

    def _merge(self) -> None:
        """Matches the whole pattern for each row of what is bound; for rows without a match the whole pattern is created, once for equal values.

        Its nodes are bound already, or have property maps.
        """
        chain = self.pattern()[1]
        on: dict[str, list] = {"create": [], "match": []}
        while self.take("on"):
            which = self.next().lower()
            self.need("set")
            on[which] += self._assignments()
        rows = materialize(self._rows().withColumn("row_", F.monotonically_increasing_id()), "merge")
        outer = [c for c in rows.columns if c != "row_"]
        fresh = [p for p in chain if p.var not in outer]
        # values of the property maps are fixed before anything is matched
        maps = {(p.var, k): self._column(v, rows) for p in chain for k, v in p.where.items()}
        names = {pk: f"m{k}_" for k, pk in enumerate(maps)}
        rows = materialize(_unvoid(rows.select("*", *[v.alias(names[pk]) for pk, v in maps.items()])), "merge")
        asked = [replace(p, where={k: (lambda df, c=names[p.var, k]: F.col(c)) for k in p.where}) for p in chain]
        plan = Plan(self.graph, used={p.var: {"*"} for p in chain})
        start = rows
        if not any(p.var in outer for p in chain[::2]):  # join by the first node's values and not by a crossing
            start = self._by_values(rows, chain[0], names)
        found = materialize(plan._match(start, [(None, asked, False)]).select("row_", *[F.col(p.var) for p in fresh]), "found")
        keys = [names[pk] for pk in names] + [f"e{k}_" for k, p in enumerate(chain) if p.var in outer]
        missing = rows.join(found.select("row_").distinct(), "row_", "left_anti")
        missing = missing.withColumns({f"e{k}_": F.col(f"{p.var}.{'eid' if isinstance(p, Edge) else 'id'}") for k, p in enumerate(chain) if p.var in outer})
        single = materialize(missing.dropDuplicates(keys).drop("row_") if keys else missing.limit(1).drop("row_"), "missing")
        made = None
        if not single.isEmpty():
            self.bound = single
            self.create_chain([replace(p, where={k: Expr(lambda df, c=names[p.var, k]: F.col(c), k) for k in p.where}) for p in chain])
            same = self.bound.select(*keys, *[F.col(p.var) for p in fresh if isinstance(p, Node)])
            made = missing.select("row_", *keys).join(same, [missing[k].eqNullSafe(same[k]) for k in keys] if keys else F.lit(True)).select("row_", *[F.col(p.var) for p in fresh if isinstance(p, Node)])
            made = materialize(made, "made")
        for which, ids in (("create", made), ("match", found)):
            if ids is None:
                continue
            for var, name, value in on[which]:
                bound = rows.join(ids, "row_").select(*rows.columns, *[c for c in ids.columns if c != "row_"])
                self.assign(self._refreshed(bound), var, name, value)
        # structs of nodes differ in their fields once some are created: rows keep ids, and the nodes are read again
        nodes = [p.var for p in fresh if isinstance(p, Node)]
        parts = [t.select("row_", *[F.col(f"{v}.id").alias(f"{v}_id") for v in nodes]) for t in ([found] if made is None else [found, made])]
        joined = rows.join(reduce(DataFrame.unionByName, parts), "row_").select(*outer, *[f"{v}_id" for v in nodes])
        for v in nodes:
            own = self.graph.nodes.select(F.struct(*self.graph.nodes.columns).alias(v))
            joined = joined.join(own, F.col(f"{v}_id") == F.col(f"{v}.id")).drop(f"{v}_id")
        self.bound = materialize(_unvoid(joined), "bindings") if joined.columns else None

    def _by_values(self, rows: DataFrame, node: Node, names: dict) -> DataFrame:
        """``rows`` joined to the nodes that have the values of the node's map."""
        own = self.graph.nodes
        for label in node.labels:
            own = own.where(F.array_contains("labels", label))
        held = own.select(F.struct(*own.columns).alias(node.var))
        tests = [F.col(names[node.var, k]) == F.col(f"{node.var}.{k}") if k in own.columns else F.lit(False) for k in node.where]
        return rows.join(held, reduce(lambda a, b: a & b, tests, F.lit(True)))

    def _refreshed(self, rows: DataFrame) -> DataFrame:
        """``rows`` whose bound nodes show the graph as it is now."""
        for f in rows.schema:
            if isinstance(f.dataType, T.StructType) and "labels" in f.dataType.names:
                own = self.graph.nodes
                now = own.select(F.struct(*own.columns).alias("now_"))
                rows = rows.join(now, F.col(f"{f.name}.id") == F.col("now_.id")).drop(f.name).withColumnRenamed("now_", f.name)
        return rows

    def _foreach(self) -> None:
        self.need("(")
        var = self.next()
        self.need("in")
        xs = self.expr()
        self.need("|")
        outer = self.bound
        rows = self._rows()
        self.bound = rows.withColumn(var, F.explode(xs(rows)))
        while not self.take(")"):
            getattr(self, f"_{self.next().lower()}")()
        self.bound = outer

    # schema

    def _index(self) -> None:
        """``[name] [IF NOT EXISTS] ON :Label(property)`` or ``… FOR (n:Label) ON (n.property)``."""
        if self.word() not in ("on", "for", "if"):
            self.next()
        if self.take("if"):
            self.need("not")
            self.need("exists")
        if self.take("for"):
            label = self.node().labels[0]
            self.need("on")
            self.need("(")
            self.next()
            self.need(".")
        else:
            self.need("on")
            self.need(":")
            label = self.next()
            self.need("(")
        name = self.next()
        self.need(")")
        self.graph = self.graph.create_index(label, name)

    def _constraint(self) -> None:
        self.need("on")
        node = self.node()
        self.need("assert")
        exists = self.take("exists")
        if exists:
            self.need("(")
        self.next()
        self.need(".")
        name = self.next()
        if exists:
            self.need(")")
        else:
            self.need("is")
            self.need("unique")
        self.graph = self.graph.add_constraint(node.labels[0], name, "exists" if exists else "unique")


def profile(df: DataFrame) -> DataFrame:
    """``step, depth, operator, rows, db_hits`` of each physical operator, outermost first, after running the whole query.

    ``rows`` is what the operator put out, null where it does not count; a scan's
    rows are its ``db_hits``.
    """
    run = df._jdf.queryExecution()
    run.toRdd().count()
    out: list[tuple[int, int, str, int | None, int | None]] = []

    def walk(plan, depth: int) -> None:
        name = plan.nodeName()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan(), depth)
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan(), depth)
        counted = plan.metrics().get("numOutputRows")
        rows = counted.get().value() if counted.isDefined() else None
        out.append((len(out), depth, name.strip(), rows, rows if "Scan" in name else None))
        kids = plan.children()
        for k in range(kids.size()):
            walk(kids.apply(k), depth + 1)

    walk(run.executedPlan(), 0)
    return df.sparkSession.createDataFrame(out, "step int, depth int, operator string, rows bigint, db_hits bigint")


class Session:
    """A store's graph that texts read and change; BEGIN holds changes back until COMMIT.

    Given a graph, the session keeps its changes in a scratch store; given a
    store, each text that writes (or COMMIT) makes a version of it.
    """

    def __init__(self, graph: PropertyGraph | GraphStore):
        self.store = graph if isinstance(graph, GraphStore) else ScratchStore(graph)
        self.graph = self.store.graph()
        self.held: tuple | None = None  # manifest at BEGIN, store of the transaction

    def _check(self, graph: PropertyGraph) -> None:
        for label, name, kind in graph.constraints:
            if not graph.violations(label, name, kind).isEmpty():
                raise ValueError(f"{label}.{name} is not {kind}")

    def _write(self, text: str, params: dict) -> DataFrame | None:
        store = self.held[1] if self.held else self.store
        writer = Writer(text, self.graph, params)
        graph, result = writer.execute()
        changes, on = writer.changes(), store.manifest()
        if graph.constraints != self.graph.constraints:
            changes.constraints = graph.constraints
        new = [i for i in graph.indexes if i not in self.graph.indexes]
        if any(changes.puts.values()) or changes.constraints is not None:
            store.commit(changes, on)
        for label, name in new:
            store.create_index(label, name)
        self.graph = store.graph()
        return result

    def run(self, text: str, **params) -> DataFrame | None:
        text = uncommented(text)
        word = text.strip().rstrip(";").lower()
        if word == "begin":
            self.held = (self.store.manifest(), ScratchStore(self.graph), self.graph)
            return None
        if word in ("commit", "rollback"):
            if self.held is None:
                raise ValueError("no transaction")
            on, own, before = self.held
            self.held = None
            if word == "commit":
                try:
                    self._check(self.graph)
                except ValueError:
                    self.graph = before
                    raise
                m, changes = own.manifest(), Changes()
                for table in KEYS:
                    deltas = own._deltas(getattr(m, table))
                    if deltas is not None:
                        last = deltas.groupBy(KEYS[table]).agg(F.max_by(F.struct(*[c for c in deltas.columns if c != "at_"]), "at_").alias("r")).select("r.*")
                        changes.puts[table].append(last)
                if m.constraints != on.constraints:
                    changes.constraints = m.constraints
                self.store.commit(changes, on)
                for label, name in own.indexes:
                    self.store.create_index(label, name)
            self.graph = self.store.graph()
            return None
        if word == "show index info":
            return self.graph.show_indexes()
        if word.startswith("profile "):
            return profile(Parser(text.strip()[8:], self.graph, params).query())
        if word.startswith("explain "):
            plan = Parser(text.strip()[8:], self.graph, params).plan()
            return self.graph.spark.createDataFrame([(line,) for line in plan.explain().split("\n")], "step string")
        if any(f" {w} " in f" {' '.join(word.replace('(', ' ').split())} " for w in _WRITES):
            return self._write(text, params)
        return Parser(text, self.graph, params).query()


def _unvoid(df: DataFrame) -> DataFrame:
    """Columns and fields of a null without type as text, so that they can be written."""

    def typed(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.NullType):
            return T.StringType()
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(f.name, typed(f.dataType)) for f in kind])
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(typed(kind.elementType))
        return kind

    return df.select(*[F.col(f"`{f.name}`").cast(typed(f.dataType)).alias(f.name) if typed(f.dataType) != f.dataType else F.col(f"`{f.name}`") for f in df.schema])


__all__ = ["Edge", "Node", "Session", "Writer"]
