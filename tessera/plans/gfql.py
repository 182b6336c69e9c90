"""The chained query language: a fluent builder and a text parser over the same logical plan.

``chain().n({"label": "Customer"}).e_forward({"max_hops": 2}).n().map("id")``
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph
from tessera.operators import algorithms, traversal
from tessera.plans.logical import Edge, Node, Plan

_OPS = {"=": "__eq__", "==": "__eq__", "!=": "__ne__", "<>": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


class Chain:
    """Steps on nodes and edges, then filters and aggregates on the last nodes; ``context`` filters every node and edge table by equality."""

    def __init__(self, graph: PropertyGraph, context: dict | None = None):
        for name, value in (context or {}).items():
            nodes = graph.nodes.where(F.col(name) == value) if name in graph.nodes.columns else graph.nodes
            edges = graph.edges.where(F.col(name) == value) if name in graph.edges.columns else graph.edges
            graph = PropertyGraph(nodes, edges, graph.snapshot)
        self.graph, self.chain_, self.rest = graph, [], []
        self.keys: list[str] = []
        self.values: list[tuple[str, Column]] = []

    def n(self, where: dict | None = None) -> Chain:
        where = dict(where or {})
        label = where.pop("label", None)
        if self.chain_ and isinstance(self.chain_[-1], Node):
            raise ValueError("two nodes without an edge")
        self.chain_.append(Node(f"n{len(self.chain_)}", (label,) if label else (), where))
        return self

    def _e(self, direction: str, options: dict | None) -> Chain:
        o = dict(options or {})
        kind = o.pop("type", None)
        low, high = o.pop("min_hops", 1), o.pop("max_hops", o.pop("hops", 1))
        self.chain_.append(Edge(f"e{len(self.chain_)}", (kind,) if kind else (), direction, low, high, o, varied=(low, high) != (1, 1)))
        return self

    def e_forward(self, options: dict | None = None) -> Chain:
        return self._e("out", options)

    def e_reverse(self, options: dict | None = None) -> Chain:
        return self._e("in", options)

    def e_undirected(self, options: dict | None = None) -> Chain:
        return self._e("both", options)

    def filter(self, column: str, op: str, value) -> Chain:
        self.rest.append(("filter", column, op, value))
        return self

    def map(self, *columns: str) -> Chain:
        self.rest.append(("map", columns))
        return self

    def group_by(self, *columns: str) -> Chain:
        self.keys = list(columns)
        return self

    def count_by(self, column: str) -> Chain:
        self.values.append((f"count_{column}", F.count(column)))
        return self

    def avg_by(self, column: str) -> Chain:
        self.values.append((f"avg_{column}", F.avg(column)))
        return self

    def sort_by(self, column: str, descending: bool = False) -> Chain:
        self.rest.append(("sort", column, descending))
        return self

    order_by = sort_by

    def limit(self, n: int) -> Chain:
        self.rest.append(("limit", n))
        return self

    # built-in algorithms on the context's graph

    def bfs(self, start: int, depth: int) -> DataFrame:
        return traversal.levels(self.graph.edges, self.graph.spark.createDataFrame([(start,)], "id bigint"), depth)

    def pagerank(self, rounds: int = 20) -> DataFrame:
        return algorithms.pagerank(self.graph.nodes, self.graph.edges, rounds)

    def shortest_path(self, start: int, end: int) -> list[int] | None:
        return traversal.shortest_path(self.graph.edges, start, end)

    def plan(self) -> Plan:
        chain = [*self.chain_]
        if chain and isinstance(chain[-1], Edge):
            chain.append(Node(f"n{len(chain)}"))
        if not chain:
            chain = [Node("n0")]
        last = chain[-1].var
        plan = Plan(self.graph, used={last: {"*"}})
        plan.add("Match", chains=[(None, chain, False)], distinct_ends=True, each=True)
        plan.add("Project", items=[("node", lambda df: F.col(last))], distinct=False)
        plan.add("Project", items=[(c, (lambda df, c=c: F.col(f"node.{c}"))) for c in self.graph.nodes.columns])
        return plan

    def explain(self) -> str:
        tail = [f"{r[0]}{r[1:]}" for r in self.rest]
        if self.values:
            tail.append(f"Aggregate(keys={self.keys}, values={[n for n, _ in self.values]})")
        return "\n".join([self.plan().explain(), *tail])

    def run(self) -> DataFrame:
        """The last step's distinct nodes, then the row steps in order; aggregates come before sort and limit."""
        df = self.plan().run()
        if len(self.chain_) > 1:
            df = df.dropDuplicates(["id"])
        grouped = False
        for kind, *args in self.rest:
            if kind == "filter":
                column, op, value = args
                df = df.where(getattr(F.col(column), _OPS[op])(value))
            elif self.values and not grouped and kind in ("sort", "limit"):
                df, grouped = self._grouped(df), True
                df = self._row(df, kind, args)
            else:
                df = self._row(df, kind, args)
        return self._grouped(df) if self.values and not grouped else df

    def _grouped(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.keys).agg(*[v.alias(n) for n, v in self.values])

    @staticmethod
    def _row(df: DataFrame, kind: str, args) -> DataFrame:
        if kind == "map":
            return df.select(*args[0])
        if kind == "sort":
            return df.orderBy(F.col(args[0]).desc_nulls_first() if args[1] else F.col(args[0]).asc_nulls_last())
        return df.limit(args[0])


def chain(graph: PropertyGraph, **context) -> Chain:
    return Chain(graph, context)


_STEPS = {"n", "e_forward", "e_reverse", "e_undirected", "filter", "map", "group_by", "count_by", "avg_by", "sort_by", "order_by", "limit"}


_SETTING = re.compile(r"\s*SET\s+GFQL_CONTEXT\s+((?:\w+\s*=\s*(?:'[^']*'|\"[^\"]*\"|[\w.+-]+)\s*,?\s*)+);?", re.I)


def _value(text: str):
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def parse(graph: PropertyGraph, text: str, params: dict | None = None, **context) -> Chain:
    """A chain from text, over any number of lines; only known steps with literal arguments (bare map keys allowed) are read, nothing is evaluated.

    ``$name`` stands for a value of ``params``.  ``SET GFQL_CONTEXT name = value, …``
    before the chain adds to ``context``.
    """
    while found := _SETTING.match(text):
        context |= {k: _value(v) for k, v in re.findall(r"(\w+)\s*=\s*('[^']*'|\"[^\"]*\"|[\w.+-]+)", found[1])}
        text = text[found.end() :]
    for name, value in (params or {}).items():
        text = re.sub(rf"\${name}\b", lambda _, v=value: repr(v), text)
    quoted = re.sub(r"([{,]\s*)([A-Za-z_]\w*)\s*:", r'\1"\2":', text.strip().rstrip(";"))
    calls = []
    # brackets let a chain run over lines
    node = ast.parse(f"({quoted}\n)", mode="eval").body
    while isinstance(node, ast.Call):
        if isinstance(node.func, ast.Name):
            if node.func.id != "chain" or node.args:
                raise SyntaxError("a chain starts with chain()")
            break
        if not isinstance(node.func, ast.Attribute) or node.func.attr not in _STEPS:
            raise SyntaxError(f"no step {getattr(node.func, 'attr', '?')}")
        calls.append((node.func.attr, [a.id if isinstance(a, ast.Name) else ast.literal_eval(a) for a in node.args]))
        node = node.func.value
    else:
        raise SyntaxError("a chain starts with chain()")
    out = Chain(graph, context)
    for name, args in reversed(calls):
        getattr(out, name)(*args)
    return out
