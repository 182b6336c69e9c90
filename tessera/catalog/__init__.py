"""Query catalogue: one entry per operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The order graph as SQL (see graph.order_graph).
NODES = "SELECT c_custkey AS id, c_name AS name, c_acctbal AS value, c_mktsegment AS category, c_nationkey AS nation, ((c_custkey * 37) % 18000) / 100.0::DOUBLE - 90 AS lat, ((c_custkey * 91) % 36000) / 100.0::DOUBLE - 180 AS lon FROM customer"
EDGES = "SELECT o_orderkey AS eid, o_custkey AS src, (o_custkey * 31 + o_orderkey * 17) % (SELECT count(*) FROM customer) AS dst, o_orderpriority AS type, o_totalprice AS weight FROM orders"
GRAPH = f"n AS ({NODES}), e AS ({EDGES})"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; ``{graph}`` in the SQL stands for the graph's common table expressions."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.replace("{graph}", GRAPH)
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from tessera.catalog import checks, frontends, graphs, joins, more, numbers, patterns, relational, stores  # noqa: F401

    return dict(QUERIES), dict(ORACLES)
