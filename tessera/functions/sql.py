"""The graph in SQL text: its tables as views, its functions as SQL functions, its procedures as table functions or views.

Functions are SQL themselves, so Catalyst inlines them into the query that
calls them: filters reach the scans and nothing runs row by row in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.functions import geo
from tessera.graph import PropertyGraph
from tessera.operators import procedures

_R = geo.EARTH_RADIUS

#: name -> (parameters, type, SQL)
SCALARS = {
    "haversine_distance": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
        f"2 * {_R} * asin(sqrt(least(1.0D, power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))))",
    ),
    "bearing": (
        "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE",
        "pmod(degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))), 360.0D)",
    ),
    "is_ahead": (
        "lat DOUBLE, lon DOUBLE, heading DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "BOOLEAN",
        "abs(pmod(bearing(lat, lon, lat2, lon2) - heading + 540, 360.0D) - 180) <= 90",
    ),
    "cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)))",
    ),
}

#: name -> (parameters, columns, query over the views ``nodes`` and ``edges``)
TABLES = {
    "edges_of": ("start BIGINT", "eid BIGINT, dst BIGINT, type STRING", "SELECT eid, dst, type FROM edges WHERE src = start"),
    "nodes_of_degree": ("least BIGINT", "id BIGINT, degree BIGINT", "SELECT src, n FROM (SELECT src, count(*) AS n FROM edges GROUP BY src) WHERE n >= least"),
    "counts_by_label": ("", "label STRING, n BIGINT", "SELECT label, count(*) FROM (SELECT explode(labels) AS label FROM nodes) GROUP BY label"),
    "edge_aggregate": ("", "type STRING, n BIGINT, avg_weight DOUBLE", "SELECT type, count(*), avg(weight) FROM edges GROUP BY type"),
    "two_hops": ("start BIGINT", "id BIGINT, ways BIGINT", "SELECT b.dst, count(*) FROM edges a JOIN edges b ON b.src = a.dst AND b.eid <> a.eid WHERE a.src = start GROUP BY b.dst"),
}


def register(graph: PropertyGraph) -> None:
    """Makes ``nodes`` and ``edges`` views of the session and registers all functions; those that need a property the graph lacks are left out."""
    spark = graph.spark
    graph.nodes.createOrReplaceTempView("nodes")
    graph.edges.createOrReplaceTempView("edges")
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (parameters, columns, body) in TABLES.items():
        if "weight" in body and "weight" not in graph.edges.columns:
            continue
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")


def procedure_view(graph: PropertyGraph, view: str, name: str, *args) -> DataFrame:
    """A procedure's rows as a view for SQL text; searches and other loops run when the view is made."""
    out = procedures.call(name, graph, *args)
    out.createOrReplaceTempView(view)
    return out
