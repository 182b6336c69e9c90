"""Outcomes of measured runs and the schema check of specifications."""

from __future__ import annotations

from tessera.graph import PropertyGraph
from tessera.harness import runner, spec


def small(spark):
    return PropertyGraph(spark.range(3).selectExpr("id", "array('N') AS labels"), spark.range(2).selectExpr("id AS eid", "id AS src", "id + 1 AS dst", "'E' AS type"))


def asked(query="MATCH (n) RETURN n.id AS id", **more):
    return spec.Spec(**({"name": "x", "query": query, "warm_runs": 1} | more))


def test_outcomes(spark):
    made = lambda s, graph=None: runner.run(graph or small(spark), s)
    loaded = made(asked(), lambda: small(spark))
    assert loaded["outcome"] == "success" and loaded["rows"] == loaded["nodes"] == 3 and loaded["load_ms"] > 0
    assert made(asked(oracle={"type": "row_count", "expected": 4}))["outcome"] == "correctness_mismatch"
    assert made(asked("MATCH (n RETURN n"))["outcome"] == "unsupported"
    assert made(asked("LOAD CSV WITH HEADERS FROM 'file:///nowhere/at/all.csv' AS row RETURN row.a AS a"))["outcome"] == "dataset_failure"
    assert made(asked(), lambda: PropertyGraph(spark.read.parquet("/nowhere/nodes"), spark.range(1)))["outcome"] == "dataset_failure"
    assert made(asked(dataset={"needs": ["cypher", "row_locks"]}))["error"] == "needs row_locks"
    assert made(asked(dataset={"skip": "too large here"}))["outcome"] == "skipped"
    assert runner.outcome_of(RuntimeError("java.lang.OutOfMemoryError: Java heap space")) is runner.Outcome.OUT_OF_MEMORY


def test_schema_violations():
    schema = {
        "type": "object", "required": ["name", "runs"], "additionalProperties": False, "definitions": {"word": {"type": "string", "pattern": "^[a-z]+$", "maxLength": 5}},
        "properties": {
            "name": {"$ref": "#/definitions/word"}, "runs": {"type": "integer", "minimum": 1, "exclusiveMaximum": 10}, "tags": {"type": "array", "items": {"enum": ["a", "b"]}, "uniqueItems": True, "minItems": 1},
            "limit": {"anyOf": [{"type": "null"}, {"type": "number", "multipleOf": 0.5}]}, "kind": {"oneOf": [{"const": 1}, {"type": "integer"}]}, "free": {"not": {"type": "boolean"}},
        },
        "patternProperties": {"^x_": {"type": ["string", "null"]}},
    }
    assert spec.violations(schema, {"name": "abc", "runs": 3, "tags": ["a"], "limit": 1.5, "kind": 2, "free": 0, "x_y": None}) == []
    wrong = spec.violations(schema, {"name": "Abcdef", "runs": 10, "tags": ["a", "c", "a"], "limit": "no", "kind": 1, "free": True, "x_y": 4, "more": 1})
    assert len(wrong) == 10 and "$.more is not allowed" in wrong and "$.x_y is no string or null" in wrong
    assert spec.violations(schema, {"runs": True, "tags": []}) == ["$.name is missing", "$.runs is no integer", "$.tags has 0 items"]
    assert spec.violations(schema, []) == ["$ is no object"] and spec.violations(True, 1) == []
