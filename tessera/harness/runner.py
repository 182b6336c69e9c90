"""Measured runs: calibration, cold and warm times, statistics, oracle, and a record instead of an exception."""

from __future__ import annotations

import enum
import json
import os
import platform
import re
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.graph import PropertyGraph
from tessera.harness import spec as specs
from tessera.operators import checksum
from tessera.operators.procedures import Budget, budget_of
from tessera.operators.statistics import enough_samples
from tessera.plans import cypher, gfql


class Outcome(enum.Enum):
    SUCCESS = "success"
    CORRECTNESS_MISMATCH = "correctness_mismatch"
    TIMEOUT = "timeout"
    UNSUPPORTED = "unsupported"
    ENGINE_ERROR = "engine_error"
    HARNESS_FAILURE = "harness_failure"
    DATASET_FAILURE = "dataset_failure"
    OUT_OF_MEMORY = "out_of_memory"
    SKIPPED = "skipped"


def ping(spark: SparkSession) -> float:
    began = time.perf_counter()
    spark.range(1).collect()
    return (time.perf_counter() - began) * 1000


def calibrate(reads: int = 10_000) -> dict[str, float]:
    """Clock resolution and cost of a reading, in nanoseconds."""
    ticks = [time.perf_counter_ns() for _ in range(reads)]
    steps = sorted(b - a for a, b in zip(ticks, ticks[1:], strict=False))
    return {"resolution_ns": next((s for s in steps if s > 0), 0), "overhead_ns": steps[len(steps) // 2]}


def environment(spark: SparkSession) -> dict:
    conf = dict(spark.sparkContext.getConf().getAll())
    return {"spark": spark.version, "python": platform.python_version(), "machine": platform.machine(), "cpus": os.cpu_count(), "master": spark.sparkContext.master, "settings": {k: v for k, v in conf.items() if k.startswith("spark.sql")}}


def engine_mode(spark: SparkSession) -> dict[str, str]:
    """How the engine runs queries."""
    on = lambda k, d="true": spark.conf.get(k, d) == "true"
    return {
        "execution": "whole-stage code generation" if on("spark.sql.codegen.wholeStage") else "interpreted",
        "parallelism": f"{spark.sparkContext.defaultParallelism} tasks",
        "vectorised_scan": str(on("spark.sql.parquet.enableVectorizedReader")),
        "adaptive": str(on("spark.sql.adaptive.enabled")),
        "plan_cache": "none",
        "storage": "parquet",
    }


BREAKERS = ("Exchange", "BroadcastExchange", "Sort", "HashAggregate", "ObjectHashAggregate", "SortAggregate", "TakeOrderedAndProject")


def profile(df: DataFrame) -> dict:
    """Physical operators, pipeline breakers among them, and segments between."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    ops = [m[1] for m in re.finditer(r"^[\s:|+\-*()\d]*([A-Z]\w+)", plan, re.M)]
    breakers = [o for o in ops if o in BREAKERS]
    return {"operators": ops, "breakers": breakers, "segments": 1 + sum("Exchange" in b for b in breakers)}


def clear_caches(spark: SparkSession) -> None:
    spark.catalog.clearCache()


def healthy(spark: SparkSession) -> bool:
    return spark.range(1).count() == 1


def dataset_matches(graph: PropertyGraph, nodes: int, edges: int) -> bool:
    return graph.counts() == (nodes, edges)


def frame(graph: PropertyGraph, spec: specs.Spec, values: dict) -> DataFrame:
    if spec.language == "gfql":
        return gfql.parse(graph, spec.query, values).run()
    return cypher.query(graph, spec.query, **values)


def timed(make: Callable[[], DataFrame]) -> tuple[float, int]:
    """Milliseconds to run a query wholly, every row and column, and its rows."""
    began = time.perf_counter()
    seen = Observation()
    spark = SparkSession.getActiveSession()
    allowed = budget_of(spark) if spark else None
    if allowed is not None:
        with Budget(spark, allowed) as budget:
            make().observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
        if budget.spent:
            raise TimeoutError(f"more than {allowed} ms")
        return (time.perf_counter() - began) * 1000, seen.get["n"]
    make().observe(seen, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return (time.perf_counter() - began) * 1000, seen.get["n"]


#: What this engine can do, by the names that specifications ask for in ``dataset["needs"]``.
CAPABILITIES = {"cypher": True, "gfql": True, "transactions": True, "snapshots": True, "indexes": True, "vector_search": True, "streaming": True, "time_budget": True, "server": False, "row_locks": False}


def outcome_of(e: Exception) -> Outcome:
    """What kind of failure an exception is."""
    text = f"{type(e).__name__} {e}"
    if isinstance(e, TimeoutError):
        return Outcome.TIMEOUT
    if isinstance(e, MemoryError) or "OutOfMemoryError" in text:
        return Outcome.OUT_OF_MEMORY
    if isinstance(e, FileNotFoundError) or any(c in text for c in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "FileNotFoundException", "UNABLE_TO_INFER_SCHEMA")):
        return Outcome.DATASET_FAILURE
    return Outcome.UNSUPPORTED if isinstance(e, (SyntaxError, KeyError, NotImplementedError)) else Outcome.ENGINE_ERROR


def run(graph: PropertyGraph | Callable[[], PropertyGraph], spec: specs.Spec, overrides: dict | None = None, adaptive: bool = False, most: int = 100) -> dict:
    """A result record; a failure is a record too.

    Calibrate, load (where ``graph`` is a function that loads it; its failure is
    the dataset's), one cold and several warm runs, the oracle.  A specification
    that needs what the engine lacks, or says ``skip``, is skipped.
    """
    record = {"benchmark": spec.name, "engine": "tessera", "capabilities": CAPABILITIES, "outcome": Outcome.HARNESS_FAILURE.value}
    lacking = [n for n in spec.dataset.get("needs", []) if not CAPABILITIES.get(n)]
    if lacking or spec.dataset.get("skip"):
        return record | {"outcome": Outcome.SKIPPED.value, "error": f"needs {', '.join(lacking)}" if lacking else str(spec.dataset["skip"])}
    try:
        values = specs.derive(spec, specs.resolve(spec, overrides))
        record |= {"parameters": values, "calibration": calibrate()}
        if callable(graph):
            began = time.perf_counter()
            try:
                graph = graph()
                record["nodes"], record["edges"] = graph.counts()
            except Exception as e:  # whatever kept the data from being read
                return record | {"outcome": Outcome.DATASET_FAILURE.value, "error": str(e)[:500]}
            record["load_ms"] = (time.perf_counter() - began) * 1000
        record["mode"] = engine_mode(graph.spark)
        make = lambda: frame(graph, spec, values)
        record["cold_ms"], record["rows"] = timed(make)
        samples = []
        while len(samples) < (most if adaptive else spec.warm_runs):
            samples.append(timed(make)[0])
            if adaptive and enough_samples(samples):
                break
        samples.sort()
        n = len(samples)
        record |= {"samples": samples, "warm_ms": sum(samples) / n, "p50_ms": samples[n // 2], "p95_ms": samples[min(n - 1, int(n * 0.95))]}
        fine = checksum.check(make(), spec.oracle) if spec.oracle else True
        record["outcome"] = (Outcome.SUCCESS if fine else Outcome.CORRECTNESS_MISMATCH).value
    except Exception as e:  # a failed run is a result
        record |= {"outcome": outcome_of(e).value, "error": str(e)[:500]}
    return record


def write(record: dict, directory: str | Path) -> Path:
    path = Path(directory) / f"{record['benchmark']}.json"
    path.write_text(json.dumps(record, indent=1, default=str))
    return path


def transpile_ms(graph: PropertyGraph, text: str, language: str, rounds: int = 20) -> float:
    """Mean time to turn a query text into its plan, without running it."""
    began = time.perf_counter()
    for _ in range(rounds):
        gfql.parse(graph, text).plan() if language == "gfql" else cypher.Parser(text, graph).plan()
    return (time.perf_counter() - began) * 1000 / rounds
