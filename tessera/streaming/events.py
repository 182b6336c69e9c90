"""Structured Streaming over event tables: windowed counts with late data, sessions and a stateful steady-state detector."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.statistics import SteadyState


def stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """A file stream with the schema of the table already there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count and sum by event type and window; works on batch and streaming input alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = rows.groupBy(span.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def steady_state(events: DataFrame) -> DataFrame:
    """The detector's state of each event type after every batch; the state is eleven numbers a key."""
    kinds = {"seen": "int", "n": "int", "mean": "double", "m2": "double", "base": "double", "deviation": "double", "up": "double", "down": "double", "calm": "int", "changes": "int", "steady_at": "int"}
    state = ", ".join(f"{name} {kind}" for name, kind in kinds.items())

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = SteadyState(*(held.get if held.exists else ()))
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
        now.extend(rows["value"].dropna().to_numpy(float))
        if now.seen:
            held.update(tuple(getattr(now, name) for name in kinds))
            yield pd.DataFrame({"event_type": [key[0]], "n": [now.seen], "mean": [now.mean], "changes": [now.changes], "steady": [now.steady_at >= 0]})

    out = "event_type string, n int, mean double, changes int, steady boolean"
    return events.select("event_type", "ts", "event_id", "value").groupBy("event_type").applyInPandasWithState(run, out, state, "update", GroupStateTimeout.NoTimeout)
