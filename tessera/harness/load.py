"""Concurrent load, phases, time series and ingestion runs on one session (FAIR scheduling, a job group per client)."""

from __future__ import annotations

import random
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[], object]

#: Shares of look-ups, expansions and aggregates.
DEFAULT_MIX = {"lookup": 0.7, "expand": 0.2, "aggregate": 0.1}
HEAVY_MIX = {"lookup": 60, "expand": 30, "aggregate": 10}


@dataclass
class Load:
    latencies: list[float] = field(default_factory=list)
    failed: int = 0
    seconds: float = 0.0

    @property
    def total(self) -> int:
        return len(self.latencies) + self.failed

    @property
    def qps(self) -> float:
        return len(self.latencies) / self.seconds if self.seconds else 0.0

    @property
    def error_rate(self) -> float:
        return self.failed / self.total if self.total else 0.0

    def percentile(self, p: float, least: int = 1) -> float | None:
        xs = sorted(self.latencies)
        return None if not xs else xs[-1] if len(xs) < least else xs[min(len(xs) - 1, int(len(xs) * p))]


def throughput(spark: SparkSession, queries: dict[str, Query], clients: int, seconds: float, mix: dict[str, float] | None = None, seed: int = 42) -> Load:
    """Clients repeat queries drawn by weight until the time is up."""
    mix = {k: v for k, v in (mix or dict.fromkeys(queries, 1)).items() if k in queries}
    out, lock, stop = Load(), threading.Lock(), time.monotonic() + seconds

    def client(k: int) -> None:
        draw = random.Random(seed + k)
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"client-{k}")
        own, bad = [], 0
        while time.monotonic() < stop:
            name = draw.choices(list(mix), list(mix.values()))[0]
            began = time.perf_counter()
            try:
                queries[name]()
                own.append((time.perf_counter() - began) * 1000)
            except Exception:  # counted, not raised: load goes on
                bad += 1
        with lock:
            out.latencies += own
            out.failed += bad

    began = time.monotonic()
    threads = [threading.Thread(target=client, args=(k,)) for k in range(clients)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    out.seconds = time.monotonic() - began
    return out


def saturation(spark: SparkSession, queries: dict[str, Query], step: int, most: int, seconds: float) -> list[tuple[int, Load]]:
    """Load at rising numbers of clients, until throughput falls by a tenth below its best or half of the queries fail."""
    out, best = [], 0.0
    for clients in range(step, most + 1, step):
        load = throughput(spark, queries, clients, seconds)
        out.append((clients, load))
        if load.qps < 0.9 * best or load.error_rate > 0.5:
            break
        best = max(best, load.qps)
    return out


def stability(spark: SparkSession, queries: dict[str, Query], clients: int, seconds: float, every: float) -> list[Load]:
    return [throughput(spark, queries, clients, every) for _ in range(max(1, int(seconds / every)))]


def templates(names: list[str], n: int, how: str = "uniform", seed: int = 42) -> list[str]:
    """A workload of template names: uniform, zipf or round-robin."""
    if how == "round_robin":
        return [names[k % len(names)] for k in range(n)]
    weights = [1 / (k + 1) for k in range(len(names))] if how == "zipf" else [1] * len(names)
    return random.Random(seed).choices(names, weights, k=n)


def time_series(query: Query, iterations: int, timeout_ms: float | None = None) -> list[float | None]:
    """Latency of each iteration; None where it failed or took longer than allowed."""
    out: list[float | None] = []
    for _ in range(iterations):
        began = time.perf_counter()
        try:
            query()
            took = (time.perf_counter() - began) * 1000
            out.append(None if timeout_ms is not None and took > timeout_ms else took)
        except Exception:  # a gap in the series
            out.append(None)
    return out


@dataclass
class Phase:
    name: str
    action: Query
    repeats: int = 1


def phases(steps: list[Phase]) -> dict[str, dict[str, float]]:
    """Mean, median, least, most and deviation (from two on) of each phase."""
    import statistics as st

    out = {}
    for p in steps:
        xs = [x for x in time_series(p.action, p.repeats) if x is not None]
        if xs:
            out[p.name] = {"mean": st.fmean(xs), "median": st.median(xs), "min": min(xs), "max": max(xs)} | ({"stdev": st.stdev(xs)} if len(xs) > 1 else {})
    return out


def ingest(batches: list[DataFrame], path: str, read_every: int = 0) -> list[dict]:
    """Appends batches, reading the row count back after every few."""
    out, spark = [], None
    for k, batch in enumerate(batches, 1):
        spark = batch.sparkSession
        began = time.perf_counter()
        batch.write.mode("append").parquet(path)
        row = {"batch": k, "write_ms": (time.perf_counter() - began) * 1000}
        if read_every and k % read_every == 0:
            began = time.perf_counter()
            row |= {"rows": spark.read.parquet(path).count(), "read_ms": (time.perf_counter() - began) * 1000}
        out.append(row)
    return out
