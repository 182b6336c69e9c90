"""Mixing sources to target weights by Pfair scheduling (operator 7).

A source's documents are cut into blocks.  Block k of a source of weight w (all
weights sum to 1) is released at slot floor(k / w) and due by ceil((k + 1) / w);
in every slot the released block with the earliest deadline goes next.  Both
bounds come from the exact weights in whole numbers, so at any slot a source
that still has blocks is less than one block from its target, however long the
schedule and however many the sources.  The driver plans one entry a block.
Only where a period is asked for are weights rounded to shares of it; then the
plan of one period repeats.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Params:
    """block: documents; period: slots after which the schedule repeats, with weights rounded to shares of it, or None for the exact weights; temperature: exponent of document counts where no weights are given; bucket: documents ranked in one task."""

    block: int = 16
    period: int | None = None
    temperature: float = 0.5
    bucket: int = 4096


def shares(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole shares of the period, one at least, by largest remainders (ties to the smaller name)."""
    names = sorted(weights)
    if not names:
        return {}
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    if period < len(names):
        raise ValueError(f"{len(names)} sources need a period of as many slots")
    total = sum(weights.values())
    ideal = {s: weights[s] / total * (period - len(names)) for s in names}
    out = {s: 1 + int(ideal[s]) for s in names}
    for s in sorted(names, key=lambda s: (int(ideal[s]) - ideal[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def schedule(share: Mapping[str, int]) -> list[tuple[str, int]]:
    """(source, block) of every slot of one period: earliest deadline first among released blocks."""
    period = sum(share.values())
    waiting = [(0, s, 0) for s in sorted(share)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * period // share[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out.append((s, k))
        if k + 1 < share[s]:
            heapq.heappush(waiting, ((k + 1) * period // share[s], s, k + 1))
    return out


def exact(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in the very ratios of the weights."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    parts = {s: Fraction(w) for s, w in weights.items()}
    scale = max((f.denominator for f in parts.values()), default=1)  # powers of two
    return {s: f.numerator * (scale // f.denominator) for s, f in parts.items()}


Places = dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]


def earliest(weight: Mapping[str, int], blocks: Mapping[str, int]) -> Places:
    """(release, deadline, slot) of every block of every source: earliest deadline first among released blocks; slots with none stay empty."""
    total = sum(weight.values())
    out = {s: np.zeros((3, blocks[s]), np.int64) for s in weight}
    waiting = [(0, s, 0) for s in sorted(weight) if blocks[s]]
    ready: list[tuple[int, str, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            release, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // weight[s]), s, k, release))
        deadline, s, k, release = heapq.heappop(ready)
        out[s][:, k] = release, deadline, slot
        slot += 1
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) * total // weight[s], s, k + 1))
    return {s: tuple(a) for s, a in out.items()}


def periodic(share: Mapping[str, int], blocks: Mapping[str, int]) -> Places:
    """The same from the plan of one period."""
    period = sum(share.values())
    at = {s: np.zeros(n, np.int64) for s, n in share.items()}
    for slot, (s, k) in enumerate(schedule(share)):
        at[s][k] = slot
    out = {}
    for s, n in share.items():
        k = np.arange(blocks[s], dtype=np.int64)
        out[s] = (k * period // n, -(-(k + 1) * period // n), k // n * period + at[s][k % n])
    return out


def plan(docs: DataFrame, weights: Mapping[str | None, float] | None = None, params: Params = Params(), id_col: str = "doc_id", source_col: str = "source", column: str = "mix_") -> DataFrame:
    """``docs`` with struct column ``column`` (source, block, release, deadline, slot, position) added.

    Each document keeps its row; a source that runs out leaves its slots empty,
    so nothing is dropped or repeated.  Null is a source of its own.  Sources
    without a given weight, or all where none are given, weigh their document
    count to ``temperature``.  Within a source documents are dealt by a hash of
    their id into buckets of bounded size, which are ranked apart and joined by
    running counts, so a source with a third of all rows is no single task.  The
    driver holds the sources and, for each block of documents, three numbers.
    """
    p = params
    name = F.coalesce(F.concat(F.lit("s"), docs[source_col].cast("string")), F.lit("n"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), name.alias("mix_source"), docs[id_col].alias("mix_id"))
    counts = {r.mix_source: r["n"] for r in rows.groupBy("mix_source").agg(F.count(F.lit(1)).alias("n")).collect()}
    given = {"n" if s is None else f"s{s}": float(w) for s, w in (weights or {}).items()}
    weights_of = {s: given.get(s, float(n) ** p.temperature) for s, n in counts.items()}
    blocks = {s: -(-n // p.block) for s, n in counts.items()}
    places = earliest(exact(weights_of), blocks) if p.period is None else periodic(shares(weights_of, p.period), blocks)
    spark = docs.sparkSession
    buckets = spark.createDataFrame([(s, -(-n // p.bucket)) for s, n in counts.items()], "mix_source string, buckets int")
    # bounded by the number of sources
    dealt = rows.join(F.broadcast(buckets), "mix_source").withColumn("bucket", F.pmod(F.xxhash64("mix_id", F.xxhash64("row")), F.col("buckets")).cast("int"))
    sizes = dealt.groupBy("mix_source", "bucket").agg(F.count(F.lit(1)).alias("n")).orderBy("mix_source", "bucket").collect()
    before, columns = dict.fromkeys(counts, 0), {c: [] for c in ("mix_source", "bucket", "before", "release", "deadline", "slot")}
    for s, bucket, n in sizes:
        first, last = before[s] // p.block, (before[s] + n - 1) // p.block
        for c, v in zip(columns, (s, bucket, before[s], *(a[first : last + 1] for a in places[s])), strict=True):
            columns[c].append(v)
        before[s] += n
    kinds = {"mix_source": pa.string(), "bucket": pa.int32(), "before": pa.int64()}
    # one row a bucket with the places of its blocks: the join meets the rows where they were ranked
    placed = spark.createDataFrame(pa.table({c: pa.array(v, kinds.get(c, pa.list_(pa.int64()))) for c, v in columns.items()}))
    rank = F.row_number().over(Window.partitionBy("mix_source", "bucket").orderBy("mix_id", F.xxhash64("row")))
    ranked = dealt.withColumn("rank", rank - 1).join(placed, ["mix_source", "bucket"]).withColumn("index", F.col("before") + F.col("rank"))
    ranked = ranked.withColumn("block", F.floor(F.col("index") / p.block)).withColumn("position", F.col("index") % p.block)
    turn = (F.col("block") - F.floor(F.col("before") / p.block)).cast("int")
    mix = F.struct(F.col("row")[source_col].cast("string").alias("source"), F.col("block"), *(F.get(c, turn).alias(c) for c in ("release", "deadline", "slot")), F.col("position"))
    return ranked.select(*[F.col("row")[c].alias(c) for c in docs.columns], mix.alias(column))


def interleave(docs: DataFrame, weights: Mapping[str | None, float] | None = None, params: Params = Params(), id_col: str = "doc_id", source_col: str = "source", placed: bool = False) -> DataFrame:
    """``docs`` in the order of the schedule: ranges of slots in ascending partitions, sorted within; same columns and rows, and where ``placed`` a last one with their places (``mix_``, or a longer name that is free)."""
    column = "mix_"
    taken = {c.lower() for c in docs.columns}
    while column in taken:
        column += "_"
    order = [f"{column}.slot", f"{column}.position"]
    out = plan(docs, weights, params, id_col, source_col, column).repartitionByRange(*order).sortWithinPartitions(*order)
    return out if placed else out.select(*docs.columns)
