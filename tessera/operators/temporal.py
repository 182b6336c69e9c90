"""As-of and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.storage import materialize


def asof_join(left: DataFrame, right: DataFrame, time: str, by: list[str], right_time: str | None = None, how: str = "left", strict: bool = False, forward: bool = False, tolerance: Column | None = None, prefix: str = "asof_") -> DataFrame:
    """Each left row with the right row of the same keys that is the last at or before its time.

    ``strict``: before; ``forward``: the first at or after; ``tolerance``: at
    most so far away (a number, or an interval for times).  Right columns get
    ``prefix``; ``how`` is left or inner.  Of right rows at one time the
    greatest, column by column, counts.  A null key or time matches nothing.

    Both sides are laid out by key and time in ranges; a range carries its last
    right row on, and what a range starts with is the last row of the ranges
    before it.  So a key with many rows spreads over many tasks, and only the
    keys that span ranges are looked at again, two rows a range at most.
    """
    right_time = right_time or time
    names = [c for c in right.columns if c not in by]
    payload = F.struct(*[F.col(c) for c in names])
    keys = [f"k{i}_" for i in range(len(by))]
    known = lambda df, t: df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*by, t]))
    # right rows of one key and time become one
    rights = known(right, right_time).groupBy(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(right_time).alias("t_")).agg(F.max(payload).alias("r_"))
    row = F.struct(*[F.col(c) for c in left.columns]).alias("l_")
    lefts = known(left, time).select(*[F.col(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(time).alias("t_"), row)
    # at one time a right row comes before the left rows it serves, or after them if it must be earlier
    side = lambda r: F.lit(int(r == (strict != forward)))
    both = lefts.withColumn("side_", side(False)).withColumn("salt_", F.xxhash64("l_")).unionByName(rights.withColumn("side_", side(True)).withColumn("salt_", F.lit(0).cast("bigint")), allowMissingColumns=True)
    order = [*keys, "t_", "side_", "salt_"]
    laid = both.repartitionByRange(*order).withColumn("range_", F.spark_partition_id())
    laid = materialize(laid, "asof")
    per = Window.partitionBy(*keys, "range_")
    # frames always grow from their start: one that ends at the last row is evaluated anew for every row
    turn = F.desc if forward else F.asc
    past = lambda w, *cols, end=0: w.orderBy(*map(turn, cols)).rowsBetween(Window.unboundedPreceding, end)
    near = F.last("r_", ignorenulls=True).over(past(per, "t_", "side_", "salt_"))
    held = F.col("r_").isNotNull()
    ends = laid.groupBy(*keys, "range_").agg((F.min_by if forward else F.max_by)(F.when(held, F.col("r_")), F.when(held, F.col("t_"))).alias("end_"))
    spanning = Window.partitionBy(*keys)
    ends = ends.withColumn("n_", F.count(F.lit(1)).over(spanning)).where("n_ > 1")
    carried = F.last("end_", ignorenulls=True).over(past(spanning, "range_", end=-1))
    ends = ends.select(*keys, "range_", carried.alias("carried_"))
    found = laid.withColumn("near_", near).where("l_ IS NOT NULL")
    # a range has at most two keys that span ranges, so this table has at most two rows a range
    found = found.join(F.broadcast(ends), [*keys, "range_"], "left").withColumn("near_", F.coalesce("near_", "carried_"))
    if tolerance is not None:
        gap = F.col(f"near_.{right_time}") - F.col("t_") if forward else F.col("t_") - F.col(f"near_.{right_time}")
        found = found.withColumn("near_", F.when(gap <= tolerance, F.col("near_")))
    out = found.select("l_.*", *[F.col(f"near_.{c}").alias(f"{prefix}{c}") for c in names])
    if how == "inner":
        return found.where("near_ IS NOT NULL").select("l_.*", *[F.col(f"near_.{c}").alias(f"{prefix}{c}") for c in names])
    alone = left.where(" OR ".join(f"`{c}` IS NULL" for c in [*by, time]))
    return out.unionByName(alone, allowMissingColumns=True)


def _units(df: DataFrame, name: str, unit: float) -> Column:
    """Whole steps of ``unit`` (seconds for times)."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.date_trunc("SECOND", F.col(name)))
    else:
        seconds = F.col(name).cast("double")
    return F.floor(seconds / unit).cast("bigint")


#: Halvings of a span's length; longer spans than 2 ** LEVELS units are cut into more pieces.
LEVELS = 40


def _pieces(spans: DataFrame, unit: float) -> DataFrame:
    """``spans`` with a row for each aligned dyadic piece ``(level_, slot_)`` that together cover ``start_`` to ``end_``, at most two a level."""
    first, last = _units(spans, "start_", unit), _units(spans, "end_", unit)
    rows = spans.withColumn("a_", first).withColumn("b_", last + 1)
    levels = F.sequence(F.lit(0), F.lit(LEVELS))

    def at(k: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        # what is left between a and b after the smaller pieces at both ends: aligned up and down
        up, down = -F.floor(-F.col("a_") / size), F.floor(F.col("b_") / size)
        half_up, half_down = -F.floor(-F.col("a_") / (size * 2)) * 2, F.floor(F.col("b_") / (size * 2)) * 2
        head = F.when((up < down) & (up % 2 != 0), F.array(up))
        tail = F.when((up < down) & (down % 2 != 0) & ~((up % 2 != 0) & (up == down - 1)), F.array(down - 1))
        middle = F.when((k == LEVELS) & (half_up < half_down), F.sequence(half_up, half_down - 1))
        slots = F.concat(F.coalesce(head, F.array().cast("array<bigint>")), F.coalesce(tail, F.array().cast("array<bigint>")), F.coalesce(middle, F.array().cast("array<bigint>")))
        return F.transform(slots, lambda s: F.struct(k.alias("level_"), s.cast("bigint").alias("slot_")))

    return rows.withColumn("p_", F.explode(F.flatten(F.transform(levels, at)))).select("*", "p_.*").drop("p_", "a_", "b_")


def points_in_spans(points: DataFrame, spans: DataFrame, time: str, start: str, end: str, by: list[str], unit: float = 60.0) -> DataFrame:
    """Every pair of a point and a span of the same keys with ``start <= time < end``; columns of both, keys once.

    A span is cut into aligned pieces whose lengths are powers of two of
    ``unit`` (two of each length at most) and a point asks for the piece of each
    length in use that it lies in, so the join is one on equality, and a key
    with many rows is spread over its times.  Names must differ but for keys.
    """
    cut = _pieces(spans.withColumn("start_", F.col(start)).withColumn("end_", F.col(end)).where("start_ < end_"), unit).drop("start_", "end_")
    cut = materialize(cut, "pieces")
    levels = [r[0] for r in cut.select("level_").distinct().collect()]  # LEVELS at most
    at = _units(points, time, unit)
    asked = points.where(F.col(time).isNotNull()).withColumn("level_", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    asked = asked.withColumn("slot_", F.call_function("shiftright", at, F.col("level_")))
    return asked.join(cut, [*by, "level_", "slot_"]).where((F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))).drop("level_", "slot_")


def overlapping(a: DataFrame, b: DataFrame, start: tuple[str, str], end: tuple[str, str], by: list[str], unit: float = 60.0) -> DataFrame:
    """Every pair of spans (start included, end not) of the same keys that share time: one begins within the other."""
    (sa, sb), (ea, eb) = start, end
    a, b = a.where(F.col(sa) < F.col(ea)), b.where(F.col(sb) < F.col(eb))
    later = points_in_spans(a, b, sa, sb, eb, by, unit)
    earlier = points_in_spans(b, a, sb, sa, ea, by, unit).where(F.col(sb) != F.col(sa))
    return later.unionByName(earlier)
