"""Statistics of samples held in rows: aggregates, window kernels, rank tests and change classes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.cypher import normal_cdf, probit
from tessera.storage import materialize

# Outlier scaling of deviations, and the threshold on modified z-scores.
MAD_SCALE, Z_LIMIT = 0.6745, 3.5


def descriptive(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, min, max, sample variance and deviation (0 below two values)."""
    return df.groupBy(*(by or [])).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"),
        F.coalesce(F.var_samp(value), F.lit(0.0)).alias("variance"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stddev"),
    )


def percentiles(df: DataFrame, value: str, points: list[float], by: list[str] | None = None, exact_below: int | None = None) -> DataFrame:
    """Linear-interpolation percentiles ``p50`` and so on.

    With ``exact_below`` groups of as many rows or more get them from a t-digest.
    """
    exact = [F.percentile(value, p).alias(f"p{round(p * 1000) / 10:g}".replace(".", "_")) for p in points]
    if exact_below is None:
        return df.groupBy(*(by or [])).agg(*exact)
    if not by:
        return digest_quantiles(digests(df, value), points) if df.count() >= exact_below else df.agg(*exact)
    sizes = df.groupBy(*by).agg((F.count(F.lit(1)) >= exact_below).alias("large_"))
    marked = df.join(sizes, by)
    return marked.where("not large_").groupBy(*by).agg(*exact).unionByName(digest_quantiles(digests(marked.where("large_"), value, by), points, by))


def floor_index_percentile(value: Column | str, p: float, least: int) -> Column:
    """The sorted value at index floor(n p), and the largest below ``least`` values."""
    xs = F.array_sort(F.collect_list(value))
    n = F.count(value)
    return F.when(n < least, F.max(value)).otherwise(F.try_element_at(xs, F.least(F.floor(n * p) + 1, n).cast("int")))


def mad(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``median`` and unscaled median absolute deviation ``mad``: two aggregations, the first joined back by group."""
    by = by or []
    mid = df.groupBy(*by).agg(F.median(value).alias("median"))
    back = df.join(mid, by) if by else df.crossJoin(F.broadcast(mid))  # one row
    return back.groupBy(*by, "median").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"), F.avg(F.abs(F.col(value) - F.col("median"))).alias("mean_dev"))


def outliers(df: DataFrame, value: str, by: list[str] | None = None, limit: float = Z_LIMIT) -> DataFrame:
    """``df`` with ``score`` and ``outlier``: modified z-score without sign, by mean deviation where the median deviation is 0, 0 where both are."""
    by = by or []
    scale = mad(df, value, by)
    back = df.join(scale, by) if by else df.crossJoin(F.broadcast(scale))  # one row
    off = F.abs(F.col(value) - F.col("median"))
    spread = F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("mean_dev"))
    score = F.when(spread > 0, MAD_SCALE * off / spread).otherwise(F.when(off.isNotNull(), 0.0))
    return back.withColumn("score", score).withColumn("outlier", F.col("score") > limit).drop("median", "mad", "mean_dev")


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``rank``: ties share the mean of their places.

    Values are counted first, so the running count is over distinct values of a group only.
    """
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    before = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("rank", F.coalesce(F.sum("ties").over(before), F.lit(0)) + (F.col("ties") + 1) / 2)
    return df.join(ranks, [*by, value])


def mann_whitney(df: DataFrame, value: str, side: str, by: list[str] | None = None) -> DataFrame:
    """``u, z, p_value`` of two samples told apart by the boolean column ``side``; null below two values each.

    Normal approximation with tie correction, without continuity correction.
    """
    by = by or []
    ranked = average_ranks(df, value, by)
    ties = ranked.groupBy(*by, value).agg(F.first("ties").alias("t")).groupBy(*by).agg(F.sum(F.pow("t", 3) - F.col("t")).alias("tied"))
    sums = ranked.groupBy(*by).agg(
        F.count(F.when(F.col(side), 1)).alias("n1"), F.count(F.when(~F.col(side), 1)).alias("n2"), F.sum(F.when(F.col(side), F.col("rank"))).alias("r1"),
    )
    both = sums.join(ties, by) if by else sums.crossJoin(F.broadcast(ties))  # one row
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u1 = F.col("r1") - n1 * (n1 + 1) / 2
    u = F.least(u1, n1 * n2 - u1)
    var = F.greatest(n1 * n2 / 12 * (n + 1 - F.col("tied") / (n * (n - 1))), F.lit(1e-10))
    enough = (n1 >= 2) & (n2 >= 2)
    z = (u - n1 * n2 / 2) / F.sqrt(var)
    return both.select(*by, F.when(enough, u).alias("u"), F.when(enough, z).alias("z"), F.when(enough, F.least(F.lit(1.0), 2 * (1 - normal_cdf(F.abs(z))))).alias("p_value"))


def classify_change(p: Column, percent: Column, alpha: float = 0.05, least: float = 5.0, lower_is_better: bool = True) -> Column:
    """Inconclusive unless significant, NoChange below the least effect in percent, else Improvement or Regression."""
    better = percent < 0 if lower_is_better else percent > 0
    return F.when(p.isNull() | (p >= alpha), "Inconclusive").when(F.abs(percent) < least, "NoChange").when(better, "Improvement").otherwise("Regression")


def compare_metric(df: DataFrame, value: str, side: str, by: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Means of both samples (``side`` true is the later), their difference, percent (0 for a mean near 0), p-value and class."""
    by = by or []
    means = df.groupBy(*by).agg(F.avg(F.when(~F.col(side), F.col(value))).alias("mean_a"), F.avg(F.when(F.col(side), F.col(value))).alias("mean_b"))
    tested = mann_whitney(df, value, side, by)
    both = means.join(tested, by) if by else means.crossJoin(F.broadcast(tested))  # one row
    delta = F.col("mean_b") - F.col("mean_a")
    percent = F.when(F.abs("mean_a") < 1e-15, 0.0).otherwise(delta / F.col("mean_a") * 100)
    kind = F.when(F.col("p_value").isNull() | (F.col("p_value") >= alpha), "NoChange").when(percent < 0, "Improvement").otherwise("Regression")
    return both.select(*by, "mean_a", "mean_b", delta.alias("delta"), percent.alias("percent"), "p_value", kind.alias("change"))


#: Prime of the resampling hash; the squares of numbers below it fit 64 bits.
PRIME = 2_147_483_647
#: Thresholds of a Poisson count of mean 1: a uniform number at or above the k-th means more than k.
POISSON = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9))


def poisson_weights(rows: np.ndarray, resamples: np.ndarray, seed: int) -> np.ndarray:
    """How often each row counts in each resample, by a hash of both: 0 to 9, one on average."""
    x = (rows % PRIME * 48_271 % PRIME)[:, None] + (resamples * 69_621 + seed * 16_807) % PRIME
    x = x % PRIME
    for k in (1, 2):  # two rounds of squaring mix the sum
        x = (x * x + k * 40_692) % PRIME
    return np.searchsorted(np.array(POISSON), x / PRIME, side="right")


def bca_interval(df: DataFrame, value: str, by: list[str], resamples: int = 1000, level: float = 0.95, seed: int = 42, row: str | None = None) -> DataFrame:
    """``n, lower, upper, bias, acceleration`` of the mean: bias-corrected accelerated bootstrap of each group with three values or more.

    Every row counts in each resample as often as a Poisson number hashed from
    the row (column ``row``, an integer, or the row's own hash) and the
    resample says, so resampling is an aggregation: a task adds up the weights
    and weighted values of its rows, and only one number pair a group and
    resample leaves it.  The acceleration needs only central moments.  ``bias``
    is the mean of the resampled means less the mean.
    """
    own = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("x_"), (F.col(row).cast("bigint") if row else F.pmod(F.xxhash64(*df.columns), F.lit(PRIME))).alias("row_"))
    kinds = own.select(*by).schema
    schema = T.StructType([*kinds.fields, T.StructField("at_", T.IntegerType()), T.StructField("w_", T.LongType()), T.StructField("wx_", T.DoubleType())])
    numbers = np.arange(resamples, dtype=np.int64)

    def part(batches):
        held: dict[tuple, list] = {}
        for rows in batches:
            for key, some in rows.groupby(by, dropna=False, sort=False) if by else [((), rows)]:
                key = key if isinstance(key, tuple) else (key,)
                key = tuple(None if pd.isna(k) else k for k in key)
                sums = held.setdefault(key, [np.zeros(resamples, np.int64), np.zeros(resamples)])
                x, r = some["x_"].to_numpy(float), some["row_"].to_numpy(np.int64)
                for a in range(0, len(x), 2048):
                    w = poisson_weights(r[a : a + 2048], numbers, seed)
                    sums[0] += w.sum(axis=0)
                    sums[1] += x[a : a + 2048] @ w
            if len(held) > 256:  # groups that are many are added up by Spark
                yield from _resampled(held, by, numbers)
                held = {}
        yield from _resampled(held, by, numbers)

    sums = own.mapInPandas(part, schema).groupBy(*by, "at_").agg(F.sum("w_").alias("w"), F.sum("wx_").alias("wx"))
    means = sums.where("w > 0").select(*by, (F.col("wx") / F.col("w")).alias("m"))
    drawn = means.groupBy(*by).agg(F.array_sort(F.collect_list("m")).alias("ms"))  # ``resamples`` numbers a group
    moments = own.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("x_").alias("mean"), F.var_pop("x_").alias("v"), F.skewness("x_").alias("skew")).where("n >= 3")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_m")) for c in by]
    both = moments.withColumnsRenamed({c: f"{c}_m" for c in by}).join(drawn, same) if by else moments.crossJoin(drawn)
    z = [float(_quantile(p)) for p in ((1 - level) / 2, (1 + level) / 2)]
    below = F.size(F.filter("ms", lambda m: m < F.col("mean"))) / F.size("ms")
    shift = probit(F.least(F.greatest(below, F.lit(1e-6)), F.lit(1 - 1e-6)))
    # sums of powers of what leaving one value out changes, from the moments
    acceleration = F.when(F.col("v") == 0, 0.0).otherwise(F.col("skew") / (6 * F.sqrt("n")))
    both = both.withColumn("z0", shift).withColumn("acceleration", acceleration)

    def end(zp: float) -> Column:
        t = F.col("z0") + zp
        share = normal_cdf(F.col("z0") + t / (1 - F.col("acceleration") * t))
        place = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (F.size("ms") - 1)
        low = F.floor(place).cast("int")
        at = lambda k: F.get("ms", F.least(k, F.size("ms") - 1))
        return at(low) + (at(low + 1) - at(low)) * (place - low)

    bias = F.aggregate("ms", F.lit(0.0), lambda a, m: a + m) / F.size("ms") - F.col("mean")
    return both.select(*by, "n", end(z[0]).alias("lower"), end(z[1]).alias("upper"), bias.alias("bias"), "acceleration")


def _quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def _resampled(held: dict[tuple, list], by: list[str], numbers: np.ndarray):
    for key, (w, wx) in held.items():
        rows = pd.DataFrame({"at_": numbers.astype(np.int32), "w_": w, "wx_": wx})
        for c, k in reversed([*zip(by, key, strict=True)]):
            rows.insert(0, c, k)
        yield rows


def jackknife(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``df`` with ``left_out``: the mean of the group's other values."""
    by = by or []
    sums = df.groupBy(*by).agg(F.sum(value).alias("sum_"), F.count(value).alias("n_"))
    back = df.join(sums, by) if by else df.crossJoin(F.broadcast(sums))  # one row
    return back.withColumn("left_out", F.when(F.col("n_") > 1, (F.col("sum_") - F.col(value)) / (F.col("n_") - 1))).drop("sum_", "n_")


def acceleration_point(df: DataFrame, order: str, value: str, window: int, threshold: float, by: list[str] | None = None) -> DataFrame:
    """``point``: first place, from the second, whose window mean is below the first window's mean times ``threshold``.

    Null values are skipped; null with fewer than two windows of values or a first mean of 0 or less.
    """
    by = by or ["series_"]
    rows = (df if by != ["series_"] else df.withColumn("series_", F.lit(0))).where(F.col(value).isNotNull())
    order_ = Window.partitionBy(*by).orderBy(order)
    rows = rows.withColumn("at", F.row_number().over(order_) - 1).withColumn("mean_", F.avg(value).over(order_.rowsBetween(0, window - 1))).withColumn("full_", F.count(value).over(order_.rowsBetween(0, window - 1)) == window)
    per = Window.partitionBy(*by)
    rows = rows.withColumn("first_", F.max(F.when(F.col("at") == 0, F.col("mean_"))).over(per)).withColumn("n_", F.count(F.lit(1)).over(per))
    hit = F.col("full_") & (F.col("at") >= 1) & (F.col("first_") > 0) & (F.col("n_") >= 2 * window) & (F.col("mean_") < F.col("first_") * threshold)
    return rows.groupBy(*by).agg(F.min(F.when(hit, F.col("at"))).cast("bigint").alias("point")).drop("series_")


def recovered(df: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    """``recovered``: the first quarter has a null and the last has none (four places or more)."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    rows = df.withColumn("at", place).join(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    quarter = F.floor(F.col("n") / 4)
    gap = F.col(value).isNull()
    early = F.max(F.when(F.col("at") <= quarter, gap.cast("int")))
    late = F.max(F.when(F.col("at") > F.col("n") - quarter, gap.cast("int")))
    return rows.groupBy(*by).agg(F.coalesce((F.first("n") >= 4) & (early == 1) & (late == 0), F.lit(False)).alias("recovered"))


def stability(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Coefficient of variation and least over greatest."""
    return df.groupBy(*by).agg((F.stddev_samp(value) / F.avg(value)).alias("cv"), F.try_divide(F.min(value).cast("double"), F.max(value).cast("double")).alias("min_max_ratio"))


def cumulative_cost(df: DataFrame, order: str, cost: str, saving: str, by: list[str]) -> DataFrame:
    """Running cost and saving, and whether the saving has met the cost."""
    run = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("total_cost", F.sum(cost).over(run)).withColumn("total_saving", F.sum(saving).over(run)).withColumn("paid_back", F.col("total_saving") >= F.col("total_cost"))


def snapshot_delta(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """after - before by key; a side without the key counts 0."""
    a, b = (d.select(key, F.col(value).alias(n)) for d, n in ((before, "before"), (after, "after")))
    return a.join(b, key, "full").select(key, "before", "after", (F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("delta"))


def variance_parts(df: DataFrame, value: str, run: str) -> DataFrame:
    """Between-run and within-run variance (one-way analysis)."""
    per = df.groupBy(run).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    all_ = per.agg(F.sum(F.col("n") * F.col("m")).alias("s"), F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    return per.crossJoin(F.broadcast(all_)).groupBy("t", "k").agg((F.sum(F.col("n") * F.pow(F.col("m") - F.col("s") / F.col("t"), 2)) / (F.first("k") - 1)).alias("between"), (F.sum((F.col("n") - 1) * F.col("v")) / (F.first("t") - F.first("k"))).alias("within")).select("between", "within")


@dataclass
class SteadyState:
    """Where a series becomes steady, for values that arrive in blocks.

    A regime has a baseline and a deviation: of the first ``least`` values for
    the first regime, its first value and 0 for a later one.  Departures from
    the baseline add up on either side, less an allowance of half of ``drift``
    deviations a value and never below 0; a sum beyond ``sigma`` deviations ends
    the regime, and the value that did it begins the next.  Without a deviation
    a tenth of the baseline stands in for it, with the whole drift.  The series
    is steady, for good, once ``least`` values in a row left the regime's own
    spread within ``sigma * drift / 10`` of its mean.
    """

    seen: int = 0
    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    base: float = 0.0
    deviation: float = 0.0
    up: float = 0.0
    down: float = 0.0
    calm: int = 0
    changes: int = 0
    steady_at: int = -1
    least: int = 5
    sigma: float = 4.0
    drift: float = 0.5

    def extend(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether steady, regimes ended) after each of the values."""
        x = np.asarray(values, float)
        steady, changes = np.zeros(len(x), bool), np.zeros(len(x), np.int64)
        at, width = 0, 64
        while at < len(x):
            if self.steady_at >= 0:
                self._moments(x[at:])
                steady[at:], changes[at:] = True, self.changes
                break
            warming = self.changes == 0 and self.seen < self.least - 1
            block = x[at : at + (self.least - 1 - self.seen if warming else width)]
            ended = self.changes
            if warming:
                self._moments(block)
                took = len(block)
            else:
                took = self._regime(block)
            changes[at : at + took] = ended
            if self.changes > ended:
                changes[at + took - 1], width = self.changes, 64
            else:
                width *= 2
            if self.steady_at >= 0:
                steady[at + took - 1] = True
            at += took
        return steady, changes

    def _moments(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, mean and sum of squares of the regime after each value; the last ones are kept."""
        n = self.n + np.arange(1, len(x) + 1)
        off = x - (self.mean if self.n else x[0] if len(x) else 0.0)
        origin = self.mean if self.n else x[0] if len(x) else 0.0
        total = np.cumsum(off)
        mean, m2 = origin + total / n, np.maximum(self.m2 + np.cumsum(off * off) - total * total / n, 0.0)
        if len(x):
            self.seen, self.n, self.mean, self.m2 = self.seen + len(x), int(n[-1]), float(mean[-1]), float(m2[-1])
        return n, mean, m2

    def _regime(self, x: np.ndarray) -> int:
        """Takes values until the regime ends or is steady; returns how many."""
        kept = (self.seen, self.n, self.mean, self.m2)
        n, mean, m2 = self._moments(x)
        spread = np.sqrt(m2 / np.maximum(n - 1, 1))
        if self.changes == 0 and kept[0] == self.least - 1:
            self.base, self.deviation = float(mean[0]), float(spread[0])
        if self.deviation > 1e-9:
            allowance, bound = self.drift / 2 * self.deviation, self.sigma * self.deviation
        else:
            unit = self.drift * abs(self.base) / 10
            allowance, bound = max(unit, 1e-10), max(self.sigma * unit, 1e-9)

        def held_at_zero(carried: float, steps: np.ndarray) -> np.ndarray:
            total = carried + np.cumsum(steps)
            return total - np.minimum(np.minimum.accumulate(total), 0.0)

        up = held_at_zero(self.up, x - self.base - allowance)
        down = held_at_zero(self.down, self.base - x - allowance)
        over = np.flatnonzero(np.maximum(up, down) > bound)
        inside = over[0] if len(over) else len(x)
        near = (spread < 1e-9) | (np.where(np.abs(mean) > 1e-10, spread / np.maximum(np.abs(mean), 1e-300), 0.0) <= self.sigma * self.drift / 10)
        late = n >= self.least
        place = np.arange(len(x))
        broken = np.maximum.accumulate(np.where(late & ~near, place, -1))
        run = np.where(broken >= 0, place - broken, self.calm + np.cumsum(late))
        calm = np.flatnonzero(late & (run >= self.least))
        took = min(inside + 1, calm[0] + 1 if len(calm) else len(x), len(x))
        # the state after the values taken
        self.seen, self.n, self.mean, self.m2 = kept
        if inside < len(x) and inside == took - 1:
            self.seen += took
            self.n, self.mean, self.m2, self.base, self.deviation = 1, float(x[inside]), 0.0, float(x[inside]), 0.0
            self.up = self.down = 0.0
            self.calm, self.changes = 0, self.changes + 1
            return took
        self._moments(x[:took])
        self.up, self.down, self.calm = float(up[took - 1]), float(down[took - 1]), int(run[took - 1])
        if len(calm) and calm[0] == took - 1:
            self.steady_at = self.seen - 1
        return took


def cusum(df: DataFrame, order: str, value: str, by: list[str]) -> DataFrame:
    """``by…, order, value, steady, changes`` of each series by the detector; the detector follows a series in order, in one task, in blocks."""
    own = df.select(*by, order, value)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema), "steady boolean", "changes int"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        known = rows[value].notna().to_numpy()
        steady, changes = SteadyState().extend(rows[value].to_numpy(float)[known])
        # a missing value changes nothing
        at = np.cumsum(known)
        return rows.assign(steady=np.append(False, steady)[at], changes=np.append(0, changes)[at])

    return own.groupBy(*by).applyInPandas(run, schema)


def digest(values: np.ndarray, weights: np.ndarray, compression: float = 100.0) -> tuple[np.ndarray, np.ndarray]:
    """(means, weights) of centroids of a t-digest.

    Sorted values are cut where the arcsine scale of their rank passes a whole
    number, so centroids are small at both tails; there are ``compression / 2``
    at most, however many values there are.
    """
    order = np.argsort(values, kind="stable")
    values, weights = values[order].astype(float), weights[order].astype(float)
    total = weights.sum()
    if not total > 0:
        return values[:0], weights[:0]
    middle = (np.cumsum(weights) - weights / 2) / total
    place = np.floor(compression / (2 * np.pi) * (np.arcsin(2 * middle - 1) + np.pi / 2)).astype(np.int64)
    starts = np.flatnonzero(np.diff(place, prepend=-1))
    sizes = np.add.reduceat(weights, starts)
    return np.add.reduceat(values * weights, starts) / sizes, sizes


#: Digests that one task merges.
FAN = 64


def digests(df: DataFrame, value: str, by: list[str] | None = None, compression: float = 100.0) -> DataFrame:
    """``by…, mean, weight``: the centroids of each group's t-digest.

    A task digests what it reads of each group, so it sends a bounded number of
    centroids; ``merge_digests`` joins them as a tree.  Digests of several
    tables merge by the union of their centroids.
    """
    by = by or []
    own = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("mean"), F.lit(1.0).alias("weight"))

    def part(batches):
        held: dict[tuple, list] = {}
        for rows in batches:
            for key, some in rows.groupby(by, dropna=False, sort=False) if by else [((), rows)]:
                key = tuple(None if pd.isna(k) else k for k in (key if isinstance(key, tuple) else (key,)))
                old = held.get(key, (np.zeros(0), np.zeros(0)))
                held[key] = digest(np.concatenate([old[0], some["mean"].to_numpy(float)]), np.concatenate([old[1], some["weight"].to_numpy(float)]), compression)
            if len(held) > 4096:
                yield from (_centroids(k, by, *d) for k, d in held.items())
                held = {}
        yield from (_centroids(k, by, *d) for k, d in held.items())

    parts = materialize(own.mapInPandas(part, own.schema).withColumn("source_", F.spark_partition_id()), "digests")
    return merge_digests(parts, by, compression, (parts.agg(F.max("source_")).first()[0] or 0) + 1)


def _centroids(key: tuple, by: list[str], means: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    rows = pd.DataFrame({"mean": means, "weight": sizes})
    for c, k in reversed([*zip(by, key, strict=True)]):
        rows.insert(0, c, k)
    return rows


def merge_digests(centroids: DataFrame, by: list[str] | None = None, compression: float = 100.0, sources: int = 1) -> DataFrame:
    """One digest a group, as a tree: each level merges the centroids of at most ``FAN`` of ``sources`` digests (told apart by ``source_``) in a task."""
    by = by or []
    now = centroids if "source_" in centroids.columns else centroids.withColumn("source_", F.lit(0))
    while True:
        sources = -(-sources // FAN)
        now = now.withColumn("source_", F.floor(F.col("source_") / FAN).cast("int"))

        def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            out = _centroids(key[:-1], by, *digest(rows["mean"].to_numpy(), rows["weight"].to_numpy(), compression))
            out["source_"] = key[-1]
            return out

        now = now.groupBy(*by, "source_").applyInPandas(merge, now.schema)
        if sources <= 1:
            return now.drop("source_")


def digest_quantiles(centroids: DataFrame, points: list[float], by: list[str] | None = None) -> DataFrame:
    """``p50`` and so on of each group of centroids, linear between their middles."""
    by = by or []
    names = [f"p{round(p * 1000) / 10:g}".replace(".", "_") for p in points]
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in centroids.select(*by).schema), *(f"{n} double" for n in names)])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("mean", kind="stable")
        mean, weight = rows["mean"].to_numpy(float), rows["weight"].to_numpy(float)
        middle = np.cumsum(weight) - weight / 2
        return pd.DataFrame([(*key, *(float(np.interp(p * weight.sum(), middle, mean)) for p in points))])

    return centroids.groupBy(*by).applyInPandas(run, fields)


def enough_samples(samples: list[float], least: int = 10, share: float = 0.02) -> bool:
    """Whether the half-width of the mean's normal interval is below ``share`` of the mean."""
    n = len(samples)
    if n < least:
        return False
    mean = sum(samples) / n
    deviation = (sum((x - mean) ** 2 for x in samples) / (n - 1)) ** 0.5
    return 1.96 * deviation / n**0.5 < share * abs(mean)


def compare_results(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two tables of result records: compare_metric of the samples of each benchmark that both have, and a line of text."""
    side = lambda rows, later: rows.select("benchmark", F.explode("samples").alias("value"), F.lit(later).alias("later"))
    both = before.select("benchmark").distinct().intersect(after.select("benchmark").distinct())
    rows = side(before, False).unionByName(side(after, True)).join(both, "benchmark", "left_semi")
    out = compare_metric(rows, "value", "later", ["benchmark"])
    line = F.format_string("%s: %.3f -> %.3f ms (%+.1f %%), %s", "benchmark", "mean_a", "mean_b", "percent", "change")
    return out.withColumn("line", line).orderBy("benchmark")


def pairwise(df: DataFrame, engine: str, metric: str, value: str) -> DataFrame:
    """compare_metric of every two engines of a metric, by a self-join on the metric."""
    names = df.select(F.col(metric).alias("metric"), F.col(engine).alias("engine")).distinct()
    pairs = names.alias("x").join(names.alias("y"), (F.col("x.metric") == F.col("y.metric")) & (F.col("x.engine") < F.col("y.engine"))).select(F.col("x.metric").alias("metric"), F.col("x.engine").alias("a"), F.col("y.engine").alias("b"))
    own = df.select(F.col(metric).alias("metric"), F.col(engine).alias("engine"), F.col(value).alias("value"))
    rows = pairs.join(own, "metric").where("engine = a or engine = b").withColumn("later", F.col("engine") == F.col("b"))
    return compare_metric(rows, "value", "later", ["metric", "a", "b"])

