"""Result comparison: canonical encodings, order-free set hashes, row equivalence and path checks."""

from __future__ import annotations

import hashlib
import struct
import unicodedata
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Type tags of the canonical encoding.
TAGS = {"null": 0, "bool": 1, "int": 2, "float": 3, "text": 4}


def encode_value(v) -> bytes:
    """Tag byte and big-endian payload; negative zero as zero, one NaN, text with its length."""
    if v is None:
        return bytes([TAGS["null"]])
    if isinstance(v, (bool, np.bool_)):
        return bytes([TAGS["bool"], int(v)])
    if isinstance(v, (int, np.integer)):
        return bytes([TAGS["int"]]) + struct.pack(">q", int(v))
    if isinstance(v, (float, np.floating)):
        v = float(v)
        raw = struct.pack(">Q", 0x7FF8000000000000) if v != v else struct.pack(">d", v + 0.0 if v else 0.0)
        return bytes([TAGS["float"]]) + raw
    text = str(v).encode()
    return bytes([TAGS["text"]]) + struct.pack(">I", len(text)) + text


def encode_row(values) -> bytes:
    return struct.pack(">I", len(values)) + b"".join(map(encode_value, values))


@F.pandas_udf(T.StringType())
def _hex_double(xs: pd.Series) -> pd.Series:
    x = xs.to_numpy(float) + 0.0  # negative zero becomes zero
    bits = np.where(np.isnan(x), np.uint64(0x7FF8000000000000), x.view(np.uint64)).astype(">u8").tobytes().hex()
    return pd.Series([f"{TAGS['float']:02x}{bits[k : k + 16]}" for k in range(0, len(bits), 16)], index=xs.index, dtype=object)


def canonical(column: Column, kind: T.DataType) -> Column:
    """Hex of the canonical encoding; only doubles leave the JVM."""
    none = F.lit("00")
    if isinstance(kind, T.BooleanType):
        body = F.when(column, "0101").otherwise("0100")
    elif isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        body = F.concat(F.lit("02"), F.lower(F.lpad(F.hex(column.cast("bigint")), 16, "0")))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        body = _hex_double(F.coalesce(column.cast("double"), F.lit(0.0)))
    else:
        text = column.cast("string")
        body = F.concat(F.lit("04"), F.lower(F.lpad(F.hex(F.octet_length(text).cast("bigint")), 8, "0")), F.lower(F.hex(F.encode(text, "utf-8"))))
    return F.when(column.isNull(), none).otherwise(body)


def canonical_rows(df: DataFrame) -> DataFrame:
    parts = [canonical(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]
    return df.select(F.concat(F.lit(struct.pack(">I", len(parts)).hex()), *parts).alias("row"))


def set_hash(df: DataFrame) -> str:
    """``sha256:`` hash of all rows, whatever their order: equal rows are counted, hashed rows sorted in buckets by their first bytes, and the buckets hashed in order."""
    rows = canonical_rows(df).groupBy("row").agg(F.count(F.lit(1)).alias("n")).select(F.concat_ws(":", F.sha2("row", 256), F.col("n").cast("string")).alias("h"))
    for width in (4, 2, 0):
        rows = rows.groupBy(F.left("h", F.lit(width)).alias("at")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("own"))
        rows = rows.select(F.concat("at", F.lit("="), "own").alias("h"))
    found = rows.first()
    return f"sha256:{found['h'].removeprefix('=') if found else hashlib.sha256(b'').hexdigest()}"


def fast_hash(df: DataFrame) -> tuple[int, str]:
    """Row count and sum of row hashes: order-free and without gathering."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h")).first()
    return row["n"], f"xx:{int(row['h']) & 0xFFFFFFFFFFFFFFFF:016x}"


def ulp_equal(a: float | None, b: float | None, ulps: int = 4) -> bool:
    """Equal within so many representable steps; NaN equals NaN, zeros are equal, other signs differ."""
    if a is None or b is None:
        return a is b
    if a != a or b != b:
        return a != a and b != b
    if a == b:
        return True
    if (a < 0) != (b < 0):
        return False
    x, y = np.float64(a).view(np.int64), np.float64(b).view(np.int64)
    return abs(int(x) - int(y)) <= ulps


def within_ulps(a: Column, b: Column, ulps: int = 4) -> Column:
    @F.pandas_udf(T.BooleanType())
    def equal(x: pd.Series, y: pd.Series) -> pd.Series:
        p, q = x.to_numpy(float), y.to_numpy(float)
        near = (np.signbit(p) == np.signbit(q)) & (np.abs(p.view(np.int64) - q.view(np.int64)) <= ulps)
        return pd.Series((p == q) | near | (np.isnan(p) & np.isnan(q)))

    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(equal(F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))))


def differing_rows(left: DataFrame, right: DataFrame, ulps: int = 4) -> DataFrame:
    """Rows of equal place (``ordinal``) that differ or have no partner; columns of other types are an error."""
    for f in left.schema:
        if f.name in right.columns and right.schema[f.name].dataType != f.dataType:
            raise TypeError(f"{f.name}: {f.dataType.simpleString()} and {right.schema[f.name].dataType.simpleString()}")
    values = [c for c in left.columns if c != "ordinal"]
    both = left.select("ordinal", *[F.col(c).alias(f"l_{c}") for c in values], F.lit(True).alias("l_")).join(right.select("ordinal", *[F.col(c).alias(f"r_{c}") for c in values], F.lit(True).alias("r_")), "ordinal", "full")
    same = F.col("l_").isNotNull() & F.col("r_").isNotNull()
    for c in values:
        l, r = F.col(f"l_{c}"), F.col(f"r_{c}")  # noqa: E741
        same = same & (within_ulps(l, r, ulps) if isinstance(left.schema[c].dataType, (T.DoubleType, T.FloatType)) else l.eqNullSafe(r))
    return both.where(~same).select("ordinal")


def canonical_path(nodes: Column, directed: bool = True) -> Column:
    """A path's node list; for undirected results the end with the smaller id goes first."""
    if directed:
        return nodes
    return F.when(F.get(nodes, F.lit(0)) > F.try_element_at(nodes, F.lit(-1)), F.reverse(nodes)).otherwise(nodes)


def path_faults(paths: DataFrame, edges: DataFrame, seed: int | None = None, low: int = 0, high: int = 1 << 30, directed: bool = True) -> DataFrame:
    """``path, fault`` of paths with too few or many hops, another start, a repeated path or a step that is no edge."""
    own = paths.select(canonical_path(F.col("nodes"), directed).alias("path"))
    hops = F.size("path") - 1
    out = own.where((hops < low) | (hops > high)).select("path", F.lit("length").alias("fault"))
    if seed is not None:
        out = out.unionByName(own.where(~F.get("path", F.lit(0)).eqNullSafe(F.lit(seed))).select("path", F.lit("seed").alias("fault")))
    out = out.unionByName(own.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("path", F.lit("duplicate").alias("fault")))
    steps = own.select("path", F.posexplode(F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))).alias("at", "a")).withColumn("b", F.get("path", F.col("at") + 1))
    known = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    if not directed:
        known = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return out.unionByName(steps.join(known.distinct(), ["a", "b"], "left_anti").select("path", F.lit("no edge").alias("fault")).distinct())


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def normalised(df: DataFrame) -> DataFrame:
    """``df`` whose texts are in composed form (NFC), so that equal characters have equal bytes."""
    return df.select(*[_composed(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema])


def exact_differences(left: DataFrame, right: DataFrame, composed: bool = False) -> DataFrame:
    """``row, times_left, times_right``: rows (canonical, as hex) that the sides hold a different number of times.

    Rows are counted by one shuffle after counting where they lie; nothing is
    gathered or sorted as a whole, and a row that occurs very often is one count
    from each task.
    """
    if len(left.columns) != len(right.columns):
        raise TypeError(f"{len(left.columns)} and {len(right.columns)} columns")
    if composed:
        left, right = normalised(left), normalised(right)
    sides = canonical_rows(left).select("row", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(canonical_rows(right).select("row", F.lit(0).alias("l"), F.lit(1).alias("r")))
    return sides.groupBy("row").agg(F.sum("l").alias("times_left"), F.sum("r").alias("times_right")).where("times_left <> times_right")


#: What repeated paths mean for a comparison.
DUPLICATES = ("allowed", "deduplicated", "unspecified")


def path_tuples(paths: DataFrame, directed: bool = True) -> DataFrame:
    """``steps, times``: each path of ``nodes`` as its list of (source, target, hop_index), and how often it occurs."""
    own = paths.select(canonical_path(F.col("nodes"), directed).alias("p"))
    steps = F.transform(F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))), lambda a, k: F.struct(a.alias("source"), F.get("p", k + 1).alias("target"), k.alias("hop_index")))
    return own.select(F.array_sort(steps).alias("steps")).groupBy("steps").agg(F.count(F.lit(1)).alias("times"))


def path_differences(left: DataFrame, right: DataFrame, duplicates: str = "unspecified", directed: bool = True) -> DataFrame:
    """``steps, times_left, times_right`` of paths that the sides do not share.

    ``allowed``: repeats count; ``deduplicated``: a repeat is itself a
    difference; ``unspecified``: repeats do not matter.
    """
    if duplicates not in DUPLICATES:
        raise ValueError(f"duplicates must be one of {', '.join(DUPLICATES)}")
    a, b = (path_tuples(p, directed).withColumnRenamed("times", t) for p, t in ((left, "times_left"), (right, "times_right")))
    both = a.join(b, "steps", "full").select("steps", F.coalesce("times_left", F.lit(0)).alias("times_left"), F.coalesce("times_right", F.lit(0)).alias("times_right"))
    differs = {"allowed": "times_left <> times_right", "deduplicated": "times_left <> times_right OR times_left > 1 OR times_right > 1", "unspecified": "(times_left = 0) <> (times_right = 0)"}
    return both.where(differs[duplicates])


def degree_distribution(edges: DataFrame, direction: str = "out") -> DataFrame:
    """``degree, nodes``: how many nodes have each degree of 1 or more."""
    ends = {"out": ["src"], "in": ["dst"], "both": ["src", "dst"]}[direction]
    every = reduce(DataFrame.unionAll, [edges.select(F.col(c).alias("id")) for c in ends])
    return every.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("nodes"))


def degree_faults(edges: DataFrame, expected: DataFrame, direction: str = "out", tolerance: float = 0.0) -> DataFrame:
    """``degree, nodes, expected`` where a distribution ``expected(degree, nodes)`` is missed by more than a share."""
    own = degree_distribution(edges, direction)
    both = own.join(expected.withColumnRenamed("nodes", "expected"), "degree", "full").select("degree", F.coalesce("nodes", F.lit(0)).alias("nodes"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.where(F.abs(F.col("nodes") - F.col("expected")) > tolerance * F.col("expected"))


def _path_length(df: DataFrame) -> Column:
    """What a row says of its path's length: ``length``, ``path_length`` or the number of nodes of ``path``; null if nothing."""
    found = [F.col(c).cast("bigint") for c in ("length", "path_length") if c in df.columns]
    if "path" in df.columns and isinstance(df.schema["path"].dataType, T.ArrayType):
        found.append(F.size("path").cast("bigint"))
    return F.coalesce(*found) if found else F.lit(None).cast("bigint")


def structural_faults(df: DataFrame, max_depth: int | None = None, seed_id=None) -> DataFrame:
    """Rows with ``fault``: ``length`` for a path beyond ``max_depth``, ``seed`` for one that starts elsewhere (column seed_id, seed or start)."""
    faults = []
    if max_depth is not None:
        faults.append(F.when(_path_length(df) > max_depth, "length"))
    starts = [F.col(c) for c in ("seed_id", "seed", "start") if c in df.columns]
    if seed_id is not None and starts:
        faults.append(F.when(F.coalesce(*starts) != F.lit(seed_id), "seed"))
    if not faults:
        return df.withColumn("fault", F.lit(None).cast("string")).where("false")
    return df.withColumn("fault", F.explode(F.array_compact(F.array(*faults))))


def check(df: DataFrame, oracle: dict) -> bool:
    """Whether a result meets an oracle.

    Kinds: row_count, row_count_range, exact_match and checksum, structural
    (``max_depth``, ``seed_id``), invariant (a ``condition`` every row must meet,
    ``invariants`` such as ``all_paths_length_le:4``, a range of rows).
    """
    kind = oracle["type"]
    if kind == "row_count":
        return df.count() == oracle["expected"]
    if kind == "row_count_range":
        return oracle.get("min", 0) <= df.count() <= oracle.get("max", 1 << 62)
    if kind in ("exact_match", "checksum"):
        return set_hash(df) == oracle["expected"]
    if kind == "structural":
        return structural_faults(df, oracle.get("max_depth"), oracle.get("seed_id")).isEmpty()
    if kind == "invariant" and "condition" not in oracle:
        low, high = oracle.get("expected_row_count_min"), oracle.get("expected_row_count_max")
        if low is not None and high is not None and not low <= df.count() <= high:
            return False
        for tag in oracle.get("invariants", []):
            name, _, limit = tag.partition(":")
            if name != "all_paths_length_le" or not limit.strip().isdigit():
                return False
            if not structural_faults(df, int(limit)).isEmpty():
                return False
        return True
    if kind == "invariant":
        return df.where(f"NOT coalesce({oracle['condition']}, false)").isEmpty()
    raise ValueError(f"unknown oracle {kind}")
