"""Nearest neighbours by a hash-prefix forest (operator 6).

Every shard holds, for each of its trees, the sorted array of its vectors' long
hash strings (signs of random projections).  A query descends each tree to its
longest matching prefix, then all trees ascend together, one bit at a time,
until enough candidates share the prefix (on the last level tree by tree); these
are scored by the exact inner product.  How many are enough starts small and is
raised until an audit against brute force reaches the wanted recall.  A shard's
forest is built once and stored; blocks of queries read it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textbytes
from tessera.llm.hnsw import usable
from tessera.llm.storage import materialize

_BITS = 64


@dataclass(frozen=True)
class Params:
    """wanted: candidates per neighbour asked for, to begin with; audit: queries checked by brute force in each block; recall: what the audit must reach."""

    trees: int = 192
    wanted: int = 8
    growth: float = 1.25
    shard_rows: int = 16384
    query_rows: int = 32768
    audit: int = 64
    recall: float = 0.93
    seed: int = 11


def _keys(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """trees x n hash strings, the first projection in the highest bit."""
    out = np.empty((len(planes), len(x)), np.uint64)
    for t, plane in enumerate(planes):
        out[t] = np.packbits(x @ plane > 0, axis=1).view(">u8")[:, 0]
    return out


class Forest:
    """Trees of one shard: the sorted hash strings of each and the vectors that they belong to."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, p: Params):
        self.ids, self.x, self.p = ids, np.ascontiguousarray(vectors, np.float64), p
        # inner products of vectors of unequal length: one more component makes all lengths equal
        length = (self.x**2).sum(axis=1)
        lifted = np.concatenate([self.x, np.sqrt(np.maximum(length.max() - length, 0))[:, None]], axis=1)
        self.middle = lifted.mean(axis=0)
        keys = _keys(lifted - self.middle, self._planes())
        self.order = np.argsort(keys, axis=1, kind="stable").astype(np.int32)
        self.keys = np.take_along_axis(keys, self.order, 1)

    def _planes(self) -> np.ndarray:
        return np.random.default_rng(self.p.seed).normal(size=(self.p.trees, self.x.shape[1] + 1, _BITS))

    def pack(self) -> list[bytes]:
        return [a.tobytes() for a in (self.x, self.middle, self.order, self.keys)]

    @classmethod
    def unpack(cls, ids: np.ndarray, parts: list[bytes], p: Params) -> Forest:
        own = cls.__new__(cls)
        own.ids, own.p, n = ids, p, len(ids)
        own.x, own.middle = np.frombuffer(parts[0]).reshape(n, -1), np.frombuffer(parts[1])
        own.order, own.keys = np.frombuffer(parts[2], np.int32).reshape(-1, n), np.frombuffer(parts[3], np.uint64).reshape(-1, n)
        return own

    def asked(self, queries: np.ndarray) -> np.ndarray:
        """Hash strings of queries; their added component is 0, and the middle counts by the query's length."""
        length = np.sqrt((queries**2).sum(axis=1, keepdims=True))
        scale = np.sqrt((self.x**2).sum(axis=1).max())
        return _keys(np.concatenate([queries * scale / length, np.zeros((len(queries), 1))], axis=1) - self.middle, self._planes())

    def candidates(self, keys: np.ndarray, wanted: int) -> list[np.ndarray]:
        """Positions of each query's candidates: synchronous ascent until ``wanted`` entries of all trees share the prefix.

        The trees ascend to that level one after another, and only until there are enough.
        """
        trees, q = keys.shape
        n = self.keys.shape[1]

        def ranges(depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Entries of each tree that share so many bits with each query; all for no bits, none beyond the last."""
            rest = np.where(depth > 0, np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(depth, _BITS - 1).astype(np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF))
            rest[depth >= _BITS] = 0
            low, high = np.empty((2, trees, q), np.int64)
            for t in range(trees):
                low[t] = np.searchsorted(self.keys[t], keys[t] & ~rest, side="left")
                high[t] = np.searchsorted(self.keys[t], keys[t] | rest, side="right")
            high[:, depth > _BITS] = low[:, depth > _BITS]
            return low, high

        # the longest prefix that enough entries share: their number falls with its length
        some, few = np.zeros(q, np.int64), np.full(q, _BITS + 1)
        while (few - some > 1).any():
            middle = (some + few) // 2
            low, high = ranges(middle)
            enough = (high - low).sum(axis=0) >= wanted
            some, few = np.where(enough, middle, some), np.where(enough, few, middle)
        (low, high), (next_low, next_high) = ranges(some), ranges(some + 1)
        size, longer = high - low, next_high - next_low
        # of the trees in turn only so many ascend to it as are needed
        total = longer.sum(axis=0) + np.cumsum(size - longer, axis=0)
        up = np.arange(trees)[:, None] <= (total < wanted).sum(axis=0)
        low, size = np.where(up, low, next_low), np.where(up, size, longer)
        flat, base = self.order.reshape(-1), np.arange(trees) * n
        out = []
        for i in range(q):
            mark = np.zeros(n, bool)
            mark[flat[textbytes.ragged(low[:, i] + base, size[:, i])]] = True
            out.append(np.flatnonzero(mark))
        return out

    def nearest(self, queries: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, inner products) of the ``k`` best of each query, ties to smaller ids; candidates grow until the audit passes."""
        n, p = len(self.ids), self.p
        audit = np.unique(np.linspace(0, len(queries) - 1, min(p.audit, len(queries))).astype(int))
        truth = [self._best(np.arange(n), queries[i], own[i], k)[0] for i in audit]
        keys, wanted = self.asked(queries[audit]), p.wanted * k
        while wanted < n * p.trees:
            got = self.candidates(keys, wanted)
            hits = sum(len(np.intersect1d(t, self._best(c, queries[i], own[i], k)[0], assume_unique=True)) for t, c, i in zip(truth, got, audit, strict=True))
            if hits >= p.recall * sum(map(len, truth)):
                break
            wanted = int(wanted * p.growth) + 1
        for a in range(0, len(queries), 512):
            some = slice(a, a + 512)
            for c, query, me in zip(self.candidates(self.asked(queries[some]), wanted), queries[some], own[some], strict=True):
                yield self._best(c, query, me, k)

    def _best(self, at: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        at = at[self.ids[at] != own]
        score = self.x[at] @ query
        if len(at) > k:
            edge = np.partition(score, len(at) - k)[len(at) - k]
            some = score >= edge
            at, score = at[some], score[some]
        top = np.lexsort((self.ids[at], -score))[:k]
        return self.ids[at][top], score[top]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(table: DataFrame, queries: DataFrame, k: int = 20, params: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query among the other rows.

    ``queries`` has the same columns as ``table``.  A row is never its own
    query's neighbour.  Null or zero vectors, vectors with null or non-finite
    components and null ids take no part; of rows that repeat an id the smallest vector counts;
    vectors of another length than the query's are no candidates.  Fewer than
    ``k`` candidates give fewer rows, an empty table none.  Rows are dealt into
    shards of bounded size, queries into blocks; every block meets every shard's
    stored forest.
    """
    p = params

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(df[id_col].cast("bigint").alias("id"), df[vector_col].cast("array<double>").alias("vector"))
        # of rows that repeat an id, the one of the smallest vector counts
        return rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))

    rows, asked = materialize(clean(table), "vectors"), materialize(clean(queries), "queries")
    counts = materialize(
        rows.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / p.shard_rows).cast("int").alias("shards")).join(asked.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / p.query_rows).cast("int").alias("blocks")), "dim"), "counts"
    )
    hashed = F.xxhash64("id")
    sent = asked.join(counts, "dim").withColumn("block", F.pmod(hashed, F.col("blocks")).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))

    def build(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("id")
        ids = shard.column("id").to_numpy()
        parts = Forest(ids, _matrix(shard.column("vector")), p).pack()
        return pa.table({"dim": shard.column("dim")[:1], "shard": shard.column("shard")[:1], "blocks": shard.column("blocks")[:1], "ids": pa.array([ids.tolist()], pa.list_(pa.int64())), "parts": pa.array([parts], pa.list_(pa.binary()))})

    dealt = rows.join(counts, "dim").withColumn("shard", F.pmod(hashed, F.col("shards")).cast("int")).select("dim", "shard", "blocks", "id", "vector")
    forests = materialize(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, blocks int, ids array<bigint>, parts array<binary>"), "forests")
    offered = forests.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            forest = Forest.unpack(np.array(right.column("ids")[0].as_py(), np.int64), right.column("parts")[0].as_py(), p)
            own = left.column("id").to_numpy()
            for i, (ids, scores) in enumerate(forest.nearest(_matrix(left.column("vector")), own, k)):
                out[0].append(np.full(len(ids), own[i]))
                out[1].append(ids)
                out[2].append(scores)
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(np.float64))})

    keys = ["dim", "shard", "block"]
    found = sent.select(*keys, "id", "vector").groupBy(*keys).cogroup(offered.select(*keys, "ids", "parts").groupBy(*keys)).applyInArrow(run, "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
