"""Near-duplicate embeddings by hierarchical navigable small-world graphs (operator 9).

Vectors of one label are dealt into shards of bounded size.  Each shard builds
a graph, which is stored; every vector of the label queries every shard of the
label, in blocks.  A beam that finds near vectors is widened by flooding the
links from them, and a block's beams are doubled until an audit against brute
force finds every link of each sampled query; a block that does not get there is
compared with its shard exactly.  Found links are confirmed by cosine in double
precision and united into components.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.storage import materialize

#: Single precision finds links down to this much under the least similarity; the cosine in double precision decides.
SLACK = 1e-4


@dataclass(frozen=True)
class Params:
    """links: neighbours kept per node (twice as many on the ground level); audit: queries checked by brute force per block, and one more for as many links found; recall: of each checked query's links."""

    links: int = 12
    build_beam: int = 48
    beam: int = 48
    shard_rows: int = 16384
    query_rows: int = 8192
    audit: int = 48
    recall: float = 1.0
    seed: int = 5


class Graph:
    """A small-world graph over unit vectors, searched for many queries at once."""

    def __init__(self, vectors: np.ndarray, p: Params):
        self.x, self.p = np.ascontiguousarray(vectors, np.float32), p
        n = len(vectors)
        rng = np.random.default_rng(p.seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(p.links)).astype(int), 6)
        # higher nodes come first, so that the entry point and the upper levels stand before the ground level fills
        self.order = np.argsort(-level, kind="stable")
        self.level = level
        self.entry = int(self.order[0])
        self.near = [np.full((n, 2 * p.links if at == 0 else p.links), -1, np.int32) for at in range(int(level.max()) + 1)]

    def build(self) -> Graph:
        top = len(self.near) - 1
        done, size = 1, 1
        while done < len(self.order):
            some = self.order[done : done + size]
            entry = np.full((len(some), 1), self.entry)
            for at in range(top, -1, -1):
                # nodes below this level only descend through it
                joins = self.level[some] >= at
                ids, sims = self.beam(self.x[some], entry, at, self.p.build_beam if joins.any() else 1)
                entry = ids[:, :1]
                if joins.any():
                    self._join(some[joins], ids[joins], sims[joins], at)
            done += len(some)
            size = min(512, max(1, done // 4))
        return self

    def _join(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, at: int) -> None:
        """Links nodes with diverse ones among those found and among each other, both ways."""
        inner = self.x[nodes] @ self.x[nodes].T
        earlier = np.tril(np.ones_like(inner, bool), -1)
        own = np.where(earlier, inner, -np.inf)
        k = min(self.p.build_beam // 2, len(nodes))
        best = np.argpartition(-own, k - 1, axis=1)[:, :k]
        more = np.where(np.isfinite(np.take_along_axis(own, best, 1)), nodes[best], -1)
        ids = np.concatenate([ids, more], axis=1)
        sims = np.concatenate([sims, np.where(more >= 0, np.take_along_axis(own, best, 1), -np.inf)], axis=1)
        ids = np.where(ids == nodes[:, None], -1, ids)
        sims = np.where(ids < 0, -np.inf, sims)
        chosen = self._diverse(ids, sims, self.near[at].shape[1] // 2)
        self.near[at][nodes, : chosen.shape[1]] = chosen
        source, column = np.nonzero(chosen >= 0)
        self._back(chosen[source, column], nodes[source], at)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
        """For each row up to ``keep`` candidates, each nearer to the row's node than to a chosen one; then the nearest others."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        n, c = ids.shape
        vec = self.x[ids]
        out, count = np.full((n, keep), -1, np.int32), np.zeros(n, np.int64)
        chosen = np.zeros((n, c), bool)
        between = np.matmul(vec, vec.transpose(0, 2, 1))
        for j in range(c):
            nearer = np.where(chosen, between[:, j], -np.inf).max(axis=1)
            good = (ids[:, j] >= 0) & (nearer < sims[:, j]) & (count < keep)
            out[good, count[good]] = ids[good, j]
            chosen[good, j] = True
            count += good
        for j in range(c):
            good = (ids[:, j] >= 0) & ~chosen[:, j] & (count < keep)
            out[good, count[good]] = ids[good, j]
            count += good
        return out

    def _back(self, targets: np.ndarray, sources: np.ndarray, at: int) -> None:
        """Adds links targets -> sources; of more than fit a node keeps diverse ones among its old links and the nearest new ones."""
        near = self.near[at]
        width = near.shape[1]
        sims = np.einsum("kd,kd->k", self.x[targets], self.x[sources])
        order = np.lexsort((-sims, targets))
        targets, sources, sims = targets[order], sources[order], sims[order]
        heads, begin, count = np.unique(targets, return_index=True, return_counts=True)
        place = np.arange(len(targets)) - np.repeat(begin, count)
        some = place < width
        row = np.repeat(np.arange(len(heads)), count)[some]
        new = np.full((len(heads), width), -1, np.int64)
        new[row, place[some]] = sources[some]
        for a in range(0, len(heads), 1024):
            part = slice(a, a + 1024)
            both = np.concatenate([near[heads[part]], new[part]], axis=1)
            # left-justified if they fit, chosen anew if not
            filled = (both >= 0).sum(axis=1)
            order = np.argsort(both < 0, axis=1, kind="stable")
            rows = np.take_along_axis(both, order, 1)[:, :width]
            over = np.flatnonzero(filled > width)
            if len(over):
                ids = both[over]
                score = np.where(ids >= 0, np.einsum("hcd,hd->hc", self.x[ids], self.x[heads[part][over]]), -np.inf)
                kept = self._diverse(ids, score, width)
                rows[over] = -1
                rows[over, : kept.shape[1]] = kept
            near[heads[part]] = rows

    def beam(self, queries: np.ndarray, entry: np.ndarray, at: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the best ``width`` nodes found on a level, nearest first, -1 where there are fewer."""
        q, n, near = len(queries), len(self.x), self.near[at]
        width = min(width, n)
        ids = np.full((q, width), -1, np.int64)
        sims = np.full((q, width), -np.inf, np.float32)
        seen = np.zeros((q, n), bool)
        rows = np.arange(q)
        first = min(entry.shape[1], width)
        ids[:, :first] = entry[:, :first]
        sims[:, :first] = np.where(ids[:, :first] >= 0, np.einsum("qd,qkd->qk", queries, self.x[ids[:, :first]]), -np.inf)
        seen[rows[:, None], np.maximum(ids[:, :first], 0)] = True
        open_ = ids >= 0
        live = rows
        while len(live):
            best = np.where(open_[live], sims[live], -np.inf).argmax(axis=1)
            going = open_[live, best]
            live, best = live[going], best[going]
            if not len(live):
                break
            open_[live, best] = False
            next_ = near[ids[live, best]]
            fresh = (next_ >= 0) & ~seen[live[:, None], np.maximum(next_, 0)]
            some = fresh.any(axis=1)
            at_rows, next_, fresh = live[some], next_[some], fresh[some]
            if not len(at_rows):
                continue
            r, c = np.nonzero(fresh)
            seen[at_rows[r], next_[r, c]] = True
            new = np.full(next_.shape, -np.inf, np.float32)
            new[r, c] = np.einsum("kd,kd->k", queries[at_rows[r]], self.x[next_[r, c]])
            all_sims = np.concatenate([sims[at_rows], new], axis=1)
            all_ids = np.concatenate([ids[at_rows], np.where(fresh, next_, -1)], axis=1)
            all_open = np.concatenate([open_[at_rows], fresh], axis=1)
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
            sims[at_rows] = np.take_along_axis(all_sims, top, 1)
            ids[at_rows] = np.take_along_axis(all_ids, top, 1)
            open_[at_rows] = np.take_along_axis(all_open, top, 1) & (ids[at_rows] >= 0)
        return ids, sims

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        ids, sims = [], []
        for a in range(0, len(queries), 256):
            some = queries[a : a + 256]
            entry = np.full((len(some), 1), self.entry)
            for at in range(len(self.near) - 1, 0, -1):
                entry = self.beam(some, entry, at, 4)[0]
            found = self.beam(some, entry, 0, width)
            ids.append(found[0])
            sims.append(found[1])
        return np.concatenate(ids), np.concatenate(sims)

    def flood(self, query: np.ndarray, start: np.ndarray, least: float, slack: float = 0.08) -> np.ndarray:
        """All nodes of at least this similarity that links from ``start`` reach over nodes not much farther."""
        seen = np.zeros(len(self.x), bool)
        seen[start] = True
        found, front = [start], start
        while len(front):
            next_ = self.near[0][front].ravel()
            next_ = np.unique(next_[next_ >= 0])
            next_ = next_[~seen[next_]]
            seen[next_] = True
            sims = self.x[next_] @ query
            found.append(next_[sims >= least])
            front = next_[sims >= least - slack]
        return np.concatenate(found)

    def strays(self) -> np.ndarray:
        """Nodes that no path of ground links from the entry reaches."""
        seen = np.zeros(len(self.x), bool)
        seen[self.entry] = True
        front = np.array([self.entry])
        while len(front):
            next_ = np.unique(self.near[0][front])
            front = next_[(next_ >= 0) & ~seen[next_]]
            seen[front] = True
        return np.flatnonzero(~seen)

    def exact(self, queries: np.ndarray, nodes: np.ndarray, least: float) -> list[np.ndarray]:
        """Those of ``nodes`` of at least this similarity for each query, by blocked matrix products."""
        out, x = [], self.x[nodes]
        for a in range(0, len(queries), 512):
            out += [nodes[row >= least] for row in queries[a : a + 512] @ x.T]
        return out

    def within(self, queries: np.ndarray, own: np.ndarray, least: float) -> list[np.ndarray]:
        """Nodes of at least this similarity for each query, without the query's ``own`` node (-1 where it is not in the shard).

        A beam that finds any is widened by flooding the links from those.
        Nodes that the entry does not reach are compared with every query.
        Beams are doubled until every audited query has its links; where a beam
        would read as many vectors as the shard holds, the block is compared
        with the whole shard.
        """
        n, width, p = len(self.x), self.p.beam, self.p
        every, strays, floor = np.arange(n), self.strays(), least - SLACK
        outside = self.exact(queries, strays, floor)
        while width * self.near[0].shape[1] < n:
            ids, sims = self.search(queries, width)
            sims = np.where((ids < 0) | (ids == own[:, None]), -np.inf, sims)
            found = []
            for k in range(len(queries)):
                close = np.union1d(ids[k][sims[k] >= floor], outside[k])
                close = close[close != own[k]]
                found.append(np.unique(self.flood(queries[k], close, floor)) if len(close) else close)
            audit = self._audited(np.array([len(f) for f in found]), sims.max(axis=1))
            truth = self.exact(queries[audit], every, least - SLACK / 10)
            if all(len(np.intersect1d(t, found[i])) >= p.recall * len(t) for t, i in ((t[t != own[i]], i) for t, i in zip(truth, audit.tolist(), strict=True))):
                return [f[f != own[k]] for k, f in enumerate(found)]
            width *= 2
        return [f[f != own[k]] for k, f in enumerate(self.exact(queries, every, floor))]

    def _audited(self, links: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Queries to audit, more where there are more links: half spread over all, half over those that have links or come nearest to one."""
        q = len(links)
        size = min(q, self.p.audit + int(links.sum()) // self.p.audit)
        likely = np.argsort(-best, kind="stable")[: max(size, np.count_nonzero(links))]
        spread = lambda m: np.linspace(0, m - 1, size - size // 2 if size < q else q).astype(int)
        return np.union1d(spread(q), likely[spread(len(likely))])

    def pack(self) -> list[bytes]:
        return [self.x.tobytes(), np.int64(self.entry).tobytes(), *(a.tobytes() for a in self.near)]

    @classmethod
    def unpack(cls, parts: list[bytes], n: int, p: Params) -> Graph:
        own = cls.__new__(cls)
        own.p = p
        own.x = np.frombuffer(parts[0], np.float32).reshape(n, -1)
        own.entry = int(np.frombuffer(parts[1], np.int64)[0])
        own.near = [np.frombuffer(a, np.int32).reshape(n, -1) for a in parts[2:]]
        return own


def usable(vector: Column) -> Column:
    """Whether a vector is not null, holds only finite numbers and is not all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_duplicate_vectors(table: DataFrame, least: float = 0.93, params: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links of cosine ``least`` or more between vectors of equal, non-null label.

    Returns ``id, n_links long, component_id long, kept boolean``, one row per
    input row.  Null or zero vectors, vectors with null or non-finite
    components, null labels and null ids link with nothing (component_id is the
    own id; a null id stays null and is kept).  Vectors of another length than
    most never meet: lengths are compared apart.  Equal vectors of a label count
    as links of one another without being searched.  Of rows that
    repeat an id, the one of the smallest label and vector counts.  Other columns are not read.
    """
    p = params
    rows = table.select(table[id_col].cast("bigint").alias("id"), table[vector_col].cast("array<double>").alias("vector"), table[label_col].cast("string").alias("label"))
    base = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    # of rows that repeat an id, the one of the smallest label and vector counts
    base = base.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x")).select("id", "x.*")
    base = materialize(base.withColumn("label", F.concat_ws(":", F.size("vector"), "label")), "vectors")
    same = base.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    same = materialize(same, "distinct-vectors")
    counts = same.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / p.shard_rows).cast("int").alias("shards"), F.ceil(F.count(F.lit(1)) / p.query_rows).cast("int").alias("blocks"))
    own = materialize(
        same.join(counts, "label").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")), "dealt"
    )

    def build(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by("id")
        graph = Graph(_unit(_matrix(shard.column("vector"))), p).build()
        return pa.table({"label": shard.column("label")[:1], "shard": shard.column("shard")[:1], "blocks": shard.column("blocks")[:1], "ids": pa.array([shard.column("id").to_pylist()], pa.list_(pa.int64())), "parts": pa.array([graph.pack()], pa.list_(pa.binary()))})

    graphs = materialize(own.select("label", "shard", "blocks", "id", "vector").groupBy("label", "shard").applyInArrow(build, "label string, shard int, blocks int, ids array<bigint>, parts array<binary>"), "graphs")
    asked = own.select("label", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block", "id", "vector")
    offered = graphs.select("label", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "ids", "parts")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if left.num_rows and right.num_rows:
            ids = np.array(right.column("ids")[0].as_py(), np.int64)
            graph = Graph.unpack(right.column("parts")[0].as_py(), len(ids), p)
            asking, x = left.column("id").to_numpy(), _unit(_matrix(left.column("vector")))
            at = np.minimum(np.searchsorted(ids, asking), len(ids) - 1)
            for i, found in enumerate(graph.within(x.astype(np.float32), np.where(ids[at] == asking, at, -1), least)):
                other = ids[found]
                a.append(np.full(len(other), asking[i]))
                b.append(other)
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        return pa.table({"a": np.minimum(a, b).astype(np.int64), "b": np.maximum(a, b).astype(np.int64)})

    pairs = asked.groupBy("label", "shard", "block").cogroup(offered.groupBy("label", "shard", "block")).applyInArrow(search, "a bigint, b bigint").distinct()
    one, two = (same.select(F.col("id").alias(c), F.col("vector").alias(f"v_{c}"), F.col("copies").alias(f"copies_{c}")) for c in "ab")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda t, v: t + v)
    cosine = dot("v_a", "v_b") / (F.sqrt(dot("v_a", "v_a")) * F.sqrt(dot("v_b", "v_b")))
    links = materialize(pairs.join(one, "a").join(two, "b").where(cosine >= least).select("a", "b", "copies_a", "copies_b"), "vector-links")
    components = connected_components(links)
    reached = links.select(F.col("a").alias("id"), F.col("copies_b").alias("n")).unionByName(links.select(F.col("b").alias("id"), F.col("copies_a").alias("n"))).groupBy("id").agg(F.sum("n").alias("reached"))
    classes = same.join(reached, "id", "left").join(components, "id", "left").select("label", "vector", (F.col("copies") - 1 + F.coalesce("reached", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    placed = base.join(classes, ["label", "vector"]).select("id", "n_links", "component_id")
    out = rows.select("id").join(placed, "id", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))

