"""Whole-graph algorithms as iterated joins and aggregations."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.storage import discard, materialize

#: Edges of a node that a row of PageRank's table holds.
LISTED = 1000
#: Of betweenness: edges of a node beyond which its lists are added up in parts first, and numbers that a task adds up at once.
HUB, CELLS = 20_000, 1_000_000
#: Of Louvain: edge ends of a block of nodes at most, of a pair of blocks in a small graph, bits of a node's place in its block, and rounds after which the same halves move again.
BLOCK, PAIR, PLACES, TURNS = 1_000_000, 20_000, 33, 62
MASK = (1 << PLACES) - 1
#: Edges of Louvain from ``block`` to the block ``to``.
PACKED = "block int, part int, to int, a binary, b binary, w binary, turns binary"
#: What nodes of a block are told of the communities of their neighbours.
SENT = "block int, part int, a binary, c binary, total binary, w binary"


def pagerank(nodes: DataFrame, edges: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """``id, rank`` summing to 1; rank of nodes without out-edges is shared by all.

    What all nodes get alike is a number, so the rank is a sum of walks: ``w0``
    is 1 for every node, each later table is the one before passed on along the
    edges, one join and one sum a round, and the factors of the tables follow
    on the driver from one number a round.  What nodes without out-edges hold
    goes to the row without id.
    """
    n = nodes.count()
    ids = nodes.select("id")
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    own = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")).join(degree, "src").select(F.col("src").alias("id"), "dst", (F.col("m") / F.col("degree")).alias("share"), "degree")
    own = own.join(ids, "id", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
    ends = ids.join(degree.select(F.col("src").alias("id")), "id", "left_anti").select("id", F.array(F.struct(F.lit(None).cast(dict(edges.dtypes)["dst"]).alias("dst"), F.lit(1.0).alias("share"))).alias("to"))
    # edges of a node lie in few rows, so that a round moves few; a hub has many rows
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("degree") / LISTED))
    own = own.groupBy("id", part.alias("part")).agg(F.collect_list(F.struct("dst", "share")).alias("to")).select("id", "to")
    steps = materialize(own.unionByName(ends), "steps")
    passed = []
    for at in range(rounds):
        given = steps.withColumn("w", F.lit(1.0)) if at == 0 else steps.join(passed[-1].where("id IS NOT NULL"), "id")
        given = given.select("w", F.explode("to").alias("to"))
        passed.append(materialize(given.groupBy(F.col("to.dst").alias("id")).agg(F.sum(F.col("w") * F.col("to.share")).alias("w")), f"walks{at}"))
    if not passed:
        return ids.select("id", F.lit(1.0 / max(n, 1)).alias("rank"))
    numbered = reduce(DataFrame.unionByName, [w.withColumn("at", F.lit(at)) for at, w in enumerate(passed)])
    held = {r["at"]: r["w"] for r in numbered.where("id IS NULL").collect()}
    factors = [1.0 / max(n, 1)]
    for _ in range(rounds):
        lost = sum(f * held.get(at, 0.0) for at, f in enumerate(factors))
        factors = [(1 - damping + damping * lost) / max(n, 1), *(damping * f for f in factors)]
    factor = F.element_at(F.array(*[F.lit(f) for f in factors[1:]]), F.col("at") + 1)
    got = numbered.where("id IS NOT NULL").groupBy("id").agg(F.sum(F.col("w") * factor).alias("got"))
    return ids.join(got, "id", "left").select("id", (F.lit(factors[0]) + F.coalesce("got", F.lit(0.0))).alias("rank"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct pairs ``a < b``."""
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).where("a < b").distinct()


def triangle_count(edges: DataFrame) -> DataFrame:
    """``triangles`` of the undirected simple graph; edges point to the end of higher degree, so hubs stay cheap."""
    pairs = materialize(undirected(edges), "pairs")
    degree = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    both = pairs.join(degree.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    up = (F.col("da") < F.col("db")) | (F.col("da") == F.col("db")) & (F.col("a") < F.col("b"))
    arcs = materialize(both.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y")), "arcs")
    wedge = arcs.alias("l").join(arcs.alias("r"), F.col("l.x") == F.col("r.x")).where("l.y < r.y").select(F.col("l.y").alias("a"), F.col("r.y").alias("b"))
    return wedge.join(pairs, ["a", "b"]).agg(F.count(F.lit(1)).alias("triangles"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable, directions ignored) by alternating large-star and small-star contraction."""
    now = materialize(undirected(edges), "links")
    while not _is_forest_of_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialize(both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct(), "large")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        then = materialize(joined.select(F.col("m").alias("a"), "b").unionByName(joined.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct(), "small")
        discard(large)
        discard(now)
        now = then
    roots = now.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Whether every node is a root or has one root and nothing below it."""
    ends = links.select(F.col("b").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("a").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 20) -> DataFrame:
    """``id, community``: in each round every node takes its neighbours' most frequent label, ties to the lowest."""
    pairs = undirected(edges)
    steps = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "steps")
    label = nodes.select("id", F.col("id").alias("community"))
    for at in range(rounds):
        votes = label.join(steps, F.col("id") == F.col("a")).groupBy(F.col("b").alias("id"), "community").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("best")).select("id", F.col("best.community").alias("new"))
        next_ = materialize(label.join(best, "id", "left").select("id", F.coalesce("new", "community").alias("community"), F.coalesce(F.col("new") != F.col("community"), F.lit(False)).alias("changed")), f"labels{at}")
        moved = not next_.where("changed").isEmpty()
        label = next_.select("id", "community")
        if not moved:
            break
    return label


def betweenness(nodes: DataFrame, edges: DataFrame, sources: int = 50, blocks: int | None = None) -> DataFrame:
    """``id, betweenness`` from the ``sources`` nodes of smallest hash, by level-wise joins for all sources at once (Brandes).

    Paths are counted forward level by level, dependencies are summed backward.
    A node's numbers for all sources of a level are one row of two lists, so an
    edge moves one row a level; lists are added up where the node's rows meet,
    a batch at a time.  No graph is held in one task.
    """
    steps = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "steps")
    hubs = any(not steps.groupBy(end).count().where(F.col("count") > HUB).isEmpty() for end in ("src", "dst"))
    number = F.row_number().over(Window.orderBy(F.xxhash64("id"), "id")) - 1
    seeds = nodes.select("id").orderBy(F.xxhash64("id"), "id").limit(sources).select("id", number.alias("source"))
    layers = [materialize(seeds.groupBy("id").agg(F.collect_list("source").alias("sources"), F.array_repeat(F.lit(1.0), F.count("source").cast("int")).alias("xs")), "sources")]
    while True:
        given = layers[-1].join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "sources", "xs", F.col("src").alias("by"))
        level = materialize(_met(given, reduce(DataFrame.unionByName, layers), sources, hubs, _reached).select("id", "sources", "xs"), f"layer{len(layers)}")
        if level.isEmpty():
            break
        layers.append(level)
    later = layers[-1].select("id", "sources", F.transform("xs", lambda p: 1 / p).alias("xs"))
    total = []
    # what the sources themselves would get does not count
    for layer in reversed(layers[1:-1]):
        given = later.join(steps, F.col("id") == F.col("dst")).select(F.col("src").alias("id"), "sources", "xs", F.col("dst").alias("by"))
        later = materialize(_met(given, layer, sources, hubs, _credited), "credit")
        total.append(later.select("id", "credit"))
    if not total:
        return nodes.select("id", F.lit(0.0).alias("betweenness"))
    return nodes.select("id").join(reduce(DataFrame.unionByName, total).groupBy("id").agg(F.sum("credit").alias("b")), "id", "left").select("id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def _reached(got: np.ndarray, sent: np.ndarray, own: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paths of the sources that come to a node for the first time."""
    return sent & ~has, got, np.zeros(len(got))


def _credited(got: np.ndarray, sent: np.ndarray, own: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a path through the nodes of a level is worth, and what the nodes get."""
    credit = np.where(has, own * got, 0.0)
    return has, (1 + credit) / np.where(has, own, 1.0), credit.sum(axis=1)


def _met(given: DataFrame, own: DataFrame, width: int, hubs: bool, fn: Callable) -> DataFrame:
    """``id, sources, xs, credit`` by ``fn`` of the sums of ``given(id, sources, xs, by)`` and of ``own(id, sources, xs)``, each with a mark for what is there."""
    if hubs:  # a node's rows are added up in parts first
        given = _summed(given.withColumn("own", F.lit(False)).repartition("id", F.pmod(F.xxhash64("by"), F.lit(64))), width, lambda got, sent, own, has: (sent, got, np.zeros(len(got))))
    both = given.select("id", "sources", "xs", F.lit(False).alias("own")).unionByName(own.select("id", "sources", "xs", F.lit(True).alias("own")))
    return _summed(both.repartition("id"), width, fn)


def _summed(rows: DataFrame, width: int, fn: Callable) -> DataFrame:
    """``fn`` of the rows of each id of a partition, added up in order of the ids; lists without entries are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None

        def row(ids, sums: np.ndarray, there: np.ndarray) -> pa.RecordBatch:
            mask, xs, credit = fn(sums[:, 0], there[:, 0], sums[:, 1], there[:, 1])
            some = mask.any(axis=1)
            mask, ends = mask[some], np.concatenate([[0], np.cumsum(mask[some].sum(axis=1))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (np.nonzero(mask)[1].astype(np.int32), xs[some][mask])]
            return pa.RecordBatch.from_arrays([ids.filter(pa.array(some)), *lists, pa.array(credit[some])], names=["id", "sources", "xs", "credit"])

        for batch in batches:
            for at in range(0, len(batch), most := max(CELLS // width, 1)):
                ids, of, xs, own = (batch.column(k).slice(at, most) for k in range(4))
                plain = ids.to_numpy(zero_copy_only=False)
                fresh = np.concatenate([[True], plain[1:] != plain[:-1]])
                code, n = np.cumsum(fresh) - 1, int(fresh.sum())
                cell = np.repeat(2 * code + own.to_numpy(zero_copy_only=False), of.value_lengths().to_numpy()) * width + of.flatten().to_numpy()
                sums = np.bincount(cell, xs.flatten().to_numpy(), 2 * n * width).reshape(n, 2, width)
                there = (np.bincount(cell, minlength=2 * n * width) > 0).reshape(n, 2, width)
                ids = ids.filter(pa.array(fresh))
                if last is not None and last[0] == ids[0]:
                    sums[0] += left[0]
                    there[0] |= left[1]
                elif last is not None:
                    yield row(last, left[0][None], left[1][None])
                if n > 1:
                    yield row(ids[:-1], sums[:-1], there[:-1])
                last, left = ids[-1:], (sums[-1], there[-1])
        if last is not None:
            yield row(last, left[0][None], left[1][None])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.where("id IS NOT NULL").select("id", "sources", "xs", "own").sortWithinPartitions("id").mapInArrow(run, f"id {kind}, sources array<int>, xs array<double>, credit double")


def louvain(nodes: DataFrame, edges: DataFrame, rounds: int = 10, passes: int = 3) -> DataFrame:
    """``id, community`` by synchronous modularity moves on the weighted undirected graph, then contraction, a few passes.

    Half of the nodes (by a hash that changes each round) may move in a round,
    which keeps neighbours from swapping for ever.  Nodes are numbered in order
    of their ids, in blocks; the edges between two blocks are one row.  In a
    round a block tells the communities of its nodes along its edges to those
    that may move, and a block picks the best of what it was told: an edge is
    moved once, in a packed row.  A block of many edges is worked on in parts.
    Communities keep the number of a node, so a contraction only renames ends.
    Tables of nodes are joined where they lie, none goes through the driver.
    """
    pairs = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    pairs = materialize(pairs.where("a IS NOT NULL"), "weighted")
    ends = 2 * pairs.count()
    blocks = max(1, -(-ends // BLOCK), math.isqrt(ends // PAIR))
    strength = pairs.select(F.explode(F.array("a", "b")).alias("v"), "w").groupBy("v").agg(F.sum("w").alias("k"))
    names = materialize(strength.repartitionByRange(blocks, "v").sortWithinPartitions("v").select(F.monotonically_increasing_id().alias("n"), "v", "k"), "names")
    m2 = names.agg(F.sum("k")).first()[0] or 1.0
    x, y = (names.select(F.col("v").alias(end), F.col("n").alias(n)).hint("merge") for end, n in (("a", "x"), ("b", "y")))
    both = F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    links = materialize(pairs.where("a <> b").join(x, "a").join(y, "b").select(both.alias("e"), "w").select("e.x", "e.y", "w"), "links")
    place = nodes.select("id").join(names.select(F.col("v").alias("id"), F.col("n").alias("c")).hint("merge"), "id", "left")
    label = names.select("n", "k", F.col("n").alias("c"))
    kind = np.min_scalar_type((1 << min(rounds, TURNS)) - 1).name
    for level in range(passes):
        parts = {r["block"]: -(-r["count"] // (2 * BLOCK)) for r in links.groupBy(_block("x").alias("block")).count().where(F.col("count") > 2 * BLOCK).collect()}
        # bit at: whether a node may move in that round
        turns = reduce(Column.bitwiseOR, [F.shiftleft((F.pmod(F.xxhash64("v", F.lit(level * 100 + at)), F.lit(2)) == 0).cast("long"), at) for at in range(min(rounds, TURNS))], F.lit(0).cast("long"))
        given = links.select(_block("x").alias("block"), _part("x", "y", parts).alias("part"), "x", "y", "w")
        steps = materialize(_beside(given, _in_parts(names.select("n", turns.alias("turns")), parts), blocks, partial(_packed, parts=parts, kind=kind), PACKED), "steps")
        discard(links)
        for at in range(rounds):
            own = _in_parts(_with_total(label), parts)
            told = _beside(steps, own, blocks, partial(_sent, parts=parts, kind=kind, at=at % TURNS), SENT)
            best = _beside(told, own, blocks, partial(_best, m2=m2), "n long, k double, old long, g double, c long, stay double")
            if parts:
                best = best.groupBy("n").agg(F.first("k").alias("k"), F.first("old").alias("old"), F.min(F.struct((-F.col("g")).alias("g"), "c")).alias("best"), F.max("stay").alias("stay")).select("n", "k", "old", (-F.col("best.g")).alias("g"), "best.c", "stay")
            better = F.col("g") > F.coalesce("stay", F.lit(0.0)) + 1e-9
            new = materialize(best.select("n", "k", F.when(better, F.col("c")).otherwise(F.col("old")).alias("c")), f"label{at}")
            discard(label)
            label = new
        place = materialize(place.join(label.select(F.col("n").alias("c"), F.col("c").alias("to")).hint("merge"), "c", "left").select("id", F.col("to").alias("c")), "place")
        if level + 1 < passes:
            own = _in_parts(_with_total(label), parts)
            told = _beside(steps, own, blocks, partial(_sent, parts=parts, kind=kind, at=None), SENT)
            links = materialize(_beside(told, own, blocks, _renamed, "x long, y long, w double"), "links")
            merged = materialize(label.groupBy("c").agg(F.sum("k").alias("k")).select(F.col("c").alias("n"), "k", "c"), "label")
            discard(label)
            label = merged
        discard(steps)
    named = place.join(names.select(F.col("n").alias("c"), "v").hint("merge"), "c", "left")
    return materialize(named.select("id", F.coalesce("v", "id").alias("community")), "place")


def _block(n: str) -> Column:
    return F.shiftright(n, PLACES).cast("int")


def _part(n: str, other: str, parts: dict[int, int]) -> Column:
    """The part of ``n``'s block that has the edges to ``other``'s block."""
    return F.pmod(_block(other), _parts_of(n, parts))


def _parts_of(n: str, parts: dict[int, int]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for item in parts.items() for x in item])[_block(n)], F.lit(1)) if parts else F.lit(1)


def _in_parts(rows: DataFrame, parts: dict[int, int]) -> DataFrame:
    """Rows of nodes ``n``, once for each part of their block."""
    part = F.explode(F.sequence(F.lit(0), _parts_of("n", parts) - 1)) if parts else F.lit(0)
    return rows.select(_block("n").alias("block"), part.alias("part"), "*")


def _with_total(label: DataFrame) -> DataFrame:
    """``n, k, c`` and the strength of the whole community."""
    return label.join(label.groupBy("c").agg(F.sum("k").alias("total")).hint("merge"), "c").select("n", "k", "c", "total")


def _beside(given: DataFrame, own: DataFrame, blocks: int, fn: Callable, schema: str) -> DataFrame:
    """``fn`` of what is given to a part of a block and of the block's nodes."""
    given, own = (rows.repartition(blocks, "block", "part").groupBy("block", "part") for rows in (given, own))
    return given.cogroup(own).applyInArrow(fn, schema)


def _numbers(table: pa.Table, *columns: str) -> list[np.ndarray]:
    return [table[c].to_numpy() for c in columns]


def _unpacked(table: pa.Table, **columns: type | str) -> list[np.ndarray]:
    return [np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[c]] or [np.zeros(0, kind)]) for c, kind in columns.items()]


def _by_place(n: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Columns of a block's nodes, to be looked up by place in the block."""
    at = n & MASK
    out = [np.zeros(at.max(initial=-1) + 1, x.dtype) for x in columns]
    for to, x in zip(out, columns, strict=True):
        to[at] = x
    return out


def _grouped(a: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by ``a``, then by number ``c``, and where a new pair begins."""
    code = (c >> PLACES) * ((c & MASK).max(initial=0) + 1) + (c & MASK)
    key = a.astype(np.int64) * (code.max(initial=0) + 1) + code
    order = np.argsort(key)
    key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])


def _table(schema: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema.values(), strict=True)], names=list(schema))


def _packed(links: pa.Table, own: pa.Table, parts: dict[int, int], kind: str) -> pa.Table:
    """Edges into a block, one row for each block that they come from."""
    x, y, w = _numbers(links, "x", "y", "w")
    (turns,) = _by_place(*_numbers(own, "n", "turns"))
    turns = turns.astype(kind)
    order, fresh = _grouped(x & MASK, y)
    if len(order):
        x, y, w = x[order][fresh], y[order][fresh], np.add.reduceat(w[order], fresh)
    by, rows = y >> PLACES, []
    order = np.argsort(by, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(by[order])) + 1) if len(order) else []:
        block, to, a = int(by[at[0]]), int(x[0] >> PLACES), x[at] & MASK
        rows.append((block, to % parts.get(block, 1), to, a.astype(np.int32).tobytes(), (y[at] & MASK).astype(np.int32).tobytes(), w[at].tobytes(), turns[a].tobytes()))
    return _table({"block": pa.int32(), "part": pa.int32(), "to": pa.int32(), "a": pa.binary(), "b": pa.binary(), "w": pa.binary(), "turns": pa.binary()}, rows)


def _sent(steps: pa.Table, own: pa.Table, parts: dict[int, int], kind: str, at: int | None) -> pa.Table:
    """The community of an edge's other end and its strength, packed for the blocks of those that may move in round ``at`` (None: of all)."""
    c, total = _by_place(*_numbers(own, "n", "c", "total"))
    rows = []
    for k in range(len(steps)):
        row = steps.slice(k, 1)
        to = row["to"][0].as_py()
        a, b, w, turns = _unpacked(row, a=np.int32, b=np.int32, w=np.float64, turns=kind)
        if at is not None:
            may = np.flatnonzero(turns & turns.dtype.type(1 << at))
            a, b, w = a[may], b[may], w[may]
        part = (c[b] >> PLACES) % parts.get(to, 1)
        for p in range(parts.get(to, 1)):
            some = part == p if to in parts else slice(None)
            if len(a[some]):
                rows.append((to, p, a[some].tobytes(), c[b[some]].tobytes(), total[b[some]].tobytes(), w[some].tobytes()))
    return _table({"block": pa.int32(), "part": pa.int32(), "a": pa.binary(), "c": pa.binary(), "total": pa.binary(), "w": pa.binary()}, rows)


def _best(told: pa.Table, own: pa.Table, m2: float) -> pa.Table:
    """Of each node of a block the community of largest gain (ties to the first) and the gain of staying."""
    n, k, old = _numbers(own, "n", "k", "c")
    strength, now = _by_place(n, k, old)
    a, c, total, w = _unpacked(told, a=np.int32, c=np.int64, total=np.float64, w=np.float64)
    g, to, stay = np.full(len(now), -np.inf), now.copy(), np.full(len(now), np.nan)
    if len(a):
        order, fresh = _grouped(a, c)
        into, first = np.add.reduceat(w[order], fresh), order[fresh]
        a, c, total = a[first], c[first], total[first]
        gain = into - strength[a] * (total - np.where(c == now[a], strength[a], 0.0)) / m2
        stay[a[c == now[a]]] = gain[c == now[a]]
        gain = np.round(gain, 9)
        starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        most = np.maximum.reduceat(gain, starts)
        top = gain == np.repeat(most, np.diff(np.append(starts, len(a))))
        pick = np.minimum.reduceat(np.where(top, np.arange(len(a)), len(a)), starts)
        g[a[pick]], to[a[pick]] = most, c[pick]
    at = n & MASK
    return pa.table({"n": n, "k": k, "old": old, "g": g[at], "c": to[at], "stay": pa.array(stay[at], from_pandas=True)})


def _renamed(told: pa.Table, own: pa.Table) -> pa.Table:
    """Edges between the communities of their ends, added up."""
    (now,) = _by_place(*_numbers(own, "n", "c"))
    a, y, w = _unpacked(told, a=np.int32, c=np.int64, w=np.float64)
    x = now[a]
    a, x, y, w = (z[x != y] for z in (a, x, y, w))
    if len(x):
        code = np.unique(x, return_inverse=True)
        order, fresh = _grouped(code[1], y)
        x, y, w = x[order][fresh], y[order][fresh], np.add.reduceat(w[order], fresh)
    return pa.table({"x": x, "y": y, "w": w})


def modularity(place: DataFrame, edges: DataFrame) -> float:
    """Of communities ``place(id, community)`` on the undirected multigraph."""
    m = edges.count()
    ends = edges.join(place.select(F.col("id").alias("src"), F.col("community").alias("x")), "src").join(place.select(F.col("id").alias("dst"), F.col("community").alias("y")), "dst")
    inside = ends.where("x = y").count()
    degree = ends.select(F.col("x").alias("c")).unionAll(ends.select(F.col("y").alias("c"))).groupBy("c").agg(F.count(F.lit(1)).alias("d"))
    return inside / m - degree.agg(F.sum((F.col("d") / (2 * m)) ** 2)).first()[0]
