"""Vector code compression by filtering Lloyd rounds (operator 11).

Vectors become whole numbers and are cut into equal parts; each part position
has a codebook.  Every partition builds kd-trees over the parts of its vectors
once and stores them: the parts in tree order with the boxes, sums and counts of
the leaves.  A round walks each tree from its root with the entries that may
still be nearest; an entry that is farther than another everywhere in a node's
box leaves the list, and a node with one entry left gives it its sum and count
as a whole.  Only the entries' sums and counts reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textbytes
from tessera.llm.storage import materialize

#: Scaled components are held within this bound, so that distances stay whole 64-bit numbers.
BOUND = 1 << 27
#: Labels whose error sums are sent to every task; with more of them the sums are joined by a shuffle.
SENT_LABELS = 100_000


@dataclass(frozen=True)
class Params:
    """tree_rows: vectors of one set of trees, which bounds a task's memory; leaf: parts of a leaf at most."""

    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256
    tree_rows: int = 8192
    leaf: int = 16


def _depth(n: int, leaf: int) -> int:
    return max(0, (-(-n // leaf) - 1).bit_length())


def _bounds(n: int, depth: int) -> list[np.ndarray]:
    """Ends of the nodes of each level: every node is halved."""
    levels = [np.array([0, n])]
    for _ in range(depth):
        old = levels[-1]
        new = np.empty(2 * len(old) - 1, old.dtype)
        new[::2] = old
        new[1::2] = (old[:-1] + old[1:]) // 2
        levels.append(new)
    return levels


def tree_order(points: np.ndarray, leaf: int) -> np.ndarray:
    """The points' order in a kd-tree: nodes are halved along the widest side of their box."""
    n = len(points)
    order = np.arange(n)
    for bounds in _bounds(n, _depth(n, leaf))[:-1]:
        inside = points[order]
        starts = bounds[:-1]
        wide = (np.maximum.reduceat(inside, starts) - np.minimum.reduceat(inside, starts)).argmax(axis=1)
        node = np.repeat(np.arange(len(starts)), np.diff(bounds))
        order = order[np.lexsort((inside[np.arange(n), wide[node]], node))]
    return order


@dataclass
class Tree:
    """Parts in tree order with the boxes and sums of the leaves; those of the levels above are merged from pairs."""

    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    leaf: int

    @classmethod
    def over(cls, points: np.ndarray, leaf: int) -> Tree:
        starts = _bounds(len(points), _depth(len(points), leaf))[-1][:-1]
        return cls(points, np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts), np.add.reduceat(points.astype(np.int64), starts), leaf)

    def levels(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(ends, low, high, sums) of every level from the root."""
        low, high, sums, out = self.low, self.high, self.sums, []
        for bounds in reversed(_bounds(len(self.points), _depth(len(self.points), self.leaf))):
            out.append((bounds, low.astype(np.int64), high.astype(np.int64), sums))
            if len(low) > 1:
                low, high, sums = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), sums[::2] + sums[1::2]
        return out[::-1]

    def filter(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nearest entry of every point, sums and counts of the entries' points); ties go to the lower entry."""
        k, d = entries.shape
        nearest = np.zeros(len(self.points), np.int64)
        total, count = np.zeros((k, d), np.int64), np.zeros(k, np.int64)
        levels = self.levels()
        nodes, may = np.zeros(1, np.int64), np.ones((1, k), bool)
        index = np.arange(k)
        for at, (bounds, low, high, sums) in enumerate(levels):
            lo, hi = low[nodes], high[nodes]
            middle = ((lo + hi)[:, None, :] - 2 * entries[None]) ** 2
            best = np.where(may, middle.sum(axis=2), np.iinfo(np.int64).max).argmin(axis=1)
            star = entries[best]
            # where an entry gains most on the best one: a corner of the box
            corner = np.where(entries[None] > star[:, None, :], hi[:, None, :], lo[:, None, :])
            lead = ((entries[None] - corner) ** 2).sum(axis=2) - ((star[:, None, :] - corner) ** 2).sum(axis=2)
            may &= (lead < 0) | ((lead == 0) & (index[None] <= best[:, None]))
            whole = may.sum(axis=1) == 1
            if whole.any():
                which, entry = nodes[whole], best[whole]
                np.add.at(total, entry, sums[which])
                sizes = bounds[which + 1] - bounds[which]
                np.add.at(count, entry, sizes)
                nearest[textbytes.ragged(bounds[which], sizes)] = np.repeat(entry, sizes)
            nodes, may = nodes[~whole], may[~whole]
            if at < len(levels) - 1:
                nodes, may = np.stack([2 * nodes, 2 * nodes + 1], axis=1).ravel(), np.repeat(may, 2, axis=0)
        if len(nodes):
            bounds = levels[-1][0]
            sizes = bounds[nodes + 1] - bounds[nodes]
            where = textbytes.ragged(bounds[nodes], sizes)
            row, entry = np.nonzero(np.repeat(may, sizes, axis=0))
            own = self.points[where].astype(np.int64)
            far = ((own[row] - entries[entry]) ** 2).sum(axis=1)
            starts = np.searchsorted(row, np.arange(len(where)))
            least = np.minimum.reduceat(far, starts)
            hit = np.flatnonzero(far == least[row])
            chosen = entry[hit[np.searchsorted(row[hit], np.arange(len(where)))]]
            nearest[where] = chosen
            np.add.at(total, chosen, own)
            count += np.bincount(chosen, minlength=k)
        return nearest, total, count


# stored trees: one row for the vectors of one length among at most tree_rows vectors


def _tree_schema(rows: DataFrame, id_col: str, label_col: str) -> T.StructType:
    kind = rows.schema[label_col].dataType
    head = T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.ArrayType(T.IntegerType()))]))
    blobs = [T.StructField(c, T.BinaryType()) for c in ("order", "points", "low", "high", "sums")]
    return T.StructType([T.StructField("n", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(kind)), T.StructField("heads", head), *blobs])


def _whole(batch: pa.Table, p: Params) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their scaled vectors) for each length of usable vectors, components padded with zeros to equal parts."""
    col = batch.column(1).combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    lengths = np.asarray(col.value_lengths().fill_null(0))
    values = col.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    fine = (lengths > 0) & (bad[begin[1:]] == bad[begin[:-1]])
    for length in np.unique(lengths[fine]):
        rows = np.flatnonzero(fine & (lengths == length))
        x = values[begin[rows][:, None] + np.arange(length)]
        x = np.clip(np.floor(x * p.scale), -BOUND, BOUND).astype(np.int32)
        yield rows, np.pad(x, ((0, 0), (0, -length % p.parts)))


def trees(rows: DataFrame, params: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Kd-trees over all parts of all usable vectors, stored; ``heads`` are each set's first rows by id, for the first codebooks."""
    p = params
    schema = _tree_schema(rows, id_col, label_col)
    own = rows.select(rows[id_col].cast("bigint").alias("id"), rows[vector_col].alias("v"), rows[label_col].alias("label"))

    def build(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for at, x in _whole(table, p):
            ids, labels = table.column(0).take(at).combine_chunks(), table.column(2).take(at)
            ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
            made = {c: [] for c in ("order", "points", "low", "high", "sums")}
            for part in np.split(x, p.parts, axis=1):
                order = tree_order(part, p.leaf)
                t = Tree.over(part[order], p.leaf)
                for c, a in zip(made, (order.astype(np.int32), t.points, t.low, t.high, t.sums), strict=True):
                    made[c].append(a.tobytes())
            key, null = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
            first = np.lexsort((*x.T[::-1], key, null))[: p.entries]
            heads = [{"id": ids[i].as_py(), "v": x[i].tolist()} for i in first]
            record = {"n": len(at), "width": x.shape[1], "ids": ids.to_pylist(), "labels": labels.to_pylist(), "heads": heads} | {c: b"".join(v) for c, v in made.items()}
            yield record

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            while table.num_rows >= p.tree_rows:
                for record in build(table.slice(0, p.tree_rows)):
                    yield pa.RecordBatch.from_pylist([record], schema=arrow)
                table = table.slice(p.tree_rows)
            held = table.to_batches()
        if held:
            for record in build(pa.Table.from_batches(held)):
                yield pa.RecordBatch.from_pylist([record], schema=arrow)

    return materialize(textbytes.map_texts(own, run, schema), "vector-trees")


def _read(batch: pa.RecordBatch, at: int, p: Params) -> Iterator[tuple[np.ndarray, Tree]]:
    """(order, tree) of each part position of one stored row."""
    n, width = batch.column("n")[at].as_py(), batch.column("width")[at].as_py()
    d = width // p.parts
    kinds = {"order": (np.int32, -1), "points": (np.int32, d), "low": (np.int32, d), "high": (np.int32, d), "sums": (np.int64, d)}
    loaded = {c: np.frombuffer(batch.column(c)[at].as_buffer(), t).reshape(p.parts, -1) for c, (t, _) in kinds.items()}
    for part in range(p.parts):
        yield loaded["order"][part], Tree(*[loaded[c][part].reshape(-1, d) for c in ("points", "low", "high", "sums")], p.leaf)


@dataclass(frozen=True)
class Codebooks:
    """``entries``: part x entry x component, whole numbers of 1 / scale; ``width``: components of a vector, padding included."""

    entries: np.ndarray
    params: Params

    @property
    def width(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _first(stored: DataFrame, p: Params) -> Codebooks | None:
    """The parts of the first rows by id; the very first row's length counts."""
    heads = stored.select("width", F.explode("heads").alias("h")).select("width", "h.*").orderBy(F.col("id").asc_nulls_last(), "v")
    top = heads.first()
    if top is None:
        return None
    rows = heads.where(F.col("width") == top["width"]).limit(p.entries).collect()
    x = np.array([r["v"] for r in rows], np.int64)
    return Codebooks(np.stack(np.split(x, p.parts, axis=1)), p)


def train(stored: DataFrame, params: Params = Params()) -> Codebooks | None:
    """Codebooks after the rounds; None without a usable vector.  A task adds up what its trees give each entry; the driver sees one row an entry."""
    p = params
    books = _first(stored, p)
    if books is None:
        return None
    parts, k, d = books.entries.shape
    wanted = stored.where(F.col("width") == books.width).select("n", "width", "order", "points", "low", "high", "sums")
    for _ in range(p.rounds):
        entries = books.entries

        def run(batches: Iterator[pa.RecordBatch], entries=entries) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((parts, k, d), np.int64), np.zeros((parts, k), np.int64)
            for batch in batches:
                for at in range(batch.num_rows):
                    for part, (_, tree) in enumerate(_read(batch, at, p)):
                        _, s, c = tree.filter(entries[part])
                        total[part] += s
                        count[part] += c
            part, entry = np.nonzero(count)
            sums = pa.ListArray.from_arrays(np.arange(0, len(part) * d + 1, d, dtype=np.int32), pa.array(total[part, entry].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), sums], ["part", "entry", "n", "sums"])

        found = textbytes.map_texts(wanted, run, "part int, entry int, n bigint, sums array<bigint>")
        rows = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(d)]).collect()
        moved = entries.copy()
        for r in rows:
            moved[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(d)]
        books = Codebooks(moved, p)
    return books


def encode(stored: DataFrame, books: Codebooks, label_type: T.DataType) -> DataFrame:
    """``id, label, code, error`` of every stored vector as long as the codebooks' (two hex digits for each part)."""
    p, entries = books.params, books.entries
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    digits = np.frombuffer(b"0123456789abcdef", np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                n = batch.column("n")[at].as_py()
                codes, errors = np.empty((n, p.parts), np.int64), np.zeros(n, np.int64)
                for part, (order, tree) in enumerate(_read(batch, at, p)):
                    nearest, _, _ = tree.filter(entries[part])
                    codes[order, part] = nearest
                    errors[order] += ((tree.points.astype(np.int64) - entries[part][nearest]) ** 2).sum(axis=1)
                text = np.stack([digits[codes >> 4], digits[codes & 15]], axis=2).reshape(n, -1)
                words = pa.Array.from_buffers(pa.utf8(), n, [None, pa.py_buffer(np.arange(0, text.size + 1, text.shape[1], dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(text))])
                yield pa.RecordBatch.from_arrays([batch.column("ids")[at].values, batch.column("labels")[at].values, words, pa.array(errors)], ["id", "label", "code", "error"])

    wanted = stored.where(F.col("width") == books.width).select("n", "width", "ids", "labels", "order", "points", "low", "high", "sums")
    return textbytes.map_texts(wanted, run, schema)


def decode(codes: DataFrame, books: Codebooks, code_col: str = "code") -> DataFrame:
    """``codes`` with column ``vector array<double>``, the entries that the codes name."""
    flat = [[float(v) / books.params.scale for v in entry] for part in books.entries.tolist() for entry in part]
    table = F.array(*[F.array(*map(F.lit, e)) for e in flat])
    k = books.entries.shape[1]
    at = lambda i: F.conv(F.substring(F.col(code_col), 2 * i + 1, 2), 16, 10).cast("int") + i * k
    return codes.withColumn("vector", F.concat(*[F.get(table, at(i)) for i in range(books.params.parts)]))


def compress(rows: DataFrame, params: Params = Params(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Codes of all usable vectors.

    Returns ``id, code string, error long, label_error long, codebooks_sha256
    string``, one row per usable row.  A null or empty vector or one with a null
    or non-finite component is left out, and so is one of another length than
    the first by id; lengths that do not divide into parts are padded with
    zeros.  Repeated rows stay repeated, a null id stays null and comes last in
    the order that names the first codebooks (ties by vector); with fewer rows
    than entries there are fewer entries.  Null labels are summed together.
    Components beyond 2**27 / scale are held there.  Other columns are not
    read.  An empty table gives no rows.
    """
    if params.entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    stored = trees(rows, params, id_col, vector_col, label_col)
    books = train(stored, params)
    kind = rows.schema[label_col].dataType
    names = (id_col, "code", "error", "label_error", "codebooks_sha256")
    if books is None:
        return rows.sparkSession.createDataFrame([], f"`{id_col}` bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = materialize(encode(stored, books, kind), "vector-codes")
    sums = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    few = sums.count() <= SENT_LABELS
    out = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(names[0]), "code", "error", "label_error", F.lit(books.sha256()).alias(names[4]))
