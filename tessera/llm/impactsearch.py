"""Ranked lexical search over impact-ordered postings, score at a time (operator 12).

Documents are dealt into shards as they are read.  A shard's postings of a term
are grouped by their exact impact, the score that the term adds to a document.
For a query, a shard's groups are taken in descending impact over all its terms;
when the impacts that remain prove that no document but a few candidates can
reach the best ``k`` (of this shard and of those that the task has searched
before), only the candidates' scores are completed.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textbytes
from tessera.llm.storage import materialize

#: Terms of the queries that are sent to the tasks that read documents; with more, all terms are indexed.
SENT_TERMS = 300_000
#: The terms' pattern after A-Z are lower-cased: digits, a-z and whatever is not ASCII.
TERM = r"[0-9a-z\x{80}-\x{10FFFF}]+"


@dataclass(frozen=True)
class Params:
    """shard_docs and shard_bytes bound a shard; block_items: queries that are searched together; candidates: how many may be left when a search stops early (only its cost depends on it); share: part of the remaining postings taken between two looks at the bounds."""

    k: int = 10
    shard_docs: int = 8192
    shard_bytes: int = 24 << 20
    block_items: int = 1024
    candidates: int = 64
    share: float = 0.3


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True


def terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(every term in order, the text that each is of) of texts given as UTF-8 bytes with offsets."""
    low = _FOLD[buf]
    inside = _INSIDE[low]
    head = np.zeros(len(low) + 1, bool)
    head[offsets] = True  # a text starts a term anew
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | head[:-1]))
    ends = np.concatenate([np.cumsum(inside)[starts] - 1, [int(inside.sum())]]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low[inside])])
    return words, np.searchsorted(offsets, starts, side="right") - 1


def query_terms(text: str | None) -> Counter:
    """Terms of one query with their repeats."""
    buf = np.frombuffer((text or "").encode(), np.uint8)
    return Counter(t.decode() for t in terms(buf, np.array([0, len(buf)]))[0].to_pylist())


class _Shard:
    """Postings of documents as they are read."""

    def __init__(self):
        self.words: list[pa.Array] = []
        self.docs: list[np.ndarray] = []
        self.tfs: list[np.ndarray] = []
        self.ids: list[pa.Array] = []
        self.lengths: list[np.ndarray] = []
        self.n = self.bytes = 0

    def add(self, ids: pa.Array, buf: np.ndarray, offsets: np.ndarray, keep: pa.Array | None) -> None:
        words, doc = terms(buf, offsets)
        self.lengths.append(np.bincount(doc, minlength=len(offsets) - 1))
        coded = words.dictionary_encode()
        index, own = np.asarray(coded.indices, np.int64), coded.dictionary
        if keep is not None:
            index_in = pc.is_in(own, value_set=keep).to_numpy(zero_copy_only=False)
            some = index_in[index] if len(index) else np.zeros(0, bool)
            index, doc = index[some], doc[some]
        pairs, tf = np.unique(index * (len(offsets) - 1) + doc, return_counts=True)
        self.words.append(own.take(pa.array(pairs // (len(offsets) - 1))))
        self.docs.append(pairs % (len(offsets) - 1) + self.n)
        self.tfs.append(tf)
        self.ids.append(ids)
        self.n += len(ids)
        self.bytes += len(buf)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The row of the shard's documents, then a row for each term."""
        lengths = np.concatenate(self.lengths)
        i32, i64 = pa.list_(pa.int32()), pa.list_(pa.int64())
        names = ["shard", "term", "df", "docs", "tfs", "ids", "lengths"]
        one = lambda v, t: pa.array([v], t)
        yield pa.RecordBatch.from_arrays([one(shard, pa.int64()), one(None, pa.string()), one(None, pa.int64()), one(None, i32), one(None, i32), one([x for a in self.ids for x in a.to_pylist()], i64), one(lengths, i32)], names)
        coded = pa.concat_arrays(self.words).dictionary_encode()
        index = np.asarray(coded.indices, np.int64)
        if not len(index):
            return
        order = np.argsort(index, kind="stable")
        docs, tfs = np.concatenate(self.docs)[order], np.concatenate(self.tfs)[order]
        ends = np.concatenate([[0], np.cumsum(np.bincount(index))]).astype(np.int32)
        for a in range(0, len(ends) - 1, 512):
            b = min(a + 512, len(ends) - 1)
            lo, hi, m = ends[a], ends[b], b - a
            lists = [pa.ListArray.from_arrays(pa.array(ends[a : b + 1] - lo), pa.array(x[lo:hi].astype(np.int32))) for x in (docs, tfs, lengths[docs])]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, shard)), coded.dictionary[a:b].cast(pa.string()), pa.array(np.diff(ends[a : b + 1]).astype(np.int64)), lists[0], lists[1], pa.nulls(m, i64), lists[2]], names)


_POSTINGS = "shard bigint, term string, df bigint, docs array<int>, tfs array<int>, ids array<bigint>, lengths array<int>"


def postings(docs: DataFrame, keep: list[str] | None = None, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored postings by shard and term (of the terms ``keep``, or of all), and a row without a term for the documents of each shard."""
    p = params
    wanted = None if keep is None else pa.array([t.encode() for t in keep], pa.binary())
    own = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            for a, b, buf, offsets in textbytes.chunks(batch.column(1)):
                held.add(batch.column(0)[a:b], buf, offsets, wanted)
                if held.n >= p.shard_docs or held.bytes >= p.shard_bytes:
                    yield from held.rows(number)
                    number, held = number + 1, _Shard()
        if held.n:
            yield from held.rows(number)

    return materialize(textbytes.map_texts(own, run, _POSTINGS), "postings")


def _impacts(stored: DataFrame, n: int, total: int) -> DataFrame:
    """Each posting list ordered by impact: ``shard, term, impacts`` (distinct, descending), ``sizes`` of their groups and ``docs``; documents' rows as they are."""
    lists = stored.where("term is not null")
    df = lists.groupBy("term").agg(F.sum("df").alias("df"))
    weights = df.select("term", F.floor(1000 * F.ln((F.lit(2.0) * n + 2) / (2 * F.col("df") + 1))).alias("w"))
    joined = lists.select("shard", "term", "docs", "tfs", "lengths").join(weights, "term")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengthened: dict[int, int] = {}
        for batch in batches:
            shard, term, docs, tfs, lengths, w = (batch.column(c) for c in ("shard", "term", "docs", "tfs", "lengths", "w"))
            counts = np.asarray(docs.value_lengths(), np.int64)
            row = np.repeat(np.arange(len(counts)), counts)
            d, tf = np.asarray(docs.flatten(), np.int64), np.asarray(tfs.flatten(), np.int64)
            distinct, where = np.unique(np.asarray(lengths.flatten(), np.int64), return_inverse=True)
            for x in distinct.tolist():
                if x not in lengthened:
                    lengthened[x] = 25 + 75 * x * n // total  # whole numbers of any size
            m = np.array([lengthened[x] for x in distinct.tolist()], np.int64)[where]
            impact = np.asarray(w, np.int64)[row] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            order = np.lexsort((d, -impact, row))
            impact, d = impact[order], d[order]
            new = np.ones(len(row), bool)
            new[1:] = (impact[1:] != impact[:-1]) | (row[1:] != row[:-1])
            heads = np.flatnonzero(new)
            groups = np.concatenate([[0], np.cumsum(np.bincount(row[heads], minlength=len(counts)))]).astype(np.int32)
            sizes = np.diff(np.append(heads, len(row))).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([shard, term, pa.ListArray.from_arrays(pa.array(groups), pa.array(impact[heads])), pa.ListArray.from_arrays(pa.array(groups), pa.array(sizes)), pa.ListArray.from_arrays(pa.array(ends), pa.array(d.astype(np.int32))), pa.nulls(len(counts), pa.list_(pa.int64()))], ["shard", "term", "impacts", "sizes", "docs", "ids"])

    schema = "shard bigint, term string, impacts array<bigint>, sizes array<int>, docs array<int>, ids array<bigint>"
    ordered = textbytes.map_texts(joined, run, schema)
    heads = stored.where("term is null").select("shard", "term", F.lit(None).cast("array<bigint>").alias("impacts"), F.lit(None).cast("array<int>").alias("sizes"), F.lit(None).cast("array<int>").alias("docs"), "ids")
    return ordered.unionByName(heads)


def index(docs: DataFrame, keep: list[str] | None = None, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The impact-ordered index, stored.  Counts and lengths are those of all documents, whichever terms are kept."""
    stored = postings(docs, keep, params, id_col, text_col)
    counts = stored.where("term is null").select(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("total"), F.expr("cast(size(filter(lengths, x -> x > 0)) as bigint)").alias("n"))
    n, total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return materialize(_impacts(stored, n, max(total, 1)), "impact-index")


class _Searcher:
    """Best documents of each query over the shards of one task."""

    def __init__(self, queries: list[Counter], p: Params):
        self.p, self.queries = p, queries
        self.best: list[list[tuple]] = [[] for _ in queries]  # (-score, id is null, id), best first

    def search(self, ids: list, slots: dict[str, int], impacts: np.ndarray, sizes: np.ndarray, docs: np.ndarray, groups: np.ndarray) -> None:
        """One shard: ``groups`` are the ends of the terms' impact groups, ``sizes`` the groups' documents."""
        at = np.concatenate([[0], np.cumsum(sizes)])
        for q, wanted in enumerate(self.queries):
            own = [(slots[t], c) for t, c in wanted.items() if t in slots]
            if own:
                self._query(q, ids, own, impacts, at, docs, groups)

    def _query(self, q: int, ids: list, own: list[tuple[int, int]], impacts: np.ndarray, at: np.ndarray, docs: np.ndarray, groups: np.ndarray) -> None:
        p, best = self.p, self.best[q]
        slot, repeats = np.array([s for s, _ in own]), np.array([c for _, c in own], np.int64)
        counts = groups[slot + 1] - groups[slot]
        group = textbytes.ragged(groups[slot], counts)
        of = np.repeat(np.arange(len(slot)), counts)
        value = impacts[group] * repeats[of]
        order = np.argsort(-value, kind="stable")
        group, of, value = group[order], of[order], value[order]
        size = at[group + 1] - at[group]
        done = np.concatenate([[0], np.cumsum(size)])
        # groups of equal impact are taken together
        ends = np.append(np.flatnonzero(value[1:] != value[:-1]) + 1, len(value))
        scores = np.zeros(len(ids), np.int64)
        floor = -best[-1][0] if len(best) >= p.k else 1
        left = p.share
        now = 0
        while now < len(value):
            target = done[now] + (done[-1] - done[now]) * left
            stop = int(ends[np.searchsorted(done[ends], target)]) if target < done[-1] else len(value)
            where = docs[textbytes.ragged(at[group[now:stop]], size[now:stop])]
            np.add.at(scores, where, np.repeat(value[now:stop], size[now:stop]))
            now = stop
            if now == len(value):
                break
            # the next group of each term bounds what a document can still gain
            rest = np.zeros(len(slot), np.int64)
            rest[of[now:][::-1]] = value[now:][::-1]
            bound = int(rest.sum())
            reach = floor
            if len(scores) > p.k:
                reach = max(reach, int(np.partition(scores, -p.k)[-p.k]))
            may = scores + bound >= reach
            if may.sum() <= max(p.candidates, p.k):
                # proven: only these can be among the best; complete their scores
                where = docs[textbytes.ragged(at[group[now:]], size[now:])]
                some = may[where]
                np.add.at(scores, where[some], np.repeat(value[now:], size[now:])[some])
                scores[~may] = 0
                break
        reach = floor
        if len(scores) > p.k:
            reach = max(reach, int(np.partition(scores, -p.k)[-p.k]))
        hits = np.flatnonzero(scores >= max(reach, 1)).tolist()
        if hits:
            found = [(-int(scores[i]), ids[i] is None, ids[i] or 0) for i in hits]
            self.best[q] = heapq.nsmallest(p.k, [*best, *found])


def _searched(stored: DataFrame, items: list[tuple[int, int | None, str | None]], p: Params) -> DataFrame:
    """``q, item_id, doc_id, score``: the best of each task's shards for each query ``(number, id, text)``."""
    queries = [query_terms(text) for _, _, text in items]
    numbers = [(n, i) for n, i, _ in items]
    vocabulary = {t for q in queries for t in q}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = _Searcher(queries, p)
        held: list[pa.RecordBatch] = []

        def shard() -> None:
            table = pa.Table.from_batches(held)
            shown = table.column("term").to_pylist()
            rows = [i for i, t in enumerate(shown) if t in vocabulary]
            ids = table.column("ids")[shown.index(None)].as_py()
            some = table.take(pa.array(rows, pa.int64()))
            lists = {c: some.column(c).combine_chunks() for c in ("impacts", "sizes", "docs")}
            lists = {c: a if isinstance(a, pa.Array) else pa.concat_arrays(a.chunks) for c, a in lists.items()}
            groups = np.concatenate([[0], np.cumsum(np.asarray(lists["impacts"].value_lengths(), np.int64))])
            flat = {c: np.asarray(a.flatten(), np.int64) for c, a in lists.items()}
            searcher.search(ids, {shown[r]: k for k, r in enumerate(rows)}, flat["impacts"], flat["sizes"], flat["docs"], groups)

        now = None
        for batch in batches:
            names = np.asarray(batch.column("shard"))
            cuts = np.concatenate([[0], np.flatnonzero(names[1:] != names[:-1]) + 1, [len(names)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a == b:
                    continue
                if held and names[a] != now:
                    shard()
                    held.clear()
                now = names[a]
                held.append(batch.slice(a, b - a))
        if held:
            shard()
        rows = [(*numbers[q], None if null else i, -score) for q, best in enumerate(searcher.best) for score, null, i in best]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["q", "item_id", "doc_id", "score"])

    # the documents' row of a shard has no term and comes first
    dealt = stored.repartition("shard").sortWithinPartitions("shard", F.col("term").asc_nulls_first())
    return textbytes.map_texts(dealt, run, "q bigint, item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text") -> DataFrame:
    """The ``k`` documents that score highest for each item.

    Returns ``item_id, rank int, doc_id, score long``.  Equal scores by
    ascending id, a null id last; documents with score 0 are left out, so an
    item without terms or with unknown ones has no rows.  Null and empty texts
    have no terms and do not count.  Every row of either table counts: a
    repeated document is ranked as often as it occurs, a repeated item is
    searched as often.  Other columns are not read; empty tables give no rows.
    Items are searched in blocks that the driver sends to the tasks.
    """
    p = params
    asked = items.select(items[item_col].cast("bigint").alias("id"), items[query_col].cast("string").alias("text"))
    asked = materialize(asked.withColumn("q", F.monotonically_increasing_id()), "items")
    found = asked.select(F.explode(F.expr(f"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM.replace(chr(92), chr(92) * 2)}', 0)")).alias("term")).distinct()
    keep = [r["term"] for r in found.limit(SENT_TERMS + 1).collect()]
    stored = index(docs, keep if len(keep) <= SENT_TERMS else None, p, id_col, text_col)
    blocks = max(1, -(-asked.count() // p.block_items))
    parts = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "id", "text").collect()
        parts.append(_searched(stored, [tuple(r) for r in rows], p))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= p.k)
    return ranked.select(F.col("item_id").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score")
