"""Near-duplicate texts by MinHash bands and odd sketches (operator 1).

One pass over the texts turns each into its set of word shingles, MinHash
samples, band keys, a fingerprint of the set and an odd sketch: a parity bitmap
in which every (sample number, sample) toggles one bit.  The population count
of two sketches' XOR estimates how many samples differ, and does so precisely
where similarity is high.  Texts with equal sets collapse into one
representative before any pair is made.  A band bucket links its members to its
smallest id, then buckets that still hold several components link theirs to a
member picked by hash; pairs that pass the sketch are confirmed on full sets.
Buckets that even then hold several components are compared across components,
so no link between different texts is lost to the shortcut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textbytes
from tessera.llm.components import connected_components
from tessera.llm.storage import materialize


@dataclass(frozen=True)
class Params:
    """shingle: words; percent: least Jaccard similarity in hundredths; bands x rows MinHash samples in keys; samples and bits of the sketch.

    At a similarity of 0.8, 32 bands of 5 rows miss a pair with a chance of 3e-6.
    ids_to_send: up to as many ids are broadcast to pick texts, more are joined by a shuffle.
    """

    shingle: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 5
    samples: int = 768
    bits: int = 3072
    ids_to_send: int = 1_000_000

    @property
    def most_odd(self) -> int:
        """Odd bits up to which a pair is confirmed: four and a half standard deviations over the mean at the least similarity."""
        samples = self.samples
        j = self.percent / 100
        toggles = 2 * samples * (1 - j)
        mean = self.bits / 2 * (1 - math.exp(-2 * toggles / self.bits))
        spread = 2 * math.sqrt(samples * j * (1 - j)) * math.exp(-2 * toggles / self.bits)
        parity = math.sqrt(self.bits) / 4 * (1 - math.exp(-4 * toggles / self.bits))
        return min(self.bits, math.ceil(mean + 4.5 * math.hypot(spread, parity)))


def _sets(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all distinct shingles, sorted within each text; first one of each text and an end)."""
    words, first = textbytes.word_hashes(buf, offsets)
    counts = np.diff(first)
    grams = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begin = first[:-1]
    with np.errstate(over="ignore"):
        at = textbytes.ragged(begin, grams)
        text = np.repeat(np.arange(len(counts)), grams)
        hashed = np.zeros(len(at), np.uint64)
        left = np.repeat(first[1:], grams)
        for k in range(size):
            inside = at + k < left
            word = words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else np.zeros(0, np.uint64)
            hashed = textbytes.mix64(np.where(inside, hashed * np.uint64(0x2545F4914F6CDD1D) + word + np.uint64(k + 1), hashed))
    ends = np.concatenate([[0], np.cumsum(grams)])
    out, sizes = [], np.zeros(len(counts), np.int64)
    for i in np.flatnonzero(grams):
        own = np.unique(hashed[ends[i] : ends[i + 1]])
        sizes[i] = len(own)
        out.append(own)
    del text
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def _signatures(hashes: np.ndarray, begin: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints n x 2, band keys n x bands, sketches n x bits / 64) of the non-empty sets."""
    heads = begin[:-1][np.diff(begin) > 0]
    n, samples = len(heads), max(p.samples, p.bands * p.rows)
    seeds = textbytes.mix64(np.arange(1, 2 * samples + 1, dtype=np.uint64))
    low = np.empty((samples, n), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(samples):
            low[i] = np.minimum.reduceat(hashes * (seeds[2 * i] | np.uint64(1)) + seeds[2 * i + 1], heads)
        prints = np.stack([np.add.reduceat(textbytes.mix64(hashes + np.uint64(k)), heads) for k in (11, 23)], axis=1)
        keys = np.empty((n, p.bands), np.uint64)
        for b in range(p.bands):
            key = np.full(n, b + 1, np.uint64)
            for r in range(p.rows):
                key = textbytes.mix64(key * np.uint64(0x2545F4914F6CDD1D) + low[b * p.rows + r])
            keys[:, b] = key
        bit = textbytes.mix64(low[: p.samples] + seeds[: p.samples, None]) % np.uint64(p.bits)
    flat = (np.arange(n, dtype=np.int64)[None, :] * p.bits + bit.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=n * p.bits) & 1).astype(np.uint8).reshape(n, p.bits)
    return prints, keys, np.packbits(odd, axis=1).view(np.uint64)


def _lists(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    """list<int64> column with ``rows`` where ``valid`` and null elsewhere."""
    width = rows.shape[1]
    ends = np.concatenate([[0], np.cumsum(np.where(valid, width, 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.view(np.int64).ravel()), mask=pa.array(~valid))


def signatures(docs: DataFrame, p: Params) -> DataFrame:
    """``id, n_shingles, f1, f2, bands, sketch`` of each row of ``docs(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in textbytes.chunks(batch.column(1)):
                hashes, begin = _sets(buf, offsets, p.shingle)
                sizes = np.diff(begin)
                some = sizes > 0
                if some.any():
                    prints, keys, sketch = _signatures(hashes, begin, p)
                else:
                    prints, keys, sketch = np.zeros((0, 2), np.uint64), np.zeros((0, p.bands), np.uint64), np.zeros((0, p.bits // 64), np.uint64)
                both = np.zeros((b - a, 2), np.uint64)
                both[some] = prints
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), *(pa.array(both[:, k].view(np.int64), mask=~some) for k in (0, 1)), _lists(keys, some), _lists(sketch, some)],
                    names=["id", "n_shingles", "f1", "f2", "bands", "sketch"],
                )

    return textbytes.map_texts(docs, run, "id bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>, sketch array<bigint>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """``id, shingles array<bigint>`` (distinct, whole set) of each row of ``docs(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in textbytes.chunks(batch.column(1)):
                hashes, begin = _sets(buf, offsets, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(hashes.view(np.int64)))], names=["id", "shingles"])

    return textbytes.map_texts(docs, run, "id bigint, shingles array<bigint>")


def _odd_bits(x: str, y: str) -> F.Column:
    return F.aggregate(F.zip_with(F.col(x), F.col(y), lambda s, t: F.bit_count(s.bitwiseXOR(t))), F.lit(0), lambda total, k: total + k)


def _confirmed(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, p: Params, name: str) -> DataFrame:
    """The pairs (a, b) whose sketches agree and whose full sets reach the similarity."""
    one, two = (sketches.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("n").alias(f"n_{c}")).hint("merge") for c in "ab")
    # similarity of 0.8 needs sizes within that ratio; the sketch rules out the rest
    near = pairs.join(one, "a").join(two, "b").where(F.col("n_a") * p.percent <= F.col("n_b") * 100).where(F.col("n_b") * p.percent <= F.col("n_a") * 100).where(_odd_bits("sketch_a", "sketch_b") <= p.most_odd)
    near = materialize(near.select("a", "b", "n_a", "n_b"), f"{name}-near")
    ids = materialize(near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct(), f"{name}-ids")
    # the size of what is broadcast is counted first
    picked = docs.join(F.broadcast(ids) if ids.count() <= p.ids_to_send else ids, "id", "left_semi")
    # equal ids have equal sets only if the table repeats a row: one set of each id is enough
    sets = materialize(shingle_sets(picked, p.shingle), f"{name}-sets").dropDuplicates(["id"])
    both = near.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b")).hint("merge"), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a")).hint("merge"), "a")
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("bigint")
    return materialize(both.withColumn("shared", shared).where(F.col("shared") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("shared")) * p.percent).select("a", "b"), f"{name}-links")


_BLOCK = 512


def _mixed(shared: DataFrame, components: DataFrame) -> DataFrame:
    """``key, id, component`` of the buckets that hold several components."""
    placed = shared.join(components.hint("merge"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    return materialize(placed.join(mixed, "key", "left_semi"), "mixed")


def _picked(rows: DataFrame, sketches: DataFrame, p: Params) -> DataFrame:
    """Pairs of each member with a member of its bucket picked by hash, in another component."""
    lead = rows.groupBy("key").agg(F.min(F.struct(F.xxhash64("key", "id").alias("h"), "id", "component")).alias("lead")).select("key", F.col("lead.id").alias("other"), F.col("lead.component").alias("there"))
    return rows.join(lead, "key").where("component <> there").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _across(mixed: DataFrame, sketches: DataFrame, p: Params) -> DataFrame:
    """Pairs (a, b) of ``mixed(key, id, component)`` in one bucket but two components whose sketches agree.

    A bucket is dealt out as blocks of ids, and a task compares two blocks with
    numpy, so a large bucket becomes many tasks of bounded memory.  Of the
    buckets that two texts share, the one of their first common band gives the pair.
    """
    rows = mixed.join(sketches.select("id", "sketch", "bands").hint("merge"), "id")
    sizes = mixed.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / _BLOCK).cast("int")
    dealt = rows.join(sizes, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id", "component", "sketch", "bands")

    def compare(batch: pa.Table) -> pa.Table:
        sketch = np.array(batch.column("sketch").combine_chunks().flatten()).view(np.uint64).reshape(batch.num_rows, -1)
        bands = np.array(batch.column("bands").combine_chunks().flatten()).reshape(batch.num_rows, -1)
        key = batch.column("key")[0].as_py()
        ids, component, block = (batch.column(c).to_numpy() for c in ("id", "component", "block"))
        i, j = batch.column("i")[0].as_py(), batch.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found_a, found_b = [], []
        for x in left:
            others = right if i != j else right[ids[right] > ids[x]]
            others = others[component[others] != component[x]]
            odd = np.bitwise_count(sketch[others] ^ sketch[x]).sum(axis=1)
            close = others[odd <= p.most_odd]
            close = close[bands[x][(bands[close] == bands[x]).argmax(axis=1)] == key]
            found_a.append(np.full(len(close), ids[x]))
            found_b.append(ids[close])
        a, b = (np.concatenate(f) if f else np.zeros(0, np.int64) for f in (found_a, found_b))
        return pa.table({"a": np.minimum(a, b).astype(np.int64), "b": np.maximum(a, b).astype(np.int64)})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint").where("a < b").distinct()


def near_duplicates(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate classes of whole texts.

    Returns ``id_col long, n_shingles long, component_id long, kept boolean``,
    one row per input row.  Words are maximal runs of other than ASCII white
    space, A-Z lower-cased.  Two texts are linked if their shingle sets' Jaccard
    similarity reaches the threshold; component_id is the smallest id reachable.
    Null, empty and blank texts have no shingles and link with nothing; texts
    with fewer words than a shingle have one.  Rows that repeat an id count as
    one document.  A null id stays null, takes no part and is kept.  Other
    columns are not read, so their names cannot clash.
    """
    p = params
    own = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    signed = materialize(signatures(own, p), "signatures")
    some = signed.where("n_shingles > 0 and id is not null")
    classes = materialize(some.groupBy("f1", "f2", "n_shingles").agg(F.min("id").alias("id")), "classes")
    kept = some.join(classes, ["f1", "f2", "n_shingles", "id"], "left_semi").dropDuplicates(["id", "f1", "f2"])
    kept = materialize(kept.select("id", F.col("n_shingles").alias("n"), "bands", "sketch"), "representatives")
    banded = kept.select("id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key", "first")
    shared = materialize(banded.join(buckets.hint("merge"), "key"), "buckets")
    # rows that repeat an id with another text may share an id between classes: they count as one document
    sketches = kept.join(shared.select("id").distinct().hint("merge"), "id", "left_semi").select("id", "n", "sketch", "bands").dropDuplicates(["id"])
    sketches = materialize(sketches, "sketches")
    stars = shared.where("first < id").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    links = _confirmed(stars, sketches, own, p, "star")
    components = materialize(connected_components(links), "components")
    for name, pairs_of in (("pick", _picked), ("across", _across)):
        rest = _mixed(shared, components)
        if rest.isEmpty():
            break
        more = _confirmed(pairs_of(rest, sketches, p), sketches, own, p, name)
        if not more.isEmpty():
            links = links.unionByName(more)
            components = materialize(connected_components(links), "components")
    final = components
    named = classes.join(final, "id", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("id", "n_shingles", "f1", "f2").join(named, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
