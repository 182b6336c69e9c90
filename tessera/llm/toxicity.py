"""Toxicity by maximum-scoring segments (operator 13).

Tokens get log-odds of occurring in toxic against other texts, under
Dirichlet priors in the classes' shares, where these are significant; a token too rare to tell takes
the log-odds of its stem (its first letters).  Every other token costs a drift,
so a text's expected score falls and a linear scan finds all of its maximal
segments.  A segment's score becomes surprise by extreme-value statistics:
``E = K n exp(-lambda S)`` segments as good are expected by chance in a text of
``n`` tokens.  Significant passages add up their surprise, which a logistic
curve turns into a probability.  Rates and curve are fitted on segments that
the counts of the other half of the learned texts found.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textbytes
from tessera.llm.storage import materialize


#: Labels that are sent to every task (an id and a bit each); with more of them labelled texts meet them by a shuffle.
SENT_LABELS = 2_000_000


@dataclass(frozen=True)
class Params:
    """prior: toxic pseudo-texts of each token, with as many others as make its log-odds 0; enough: least log-odds in standard errors; known: texts from which a token's own counts decide; stems: lengths tried in turn; drift: cost of any other token; expected: chance segments a passage may have; tokens: bound of the model's table, the surest kept."""

    prior: float = 0.3
    enough: float = 2.8
    known: int = 8
    stems: tuple[int, ...] = (5, 4)
    drift: float = 0.5
    expected: float = 0.05
    tokens: int = 500_000
    threshold: float = 0.7


@dataclass
class Model:
    """``tables``: for whole words, then for each stem length, log-odds of the tokens that decide; rate and scale (lambda, K) of chance segments; slope and offset of the curve."""

    tables: list[dict[str, float]]
    params: Params
    rate: float = 1.0
    scale: float = 1.0
    slope: float = 0.0
    offset: float = 0.0


# scanning


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray]:
    """(start and end byte of every run of letters, its text, its coded lower-case form)."""
    letter = textbytes.byte_classes(buf) == textbytes.LETTER
    head = np.zeros(len(buf) + 1, bool)
    head[offsets] = True
    before = np.concatenate([[False], letter[:-1]])
    after = np.concatenate([letter[1:], [False]])
    starts = np.flatnonzero(letter & (~before | head[:-1]))
    ends = np.flatnonzero(letter & (~after | head[1:])) + 1
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    raw = pa.Array.from_buffers(pa.utf8(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf[letter]))])
    coded = raw.dictionary_encode()
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1, pa.DictionaryArray.from_arrays(coded.indices, pc.utf8_lower(coded.dictionary))


class Scorer:
    """A model's log-odds of words, looked up for distinct words at once."""

    def __init__(self, model: Model):
        self.stems = model.params.stems
        self.drift = model.params.drift
        self.tables = [(pa.array(list(t), pa.string()), np.array([*t.values(), np.nan])) for t in model.tables]

    def __call__(self, distinct: pa.Array) -> np.ndarray:
        out = np.full(len(distinct), np.nan)
        for length, (names, values) in zip((0, *self.stems), self.tables, strict=True):
            keys = pc.utf8_slice_codeunits(distinct, 0, length) if length else distinct
            at = pc.fill_null(pc.index_in(keys, value_set=names), len(names)).to_numpy(zero_copy_only=False)
            out = np.where(np.isnan(out), values[at], out)
        return np.nan_to_num(out) - self.drift


def maximal_segments(at: np.ndarray, gain: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """(first, last, gaining tokens, score) of all maximal scoring segments, in order.

    Tokens at the positions ``at`` gain ``gain`` > 0, all others lose ``drift``.
    A segment is maximal if none that contains it scores more and it is not part
    of another such segment (Ruzzo and Tompa 1999); time is linear.
    """
    found: list[list] = []  # first, last, total before it, total after it, index of the nearest earlier one that starts lower, gaining tokens
    total, last = 0.0, -1
    for position, value in zip(at.tolist(), gain.tolist(), strict=True):
        total -= drift * (position - last - 1)
        last = position
        new = [position, position, total, total + value, -1, 1]
        total += value
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= new[2]:
                k = found[k][4]
            if k < 0 or found[k][3] >= new[3]:
                new[4] = k
                found.append(new)
                break
            new = [found[k][0], new[1], found[k][2], new[3], -1, new[5] + sum(s[5] for s in found[k:])]
            del found[k:]
    return [(a, b, hits, after - before) for a, b, before, after, _, hits in found]


_SEGMENTS = T.ArrayType(T.StructType([*[T.StructField(c, T.IntegerType()) for c in ("first", "last", "start", "end", "hits")], T.StructField("score", T.DoubleType())]))


def _scan(texts: pa.Array, which: np.ndarray | None, scorers: list[Scorer]) -> Iterator[tuple[list[int], list[list[dict]]]]:
    """(tokens, segments) of each text of each chunk; ``which`` names each text's scorer."""
    done = 0
    for a, b, buf, offsets in textbytes.chunks(texts):
        starts, ends, text, coded = words(buf, offsets)
        index = np.asarray(coded.indices, np.int64)
        counts = np.bincount(text, minlength=b - a)
        first = np.concatenate([[0], np.cumsum(counts)])
        own = np.zeros(b - a, np.int64) if which is None else which[done : done + b - a]
        scores = np.zeros(len(index))
        for k, scorer in enumerate(scorers):
            mine = own[text] == k
            if mine.any():
                scores[mine] = scorer(coded.dictionary)[index[mine]]
        hits = np.flatnonzero(scores > 0)
        segments: list[list[dict]] = [[] for _ in range(b - a)]
        if len(hits):
            point = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])  # code points before each byte
            of = text[hits]
            cuts = np.concatenate([[0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(hits)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                t = int(of[lo])
                some = hits[lo:hi]
                for x, y, h, s in maximal_segments(some - first[t], scores[some], scorers[own[t]].drift):
                    base = point[offsets[t]]
                    segments[t].append({"first": x, "last": y, "start": int(point[starts[first[t] + x]] - base), "end": int(point[ends[first[t] + y]] - base), "hits": h, "score": float(s)})
        yield counts.tolist(), segments
        done += b - a


def segments(rows: DataFrame, models: list[Model], extra: list[str], text_col: str = "text", which: str | None = None) -> DataFrame:
    """Columns ``extra`` with ``n_tokens`` and the maximal ``segments`` of every whole text; column ``which`` names the model of a row."""
    own = rows.select(*[rows[c] for c in extra], rows[text_col].cast("string").alias("text_"), *([rows[which].cast("int").alias("which_")] if which else []))
    kept = own.select(*extra).schema
    schema = T.StructType([*kept.fields, T.StructField("n_tokens", T.LongType()), T.StructField("segments", _SEGMENTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(m) for m in models]
        struct = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hits", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            choice = np.asarray(batch.column("which_")) if which else None
            counts, found = [], []
            for c, s in _scan(batch.column("text_"), choice, scorers):
                counts += c
                found += s
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in extra], pa.array(counts, pa.int64()), pa.array(found, struct)], [*extra, "n_tokens", "segments"])

    return textbytes.map_texts(own, run, schema)


# learning


#: Columns of the counts: texts of each half that have the token, toxic and other, and bitmaps of the words left and right of it in toxic ones.
_COUNTS = ("t0", "o0", "l0", "r0", "t1", "o1", "l1", "r1")


def _counted(rows: DataFrame) -> DataFrame:
    """``stem`` and the counts of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, half = np.asarray(batch.column("label_"), np.int64), np.asarray(batch.column("half_"), np.int64)
            done = 0
            for a, b, buf, offsets in textbytes.chunks(batch.column("text_")):
                _, _, text, coded = words(buf, offsets)
                n = b - a
                mine, kind = half[done : done + n], (half * 2 + label)[done : done + n]
                done += n
                # equal words of one text count once; lower-casing may have made entries equal
                low = coded.dictionary.dictionary_encode()
                index = np.asarray(low.indices, np.int64)[np.asarray(coded.indices, np.int64)] if len(text) else np.zeros(0, np.int64)
                pairs = np.unique(index * n + text)
                size = len(low.dictionary)
                table = np.bincount(pairs // n * 4 + kind[pairs % n], minlength=4 * size).reshape(size, 2, 2)
                beside = np.zeros((2, size, 2), np.int64)
                at = np.flatnonzero(kind[text] % 2 == 1)
                for side, bit in enumerate(_neighbours(low.dictionary, index, text, at)):
                    np.bitwise_or.at(beside[side], (index[at], mine[text[at]]), np.left_shift(np.int64(1), bit))
                yield pa.RecordBatch.from_arrays([low.dictionary, *[pa.array(c) for h in (0, 1) for c in (table[:, h, 1], table[:, h, 0], beside[0, :, h], beside[1, :, h])]], ["stem", *_COUNTS])

    found = textbytes.map_texts(rows, run, "stem string, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    return _summed(found, F.col("stem"))


def _neighbours(distinct: pa.Array, index: np.ndarray, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 64 for the words left and right of each token ``at``."""
    left, right = np.maximum(at - 1, 0), np.minimum(at + 1, max(len(index) - 1, 0))
    spread = np.zeros(len(distinct), np.int64)
    some = np.unique(np.concatenate([index[left], index[right]])) if len(at) else np.zeros(0, np.int64)
    hashed = textbytes.mix64(np.array([zlib.crc32(w.encode()) + 1 for w in distinct.take(pa.array(some)).to_pylist()], np.uint64))
    spread[some] = (hashed & np.uint64(63)).astype(np.int64)
    before = np.where((at > 0) & (text[left] == text[at]), spread[index[left]], 0)
    return before, np.where((right > at) & (text[right] == text[at]), spread[index[right]], 0)


def _summed(own: DataFrame, key: Column) -> DataFrame:
    return own.groupBy(key.alias("stem")).agg(*[(F.bit_or(c) if c[0] in "lr" else F.sum(c)).alias(c) for c in _COUNTS])


def _log_odds(own: DataFrame, halves: tuple[int, ...], totals: tuple[int, int], p: Params) -> DataFrame:
    """``stem, odds, sure, known`` from the counts of some halves; odds are 0 where they are not significantly above 0.

    Toxic texts count at most as often as the words on either side of their
    token differ (linear counting in the bitmaps, while that can tell), since a
    passage that is copied gives a token many texts but one neighbour.
    """
    toxic, other = (reduce(lambda x, y: x + y, [F.col(f"{c}{h}") for h in halves]) for c in "to")
    bits = F.least(*[F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), [F.col(f"{side}{h}") for h in halves])) for side in "lr"])
    differ = F.ceil(-64 * F.log((64 - bits) / 64.0))
    own = own.select("stem", F.when(bits < 56, F.least(toxic, differ)).otherwise(toxic).alias("toxic"), other.alias("other"))
    share = (totals[1] + 1.0) / (totals[0] + 1.0)
    t, c = F.col("toxic") + p.prior, F.col("other") + p.prior * share
    odds = F.log(t) - F.log(c) + float(np.log(share))
    sure = odds / F.sqrt(1 / t + 1 / c)
    return own.select("stem", F.when(sure >= p.enough, odds).otherwise(0.0).alias("odds"), sure.alias("sure"), (F.col("toxic") + F.col("other") >= p.known).alias("known"))


def _tables(counts: dict[int, DataFrame], halves: tuple[int, ...], p: Params) -> list[dict[str, float]]:
    """Log-odds of the words (length 0) and stems that decide: positive ones, and known ones that a positive shorter stem would name wrongly."""
    sums = counts[0].agg(*[F.coalesce(F.sum(f"{c}{h}"), F.lit(0)).alias(f"{c}{h}") for c in "to" for h in halves]).first()
    totals = tuple(sum(sums[f"{c}{h}"] for h in halves) for c in "to")
    out: list[dict[str, float]] = []
    shorter: list[tuple[int, DataFrame]] = []
    for length in (*reversed(p.stems), 0):
        at = _log_odds(counts[length], halves, totals, p)
        keep = F.col("odds") > 0
        if length:
            keep &= F.col("known")
        for n, up in shorter:
            at = at.join(up.select(F.col("stem").alias("up"), F.lit(True).alias(f"under{n}")), F.substring("stem", 1, n) == F.col("up"), "left").drop("up")
            keep |= F.col("known") & F.coalesce(F.col(f"under{n}"), F.lit(False))
        # the surest first; a token that is left out costs the drift
        kept = materialize(at.where(keep).select("stem", "odds", "sure").orderBy(F.abs("sure").desc(), "stem").limit(p.tokens), "toxic-table")
        out.append({r["stem"]: r["odds"] for r in kept.select("stem", "odds").collect()})
        if length:
            shorter.append((length, kept))
    return out[::-1]


def _chance(values: np.ndarray, tokens: np.ndarray, p: Params) -> float:
    """Lambda: the positive root of the sum of p(s) exp(lambda s) = 1 over token scores."""
    share = tokens / tokens.sum()
    low, high = 0.0, 1.0

    def excess(x: float) -> float:
        return float((share * np.exp(np.minimum(x * values, 700))).sum()) - 1

    while excess(high) < 0:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def surprise(model: Model) -> Column:
    """Summed surprise of the significant passages in columns ``segments`` and ``n_tokens``."""
    return F.aggregate(F.transform(significant(model), lambda s: s["surprise"]), F.lit(0.0), lambda a, x: a + x)


def significant(model: Model) -> Column:
    """The segments that chance gives at most ``expected`` times, with their ``surprise`` (the negative log of how often)."""
    n = F.greatest("n_tokens", F.lit(1)).cast("double")
    kept = F.transform("segments", lambda s: s.withField("surprise", s["score"] * model.rate - F.log(n * model.scale)))
    return F.filter(kept, lambda s: s["surprise"] >= float(-np.log(model.params.expected)))


def _x() -> Column:
    """What the curve is a function of: the surprise on a logarithmic scale."""
    return F.log1p("surprise")


def learn(rows: DataFrame, params: Params = Params()) -> Model:
    """A model from ``text_`` and ``label_`` (0 or 1) of all rows.

    Equal texts fall into one half, and copies of toxic ones add nothing to
    the different neighbours of their tokens.  All counts are over all rows; the driver
    sees the deciding tokens (at most ``tokens`` a table) and histograms.  The
    texts are read twice and not stored.
    """
    p = params
    first = rows.withColumn("half_", F.pmod(F.xxhash64("text_"), F.lit(2)).cast("int"))
    counts = {0: materialize(_counted(first), "toxic-words")}
    for length in p.stems:
        counts[length] = materialize(_summed(counts[0].where(F.length("stem") > length), F.substring("stem", 1, length)), "toxic-stems")
    halves = [Model(_tables(counts, (h,), p), p) for h in (0, 1)]
    model = Model(_tables(counts, (0, 1), p), p)
    # each half is scanned with what the other half taught
    scanned = materialize(segments(first.withColumn("other_", 1 - F.col("half_")), halves, ["label_"], "text_", "other_"), "toxic-segments")
    clean = scanned.where("label_ = 0")
    tokens = clean.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    # what a gaining token of a segment brings on average: the segment's score and the drift of its other tokens
    gain = (F.col("s.score") + (F.col("s.last") - F.col("s.first") + 1 - F.col("s.hits")) * p.drift) / F.col("s.hits")
    every = scanned.select("label_", F.explode("segments").alias("s")).select("label_", "s.score", "s.hits", gain.alias("gain"))
    hits = every.where("label_ = 0").groupBy(F.round("gain", 1).alias("gain")).agg(F.sum("hits").alias("n")).collect()
    chance, least = every.where("label_ = 0").count(), every.agg(F.min("score")).first()[0] or 1.0
    # half a chance token of the least gain is added, so that there is always a root
    values = np.array([-p.drift, *[r["gain"] for r in hits], least])
    weight = np.array([max(tokens, 1), *[r["n"] for r in hits], 0.5])
    while (values * weight).sum() >= 0:  # the drift must win in clean text
        weight[0] *= 2
    model.rate = _chance(values, weight, p)
    model.scale = float((chance + 0.5) * np.exp(model.rate * least) / max(tokens, 1))
    bins = scanned.withColumn("surprise", surprise(model)).groupBy(F.round(_x(), 2).alias("x"), "label_").agg(F.count(F.lit(1)).alias("n")).collect()
    model.slope, model.offset = _curve(bins)
    return model


def _curve(bins: list) -> tuple[float, float]:
    """Slope (not negative) and offset of the logistic curve through binned labels, with smoothed targets (Platt 1999)."""
    x = np.array([r["x"] for r in bins], float)
    y = np.array([r["label_"] for r in bins], float)
    n = np.array([r["n"] for r in bins], float)
    pos, neg = (n * y).sum(), (n * (1 - y)).sum()
    if not len(x):
        return 0.0, 0.0
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 0.0, float(np.log((pos + 1) / (neg + 1)))

    def loss(a: float, b: float) -> float:
        z = a * x + b
        return float((n * (np.logaddexp(0, z) - target * z)).sum()) + 1e-3 * a * a

    now = loss(a, b)
    for _ in range(100):
        q = 1 / (1 + np.exp(-(a * x + b)))
        w = n * q * (1 - q) + 1e-9
        grad = np.array([(n * (q - target) * x).sum() + 2e-3 * a, (n * (q - target)).sum()])
        hess = np.array([[(w * x * x).sum() + 2e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-9]])
        step, size = np.linalg.solve(hess, grad), 1.0
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        new = loss(a, b)
        if now - new < 1e-9:
            break
        now = new
    return max(float(a), 0.0), float(b)


def fit(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled documents that are not held out (crc32 of the id modulo 3 is 1); null labels, ids and texts teach nothing, of several labels of an id the largest counts."""
    own = docs.select(docs[id_col].alias("id_"), docs[text_col].cast("string").alias("text_")).where(F.col("text_").isNotNull() & ~_held_out("id_"))
    of = labels.where(labels[label_col].isNotNull()).groupBy(labels[id_col].alias("id_")).agg((F.max(labels[label_col]) > 0).cast("int").alias("label_"))
    of = materialize(of, "toxic-labels")
    # a copy of the texts by a shuffle only where the labels are too many to send
    few = of.count() <= SENT_LABELS
    return learn(own.join(F.broadcast(of) if few else of, "id_").select("text_", "label_"), params)


def _held_out(id_col: str) -> Column:
    """Null ids are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Toxicity of every whole text.

    Returns ``id, held_out, score double, predicted int, n_tokens long,
    passages`` (start and end in code points, score, surprise), one row per
    input row.  Null and empty texts have no tokens and get the score of a text
    without passages.  Repeated rows stay repeated, a null id stays null and is
    held out.  Other columns are not read.
    """
    own = docs.select(docs[id_col].alias("id_"), docs[text_col].alias("text_in_"))
    found = segments(own, [model], ["id_"], "text_in_").withColumn("surprise", surprise(model))
    value = 1 / (1 + F.exp(-(_x() * model.slope + model.offset)))
    out = found.select(
        F.col("id_").alias(id_col), _held_out("id_").alias("held_out"), value.alias("score"), (value >= model.params.threshold).cast("int").alias("predicted"), "n_tokens",
        F.transform(significant(model), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score"), s["surprise"].alias("surprise"))).alias("passages"),
    )
    return out


def toxic_passages(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``score`` by a model that the labelled, not held-out documents teach; without labels every score is 0.5."""
    return score(docs, fit(docs, labels, params, id_col, text_col, label_col), id_col, text_col)
