"""Token-id files by an adaptive context-mixing range coder (operator 10).

A file is a table of frames in ascending id order of the documents, written by
the engine's own committing writer, so a lost executor leaves no half file.  A
frame holds whole documents as the ids of its distinct words (pre-tokens, and
the end of a document), the most frequent first, and then the places of all words
in that list: on common texts that is far fewer numbers than ids.  Both are one
run of numbers, cut into blocks; blocks start from a reset model, carry their
own CRC-32 and decode alone.  All blocks of a frame (the lanes) are coded side
by side, one number of every block at a time, in integer arithmetic only, so
that any machine decodes what another encoded.  Below, "id" is any such number.

For each id, a table of order-2 contexts and one of order-1 contexts each guess
an id.  A guess's confidence and the lane's recent hit rate (order 0) are mixed
in the logistic domain with weights learned on the way.  The mixed probabilities split the coder's range into "the order-2
guess", "the order-1 guess" and the order-0 shares of the id's high part, which
follow the lane's own counts; the low part takes equal shares of the high
part's.  One step of the coder takes all of an id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import bpe, textbytes
from tessera.llm.storage import scratch_path

_U = np.uint64
_WORD = _U(32)
_LOW32 = _U(0xFFFFFFFF)
#: Bits of the shares of guesses and high parts, of the order-0 counts, and least count of a high part.
_SHARE, _COUNT, _LEAST = 16, 14, 4


#: What a guess's confidence says in the logistic domain, and how it changes by the old one, after a miss (it is halved) and after a hit (one more, 7 at most).
_BELIEF = np.array([-1900, -250, 60, 340, 540, 780, 1050, 1300], np.int32)
_CONFIDENCE = np.array([-((c + 1) >> 1) for c in range(8)] + [1] * 7 + [0], np.int32)


@dataclass(frozen=True)
class Params:
    """block: ids coded from one reset; frame: ids after which a frame closes at the next document end; low_bits: of an id, coded in equal shares; contexts: slots of each order in a block; refresh: ids after which the order-0 shares follow the counts."""

    block: int = 1024
    frame: int = 10_000_000
    low_bits: int = 10
    contexts: int = 512
    refresh: int = 64
    end_id: int = 2

    def low(self, id_bits: int) -> int:
        """Bits coded in equal shares: more where ids are so long that their high parts would be too many."""
        found = max(self.low_bits, min(id_bits - 6, 32 - _SHARE), id_bits - 8)
        if found > 32 - _SHARE:
            raise ValueError(f"ids of {id_bits} bits are too long")
        return found


@cache
def _squash() -> tuple[np.ndarray, np.ndarray]:
    """Integer logistic tables: 12-bit probability of a stretch in -2047..2047, and its inverse."""
    knots = [1, 2, 3, 6, 10, 16, 27, 45, 73, 120, 194, 310, 488, 747, 1101, 1546, 2047, 2549, 2994, 3348, 3607, 3785, 3901, 3975, 4022, 4050, 4068, 4079, 4085, 4089, 4092, 4093, 4094]
    d = np.arange(-2048, 2048)
    w, at = d & 127, (d >> 7) + 16
    k = np.array([*knots, knots[-1]])
    squash = ((k[at] * (128 - w) + k[at + 1] * w + 64) >> 7).astype(np.int32)
    stretch = np.searchsorted(squash, np.arange(4096), side="left").clip(0, 4095).astype(np.int32) - 2048
    return squash, stretch


class _Model:
    """State of all lanes: guesses with confidences, mixing weights, hit rates and order-0 counts.

    Both decisions (order-2 guess right, else order-1 guess right) are stacked,
    so that a step is few vector operations.  A guess is its id in the upper
    bits of a cell and its confidence of 0 to 7 in the lower three.
    """

    def __init__(self, lanes: int, p: Params, id_bits: int):
        self.p, self.lanes, self.step = p, lanes, 0
        self.lane = np.arange(lanes)
        self.low = p.low(id_bits)
        self.base = np.stack([self.lane, self.lane + lanes]) * p.contexts
        self.table = np.zeros(2 * lanes * p.contexts, np.int32)
        self.weight = np.full((2, 2, lanes), 3 << 14, np.int32)
        self.input = np.empty((2, 2, lanes), np.int32)
        self.recent = np.full((2, lanes), 1 << 14, np.int32)
        self.high = max(2, 1 << max(0, id_bits - self.low))
        self.freq = np.full((self.high, lanes), 2, np.int32)
        self.share = np.empty((self.high + 1, lanes), np.int32)
        self._reshare()

    def _reshare(self) -> None:
        """Running order-0 shares of the high parts, from the counts: they sum to a fixed power of two."""
        total = np.cumsum(self.freq, axis=0, dtype=np.int64)
        free = (1 << _COUNT) - _LEAST * self.high
        unit = (free << 24) // total[-1]
        self.share[0] = 0
        self.share[1:] = (total * unit >> 24) + _LEAST * np.arange(1, self.high + 1)[:, None]
        self.share[-1] = 1 << _COUNT
        # begin and end of a part in one cell
        self.ends = self.share[:-1] << _COUNT + 1 | self.share[1:]

    def span(self, ends: np.ndarray, both: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, size) in the coder's range of parts by their cells."""
        begin = both + ((ends >> _COUNT + 1) * left >> _COUNT)
        return begin.astype(np.int64), (both + ((ends & (2 << _COUNT) - 1) * left >> _COUNT) - begin).astype(np.int64)

    def counted(self, ids: np.ndarray, step: int) -> None:
        """Adds the high parts of the last ``ids`` (steps x lanes) to the counts; older counts fade."""
        cell = (ids >> self.low).astype(np.int64) * self.lanes + self.lane
        if step >= self.p.refresh:
            self.freq -= self.freq >> 2
        self.freq += 16 * np.bincount(cell.ravel(), minlength=self.freq.size).reshape(self.freq.shape).astype(np.int32)
        self._reshare()

    def refreshes(self, steps: int) -> list[int]:
        """Steps before which the order-0 shares change: early ones at powers of two, later ones evenly apart."""
        at, out = 8, []
        while at < steps:
            out.append(at)
            at += min(at, self.p.refresh)
        return out

    def slots(self, last: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Table cells of both orders' contexts; the ids may be of many steps."""
        last, before = last.view(np.uint32), before.view(np.uint32)
        out = np.empty((*last.shape[:-1], 2, self.lanes), np.int64)
        shift = np.uint32(32 - (self.p.contexts.bit_length() - 1))
        np.add((last * np.uint32(0x9E3779B1) + before * np.uint32(0x85EBCA77)) >> shift, self.base[0], out=out[..., 0, :], casting="unsafe")
        np.add((last * np.uint32(0xC2B2AE35)) >> shift, self.base[1], out=out[..., 1, :], casting="unsafe")
        return out

    def predict(self, slot: np.ndarray) -> None:
        """Guesses of both orders at ``slot`` and the shares of the coder's range that they get."""
        # look-ups are in range but for the last, which is meant to clip; this mode is faster as it never raises
        squash, stretch = _squash()
        self.entry = entry = self.table.take(slot, mode="clip")
        self.said = entry >> 3
        self.sure = sure = entry & 7
        self.same = self.said[0] == self.said[1]
        self.input[:, 0] = _BELIEF.take(sure, mode="clip")
        self.input[:, 1] = stretch.take(self.recent >> 4, mode="clip")
        dot = (self.weight[:, 0] * self.input[:, 0] + self.weight[:, 1] * self.input[:, 1]) >> 16
        dot += 2048
        self.chance = squash.take(dot, mode="clip")
        self.share2 = share2 = np.clip(self.chance[0] << 4, 64, 57344)
        rest = 65536 - share2
        share1 = np.minimum(np.maximum((rest * self.chance[1]) >> 12, 16), rest - 4096)
        share1 *= ~self.same
        self.share1 = share1
        self.both = share2 + share1
        self.left = rest - share1

    def update(self, slot: np.ndarray, ids: np.ndarray, hit: np.ndarray) -> None:
        """Learns that ``ids`` came; ``hit``: which guesses were right."""
        active = ~(hit[0] | self.same)
        error = hit * np.int32(4095) - self.chance
        error[1] *= active
        weight = self.weight
        weight += (self.input * error[:, None]) >> 10
        self.step += 1
        if not self.step & 15:  # a weight moves less than 2 ** 13 in a step, so no product overflows between
            np.clip(weight, -(1 << 18), 1 << 18, out=weight)
        aim = hit * np.int32(65535)
        move = (aim - self.recent) >> 4
        move[1] *= active
        self.recent += move
        sure = self.sure
        entry = self.entry + _CONFIDENCE.take(sure + hit * np.int32(8), mode="clip")
        fresh = ids << 3
        entry -= fresh
        entry *= hit | (sure > 0)
        entry += fresh
        self.table[slot] = entry


def _windows(model: _Model, steps: int) -> Iterator[tuple[int, int]]:
    """Runs of steps between changes of the order-0 shares."""
    edges = [0, *model.refreshes(steps), steps]
    return zip(edges[:-1], edges[1:], strict=True)


def _settle(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Lanes whose first word is settled or, where the range is too narrow, is made so by cutting the range."""
    settled = (low ^ (low + width)) <= _LOW32
    tight = width <= _LOW32
    tight &= ~settled
    if tight.any():
        width[tight] = (~low[tight] + _U(1)) & _LOW32
        settled |= tight
    return settled


def encode_blocks(ids: np.ndarray, p: Params, id_bits: int) -> tuple[list[bytes], np.ndarray]:
    """(code of each block, CRC-32 of each block's ids as little-endian 32-bit) of a run of ids."""
    if not len(ids):
        return [], np.zeros(0, np.int64)
    lanes, steps = -(-len(ids) // p.block), min(p.block, len(ids))
    padded = np.zeros(lanes * p.block, np.int32)
    padded[: len(ids)] = ids
    # two rows of zeros before the first id are its contexts
    grid = np.zeros((steps + 2, lanes), np.int32)
    grid[2:] = padded.reshape(lanes, p.block).T[:steps]
    del padded
    model = _Model(lanes, p, id_bits)
    bits = model.low
    mask, scale, unit_bits = (1 << bits) - 1, np.int64(1 << bits), _U(_SHARE + bits)
    low, width = np.zeros(lanes, _U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
    out = np.zeros((lanes, steps + 8), np.uint32)
    flat = out.reshape(-1)
    at_word = np.arange(lanes) * out.shape[1]
    with np.errstate(over="ignore"):
        for first, stop in _windows(model, steps):
            if first:
                model.counted(grid[last_first + 2 : first + 2], first)
            last_first = first
            rows = grid[first + 2 : stop + 2]
            slots = model.slots(grid[first + 1 : stop + 1], grid[first:stop])
            cell = (rows >> bits).astype(np.int64) * lanes + model.lane
            ends = model.ends.take(cell)
            lows = (rows & mask).astype(np.int64)
            for k in range(stop - first):
                now, slot = rows[k], slots[k]
                model.predict(slot)
                hit = model.said == now
                begin, size = model.span(ends[k], model.both, model.left)
                at = begin * scale + lows[k] * size
                # products with truth values choose: random masks are slower
                first_share, second = model.share2 * scale, hit[1] > hit[0]
                plain = ~(hit[0] | second)
                at *= plain
                at += first_share * second
                size *= plain
                size += first_share * hit[0]
                size += model.share1 * (scale * second)
                unit = width >> unit_bits
                low += unit * at.view(_U)
                width = unit * size.view(_U)
                move = _settle(low, width)
                flat[at_word] = low >> _WORD  # a lane that does not move on writes its word again
                at_word += move
                shift = move * _WORD
                low <<= shift
                width <<= shift
                model.update(slot, now, hit)
        for _ in range(2):
            flat[at_word] = low >> _WORD
            at_word += 1
            low = low << _WORD
    little = ids.astype("<u4")
    used = at_word - np.arange(lanes) * out.shape[1]
    codes = [out[k, : used[k]].astype("<u4").tobytes() for k in range(lanes)]
    return codes, np.array([zlib.crc32(little[k * p.block : (k + 1) * p.block].tobytes()) for k in range(lanes)], np.int64)


def decode_blocks(codes: list[bytes], count: int, sums: np.ndarray, p: Params, id_bits: int) -> np.ndarray:
    """The ``count`` ids of a frame; raises if a block's checksum differs."""
    lanes = len(codes)
    if not lanes:
        return np.zeros(0, np.int32)
    size = np.array([len(c) // 4 for c in codes])
    source = np.zeros((lanes, int(size.max()) + 8), _U)
    for k, c in enumerate(codes):
        source[k, : size[k]] = np.frombuffer(c, "<u4")
    flat = source.reshape(-1)
    model = _Model(lanes, p, id_bits)
    bits = model.low
    scale, unit_bits, top = np.int64(1 << bits), _U(_SHARE + bits), _U((1 << (_SHARE + bits)) - 1)
    low, width = np.zeros(lanes, _U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, _U)
    value = source[:, 0] << _WORD | source[:, 1]
    at_word = np.arange(lanes) * source.shape[1] + 2
    steps = min(p.block, count)
    grid = np.zeros((steps + 2, lanes), np.int32)
    with np.errstate(over="ignore"):
        for first, end in _windows(model, steps):
            if first:
                model.counted(grid[last_first + 2 : first + 2], first)
            last_first = first
            shares = model.share.reshape(-1)
            for k in range(first, end):
                slot = model.slots(grid[k + 1], grid[k])
                model.predict(slot)
                unit = width >> unit_bits
                spot = np.minimum((value - low) // unit, top).view(np.int64)
                share = (spot >> bits).astype(np.int32)
                hit2 = share < model.share2
                now = np.where(hit2, model.said[0], model.said[1])
                at = np.where(hit2, 0, model.share2 * scale)
                size = np.where(hit2, model.share2, model.share1) * scale
                plain = np.flatnonzero(share >= model.both)
                if len(plain):
                    both, left = model.both[plain], model.left[plain]
                    # a part's share begins at floor(shares * left): it is the last one at or before this
                    most = (((share[plain] - both + 1) << _COUNT) - 1) // left
                    place, jump = plain.copy(), model.high >> 1
                    while jump:
                        place += (shares.take(place + jump * lanes, mode="clip") <= most) * (jump * lanes)
                        jump >>= 1
                    begin, own = model.span(model.ends.take(place), both, left)
                    begin *= scale
                    rest = (spot[plain] - begin) // own
                    now[plain] = (place // lanes << bits) + rest
                    at[plain] = begin + rest * own
                    size[plain] = own
                grid[k + 2] = now
                low += unit * at.view(_U)
                width = unit * size.view(_U)
                move = _settle(low, width)
                shift = move * _WORD
                low <<= shift
                width <<= shift
                value <<= shift
                value |= flat.take(at_word, mode="clip") * move
                at_word += move
                model.update(slot, now, model.said == now)
    ids = np.ascontiguousarray(grid[2:].T).ravel()[:count] if lanes > 1 else grid[2:, 0][:count]
    little = ids.astype("<u4")
    for k in range(lanes):
        if zlib.crc32(little[k * p.block : (k + 1) * p.block].tobytes()) != sums[k]:
            raise ValueError(f"checksum of block {k} differs")
    return ids


def _ranked(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct symbols, most frequent first; each symbol's place among them)."""
    uses = np.bincount(symbols)
    found = np.flatnonzero(uses)
    found = found[np.argsort(-uses[found], kind="stable")]
    place = np.zeros(len(uses), np.int32)
    place[found] = np.arange(len(found), dtype=np.int32)
    return found, place[symbols]


def pack(spelled: np.ndarray, sizes: np.ndarray, places: np.ndarray, p: Params, id_bits: int) -> dict:
    """A frame's numbers, coded: ids of its distinct words, ids of each word, place of every word in turn.

    Where words hardly occur again, or are too many, every distinct id is a word.
    """
    count = int(sizes[places].sum())
    if len(sizes) >> 24 or len(spelled) + len(places) > count + np.count_nonzero(np.bincount(spelled)):
        begin = np.cumsum(sizes) - sizes
        spelled, places = _ranked(spelled[textbytes.ragged(begin[places], sizes[places])])
        sizes = np.ones(len(spelled), np.int64)
    bits = max(id_bits, len(sizes).bit_length())
    codes, sums = encode_blocks(np.concatenate([spelled, places]).astype(np.int32, copy=False), p, bits)
    return {"bits": bits, "count": count, "spelled": len(spelled), "places": len(places), "words": zlib.compress(sizes.astype("<u4").tobytes(), 1), "sums": sums.tolist(), "codes": codes}


def unpack(row: dict, p: Params) -> np.ndarray:
    """All ids of a frame; raises if a checksum differs."""
    numbers = decode_blocks(row["codes"], row["spelled"] + row["places"], np.array(row["sums"]), p, row["bits"])
    spelled, places = numbers[: row["spelled"]], numbers[row["spelled"] :]
    sizes = np.frombuffer(zlib.decompress(row["words"]), "<u4").astype(np.int64)
    begin = np.cumsum(sizes) - sizes
    return spelled[textbytes.ragged(begin[places], sizes[places])]


_FRAME = "part int, frame int, bits int, count bigint, spelled bigint, places bigint, words binary, ids array<bigint>, sizes array<bigint>, sums array<bigint>, codes array<binary>"


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encodes every whole text with the tokenizers library, adds ``end_id`` to each and writes files in ascending id order.

    Every text is cut into pre-tokens by the library's own published pattern
    (tests compare with the library on whole texts, fuzzed ones too) and the
    library's model encodes the distinct ones.  A frame also closes where a
    worker's memory of words is full, which changes the files' layout only.
    Null text is empty, a null id sorts
    first, rows of equal id are in order of their text; an empty table writes no
    frame.  Other columns are not read.  Texts are range-partitioned by id
    (balanced, whatever the sources' sizes) and sorted in their partitions.
    """
    p, file = params, tokenizer or bpe.default_tokenizer()
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = bpe.word_table(file, "library")
        id_bits = max(table.vocab.size, p.end_id + 1).bit_length()
        part, frame = TaskContext.get().partitionId(), 0
        keys: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal keys, held, sizes, frame
            words, places = _ranked(np.concatenate(held))
            end = np.flatnonzero(words == 0)
            numbers = np.delete(words, end) - 1
            counts = table.counts(numbers)
            at = counts[: end[0]].sum()
            spelled = np.insert(table.flat[textbytes.ragged(table.offset[numbers], counts)], at, p.end_id)
            packed = pack(spelled, np.insert(counts, end, 1), places, p, id_bits)
            row = pa.RecordBatch.from_pylist([{"part": part, "frame": frame, "ids": keys, "sizes": np.concatenate(sizes).tolist(), **packed}], schema=arrow)
            keys, held, sizes, frame = [], [], [], frame + 1
            return row

        for batch in batches:
            for a, b, buf, offsets in textbytes.chunks(batch.column(1), 2 * textbytes.CHUNK_BYTES):
                if held and table.full:
                    yield close()
                numbers, first = table.encode(buf, offsets)
                ends = np.concatenate([[0], np.cumsum(table.counts(numbers))])
                keys += batch.column(0).slice(a, b - a).to_pylist()
                # 0 ends a document
                held.append(np.insert((numbers + 1).astype(np.int32), first[1:], 0))
                sizes.append(np.diff(ends[first]) + 1)
                if sum(int(s.sum()) for s in sizes) >= p.frame:
                    yield close()
        if held:
            yield close()

    lists = pa.list_(pa.int64())
    arrow = pa.schema([("part", pa.int32()), ("frame", pa.int32()), ("bits", pa.int32()), ("count", pa.int64()), ("spelled", pa.int64()), ("places", pa.int64()), ("words", pa.binary()), ("ids", lists), ("sizes", lists), ("sums", lists), ("codes", pa.list_(pa.binary()))])
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    ordered = rows.repartitionByRange(n, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first())
    textbytes.map_texts(ordered, run, _FRAME).write.option("compression", "uncompressed").parquet(path)


def read_ids(spark, path: str, params: Params = Params(), keep_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32[, ids]`` of every document from files of ``write_ids``."""
    p = params
    frames = spark.read.schema(_FRAME).parquet(path)
    # frames of a part follow one another; parts follow one another: two small running sums, no text or id is moved
    within = Window.partitionBy("part").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    heads = frames.select("part", "frame", "count").withColumn("before", F.coalesce(F.sum("count").over(within), F.lit(0)))
    parts = frames.groupBy("part").agg(F.sum("count").alias("total"))
    earlier = parts.withColumn("offset", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = heads.join(earlier.select("part", "offset"), "part").select("part", "frame", (F.col("offset") + F.col("before")).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row, p)
                ends = np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64)
                little = ids.astype("<u4")
                sums = [zlib.crc32(little[a:b].tobytes()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                n = len(sums)
                cols = [pa.array([row["part"]] * n, pa.int32()), pa.array([row["frame"]] * n, pa.int32()), pa.array(row["ids"], pa.int64()), pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.array(sums, pa.int64())]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    fields = [("part", "int"), ("frame", "int"), ("doc_id", "bigint"), ("at", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint"), *([("ids", "array<int>")] if keep_ids else [])]
    names = [f for f, _ in fields]
    found = textbytes.map_texts(frames, run, ", ".join(f"{f} {k}" for f, k in fields))
    return found.join(offsets, ["part", "frame"]).select("doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else []))


def round_trip(docs: DataFrame, tokenizer: str | None = None, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the files into the shared folder and reads them back."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_ids(docs, path, tokenizer, params, id_col, text_col)
    return read_ids(docs.sparkSession, path, params, keep_ids=False)
