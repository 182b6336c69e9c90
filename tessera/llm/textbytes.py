"""Vectorised text scanning over Arrow string buffers (numpy, no per-row Python).

``chunks`` yields runs of whole texts as one UTF-8 byte array with offsets, so
that memory is bounded by ``CHUNK_BYTES`` plus the longest single text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

CHUNK_BYTES = 1 << 21
#: Bytes of an Arrow batch between Spark and Python (one row more, however long), unless the session sets its own limit.
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_UNSET = f"{(1 << 31) - 2}b"  # what a session without a limit of its own answers
LETTER, NUMBER, OTHER, SPACE, SPECIAL = 1, 2, 3, 4, 9


def release() -> None:
    """Gives memory that a Python worker has freed back to the machine, where its C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


def map_texts(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` in batches of bounded bytes; a worker returns its free memory after each partition.

    The limit is a setting of the session; it is set here only where the session has none.
    """
    conf = df.sparkSession.conf
    if conf.get(_LIMIT, _UNSET) == _UNSET:
        conf.set(_LIMIT, str(BATCH_BYTES))

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return df.mapInArrow(partition, schema)


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    _, off, data = col.buffers()
    off = np.frombuffer(off, dtype=np.int64 if pa.types.is_large_string(col.type) else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = int(np.searchsorted(off, off[first] + limit, side="right")) - 1
        end = min(max(end, first + 1), n)
        yield first, end, data[off[first] : off[end]], off[first : end + 1] - off[first]
        first = end


@cache
def codepoint_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
    return table


@cache
def _byte_classes() -> np.ndarray:
    return np.concatenate([codepoint_classes()[:128], np.full(128, OTHER, np.uint8)])


def byte_classes(buf: np.ndarray) -> np.ndarray:
    """Class of the character that each byte belongs to."""
    cls = _byte_classes()[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b0 = buf[lead].astype(np.int32)
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        last = len(buf) - 1
        tail = [buf[np.minimum(lead + k, last)].astype(np.int32) & 0x3F for k in (1, 2, 3)]
        point = np.where(size == 2, (b0 & 0x1F) << 6 | tail[0], np.where(size == 3, (b0 & 0x0F) << 12 | tail[0] << 6 | tail[1], (b0 & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))
        kind = codepoint_classes()[np.minimum(point, 0x10FFFF)]
        cls[lead] = kind
        for k in (1, 2, 3):
            at = size > k
            cls[np.minimum(lead[at] + k, last)] = kind[at]
    return cls


def pretoken_starts(buf: np.ndarray, offsets: np.ndarray, special: bytes | None = None) -> np.ndarray:
    """Byte offsets at which the pre-tokens of a byte-level BPE begin.

    The rule is the published pattern
    ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
    evaluated over runs of equal character class.  Every byte belongs to exactly
    one pre-token; texts never share one.  ``special`` marks a string that is
    one pre-token by itself and ends the text before it.
    """
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    cls = byte_classes(buf)
    doc_start = np.zeros(n + 1, bool)
    doc_start[offsets] = True
    cut = np.empty(n, bool)
    cut[0] = True
    if special and special[0] in buf[:: 1]:
        text = buf.tobytes()
        at = text.find(special)
        hits = []
        while at >= 0:
            end = at + len(special)
            if not doc_start[at + 1 : end].any():
                hits.append(at)
                at = text.find(special, end)
            else:
                at = text.find(special, at + 1)
        for at in hits:
            cls[at : at + len(special)] = SPECIAL
    else:
        hits = []
    np.not_equal(cls[1:], cls[:-1], out=cut[1:])
    cut |= doc_start[:n]
    for at in hits:
        cut[at] = True
    run = np.flatnonzero(cut)
    kind = cls[run]
    end = np.append(run[1:], n)
    starts = cut
    followed = np.zeros(len(run), bool)
    followed[:-1] = (kind[:-1] == SPACE) & ~doc_start[run[1:]] & (kind[1:] != SPECIAL)
    which = np.flatnonzero(followed)
    if len(which):
        last = end[which] - 1
        for _ in range(2):  # white space takes three bytes at most
            back = (buf[last] & 0xC0) == 0x80
            last = np.where(back, last - 1, last)
        starts[last] = True
        starts[end[which][buf[last] == 0x20]] = False
    which = np.flatnonzero((kind[:-1] == OTHER) & (end[:-1] - run[:-1] == 1) & (kind[1:] == LETTER) & (buf[run[:-1]] == 0x27) & starts[run[:-1]] & ~doc_start[run[1:]])
    if len(which):
        after, stop = run[which + 1], end[which + 1]
        one = buf[after]
        two = buf[np.minimum(after + 1, n - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = (stop - after >= 2) & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        size = np.where(short, 1, np.where(pair, 2, 0))
        hit = size > 0
        starts[after[hit]] = False
        more = hit & (after + size < stop)
        starts[(after + size)[more]] = True
    return np.flatnonzero(starts)


def pretokens(buf: np.ndarray, offsets: np.ndarray, special: bytes | None = None) -> tuple[pa.Array, np.ndarray]:
    """(binary array of all pre-tokens in order, index of each text's first one, and an end)."""
    starts = pretoken_starts(buf, offsets, special)
    bounds = np.append(starts, len(buf)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(buf))])
    return words, np.searchsorted(starts, offsets)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every (start, count) after one another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain splitmix constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, inverse)]), dtype=np.uint64)
    return up, down


@cache
def _letters() -> np.ndarray:
    """Random 64-bit value of each byte, A-Z as a-z."""
    fold = np.arange(256)
    fold[65:91] += 32
    return mix64((fold + 1).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, first word of each text and an end)."""
    n = len(buf)
    blank = (buf == 0x20) | ((buf >= 0x09) & (buf <= 0x0D))
    inside = ~blank
    begin = np.empty(n, bool)
    if n:
        begin[0] = inside[0]
        begin[1:] = inside[1:] & blank[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[heads] |= inside[heads]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    doc_end = np.zeros(n + 1, bool)
    doc_end[offsets] = True
    stop = np.empty(n, bool)
    stop[-1] = inside[-1]
    stop[:-1] = inside[:-1] & (blank[1:] | doc_end[1:n])
    ends = np.flatnonzero(stop) + 1
    size = 1 << max(n, 1).bit_length()
    up, down = _powers(max(size, CHUNK_BYTES))
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_letters()[buf] * up[:n], dtype=np.uint64, out=total[1:])
        hashed = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashed, np.searchsorted(starts, offsets)
