"""BPE encoding and decoding by prefix-sharing trie traversal (operator 5).

Distinct pre-tokens are inserted into a trie in byte order; a depth-first walk
holds, for every prefix on the current root path, the last token of that
prefix's encoding.  An encoding is the encoding of a shorter prefix plus one
token, so each shared prefix is worked on once, and a word's ids are read by
following last tokens backwards.  A token may end a prefix only if it is
compatible with the last token before it: merging both from bytes, in rank
order, never joins across their border.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import cache, cached_property
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import textbytes

#: Distinct words that a Python worker remembers between batches, about 150 bytes each, by engine, and pairs of tokens; beyond it the memory is emptied, results are the same.
WORDS_KEPT = {"trie": 250_000, "library": 900_000}
PAIRS_KEPT = 100_000
_NEVER = 1 << 60


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-in character of each byte, as byte-level BPE files use it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, merge ranks and border spines of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.ids = {raw(token): i for token, i in spec["model"]["vocab"].items() if all(c in alphabet for c in token)}
        added = spec["added_tokens"]
        self.special = {t["content"].encode(): t["id"] for t in added}
        for t in added:
            if self.ids.get(t["content"].encode()) == t["id"]:
                del self.ids[t["content"].encode()]
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes = [b""] * self.size
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.bytes[i] = token
        self.lengths = [len(t) for t in self.bytes]
        self.longest = max(map(len, self.ids))
        self._merges = spec["model"]["merges"]
        self._raw = raw
        self._spines: tuple[dict, dict] = ({}, {})
        self._fits: dict[int, bool] = {}

    @cached_property
    def merges(self) -> tuple[dict[int, int], dict[int, tuple[int, int, int]]]:
        """(rank of each pair of tokens, numbered as one; left, right and rank of each merged token)."""
        rank: dict[int, int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(self._merges):
            a, b = map(self._raw, pair.split(" ") if isinstance(pair, str) else pair)
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            rank[left * self.size + right] = r
            parts.setdefault(whole, (left, right, r))
        self._merges = None
        return rank, parts

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """(piece at the border, rank of the merge that takes it in) from a byte up to the token; side 0: its end, 1: its start."""
        found = self._spines[side].get(token)
        if found is None:
            found, piece = [(token, _NEVER)], token
            parts = self.merges[1]
            while piece in parts:
                left, right, r = parts[piece]
                piece = left if side else right
                found.append((piece, r))
            found.reverse()
            self._spines[side][token] = found
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether a followed by b is the encoding of their joined bytes."""
        ends, heads, i, j, rank, size = self._spine(a, 0), self._spine(b, 1), 0, 0, self.merges[0], self.size
        while True:
            (x, rx), (y, ry) = ends[i], heads[j]
            across = rank.get(x * size + y, _NEVER)
            if across < rx and across <= ry and across < _NEVER:  # equal ranks merge leftmost first
                result = False
                break
            if rx == ry == _NEVER:
                result = True
                break
            if rx <= ry:
                i += 1
            else:
                j += 1
        if len(self._fits) > PAIRS_KEPT:
            self._fits.clear()
        self._fits[a * self.size + b] = result
        return result

    def encode_words(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of each of ``words``, which come in byte order: a depth-first walk of their trie."""
        look_up, fits, known, longest, lengths, size = self.ids.get, self.fits, self._fits.get, self.longest, self.lengths, self.size
        path, last = b"", [-1]
        for word in words:
            shared, most = 0, min(len(path), len(word))
            if word[:most] == path[:most]:
                shared = most
            else:
                while word[shared] == path[shared]:
                    shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                for start in range(end - longest if end > longest else 0, end):
                    token = look_up(word[start:end])
                    if token is not None:
                        if start:
                            fit = known(last[start] * size + token)
                            if fit is None:
                                fit = fits(last[start], token)
                            if not fit:
                                continue
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no encoding of {word[:end]!r}")
            path, out, end = word, [], len(word)
            while end:
                out.append(last[end])
                end -= lengths[last[end]]
            out.reverse()
            yield out


    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all tokens after one another, begin of each and an end)."""
        return np.frombuffer(b"".join(self.bytes), np.uint8), np.concatenate([[0], np.cumsum(self.lengths)])

    @cached_property
    def decimal(self) -> tuple[np.ndarray, np.ndarray]:
        """(decimal digits of every id and a comma, in rows of equal width; characters used of each)."""
        each = [b"%d," % i for i in range(self.size)]
        width = len(each[-1])
        return np.frombuffer(b"".join(d.ljust(width) for d in each), np.uint8).reshape(-1, width), np.array([len(d) for d in each])


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class WordTable:
    """Ids of the distinct pre-tokens seen, as flat arrays indexed by word number.

    ``engine``: "trie" walks the prefix-sharing trie, "library" asks the tokenizers library.
    """

    def __init__(self, path: str, engine: str = "trie"):
        self.path, self.engine, self.vocab = path, engine, vocabulary(path)
        if engine == "library":
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(path)
            # 0xFF is in no UTF-8 text, so it may stand between words
            self.letters = {b: c for c, b in _byte_alphabet().items()} | {0xFF: " "}
            self.lengths = np.array(self.vocab.lengths)
        self.special = next(iter(self.vocab.special), None)
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.int32)
        self.offset = np.zeros(1 << 14, np.int64)
        self.used = 0

    @property
    def full(self) -> bool:
        """Whether the next call of ``encode`` empties the memory first, so that its numbers begin anew."""
        return len(self.number) > WORDS_KEPT[self.engine]

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        if self.engine == "trie":
            each = list(self.vocab.encode_words(words))
            return np.fromiter(chain.from_iterable(each), np.int32), np.fromiter(map(len, each), np.int64, len(each))
        # the words are pre-tokens already: spelled in the byte alphabet they go to the library's model, past its scanner
        spelled = b"\xff".join(words).decode("latin-1").translate(self.letters).split(" ")
        if len(spelled) != len(words):
            raise ValueError("a text is not UTF-8")
        model = self.library.model
        ids = np.fromiter((t.id for w in spelled for t in model.tokenize(w)), np.int32)
        # a word's tokens have its bytes together
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))) + 1
        return ids, np.diff(ends, prepend=0)

    def numbers(self, distinct: list[bytes]) -> np.ndarray:
        """Word numbers of distinct pre-tokens; new ones are encoded."""
        if self.full:
            self._clear()
        number = self.number
        known = np.fromiter(map(number.get, distinct, repeat(-1)), np.int64, len(distinct))
        unknown = np.flatnonzero(known < 0)
        if not len(unknown):
            return known
        new = [distinct[i] for i in unknown.tolist()]
        k = len(number)
        special = self.vocab.special
        plain = sorted(w for w in new if w not in special) if self.engine == "trie" else [w for w in new if w not in special]
        words = plain + [w for w in new if w in special]
        ids, counts = self._encoded(plain) if plain else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        marks = [special[w] for w in words[len(plain) :]]
        ids, counts = np.concatenate([ids, np.array(marks, np.int32)]), np.concatenate([counts, np.ones(len(marks), np.int64)])
        number.update(zip(words, range(k, k + len(words)), strict=True))
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
        if len(number) + 1 > len(self.offset):
            self.offset = np.concatenate([self.offset, np.zeros(max(len(self.offset), len(words)), np.int64)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.offset[k + 1 : k + 1 + len(words)] = self.used + np.cumsum(counts)
        self.used += len(ids)
        known[unknown] = np.fromiter(map(number.get, new), np.int64, len(new))
        return known

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word number of every pre-token, index of each text's first pre-token and an end)."""
        words, first = textbytes.pretokens(buf, offsets, self.special)
        if not len(words):
            return np.zeros(0, np.int64), first
        coded = words.dictionary_encode()
        return self.numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()], first

    def ids(self, numbers: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, index of each text's first id and an end)."""
        counts = self.counts(numbers)
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self.flat[textbytes.ragged(self.offset[numbers], counts)], ends[first]

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Number of ids of each word."""
        return self.offset[numbers + 1] - self.offset[numbers]


_tables: dict[tuple[str, str], WordTable] = {}


def word_table(path: str, engine: str = "trie") -> WordTable:
    """The Python worker's table; it lasts as long as the worker."""
    if (path, engine) not in _tables:
        _tables[path, engine] = WordTable(path, engine)
    return _tables[path, engine]


def decode(ids: list[int], path: str) -> str:
    """Text of an id sequence, special tokens included."""
    table = vocabulary(path).bytes
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")


def _others(df: DataFrame, own: set[str]) -> list[str]:
    return [c for c in df.columns if c not in own]


def encode_documents(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns ``id_col, n_tokens long, ids array<int> (if keep_ids), ids_sha256
    string, decoded_sha256 string`` and one row per input row: repeated rows stay
    repeated.  Null text is empty: no ids, hashes of the empty string.  A null id
    stays null.  Other input columns are not read, so their names cannot clash.
    The tokenizer file is a path that every executor can open (it is installed
    with the library).  A narrow map: no shuffle, memory bounded by one chunk of
    texts, the longest text and ``WORDS_KEPT`` words.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sha = word_table(path), hashlib.sha256
        pieces, starts = table.vocab.spelled
        digits, sizes = table.vocab.decimal
        column = np.arange(digits.shape[1])
        for batch in batches:
            for a, b, buf, offsets in textbytes.chunks(batch.column(1)):
                numbers, first = table.encode(buf, offsets)
                ids, begin = table.ids(numbers, first)
                long = sizes[ids]
                written, at = digits[ids][column < long[:, None]].tobytes(), np.concatenate([[0], np.cumsum(long)])[begin].tolist()
                long = starts[ids + 1] - starts[ids]
                text, cut = pieces[textbytes.ragged(starts[ids], long)].tobytes(), np.concatenate([[0], np.cumsum(long)])[begin].tolist()
                # the comma after a text's last id goes
                digests = [sha(written[x : max(x, y - 1)]).hexdigest() for x, y in pairwise(at)]
                decoded = [sha(text[x:y].decode("utf-8", "replace").encode()).hexdigest() for x, y in pairwise(cut)]
                out = [batch.column(0).slice(a, b - a), pa.array(np.diff(begin), pa.int64())]
                if keep_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays([*out, pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    fields = [(id_col, kind), ("n_tokens", "bigint"), *([("ids", "array<int>")] if keep_ids else []), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    names = [f for f, _ in fields]
    return textbytes.map_texts(docs.select(docs[id_col], docs[text_col].cast("string").alias("text")), run, ", ".join(f"`{f}` {k}" for f, k in fields))
