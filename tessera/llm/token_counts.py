"""Token counts by trie-shared dynamic programming (operator 2).

A worker inserts the distinct pre-tokens of its texts into a trie, in byte order
of each chunk's new ones.  The forward pass of a unigram model (best log
probability of a prefix, and its last token) runs once for every trie node,
however many words share the prefix; a terminal keeps its word's best
segmentation and how often the word occurs.

The model's probabilities are estimated from the table itself: the
distinct pre-tokens of all documents are counted, in each round they are
segmented by the round's scores, the terminals' counts give how often each token
of the vocabulary is used, and those sums are the next round's scores.  The first round's scores are equal,
so that it takes the fewest tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe, textbytes
from tessera.llm.storage import materialize

#: Terminals that a trie holds; beyond it the counts are handed over and the trie starts empty, results are the same.
TERMINALS = 700_000


def equal_scores(path: str) -> np.ndarray:
    """The first round's score of every token id."""
    return np.full(bpe.vocabulary(path).size, -1.0)


def scores_of(counts: dict[int, int], path: str) -> np.ndarray:
    """Log probability of every token id by its count and one."""
    vocab = bpe.vocabulary(path)
    times = np.ones(vocab.size)
    for token, n in counts.items():
        times[token] += n
    return np.log(times / times[sorted(vocab.ids.values())].sum())


class ForwardTrie:
    """Terminals of a trie of pre-tokens, each with its tokens, score and occurrences, under one table of token scores."""

    def __init__(self, path: str, scores: np.ndarray):
        ids = bpe.vocabulary(path).ids
        self.tokens = {piece: (float(scores[i]), i) for piece, i in ids.items()}
        self.size = len(scores)
        # longest token by its last three bytes: where a token can end tells how far back it can begin
        self.longest: dict[bytes, int] = {}
        for piece in ids:
            if len(piece) > self.longest.get(piece[-3:], 2):
                self.longest[piece[-3:]] = len(piece)
        self.total = np.zeros(self.size, np.int64)
        self._clear()

    def _clear(self) -> None:
        self.terminal: dict[bytes, int] = {}
        self.score: list[float] = []
        self.best: list[list[int]] = []
        self.count = np.zeros(0, np.int64)

    def forward(self, words: Iterable[bytes]) -> Iterator[tuple[list[int], float]]:
        """(token ids, log probability) of the best segmentation of each of ``words``, which come in byte order.

        The lists hold the forward state of the nodes on the path from the root;
        words that share a prefix share its nodes.  Of equal scores the one with
        fewer tokens counts, then the one with the longer last token.
        """
        look_up, longest = self.tokens.get, self.longest.get
        path, score, count, last = b"", [0.0], [0], [(0, -1)]
        for word in words:
            shared, most = 0, min(len(path), len(word))
            if word[:most] == path[:most]:
                shared = most
            else:
                while word[shared] == path[shared]:
                    shared += 1
            del score[shared + 1 :], count[shared + 1 :], last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                best, fewest, back = -math.inf, 0, (0, -1)
                reach = longest(word[end - 3 : end], 2) if end > 2 else end
                for start in range(end - reach if end > reach else 0, end):
                    found = look_up(word[start:end])
                    if found is not None:
                        total = score[start] + found[0]
                        if total > best or total == best and count[start] + 1 < fewest:
                            best, fewest, back = total, count[start] + 1, (start, found[1])
                score.append(best)
                count.append(fewest)
                last.append(back)
            path, ids, at = word, [], len(word)
            while at:
                at, token = last[at]
                ids.append(token)
            ids.reverse()
            yield ids, score[-1]

    def insert(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """Terminal numbers of distinct words that occur so often; new words get their forward scores."""
        if len(self.terminal) > TERMINALS:
            self.hand_over()
        known = self.terminal
        new = sorted(w for w in words if w not in known)
        for word, (ids, score) in zip(new, self.forward(new), strict=True):
            known[word] = len(self.best)
            self.best.append(ids)
            self.score.append(score)
        at = np.array([known[w] for w in words], np.int64)
        self.count = np.concatenate([self.count, np.zeros(len(self.best) - len(self.count), np.int64)])
        self.count[at] += times
        return at

    def hand_over(self) -> np.ndarray:
        """Uses of every token id so far: the terminals' counts times their segmentations; the trie is emptied."""
        if self.best:
            sizes = np.array([len(b) for b in self.best])
            flat = np.fromiter((t for b in self.best for t in b), np.int64, int(sizes.sum()))
            self.total += np.bincount(flat, np.repeat(self.count, sizes), self.size).astype(np.int64)
        self._clear()
        return self.total


def _words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
    """(first row, end row, index of each text's first pre-token and an end, number of every pre-token among the chunk's distinct ones, those, occurrences)."""
    for a, b, buf, offsets in textbytes.chunks(column):
        words, first = textbytes.pretokens(buf, offsets)
        coded = words.dictionary_encode()
        at = coded.indices.to_numpy()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        yield a, b, first, at, distinct, np.bincount(at, minlength=len(distinct))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word binary, n long``: how often each distinct pre-token stands in all texts; every task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for *_, distinct, times in _words(batch.column(0)):
                for word, n in zip(distinct, times.tolist(), strict=True):
                    seen[word] = seen.get(word, 0) + n
                if len(seen) > TERMINALS:
                    yield rows()
                    seen.clear()
        yield rows()

    each = textbytes.map_texts(docs.select(docs[text_col].cast("string").alias("text")), run, "word binary, n bigint")
    return each.groupBy("word").agg(F.sum("n").alias("n"))


def token_uses(words: DataFrame, path: str, scores: np.ndarray) -> dict[int, int]:
    """How often the best segmentations of ``words(word, n)`` use each token id.

    Every task walks its own words in byte order and sums them, so at most a
    vocabulary of rows leaves it and a vocabulary of sums reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ForwardTrie(path, scores)
        for batch in batches:
            trie.insert(batch.column(0).to_numpy(zero_copy_only=False).tolist(), batch.column(1).to_numpy())
        total = trie.hand_over()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["token", "n"])

    rows = textbytes.map_texts(words.sortWithinPartitions("word"), run, "token int, n bigint")
    return {r["token"]: r["n"] for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def fit(docs: DataFrame, tokenizer: str | None = None, rounds: int = 1, text_col: str = "text") -> np.ndarray:
    """Log probability of every token id of the vocabulary, estimated from all texts; an empty table gives equal ones."""
    path = tokenizer or bpe.default_tokenizer()
    scores, words = equal_scores(path), word_counts(docs, text_col)
    if rounds > 1:
        words = materialize(words, "word-counts")
    for _ in range(rounds):
        scores = scores_of(token_uses(words, path, scores), path)
    return scores


_tries: dict[tuple[str, bytes], ForwardTrie] = {}


def _trie(path: str, scores: np.ndarray) -> ForwardTrie:
    """The Python worker's trie for these scores; one is kept."""
    key = path, scores.tobytes()
    if key not in _tries:
        _tries.clear()
        _tries[key] = ForwardTrie(path, scores)
    return _tries[key]


def token_counts(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", scores: np.ndarray | None = None) -> DataFrame:
    """Unigram token count of every whole text.

    Returns ``id_col, n_pretokens long, n_distinct long, n_tokens long, log_prob
    double`` (rounded to 6 places), one row per input row; repeated rows stay
    repeated.  ``scores`` are those of ``fit``, which reads the table once more
    where none are given.  Null or empty text has zeros.  A null id stays null.
    Other columns are not read.  Narrow maps and one sum by token; memory is
    bounded by one chunk of texts, the longest text and ``TERMINALS``.
    """
    path = tokenizer or bpe.default_tokenizer()
    scores = fit(docs, path, text_col=text_col) if scores is None else scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(path, scores)
        for batch in batches:
            for a, b, first, at, distinct, times in _words(batch.column(1)):
                rows = b - a
                terminals = trie.insert(distinct, times)
                each = np.array([len(trie.best[k]) for k in terminals], np.int64)
                logs = np.array([trie.score[k] for k in terminals], np.float64)
                # occurrences of a word in a text: one (text, word) key
                key, often = np.unique(np.repeat(np.arange(rows), np.diff(first)) * max(len(distinct), 1) + at, return_counts=True)
                text, word = key // max(len(distinct), 1), key % max(len(distinct), 1)
                tokens = np.bincount(text, each[word] * often, rows).astype(np.int64)
                logp = np.bincount(text, logs[word] * often, rows) + 0.0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, rows), pa.array(np.diff(first), pa.int64()), pa.array(np.bincount(text, minlength=rows), pa.int64()), pa.array(tokens), pa.array(np.round(logp, 6))],
                    names=[id_col, "n_pretokens", "n_distinct", "n_tokens", "log_prob"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return textbytes.map_texts(docs.select(docs[id_col], docs[text_col].cast("string").alias("text")), run, f"`{id_col}` {kind}, n_pretokens bigint, n_distinct bigint, n_tokens bigint, log_prob double")
