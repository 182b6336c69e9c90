"""Language identification by a byte convolutional network (operator 4).

Texts are cut into fixed-length byte windows that cover them wholly.  Byte
embeddings pass through filters of several widths, a rectifier and a maximum
over the window, then a softmax over the learned languages; a text's
probabilities are its windows' means, weighted by their bytes.  Training runs
in numpy on the driver over a bounded sample of labelled texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textbytes

UNKNOWN = "und"


@dataclass(frozen=True)
class Params:
    """texts_per_language and windows_per_text bound the training sample (whole texts are windowed, windows are spread over them); steps: least number of updates, for small samples."""

    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    embedding: int = 8
    texts_per_language: int = 400
    windows_per_text: int = 6
    epochs: int = 5
    steps: int = 600
    batch: int = 64
    rate: float = 0.004
    seed: int = 7


@dataclass
class Model:
    languages: list[str]
    params: Params
    embed: np.ndarray | None = None
    filters: list[np.ndarray] = field(default_factory=list)
    bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None


def _patches(windows: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(windows, width, axis=1)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], p: Params) -> Model:
    """Fits the network to byte windows (n x window, uint8) by Adam; only the winning position of each filter gets a gradient."""
    rng = np.random.default_rng(p.seed)
    d, f, n_out = p.embedding, p.filters, len(languages)
    model = Model(languages, p, rng.normal(0, 0.5, (256, d)).astype(np.float32))
    model.embed[0] = 0
    model.filters = [rng.normal(0, 1 / np.sqrt(w * d), (w, d, f)).astype(np.float32) for w in p.widths]
    model.bias = [np.zeros(f, np.float32) for _ in p.widths]
    model.out = rng.normal(0, 0.1, (f * len(p.widths), n_out)).astype(np.float32)
    model.out_bias = np.zeros(n_out, np.float32)
    weights = [model.embed, model.out, model.out_bias, *model.filters, *model.bias]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    step = 0
    for _ in range(max(p.epochs, -(-p.steps // -(-len(windows) // p.batch)))):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), p.batch):
            some = order[at : at + p.batch]
            x, m = windows[some], len(some)
            pooled, winners = [], []
            for w, kernel, b in zip(p.widths, model.filters, model.bias, strict=True):
                span = x.shape[1] - w + 1
                conv = sum((model.embed @ kernel[k])[x[:, k : k + span]] for k in range(w)) + b
                where = conv.argmax(axis=1)
                winners.append(where)
                pooled.append(np.take_along_axis(conv, where[:, None, :], 1)[:, 0])
            pooled = np.concatenate(pooled, axis=1)
            hidden = np.maximum(pooled, 0)
            logits = hidden @ model.out + model.out_bias
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(m), labels[some]] -= 1
            prob /= m
            grad_hidden = (prob @ model.out.T) * (pooled > 0)
            grad_embed = np.zeros_like(model.embed)
            grad_kernel, grad_bias = [], []
            for i, w in enumerate(p.widths):
                g = grad_hidden[:, i * f : (i + 1) * f]
                seen = np.take_along_axis(_patches(x, w), winners[i][:, :, None], 1)  # m x f x w bytes
                vec = model.embed[seen]
                grad_kernel.append(np.einsum("mf,mfwd->wdf", g, vec))
                grad_bias.append(g.sum(axis=0))
                np.add.at(grad_embed, seen, np.einsum("mf,wdf->mfwd", g, model.filters[i]))
            grad_embed[0] = 0
            step += 1
            for w, a, b, g in zip(weights, first, second, [grad_embed, hidden.T @ prob, prob.sum(axis=0), *grad_kernel, *grad_bias], strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= p.rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return model


class Scorer:
    """Network of a model with each filter's responses to byte pairs tabulated, so that a window costs few look-ups a byte."""

    def __init__(self, model: Model):
        self.model = model
        self.tables = []
        for kernel in model.filters:
            single = [model.embed @ k for k in kernel]
            pairs = [(single[k][:, None, :] + single[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, len(single) - 1, 2)]
            self.tables.append((pairs, single[-1] if len(single) % 2 else None))

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        x = windows.astype(np.int32)
        pair = (x[:, :-1] << 8) | x[:, 1:]
        pooled = []
        for w, (pairs, single), bias in zip(self.model.params.widths, self.tables, self.model.bias, strict=True):
            span = x.shape[1] - w + 1
            conv = np.take(pairs[0], pair[:, :span], axis=0)
            for k, table in enumerate(pairs[1:], 1):
                conv += np.take(table, pair[:, 2 * k : 2 * k + span], axis=0)
            if single is not None:
                conv += np.take(single, x[:, w - 1 : w - 1 + span], axis=0)
            pooled.append(conv.max(axis=1) + bias)
        logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.model.out + self.model.out_bias
        prob = np.exp(logits - logits.max(axis=1, keepdims=True))
        return prob / prob.sum(axis=1, keepdims=True)


def windows_of(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows that cover every text, padded with zeros; each one's text; each one's bytes)."""
    length = np.diff(offsets)
    per = -(-length // size)
    text = np.repeat(np.arange(len(length)), per)
    begin = np.repeat(offsets[:-1], per) + textbytes.ragged(np.zeros(len(per), np.int64), per) * size
    used = np.minimum(offsets[1:][text] - begin, size)
    padded = np.concatenate([buf, np.zeros(size, np.uint8)])
    out = padded[begin[:, None] + np.arange(size)]
    short = np.flatnonzero(used < size)
    out[short] *= np.arange(size) < used[short, None]
    return out, text, used


def hold_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves no rest by 5; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_windows(docs: DataFrame, p: Params, id_col: str, text_col: str, lang_col: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A bounded sample of byte windows of labelled texts outside the held-out fifth.

    At most ``texts_per_language`` texts of each language, those with the
    smallest hash of their id, so that the sample is the same at every layout.
    """
    rows = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~hold_out(F.col("id"))).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    counts = {r.lang: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return np.zeros((0, p.window), np.uint8), np.zeros(0, np.int64), []
    want = p.texts_per_language
    limit = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, float(min(1.0, (want + 6 * want**0.5) / n) * (1 << 30)))])
    picked = rows.where(F.col("h") < limit[F.col("lang")])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    picked = picked.withColumn("rank", rank).where(F.col("rank") <= want)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in textbytes.chunks(batch.column(0)):
                windows, text, _ = windows_of(buf, offsets, p.window)
                per = np.bincount(text, minlength=b - a)
                first = np.concatenate([[0], np.cumsum(per)])[:-1]
                take = np.minimum(per, p.windows_per_text)
                k = textbytes.ragged(np.zeros(len(take), np.int64), take)
                own = np.repeat(np.arange(b - a), take)
                at = first[own] + k * per[own] // np.maximum(take[own], 1)
                yield pa.RecordBatch.from_arrays([pa.array([windows[i].tobytes() for i in at], pa.binary()), batch.column(1).slice(a, b - a).take(pa.array(own))], names=["window", "lang"])

    got = textbytes.map_texts(picked.select("text", "lang"), cut, "window binary, lang string").toPandas().sort_values(["lang", "window"], kind="stable")
    languages = sorted(counts)
    x = np.frombuffer(b"".join(bytes(w) for w in got["window"]), np.uint8).reshape(-1, p.window)
    return x, np.searchsorted(languages, got["lang"].to_numpy().astype(str)), languages


def fit(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages labelled in ``docs``; without any it knows none and predicts ``und``."""
    windows, labels, languages = training_windows(docs, params, id_col, text_col, lang_col)
    if not len(windows):
        return Model([], params)
    return train(windows, labels, languages, params)


_BATCH = 512
_scorers: dict[int, Scorer] = {}


def _predict(model: Model, buf: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    rows = len(offsets) - 1
    cls = textbytes.byte_classes(buf)
    letters = np.concatenate([[0], np.cumsum(cls == textbytes.LETTER)])
    has = letters[offsets[1:]] > letters[offsets[:-1]]
    if not model.languages or not has.any():
        return [UNKNOWN] * rows, np.zeros(rows)
    scorer = _scorers.get(id(model))
    if scorer is None:
        _scorers.clear()
        scorer = _scorers[id(model)] = Scorer(model)
    windows, text, used = windows_of(buf, offsets, model.params.window)
    prob = np.zeros((rows, len(model.languages)))
    for at in range(0, len(windows), _BATCH):
        some = slice(at, at + _BATCH)
        np.add.at(prob, text[some], scorer.probabilities(windows[some]) * used[some, None])
    prob /= np.maximum(np.diff(offsets), 1)[:, None]
    best = prob.argmax(axis=1)
    score = np.where(has, np.clip(prob[np.arange(rows), best], 0, 1), 0)
    return [model.languages[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), has.tolist(), strict=True)], score


def with_language(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with the predicted language (string) and its score (double) added under ``names``.

    Only the text is looked at.  ``und`` with score 0 where text is null or has
    no letter, or the model knows no language.  Columns of these two names in
    the input are replaced, so a caller who wants to keep them gives other
    names; all others are kept as they are.  A narrow map.
    """
    keep = docs.drop(*names)
    at = keep.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, buf, offsets in textbytes.chunks(batch.column(at)):
                language, score = _predict(model, buf, offsets)
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(language, pa.string()), pa.array(score)], names=[*own.schema.names, *names])

    schema = T.StructType([*keep.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return textbytes.map_texts(keep, run, schema)


def identify(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id, held_out boolean, lang_pred string, score double`` of every row; trained on the rows not held out.

    Repeated rows stay repeated, a null id stays null and is not held out.
    Null or letterless text is ``und`` with score 0.
    """
    model = fit(docs, params, id_col, text_col, lang_col)
    named = with_language(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")), model)
    return named.select(F.col("id").alias(id_col), hold_out(F.col("id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
