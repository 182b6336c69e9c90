"""The corpus pipeline against a brute-force version on a small fixture."""

from __future__ import annotations

import hashlib

import corpus_pipeline
from tessera.llm import mixing
from tessera.llm.storage import materialize
from tests.llm.test_text import brute_components, library, spans_of  # noqa: F401

DATA = "/root/testdata/sf0.001"


def redacted(text):
    found = sorted((int(s.split(":")[1]), -int(s.split(":")[2]), s.split(":")[0]) for s in spans_of(text))
    out, at = "", 0
    for a, b, kind in found:
        if a < at:
            at = max(at, -b)
            continue
        out += text[at:a] + f"[{kind.upper()}]"
        at = -b
    return out + text[at:]


def test_pipeline(spark, library):  # noqa: F811
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "pii", "mix", "bpe"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    named = corpus_pipeline.language(spark, docs, DATA)
    assert named.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in named.collect()}
    assert len(rows) >= 0.97 * docs.count()
    order = sorted(rows)
    _, root = brute_components([rows[i] for i in order], 5)
    kept = [order[i] for i, r in enumerate(root) if r == i]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, DATA).collect()}
    assert sorted(got) == kept
    for i in kept:
        ids = library.encode(redacted(rows[i]), add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded_sha256"] == hashlib.sha256(redacted(rows[i]).encode()).hexdigest()


def test_order_of_the_schedule_reaches_the_output(spark):
    rows = [(i, f"text number {i} of the corpus", "en", "hot" if i % 3 else f"s{i % 7}", 20) for i in range(700)]
    docs = spark.createDataFrame([*rows, (None, "no id", "en", "hot", 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mixed = materialize(corpus_pipeline.mix(spark, docs, DATA), "mixed")
    want = {r["doc_id"]: (r["slot"], r["position"]) for r in mixing.plan(docs).select("doc_id", "mix_.slot", "mix_.position").collect()}
    got = corpus_pipeline.encode(spark, mixed, DATA).collect()
    assert [r["doc_id"] for r in got] == sorted(want, key=want.get)
    assert all((r["slot"], r["position"]) == want[r["doc_id"]] for r in got)
    out = [(r["slot"], r["position"]) for r in corpus_pipeline.run(spark, DATA).collect()]
    assert out == sorted(out) and len(set(out)) == len(out)


def test_language_stage_keeps_documents_without_any_label(spark):
    texts = ["Some plain text.", "Ein Satz auf Deutsch.", "漢字", "12 34 !?", "", None]
    docs = spark.createDataFrame([(i, t, None, "a", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    named = corpus_pipeline.language(spark, docs, DATA)
    assert named.columns == docs.columns and sorted(r["doc_id"] for r in named.collect()) == [0, 1, 2]
