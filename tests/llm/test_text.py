"""Text operators against the tokenizers library, regular expressions and brute force, on awkward small tables."""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, licenses, minhash, mixing, pii, textbytes, token_counts, tokenfile

PIECES = [*"abst 's're'll've'd'm  \n\t  é漢字١٢½²_-..,!?'\"Ⅷ", "<|endoftext|>", "'s", "'re", " 'll", "   ", "\n\n", "aaaa", "hello", " world", "00123", "\r\n", "\U0001f600", " \x1c ", " \x85 "]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, key string, spans string, mark string"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_tokenizer())


def docs(spark, texts, sources=("a", "b")):
    rows = [(i, t, "en", sources[i % len(sources)], None, "x", "k", "s", "m") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


AWKWARD = [None, "", " ", "\n\t", "one", "one two three", "é" * 50, "x" * 30000, "word " * 4000, "a@b.co", "same text again and again", "same text again and again", "<|endoftext|> <|endoftext|>", "don't we'll\n\nnow  "]


def encode_all(texts, engine):
    table, out = bpe.WordTable(bpe.default_tokenizer(), engine), []
    for a, b, buf, offsets in textbytes.chunks(pa.array(texts, pa.string()), 4096):
        ids, begin = table.ids(*table.encode(buf, offsets))
        out += [ids[begin[i] : begin[i + 1]].tolist() for i in range(b - a)]
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=40).map("".join), min_size=1, max_size=8))
def test_encoders_equal_the_library(texts):
    from tokenizers import Tokenizer

    want = [e.ids for e in Tokenizer.from_file(bpe.default_tokenizer()).encode_batch(texts, add_special_tokens=False)]
    assert encode_all(texts, "trie") == want
    assert encode_all(texts, "library") == want
    assert all(bpe.decode(ids, bpe.default_tokenizer()) == t for ids, t in zip(want, texts, strict=True))


def test_bpe_query(spark, library):
    got = {r["doc_id"]: r for r in bpe.encode_documents(docs(spark, AWKWARD)).collect()}
    for i, t in enumerate(AWKWARD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(docs(spark, [])).count() == 0


def test_token_counts_equal_plain_dynamic_programming(spark, library):
    """Estimated probabilities and results of a whole table against a version without tries or tasks."""
    path = bpe.default_tokenizer()
    ids = bpe.vocabulary(path).ids
    texts = [*AWKWARD, "hello help helping the then", "zzzz é " + "ab" * 40, "help the help the help"]

    def cut(t):
        words, _ = textbytes.pretokens(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))
        return [w.as_py() for w in words]

    def plain(w, score):
        best = [(0.0, 0, [])]
        for e in range(1, len(w) + 1):
            found = None
            for s in range(max(0, e - 128), e):
                if w[s:e] in ids:
                    new = (best[s][0] + score[ids[w[s:e]]], best[s][1] + 1, [*best[s][2], ids[w[s:e]]])
                    if found is None or new[0] > found[0] or new[0] == found[0] and new[1] < found[1]:
                        found = new
            best.append(found)
        return best[-1]

    uses = {}
    for t in texts:
        for w in cut(t):
            if len(w) < 400:
                for k in plain(w, token_counts.equal_scores(path))[2]:
                    uses[k] = uses.get(k, 0) + 1
    short = [t for t in texts if t is None or len(t) < 400 or " " in t]
    scores = token_counts.fit(docs(spark, short))
    assert np.allclose(scores, token_counts.scores_of(uses, path))
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs(spark, short)).collect()}
    for i, t in enumerate(short):
        words = cut(t)
        each = [plain(w, scores) for w in words]
        assert (got[i]["n_pretokens"], got[i]["n_distinct"], got[i]["n_tokens"]) == (len(words), len(set(words)), sum(n for _, n, _ in each))
        assert math.isclose(got[i]["log_prob"], sum(p for p, _, _ in each), abs_tol=1e-4)
    # a long word, and tries that are emptied on the way
    keep, token_counts.TERMINALS = token_counts.TERMINALS, 3
    trie = token_counts.ForwardTrie(path, scores)
    for t in short:
        words = cut(t)
        trie.insert(list(dict.fromkeys(words)), np.array([words.count(w) for w in dict.fromkeys(words)], np.int64))
    total = trie.hand_over()
    token_counts.TERMINALS = keep
    assert total.sum() == sum(r["n_tokens"] for r in got.values())
    assert token_counts.token_counts(docs(spark, ["x" * 30000])).first()["n_tokens"] > 0
    assert token_counts.token_counts(docs(spark, [])).count() == 0
    same = spark.createDataFrame([(None, "a b"), (2, "a b"), (2, "a b"), (3, None)], "doc_id bigint, text string")
    assert sorted(((r["doc_id"] or 0, r["n_pretokens"]) for r in token_counts.token_counts(same).collect())) == [(0, 2), (2, 2), (2, 2), (3, 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 50256), st.integers(0, 5)), max_size=400), st.sampled_from([1, 7, 64, 2048]))
def test_range_coder_round_trip(ids, block):
    p = tokenfile.Params(block=block)
    x = np.array(ids, np.int32)
    for bits in (16, 24):
        codes, sums = tokenfile.encode_blocks(x * (1 << bits - 16), p, bits)
        assert (tokenfile.decode_blocks(codes, len(x), sums, p, bits) == x * (1 << bits - 16)).all()


def test_range_coder_blocks_are_apart_and_checked():
    draw = np.random.default_rng(1)
    x = np.minimum(draw.zipf(1.3, 9000), 50000).astype(np.int32)
    p = tokenfile.Params(block=1000)
    codes, sums = tokenfile.encode_blocks(x, p, 16)
    assert sum(map(len, codes)) < 2 * len(x)
    one = tokenfile.decode_blocks([codes[4]], 1000, sums[4:5], p, 16)
    assert (one == x[4000:5000]).all()
    broken = bytes([codes[4][0] ^ 255]) + codes[4][1:]
    with pytest.raises(ValueError, match="checksum"):
        tokenfile.decode_blocks([broken], 1000, sums[4:5], p, 16)


def test_token_files(spark, library, tmp_path):
    rows = docs(spark, AWKWARD).repartition(3)
    tokenfile.write_ids(rows, str(tmp_path / "t"), params=tokenfile.Params(frame=5000))
    got = tokenfile.read_ids(spark, str(tmp_path / "t"), tokenfile.Params(frame=5000)).orderBy("doc_id").collect()
    at = 0
    for r, t in zip(got, AWKWARD, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert tokenfile.round_trip(docs(spark, [])).count() == 0


def test_token_files_code_distinct_words_and_their_places(spark, library, tmp_path):
    draw = np.random.default_rng(3)
    long = [f" {a}{b}{c}" for a in ("zuverkeit", "ingtion", "ñosque") for b in ("heit", "ly", "mente", "bex") for c in ("ung", "ed", "íco", "qz")]
    texts = ["".join(draw.choice(long, 200)) for _ in range(20)]
    tokenfile.write_ids(docs(spark, texts).repartition(2), str(tmp_path / "t"), partitions=1)
    (frame,) = spark.read.parquet(str(tmp_path / "t")).collect()
    # every word is one number, and its ids are spelled once
    assert frame["places"] == 20 * 201 and frame["spelled"] < 500 and frame["places"] + frame["spelled"] < 0.5 * frame["count"]
    got = tokenfile.read_ids(spark, str(tmp_path / "t")).orderBy("doc_id").collect()
    assert [r["ids"] for r in got] == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_words_that_hardly_occur_again_are_coded_by_id():
    draw, p = np.random.default_rng(4), tokenfile.Params(block=100)
    sizes = draw.integers(1, 6, 3000)
    spelled = draw.integers(0, 200, sizes.sum())
    for places in (draw.permutation(3000), draw.permutation(np.repeat(np.arange(3000), 3))):
        row = tokenfile.pack(spelled, sizes, places, p, 16)
        begin = np.cumsum(sizes) - sizes
        assert (tokenfile.unpack(row, p) == np.concatenate([spelled[begin[k] : begin[k] + sizes[k]] for k in places])).all()
        # once each: as many numbers as ids and distinct ids; thrice: the words and their places
        assert row["spelled"] + row["places"] == (row["count"] + 200 if len(places) == 3000 else len(spelled) + 9000)


def test_memory_of_words_tells_when_its_numbers_begin_anew(library, monkeypatch):
    monkeypatch.setitem(bpe.WORDS_KEPT, "library", 100)
    table, emptied = bpe.WordTable(bpe.default_tokenizer(), "library"), 0
    for i in range(20):
        text = " ".join(f"w{i * 31 + k * k}ñ" for k in range(60))
        emptied += table.full
        buf = np.frombuffer(text.encode(), np.uint8)
        numbers, first = table.encode(buf, np.array([0, len(buf)]))
        ids, _ = table.ids(numbers, first)
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and len(ids) == table.counts(numbers).sum()
    assert emptied > 1


def test_token_files_with_null_and_repeated_ids(spark, library):
    rows = [(3, "three"), (None, "none"), (3, "another three"), (3, "three"), (1, None)]
    got = tokenfile.round_trip(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)).orderBy("start").collect()
    at = 0
    for r, (i, t) in zip(got, [(None, "none"), (1, ""), (3, "another three"), (3, "three"), (3, "three")], strict=True):
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def words_of(t):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))


def brute_components(texts, k):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def copies(draw, base, rate):
    return " ".join(f"w{draw.randrange(10**6)}" if draw.random() < rate else w for w in base.split())


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_brute_force(spark, k):
    draw = random.Random(k)
    texts = list(AWKWARD)
    for _ in range(8):
        base = " ".join(f"v{draw.randrange(3000)}" for _ in range(draw.choice([12, 60, 400])))
        texts += [copies(draw, base, rate) for rate in (0, 0, 0.005, 0.02, 0.03, 0.04, 0.05, 0.1)]
    hot = " ".join(f"h{i}" for i in range(150))
    texts += [copies(draw, hot, 0.025) for _ in range(60)] + [hot.upper()] * 30
    sizes, want = brute_components(texts, k)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(spark, texts), minhash.Params(shingle=k)).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert all(got[i]["kept"] == (want[i] == i) for i in got)


def test_near_duplicates_empty_and_null_ids(spark):
    assert minhash.near_duplicates(docs(spark, [])).count() == 0
    rows = docs(spark, ["a b c d e f", "a b c d e f"]).withColumn("doc_id", F.when(F.col("doc_id") == 1, 1))
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(rows).collect()}
    assert got == {None: (None, True), 1: (1, True)}


RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, v):
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    d = re.sub("[^0-9]", "", v)
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def spans_of(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, r in RULES for m in re.finditer(r, t or "") if valid(k, m[0])]


def test_base_rules_equal_regular_expressions(spark):
    draw = random.Random(5)
    parts = ["a@b.c", "x.y+z@mail-1.example.com", "@", "a@b", "é", "😀", "1.2.3.4", "256.1.1.1", "001.02.3.4", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111112", "9" * 40, "+1 (988) 555-2485", "+1 2", "+1..........", " ", " ", "\n", ".", "-", "+", "7", "a.b@c.d@e.f", "a@b.c%x@d.e"]
    texts = [*AWKWARD, *("".join(draw.choice(parts) for _ in range(draw.randrange(14))) for _ in range(400)), "a" * 60000, "1" * 60000, "1 " * 9000, "+1" + "(" * 30000]
    got = {r["doc_id"]: r for r in pii.find(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = spans_of(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t[:80]
        assert [got[i][f"n_{k}"] for k, _ in RULES] == [sum(s.startswith(k + ":") for s in want) for k, _ in RULES]
        assert set(want) <= set(got[i]["spans"].split(",")) | {""}
    assert pii.find(docs(spark, [])).count() == 0


def test_patterns_discover_unseen_identifiers(spark):
    texts = [f"Please contact user{i}@mail.example.com today" for i in range(12)]
    texts += ["Please contact helpdesk77 today", "nothing to see77777 here", "some plain words"]
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(14)]
    # long strings that a name is set to seed secrets; the name then finds a short one, and that one a second name
    texts += [f'w{i}w Token = "{k}" x{i}x' for i, k in enumerate(keys)] + ['y Token = "abc12345"!!', "word 1234567890123456 word", f"{keys[0][:-1]} alone"]
    got = {r["doc_id"]: r for r in pii.find(docs(spark, [*texts, None, texts[12]])).collect()}
    assert got[12]["spans"] == got[len(texts) + 1]["spans"] == "email:15:25" and got[13]["spans"] == got[14]["spans"] == ""
    assert got[0]["spans"].startswith("email:15:") and got[0]["n_learned"] == 0
    assert all(got[15 + i]["spans"] == f"secret:{13 + (i > 9)}:{53 + (i > 9)}" and got[15 + i]["n_spans"] == 1 for i in range(14))
    # seeds are known by a rule; the short one is not, and neither is what stands where addresses do
    assert got[29]["n_discovered"] == got[12]["n_discovered"] == 1 and not any(got[15 + i]["n_discovered"] for i in range(14))
    assert got[29]["spans"] == "secret:11:19" and got[30]["spans"] == got[31]["spans"] == "" and got[32]["n_spans"] == 0


def test_a_text_with_very_many_tokens(spark):
    text = " ".join(f"k{i} x{i}@b.co" if i % 3 else f"+1 (309) 555-{1000 + i % 9000}" for i in range(50_000))
    (r,) = pii.find(docs(spark, [text])).collect()
    assert (r["n_email"], r["n_phone"], r["n_spans"]) == (33_333, 16_667, 50_000)
    assert r["base_sha256"] == hashlib.sha256(",".join(spans_of(text)).encode()).hexdigest()


def test_discovery_on_the_documents(spark):
    """Their secrets are all of the seeds' form, so nothing is discovered beyond them: every secret set to a name is found; numbers that fail the card check are left alone."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    more = {r["doc_id"]: r["spans"] for r in pii.find(rows).where("n_learned > 0").collect()}
    want = {i: [m.span(1) for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)] for i, t in texts.items()}
    want = {i: v for i, v in want.items() if v}
    got = {i: [tuple(map(int, x.split(":")[1:])) for x in s.split(",") if x.startswith("secret:")] for i, s in more.items()}
    assert got == want and len(want) > 5
    assert pii.find(rows).agg(F.sum("n_discovered")).first()[0] == 0


def test_finding_with_null_and_repeated_ids(spark):
    rows = spark.createDataFrame([(None, "mail a@b.co"), (None, None), (7, "mail a@b.co"), (7, "mail a@b.co"), (7, "1.2.3.4")], "doc_id bigint, text string")
    got = sorted(((r["doc_id"] or 0, r["spans"]) for r in pii.find(rows).collect()))
    assert got == [(0, ""), (0, "email:5:11"), (7, "email:5:11"), (7, "email:5:11"), (7, "ip:0:7")]


def test_redaction(spark):
    rows = docs(spark, [None, "mail a@b.co or +1 (988) 555-2485 😀 1.2.3.4!", "clean"])
    out = pii.redact(rows)
    assert out.columns == rows.columns
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == [None, "mail [EMAIL] or [PHONE] 😀 [IP]!", "clean"]


def test_licence_rules(spark):
    every = [s for _, rule in licenses.RULES for s in rule]
    assert set(every) <= set(licenses.SENTENCES) and len(set(licenses.SENTENCES.values())) == len(licenses.SENTENCES)
    assert all(set(s.split()) & set(licenses.ANCHORS) for s in licenses.SENTENCES.values())
    mit = [licenses.SENTENCES[s] for s in ("mit-grant", "mit-notice", "mit-as-is")]
    bsd = [licenses.SENTENCES[s] for s in ("bsd-grant", "bsd-source", "bsd-binary")]
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/."
    gpl = "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version."
    asis = 'THE SOFTWARE\nIS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
    texts = [None, "", "Licensed under the Apache License, Version 2.0.", "Some words.\nReleased under the MIT License.\nMore", ". ".join(mit) + ".", ". ".join(mit[::-1]) + ".", mit[0].replace(" any ", "\nany ").capitalize() + ".", "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0.", "we talk of a license here"]
    texts += [f"{bsd[0]}:\n1. {bsd[1]}\n2. {bsd[2].replace(' this list ', chr(10) + 'this list ')}.", f"{mit[0]}\n{mit[1]}\n{asis}", asis, mpl, gpl, "# SPDX-License-Identifier: GPL-2.0-or-later\nx = 1", "Copyright 2020 X\n" + mit[0].replace(" any ", "\nany ") + ":", "Released under the MIT License.\n" * 3, "license " * 30000, "-" * 60000 + " license", "license\x01 \x01software"]
    rows = docs(spark, texts)
    got = [(r["licenses"], r["sentence_ids"]) for r in licenses.scan(rows).orderBy("doc_id").collect()]
    assert [g for g, _ in got] == ["", "", "Apache-2.0", "MIT", "MIT", "", "", "CC-BY-NC-4.0,GPL-3.0", "", "BSD-2-Clause", "MIT", "", "MPL-2.0", "GPL-2.0", "GPL-2.0", "", "MIT", "", "", ""]
    assert got[6][1] == got[15][1] == "mit-grant" and got[11][1] == "mit-as-is" and got[16][1] == ",".join(["mit-ref"] * 3)
    assert got[9][1] == "bsd-grant,bsd-source,bsd-binary"
    assert licenses.scan(docs(spark, [])).count() == 0
    same = spark.createDataFrame([(None, mpl), (4, gpl), (4, gpl)], "doc_id bigint, text string")
    assert sorted(r["licenses"] for r in licenses.scan(same).collect()) == ["GPL-2.0", "GPL-2.0", "MPL-2.0"]


def test_common_notices(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n"
    bsd = bsd.replace("\n1. ", "\n1.\n").replace("\n2. ", "\n2.\n")
    endorse = "\n3.\nNeither the name of {} nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"
    gpl = "This program is free software;\nyou can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; {}version 2 of the License{}."
    cases = [
        (bsd + endorse.format("Example Corp. (Europe)"), "BSD-3-Clause"), (bsd + endorse.format("the copyright holder"), "BSD-3-Clause"), (bsd, "BSD-2-Clause"), (bsd + bsd + endorse.format("A"), "BSD-2-Clause,BSD-3-Clause"),
        ("// SPDX-License-Identifier: MIT OR Apache-2.0\n", "Apache-2.0,MIT"), ("# spdx-license-identifier: (GPL-2.0-only WITH Classpath-exception-2.0) AND BSD-2-Clause", "BSD-2-Clause,GPL-2.0"), ("SPDX-License-Identifier: nothing-known", ""),
        (gpl.format("", ""), "GPL-2.0"), (gpl.format("either ", ", or (at your option) any later version"), "GPL-2.0"),
        ("                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n", "Apache-2.0"),
        ("Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:", "Zlib"),
        ("Boost Software License - Version 1.0 - August 17th, 2003\n", "BSL-1.0"), ("neither the name of " + "a " * 40 + "nor the names of its contributors", ""),
    ]
    got = [r["licenses"] for r in licenses.scan(docs(spark, [t for t, _ in cases])).orderBy("doc_id").collect()]
    assert got == [want for _, want in cases]
    # the SQL says the same of them
    import duckdb

    from tessera.llm import queries

    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [(i, t) for i, (t, _) in enumerate(cases)])
    rel = c.sql(queries.oracle_sql()["op3_license_scan"])
    at = [rel.columns.index(x) for x in ("doc_id", "licenses")]
    assert [r[at[1]] for r in sorted(rel.fetchall(), key=lambda r: r[at[0]])] == got


def test_language_network_learns(spark):
    draw = random.Random(2)
    stems = {"aa": ["the", "and", "ing"], "bb": ["que", "ción", "los"], "cc": ["ung", "sch", "der"]}
    texts = [" ".join("".join(draw.choices(stems[k], k=3)) for _ in range(draw.randrange(5, 80))) for k in list(stems) * 60]
    rows = [(i, t, list(stems)[i % 3], "s", 0, "x", "k", "s", "m") for i, t in enumerate(texts)] + [(900, None, None, "s", 0, "", "", "", ""), (901, "1234 !!", "aa", "s", 0, "", "", "", ""), (902, "", None, "s", 0, "", "", "", "")]
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, DOCS), langid.Params(epochs=8)).collect()}
    held = [i for i in range(180) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(180))
    assert sum(got[i]["lang_pred"] == rows[i][2] for i in held) >= 0.95 * len(held)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.identify(spark.createDataFrame([], DOCS))
    assert none.count() == 0
    unlabelled = langid.identify(docs(spark, ["hello there"]).withColumn("lang", F.lit(None).cast("string")))
    assert unlabelled.first()["lang_pred"] == "und"


def test_tabulated_network_equals_the_plain_one():
    rng = np.random.default_rng(1)
    p = langid.Params(epochs=1)
    x = rng.integers(0, 256, (64, p.window), dtype=np.uint8)
    model = langid.train(x, rng.integers(0, 3, 64), ["a", "b", "c"], p)
    pooled = []
    for w, k, b in zip(p.widths, model.filters, model.bias, strict=True):
        vec = model.embed[langid._patches(x, w)]
        pooled.append(np.einsum("npwd,wdf->npf", vec, k).max(axis=1) + b)
    logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ model.out + model.out_bias
    want = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(langid.Scorer(model).probabilities(x), want, atol=1e-4)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.floats(0.01, 50), min_size=1), st.integers(8, 200))
def test_schedule_keeps_every_prefix_within_a_block(weights, period):
    share = mixing.shares(weights, period)
    slots = mixing.schedule(share)
    total = sum(share.values())
    done = dict.fromkeys(share, 0)
    for at, (s, k) in enumerate(slots):
        assert k == done[s] and k * total // share[s] <= at < -(-(k + 1) * total // share[s])
        done[s] += 1
        assert all(abs(done[x] * total - share[x] * (at + 1)) < total for x in share)
    assert done == share


def test_mixing_places_every_row_once(spark):
    n = 500
    rows = spark.createDataFrame([(i, f"t{i}", "en", None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 7}", 1, "", "", "", "") for i in range(n)] + [(1, "t1", "en", "hot", 1, "", "", "", "")] * 3, DOCS)
    p = mixing.Params(block=4, period=60, bucket=16)
    out = mixing.plan(rows, {"hot": 3.0, None: 1.0}, p).select("doc_id", "mix_.*").collect()
    assert len(out) == n + 3
    assert len({(r["slot"], r["position"]) for r in out}) == n + 3
    counts = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = mixing.shares({"n" if s is None else f"s{s}": {"hot": 3.0, None: 1.0}.get(s, c**0.5) for s, c in counts.items()}, 60)
    place = {}
    for at, (s, k) in enumerate(mixing.schedule(share)):
        place[s, k] = at
    for r in out:
        key = "n" if r["source"] is None else "s" + r["source"]
        assert r["slot"] == r["block"] // share[key] * 60 + place[key, r["block"] % share[key]]
        assert r["release"] <= r["slot"] < r["deadline"]
    blocks = {}
    for r in out:
        blocks.setdefault((r["source"], r["block"]), set()).add(r["position"])
    assert all(v == set(range(len(v))) for v in blocks.values())
    mixed = mixing.interleave(rows, None, p)
    assert mixed.columns == rows.columns and mixed.count() == n + 3
    assert mixing.plan(docs(spark, [])).count() == 0
    assert heapq.nsmallest(1, place.values()) == [0]


@pytest.mark.parametrize("n", [1, 20, 1300])
def test_schedule_follows_the_target_weights(n):
    weights = {f"s{i:04}": (1 + (i * 7919 % 997)) ** 0.5 * (9 if i == 0 else 1) for i in range(n)}
    total = sum(map(Fraction, weights.values()))
    blocks = {s: 2 + int(12000 * w / float(total)) for s, w in weights.items()}
    slots = sorted((int(at), s, k) for s, (_, _, slot) in mixing.earliest(mixing.exact(weights), blocks).items() for k, at in enumerate(slot))
    assert len({at for at, _, _ in slots}) == len(slots) == sum(blocks.values())
    done = dict.fromkeys(weights, 0)
    for at, s, k in slots:
        w = Fraction(weights[s]) / total
        # less than a block ahead after it, less than a block behind before it
        assert k == done[s] and k < w * (at + 1) and w * at < k + 1
        done[s] += 1


def test_mixing_with_clashing_columns_and_null_ids(spark):
    rows = spark.createDataFrame([(i if i % 5 else None, "abc"[i % 3] if i % 7 else None, i, "r", 1, 2) for i in range(60)], "doc_id bigint, source string, mix_ int, `row` string, slot int, bucket int")
    out = mixing.interleave(rows)
    assert out.columns == rows.columns and out.exceptAll(rows).isEmpty() and out.count() == 60
    assert mixing.interleave(rows, placed=True).columns == [*rows.columns, "mix__"]
    assert mixing.interleave(rows.limit(0)).count() == 0


def test_mixing_by_target_weights(spark):
    n = 12000
    names = ["hot" if i % 3 == 0 else f"s{i % 19}" for i in range(n)]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(names)], "doc_id bigint, source string")
    out = mixing.plan(rows, None, mixing.Params(block=1, bucket=512)).select("doc_id", "mix_.*").collect()
    weights = {s: Fraction(float(names.count(s)) ** 0.5) for s in set(names)}
    total = sum(weights.values())
    assert sorted(r["doc_id"] for r in out) == list(range(n)) and len({r["slot"] for r in out}) == n
    assert {s: sorted(r["block"] for r in out if r["source"] == s) for s in weights} == {s: list(range(names.count(s))) for s in weights}
    for r in out:
        w = weights[r["source"]] / total
        assert r["release"] == math.floor(r["block"] / w) and r["deadline"] == math.ceil((r["block"] + 1) / w)
        assert r["release"] <= r["slot"] < r["deadline"]
