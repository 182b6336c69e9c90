"""Vector codes, ranked search and toxic passages against brute force, on awkward small tables."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import impactsearch, toxicity, vectorcodes

VECTORS = "vec_id bigint, embedding array<float>, label int, code string, n int, ids string"
DOCS = "doc_id bigint, text string, lang string, shard string, n_tokens string, segments string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 1, "y") for i, v, label in rows], VECTORS)


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in rows], DOCS)


# codes


def lloyd(rows, p):
    """Every part against every entry."""
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, None
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, [math.floor(p.scale * x) for x in r[1]]))
    width = len(order[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    whole = lambda v: np.pad(np.floor(np.array(v, np.float64) * p.scale).astype(np.int64), (0, -width % p.parts)).reshape(p.parts, -1)
    x = np.array([whole(r[1]) for r in kept])
    books = np.array([whole(r[1]) for r in [r for r in order if len(r[1]) == width][: p.entries]]).swapaxes(0, 1).copy()
    for turn in range(p.rounds + 1):
        far = ((x[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        near, error = far.argmin(axis=2), far.min(axis=2).sum(axis=1)
        if turn < p.rounds:
            for part in range(p.parts):
                for e in range(books.shape[1]):
                    mine = x[near[:, part] == e, part]
                    if len(mine):
                        books[part, e] = mine.sum(axis=0) // len(mine)
    sums = Counter()
    for r, e in zip(kept, error.tolist(), strict=True):
        sums[r[2]] += e
    out = Counter((r[0], "".join(f"{c:02x}" for c in row), e, sums[r[2]]) for r, row, e in zip(kept, near.tolist(), error.tolist(), strict=True))
    return out, hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def check_codes(spark, rows, p):
    got = vectorcodes.compress(vectors(spark, rows), p).collect()
    want, sha = lloyd(rows, p)
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == (want or Counter())
    assert {r["codebooks_sha256"] for r in got} <= {sha}


def test_codes_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    crowd = rng.normal(size=32)
    rows = [(i, rng.normal(0, 0.3, 32).astype(np.float32).tolist(), int(i % 3) or None) for i in range(150)]
    rows += [(200 + i, (crowd + rng.normal(0, 0.02, 32)).astype(np.float32).tolist(), 7) for i in range(150)]
    rows += [(500 + i, rows[3][1], 7) for i in range(30)] + [rows[5], rows[5], (None, rows[9][1], 1), (None, rows[8][1], None)]
    nan, inf = float("nan"), float("inf")
    rows += [(600, None, 1), (601, [], 1), (602, [nan] + [1.0] * 31, 1), (603, [inf] + [1.0] * 31, 1), (604, [None] + [1.0] * 31, 1), (605, [1.0] * 8, 1), (606, [0.0] * 32, 2), (607, [-0.001, 0.00390625] * 16, 2)]
    random.Random(1).shuffle(rows)
    check_codes(spark, rows, vectorcodes.Params(tree_rows=64, leaf=4))
    check_codes(spark, rows, vectorcodes.Params(parts=4, entries=100, rounds=3, tree_rows=1000))


def test_codes_of_few_rows(spark):
    check_codes(spark, [], vectorcodes.Params())
    check_codes(spark, [(5, [0.5] * 20, None)], vectorcodes.Params())  # parts are padded
    check_codes(spark, [(i, [i / 4] * 16, 1) for i in range(9)] + [(3, [9.0] * 16, 1)], vectorcodes.Params())


def test_codes_decode_to_their_error(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.3, 32).astype(np.float32).tolist(), 1) for i in range(120)]
    p = vectorcodes.Params()
    df = vectors(spark, rows)
    stored = vectorcodes.trees(df, p)
    books = vectorcodes.train(stored, p)
    coded = vectorcodes.encode(stored, books, df.schema["label"].dataType)
    for r in vectorcodes.decode(coded, books).collect():
        whole = np.floor(np.array(rows[r["id"]][1], np.float64) * p.scale)
        assert ((whole - np.array(r["vector"]) * p.scale) ** 2).sum() == r["error"]


@pytest.mark.parametrize("spread", [1, 3, 1000])
def test_filtering_equals_every_comparison(spread):
    """Whole subtrees go to the entry that a comparison of each part gives, ties to the lower one."""
    rng = np.random.default_rng(spread)
    for n in (1, 2, 5, 63, 400):
        points = rng.integers(-spread, spread + 1, (n, 3)).astype(np.int32)
        entries = rng.integers(-spread, spread + 1, (17, 3)).astype(np.int64)
        order = vectorcodes.tree_order(points, 4)
        nearest, total, count = vectorcodes.Tree.over(points[order], 4).filter(entries)
        want = ((points[order][:, None, :] - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (nearest == want).all() and (count == np.bincount(want, minlength=17)).all()
        assert all((total[e] == points[order][want == e].sum(axis=0)).all() for e in range(17))


# ranked search


def ranked(rows, items, k=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    own = [(i, Counter(cut(t))) for i, t in rows]
    n = sum(bool(c) for _, c in own)
    total = sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in own:
            size = sum(c.values())
            score = 0
            for t in cut(text):
                if c[t]:
                    m = 25 + 75 * size * n // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score:
                scored.append((-score, i is None, i))
        out += [(item, at + 1, i, -s) for at, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return Counter(out)


def test_search_equals_brute_force(spark):
    draw = random.Random(3)
    words = [*"abcdefgh", "the", "The", "don't", "é", "ÉÀ", "x1", "漢字", "a_b", "\x00q", "Z z", "123"]
    rows = [(i, " ".join(draw.choices(words, range(len(words), 0, -1), k=draw.randrange(40)))) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(50)] + [rows[3], rows[3], (None, rows[3][1]), (None, "the a b"), (400, None), (401, ""), (402, " .,;"), (403, "the " * 5000), (404, "x" * 20000)]
    draw.shuffle(rows)
    items = [(i, " ".join(draw.choices(words, k=draw.randrange(1, 12)))) for i in range(12)]
    items += [(3, "the the the a"), (50, None), (51, ""), (52, "unknownword"), (53, rows[3][1]), (None, "é x1")]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, doc_id string")
    want = ranked(rows, items)
    for p in (impactsearch.Params(), impactsearch.Params(shard_docs=16, candidates=10, share=0.1), impactsearch.Params(shard_docs=50, block_items=5)):
        got = impactsearch.search(docs(spark, rows), asked, p).collect()
        assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got) == want
    whole = impactsearch.index(docs(spark, rows))  # of all terms, not only those asked for
    assert {r["term"] for r in whole.select("term").distinct().collect()} >= {"the", "漢字", "123", "q"}
    for r in whole.where("term is not null").collect():
        assert r["impacts"] == sorted(set(r["impacts"]), reverse=True) and sum(r["sizes"]) == len(r["docs"])
    assert impactsearch.search(docs(spark, []), asked).count() == 0
    assert impactsearch.search(docs(spark, rows), asked.limit(0)).count() == 0


# toxic passages


def best_segments(scores, at=0):
    """The best segment of all, then those left and right of it."""
    best = None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > 0 and (best is None or total > best[2] + 1e-12):
                best = (i, j, total)
    if best is None:
        return []
    i, j, total = best
    return [*best_segments(scores[:i], at), (at + i, at + j, total), *best_segments(scores[j + 1 :], at + j + 1)]


def test_segments_are_all_maximal_ones():
    rng = np.random.default_rng(5)
    for n in (0, 1, 5, 40):
        for _ in range(60):
            scores = np.where(rng.random(n) < 0.35, rng.uniform(0.1, 3, n), -0.5)
            at = np.flatnonzero(scores > 0)
            got = toxicity.maximal_segments(at, scores[at], 0.5)
            want = best_segments(scores.tolist())
            assert [(a, b) for a, b, _, _ in got] == [(a, b) for a, b, _ in want]
            assert np.allclose([s for *_, s in got], [s for *_, s in want])
            assert [h for _, _, h, _ in got] == [int((scores[a : b + 1] > 0).sum()) for a, b, _, _ in got]


@pytest.fixture(scope="module")
def prose():
    draw = random.Random(8)
    plain = ["".join(draw.choices("abcdeénorst", k=draw.randrange(2, 8))) for _ in range(300)]
    rude = ["vilest", "Grubby", "snarlish", "snarlung", "ödblick"]
    rows, toxic = [], {}
    for i in range(900):
        text = draw.choices(plain, range(300, 0, -1), k=draw.randrange(5, 120))
        if i % 8 == 0:
            for _ in range(draw.randrange(2, 5)):
                text.insert(draw.randrange(len(text)), draw.choice(rude) + draw.choice(["", ",", "!"]))
        rows.append((i, " ".join(text)))
        toxic[i] = int(i % 8 == 0)
    return rows, toxic


def test_toxic_texts_are_found(spark, prose):
    rows, toxic = prose
    labels = spark.createDataFrame([(i, t, i % 2) for i, t in toxic.items() if i % 3] + [(1, None, 1), (None, 1, 1)], "doc_id bigint, toxic int, text int")
    extra = [(2000, None), (2001, ""), (2002, " .,"), (2003, "vilest " * 3000 + "abc"), (2004, "é ö, Snarlixx vilest; Grubby"), rows[8], (None, rows[8][1]), (2005, "x" * 50000)]
    got = toxicity.toxic_passages(docs(spark, [*rows, *extra]), labels).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 for r in got)
    held = [i for i in toxic if by[i]["held_out"]]
    assert all(by[i]["held_out"] == (toxicity.zlib.crc32(str(i).encode()) % 3 == 1) for i in toxic) and by[None]["held_out"]
    right = [by[i]["predicted"] == toxic[i] for i in held]
    assert len(held) > 200 and sum(right) >= 0.97 * len(right)
    quiet = by[2000]["score"]
    assert by[2001]["score"] == by[2002]["score"] == by[2005]["score"] == quiet < 0.1 and by[2000]["n_tokens"] == 0
    assert by[2003]["predicted"] == 1 and len(by[2003]["passages"]) == 1
    spans = [(s["start"], s["end"]) for s in by[2004]["passages"]]
    text = dict(extra[:5])[2004]
    assert text[spans[-1][0] : spans[-1][1]].endswith("Grubby") and by[2004]["predicted"] == 1
    assert by[None]["score"] == by[8]["score"] and sum(r["doc_id"] == 8 for r in got) == 2


def test_toxicity_without_labels_or_texts(spark, prose):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity.toxic_passages(docs(spark, prose[0][:5]), none).collect()
    assert [r["score"] for r in got] == [0.5] * 5 and not any(r["predicted"] for r in got)
    assert toxicity.toxic_passages(docs(spark, []), none).count() == 0
    only = spark.createDataFrame([(i, 1) for i in range(900)], "doc_id bigint, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.toxic_passages(docs(spark, prose[0][:60]), only).collect())


def test_copied_passages_do_not_make_tokens_toxic(spark, prose):
    """Words of one passage that many toxic texts share have one pair of neighbours each."""
    rows, toxic = prose
    shared = "quellmar hindobel trasp ovenlick marrowdin"
    more = [(3000 + i, f"{rows[8 * i][1]} {shared}") for i in range(60)]
    labels = spark.createDataFrame([*toxic.items(), *((i, 1) for i, _ in more)], "doc_id bigint, toxic int")
    clean = [(5000 + i, f"{rows[8 * i + 1][1]} {shared} {rows[8 * i + 2][1]}") for i in range(20)]
    got = toxicity.toxic_passages(docs(spark, [*rows, *more, *clean]), labels).where("doc_id >= 5000").agg(F.sum("predicted")).first()[0]
    assert got == 0
