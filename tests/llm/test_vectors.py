"""Vector operators against brute force, with hot groups, copies, nulls and clashing columns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hnsw, lshforest
from tessera.llm.components import connected_components

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, shard string, vector string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", "y", "z") for i, v, l in rows], SCHEMA)


def unusable(first):
    nan, inf = float("nan"), float("inf")
    return [(first, None, 1), (first + 1, [0.0] * 8, 1), (first + 2, [nan] + [1.0] * 7, 1), (first + 3, [inf] + [1.0] * 7, 1), (first + 4, [None] + [1.0] * 7, 1)]


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(4)
    rows = []
    for g in range(60):
        base = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), (base + rng.normal(0, 0.12, 8)).astype(np.float32).tolist(), int(rng.integers(0, 3)) if g % 2 else 1))
    hot = rng.normal(size=8)
    for _ in range(150):
        rows.append((len(rows), (hot + rng.normal(0, 0.05, 8)).astype(np.float32).tolist(), 2))
    rows += [(len(rows) + k, rows[0][1], rows[0][2]) for k in range(40)]
    rows.append((len(rows), rows[0][1], None))
    return rows


def test_vector_duplicates_equal_brute_force(spark, groups):
    rows = [*groups, *unusable(5000)]
    x = np.array([v for _, v, _ in groups], np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    labels = [l for _, _, l in groups]
    same = np.array([[a is not None and a == b for b in labels] for a in labels])
    near = (unit @ unit.T >= 0.93) & same
    np.fill_diagonal(near, False)
    root = list(range(len(groups)))
    for _ in range(len(groups)):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(groups))]
        if new == root:
            break
        root = new
    p = hnsw.Params(shard_rows=100, query_rows=64, beam=8, build_beam=24)
    got = {r["vec_id"]: r for r in hnsw.near_duplicate_vectors(table(spark, rows), 0.93, p).collect()}
    assert len(got) == len(rows)
    assert [got[i]["n_links"] for i in range(len(groups))] == near.sum(axis=1).tolist()
    assert [got[i]["component_id"] for i in range(len(groups))] == root
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(5000, 5005))
    assert hnsw.near_duplicate_vectors(table(spark, [])).count() == 0


def test_forest_search(spark, groups):
    rows = [*groups, *unusable(6000)]
    ids = np.array([i for i, _, _ in groups])
    x = np.array([v for _, v, _ in groups], np.float64)
    t = table(spark, rows)
    asked = t.where("vec_id % 20 = 0")
    got = lshforest.search(t, asked, 20, lshforest.Params(shard_rows=128, query_rows=16)).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = 0
    queries = [i for i in ids if i % 20 == 0]
    assert set(by) == set(queries)
    for q in queries:
        score = x @ x[q]
        score[q] = -np.inf
        top = np.lexsort((ids, -score))[:20]
        found = [i for i, _ in by[q]]
        assert q not in found and len(found) == 20
        assert all(abs(score[i] - s) < 1e-9 for i, s in by[q])
        assert found == sorted(found, key=lambda i: (-dict(by[q])[i], i))
        hits += len(set(top.tolist()) & set(found))
    assert hits >= 0.9 * 20 * len(queries)
    few = table(spark, groups[:5])
    assert lshforest.search(few, few.where("vec_id = 0"), 20).count() == 4
    assert lshforest.search(table(spark, []), table(spark, []), 20).count() == 0


def test_unequal_lengths_are_searched_by_inner_product(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 8)) * rng.lognormal(0, 1, (400, 1))
    rows = table(spark, [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)])
    got = lshforest.search(rows, rows.where("vec_id < 20"), 10, lshforest.Params(trees=24)).collect()
    x = x.astype(np.float32).astype(np.float64)
    hits = 0
    for q in range(20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:10].tolist()) & {r["vec_id"] for r in got if r["query_id"] == q})
    assert hits >= 0.9 * 200


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (5, 5), (None, 1), (7, None), (9, 8), (8, 10), (10, 11), (11, 12), (2, 1)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 8, 11: 8, 12: 8}
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert connected_components(chain).where("component <> 0").count() == 0
    assert connected_components(chain.where("false")).count() == 0


def test_graph_search_loses_no_link_of_sparse_or_unreached_nodes():
    rng = np.random.default_rng(12)
    hot = rng.normal(size=16) + rng.normal(0, 0.02, (600, 16))
    pairs = np.repeat(rng.normal(size=(700, 16)), 2, axis=0) + rng.normal(0, 0.05, (1400, 16))
    x = np.concatenate([hot, pairs])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    want = [np.flatnonzero(row).tolist() for row in near]
    own = np.arange(len(x))
    poor = hnsw.Graph(x, hnsw.Params(links=3, build_beam=6, beam=4)).build()
    assert [f.tolist() for f in poor.within(x, own, 0.93)] == want
    cut = hnsw.Graph(x, hnsw.Params()).build()
    cut.near = [np.where(np.isin(level, [900, 901, 1500]), -1, level) for level in cut.near]
    got = cut.within(x, own, 0.93)
    assert [got[k].tolist() for k in (900, 901, 1500, 1501)] == [want[k] for k in (900, 901, 1500, 1501)]
    assert [f.tolist() for f in cut.within(x[600:], np.full(1400, -1), 0.93)] == [sorted([*w, k + 600]) for k, w in enumerate(want[600:])]
