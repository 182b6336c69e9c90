"""The queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, hnsw, impactsearch, langid, licenses, lshforest, minhash, mixing, pii, token_counts, tokenfile, toxicity, vectorcodes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.Params(shingle=4))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), keep_ids=False)


def op6_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return lshforest.search(rows, rows.where("vec_id % 20 = 0"), k=20)


def op7_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents").select("doc_id", "source")).select("doc_id", "mix_.*")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(_table(spark, sf_dir, "documents"))


def op11_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(_table(spark, sf_dir, "embeddings"))


def op12_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impactsearch.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxic_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    spans = F.array_join(F.transform("passages", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", "held_out", "score", "predicted", F.size("passages").cast("bigint").alias("n_passages"), spans.alias("passages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_minhash_near_dedup, op2_token_counts, op3_license_scan, op4_language_id, op5_bpe, op6_hash_prefix_forest, op7_pfair_mixing, op8_pii, op9_embedding_near_dedup, op10_token_files, op11_filtering_lloyd, op12_impact_search, op13_toxic_passages)
    return {f.__name__: f for f in every}


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w),
u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id AND a.n * 80 <= b.n * 100 AND b.n * 80 <= a.n * 100
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id, c = doc_id AS kept FROM s JOIN (SELECT id, min(root) AS c FROM r GROUP BY 1) ON id = doc_id
"""

OP9_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id)
SELECT id AS vec_id, (SELECT count(*) FROM l WHERE l.a = id) AS n_links, min(root) AS component_id, min(root) = id AS kept FROM r GROUP BY id
"""


def _op11_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every part against every entry; the codebooks' tables follow one another."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT r, j, v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
    SELECT p.r, p.j, p.v, b.e, list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN b{r} b USING (j)) GROUP BY r, j, v)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT b.j, b.e, coalesce(s.v, b.v) AS v FROM b{r} b LEFT JOIN (
    SELECT j, e, list(floor_div ORDER BY i) AS v FROM (
      SELECT j, e, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS floor_div FROM (
        SELECT j, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY j, e, i) GROUP BY j, e) s ON s.j = b.j AND s.e = b.e)""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, j, v[j * (len(v) // {parts}) + 1:(j + 1) * (len(v) // {parts})] AS v FROM k, range({parts}) t(j)),
b0 AS MATERIALIZED (SELECT j, e, p.v FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM k ORDER BY vec_id, v LIMIT {entries}) USING (r)),
{", ".join(steps)},
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY j) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
t AS (SELECT label, sum(error)::BIGINT AS label_error FROM c JOIN k USING (r) GROUP BY label)
SELECT vec_id, code, error, label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY j, e)) FROM b{rounds}) AS codebooks_sha256
FROM c JOIN k USING (r) JOIN t ON t.label IS NOT DISTINCT FROM k.label
"""


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
s AS (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS total FROM d WHERE len(ws) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ws) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t, docs),
q AS (SELECT item_id, t, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t FROM benchmark) GROUP BY item_id, t),
m AS (SELECT r, doc_id, 25 + (75 * len(ws) * docs) // total AS m FROM d, s WHERE len(ws) > 0),
x AS (SELECT item_id, doc_id, r, sum(qf * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (r) GROUP BY item_id, doc_id, r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0
QUALIFY rank <= 10
"""


def _op3_sql() -> str:
    """Runs of the pieces between line and sentence ends are looked up one by one, and the runs chosen by following pointers from the first."""
    known = ", ".join(f"('{name}', '{words}', {words.count(' ') + 1})" for name, words in licenses.SENTENCES.items())
    rules = ", ".join(f"('{name}', [{', '.join(repr(s) for s in rule)}])" for name, rule in licenses.RULES)
    tags = ", ".join(f"('{tag.lower()}', '{name}')" for tag, name in licenses.SPDX.items())
    times = lambda s: f"(SELECT len(list_filter(ids, lambda x: x = '{s}')) FROM ids WHERE ids.r = every.r)"
    beaten = " AND ".join(
        f"NOT (name = '{plain}' AND (r, '{longer}') IN (SELECT r, name FROM every) AND (r, '{plain}') NOT IN (SELECT r, name FROM expressed) AND {times(last)} <= {times(added)})"
        for plain, last, longer, added in licenses.EXTENDED
    )
    return f"""
WITH RECURSIVE known(id, words, n) AS (VALUES {known}), rules(name, steps) AS (VALUES {rules}),
numbered AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
low AS (SELECT r, regexp_replace(lower(text), '{licenses.HOLDER}', '{licenses.HOLDER_PLAIN}', 'g') AS text FROM numbered WHERE text IS NOT NULL),
lines AS (SELECT r, unnest(string_split(replace(text, chr(13), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13), chr(10)), chr(10)), 1) AS l FROM low),
parts AS (SELECT r, l, regexp_split_to_array(line, '[.!?;:](\\s+|$)') AS ps FROM lines),
pieces AS (SELECT r, l, generate_subscripts(ps, 1) AS p, trim(regexp_replace(unnest(ps), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS words FROM parts),
own AS (SELECT r, list(words ORDER BY l, p) AS ps FROM pieces WHERE words <> '' GROUP BY r),
heads AS (SELECT DISTINCT split_part(words, ' ', 1) AS head FROM known),
starts AS MATERIALIZED (SELECT r, ps, i FROM (SELECT r, ps, unnest(range(1, len(ps) + 1)) AS i FROM own) WHERE split_part(ps[i], ' ', 1) IN (SELECT head FROM heads)),
runs AS (SELECT DISTINCT s.r, s.i, s.i + k.w AS j, array_to_string(s.ps[s.i:s.i + k.w], ' ') AS words FROM starts s JOIN (SELECT unnest(range(0, (SELECT max(n) FROM known))) AS w) k ON s.i + k.w <= len(s.ps)),
hits AS (SELECT r, i, max(j) AS j, arg_max(id, j) AS id FROM runs JOIN known USING (words) GROUP BY r, i),
linked AS (SELECT r, i, id, (SELECT min(x.i) FROM hits x WHERE x.r = h.r AND x.i > h.j) AS next FROM hits h),
chosen(r, i, id, next) AS (SELECT r, i, id, next FROM linked WHERE (r, i) IN (SELECT r, min(i) FROM hits GROUP BY r) UNION ALL SELECT l.r, l.i, l.id, l.next FROM chosen c JOIN linked l ON l.r = c.r AND l.i = c.next),
ids AS (SELECT r, list(id ORDER BY i) AS ids FROM chosen GROUP BY r),
tags(tag, name) AS (VALUES {tags}),
expressed AS (SELECT DISTINCT r, name FROM (SELECT r, unnest(regexp_split_to_array(line, '[^a-z0-9.+-]+')) AS tag FROM (SELECT r, unnest(regexp_extract_all(lower(text), '{licenses.EXPRESSION}', 1)) AS line FROM numbered WHERE text IS NOT NULL)) JOIN tags USING (tag)),
ruled AS (SELECT DISTINCT r, name FROM ids, rules WHERE regexp_matches(',' || array_to_string(ids, ',') || ',', '(^|,)' || array_to_string(list_transform(steps, lambda s: replace(s, '.', '[.]')), ',(.*,)?') || ',')),
every AS (SELECT r, name FROM ruled UNION SELECT r, name FROM expressed),
matched AS (SELECT r, name FROM every WHERE {beaten})
SELECT d.doc_id, coalesce(len(ids), 0)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
  coalesce(names, '') AS licenses
FROM numbered d LEFT JOIN ids USING (r) LEFT JOIN (SELECT r, string_agg(name, ',' ORDER BY name) AS names FROM matched GROUP BY r) USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1_SQL, "op3_license_scan": _op3_sql(), "op9_embedding_near_dedup": OP9_SQL, "op11_filtering_lloyd": _op11_sql(), "op12_impact_search": OP12_SQL}
