"""A corpus pipeline of five operators; each stage takes what its predecessor kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, minhash, mixing, pii
from tessera.llm.storage import materialize

#: Texts whose best language is less likely than so many times an even share are rejected, as are those without a letter.
LEAST_SHARE = 1.2


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rejects texts of no recognisable language; a missing ``lang`` is filled in.

    Where no document is labelled no language can be told, and only texts without a letter are rejected.
    """
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    least = LEAST_SHARE / max(len(model.languages), 2)
    pred, score = _free(docs, "lang_pred"), _free(docs, "lang_score")
    named = langid.with_language(docs, model, names=(pred, score)).where((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= least))
    return named.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the document with the smallest id of each group stays.

    Of rows that repeat an id one stays, the first in order of its columns as
    JSON; rows without an id stay.  Only ids are shuffled to find repeats.
    """
    found = minhash.near_duplicates(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_"), F.max("kept").alias("kept_"))
    found = materialize(found.where("kept_ and doc_id is not null").select("doc_id", "n_"), "kept")
    own = docs.join(found.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    twice = found.where("n_ > 1").select("doc_id")
    if not twice.isEmpty():
        row = F.struct(*docs.columns)
        first = docs.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.to_json(row)).alias("row_")).select("row_.*")
        own = own.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))
    return own.unionByName(docs.where("doc_id is null"))


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: personal data in texts gives way to its kind."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents in the order of the Pfair schedule of their sources."""
    return mixing.interleave(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: ids of every text, and the hash of the text decoded from them, in the order of the Pfair schedule.

    A table read again has lost the order of its files, so the schedule, which
    depends on the rows alone, is drawn up once more; ``slot`` and ``position``
    give each document's place in it.
    """
    order = mixing.interleave(docs, placed=True)
    own = order.columns[-1]
    place = F.struct("doc_id", F.col(f"{own}.slot").alias("slot"), F.col(f"{own}.position").alias("position"))
    # the encoder maps each partition in its order
    coded = bpe.encode_documents(order.select(place.alias("place"), "text"), id_col="place")
    return coded.select("place.doc_id", *coded.columns[1:], "place.slot", "place.position")


STAGES = [("language", language), ("near_dedup", near_dedup), ("pii", redact_pii), ("mix", mix), ("bpe", encode)]

#: SQL cannot train the language network or walk the encoder's trie; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
