"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm import bpe, decontaminate, langid, secrets, simhash
from gaugeworks.llm.common import shared_folder, table

LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without an identified language: no text, no letter, or a posterior under LEAST_SCORE.

    Learns from the rows of ``docs`` with a language that aren't held out; where there are none, no language
    can be told and all rows stay.
    """
    path = public_tokenizers.path("piece_bpe_32k.model")
    langs, probs = langid.train(docs.filter(~langid.held_out()), path)
    if not langs:
        return docs
    others = tuple(c for c in docs.columns if c != "doc_id")
    named = langid.predict(docs, path, langs, probs, keep=others)
    return named.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component: that of the smallest id, then of the smallest text hash.

    Rows without an id come after those with one; of wholly equal rows one stays.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_key"))
    found = simhash.near_duplicates(docs.select(key.alias("key"), "text"), id_col="key")
    kept = found.filter(F.col("key") == F.col("component_id")).select("key").distinct()
    kept = kept.select(F.coalesce("key.id", F.lit(-1)).alias("k_id"), F.col("key.none").alias("k_none"), F.col("key.text_key").alias("k_text"))
    same = (F.coalesce("doc_id", F.lit(-1)) == F.col("k_id")) & (F.col("doc_id").isNull() == F.col("k_none")) & (F.xxhash64("text") == F.col("k_text"))
    rows = docs.join(kept, same).drop("k_none")
    return rows.dropDuplicates(["k_id", "k_text"]).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that benchmark windows contaminate."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = found.filter(decontaminate.verdict(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("b_id"), F.col("text_key").alias("b_key")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.xxhash64("text") == F.col("b_key")), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by ``[SECRET]``; all documents stay, ``n_chars`` follows."""
    return secrets.clean(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the bytes they decode to."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

#: Fingerprints, a trained classifier and a trained network are not for SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
