"""The registered queries of the training-data operators: each applies one operator to whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, langid, lexical, licenses, nearest, oracles, pii, prefix_trie, secrets, simhash, token_count, token_files
from .common import shared_folder, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and a digest of the base findings, and all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in secrets.KINDS], F.sha2(secrets.digest("base"), 256).alias("base_sha256"), secrets.digest("spans").alias("spans")
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and their decoded bytes, as digests."""
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and checksum in the token files, read back from them."""
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, folder)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in benchmark windows."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        decontaminate.verdict(F.col("n_hit"), F.col("n_words")).alias("contaminated"), "n_near",
    )


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library token counts of every document."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from the documents that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("piece_bpe_32k.model")
    langs, probs = langid.train(docs.filter(~langid.held_out()), path)
    return langid.predict(docs, path, langs, probs).withColumn("held_out", langid.held_out()).select("doc_id", "held_out", "lang_pred", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest-scoring documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and a digest of the base findings, and all spans."""
    found = pii.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in pii.BASE], F.sha2(secrets.digest(base), 256).alias("base_sha256"), secrets.digest("spans").alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_license_scan": op2_license_scan,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_token_files": op4_token_files,
        "op5_decontamination": op5_decontamination,
        "op6_nearest": op6_nearest,
        "op7_simhash": op7_simhash,
        "op8_html_text": op8_html_text,
        "op9_token_count": op9_token_count,
        "op10_language_id": op10_language_id,
        "op11_lexical_search": op11_lexical_search,
        "op12_pii": op12_pii,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": oracles.license_scan(), "op5_decontamination": oracles.decontamination(), "op11_lexical_search": oracles.lexical_search(), "op13_prefix_trie": oracles.prefix_trie_sql()}
