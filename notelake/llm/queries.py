"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.driver import shared_folder
from notelake.llm import bagminhash, katz, katz_store, merkle, pages, partitions, pieces, pseudonyms, quality, repeats, resampling, sql, suffix_dedup, templates, toxicity

#: The vocabulary file of the encoding queries; it is read where the query is built.
PIECES_MODEL = os.environ.get("NOTELAKE_PIECES_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
#: The pseudonym key; a real run sets its own secret one.
PII_KEY = os.environ.get("NOTELAKE_PII_KEY", "a key for tests")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Queries without SQL are held against brute force, an exact round trip or held-out labels in ``tests/llm``.
ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(_table(spark, sf_dir, "documents"))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), pieces.read_model(PIECES_MODEL))


@query
def sentencepiece_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for which op1 and the SentencePiece library differ: none."""
    return pieces.parity(_table(spark, sf_dir, "documents"), pieces.read_model(PIECES_MODEL))


@query
def longest_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's doubling beyond 13 words, until no candidates survive."""
    return repeats.longest_repeats(_table(spark, sf_dir, "documents"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(_table(spark, sf_dir, "pages"))


@query
def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


@query
def op9_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.cut_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query
def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(_table(spark, sf_dir, "documents"))


@query
def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(_table(spark, sf_dir, "documents"))


@query
def katz_stored_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3's model of order 3, stored in tables and read back to score all texts."""
    docs, folder = _table(spark, sf_dir, "documents"), shared_folder(spark, "katz")
    katz_store.train(docs.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))), folder, 3)
    return katz_store.score(docs, folder)


@query
def op7_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~toxicity.held_out())
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", F.size("spans").alias("n_spans"))


@query
def op11_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(_table(spark, sf_dir, "documents"))
