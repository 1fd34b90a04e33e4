"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bilinear_lm, bpe_codec, importance_resample, language_id, ngram_join, phrase_growth, piece_codec, secret_scan, source_mix, splitter_shards, token_counts, webp, weighted_fingerprint
from . import oracle
from .common import crc_mod, documents

RANK_FILE, TOKENIZER_FILE, PIECE_FILE = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.store_texts(documents(spark, sf_dir))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        n(0).alias("n_assign"),
        n(1).alias("n_access"),
        n(2).alias("n_hex"),
        F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.span_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
        "n_tested",
        "n_random",
    )


def op4_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 7) == 2
    scored = bilinear_lm.score(documents(spark, sf_dir), ~held_out)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(documents(spark, sf_dir), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op6_weighted_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_fingerprint.compare_neighbours(documents(spark, sf_dir))


def op7_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = splitter_shards.shard_documents(documents(spark, sf_dir), 24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER_FILE), budgets=(512,))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("keep_512") < F.col("n_chars")).alias("over_limit"), F.col("keep_512").alias("fits_512"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(documents(spark, sf_dir), n=4, num=85, den=100)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_mod("doc_id", 3) == 1
    model = language_id.fit(docs.where(~held_out))
    return language_id.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op11_phrase_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_growth.collocations(documents(spark, sf_dir)).withColumnRenamed("g", "lang")


def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.round_trip(documents(spark, sf_dir), public_tokenizers.path(PIECE_FILE))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = importance_resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return scored.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        op1_webp, op2_source_mix, op3_secret_scan, op4_bilinear_lm, op5_bpe_codec, op6_weighted_fingerprint, op7_splitter_shards, op8_token_counts, op9_ngram_join, op10_language_id, op11_phrase_growth,
        op12_piece_codec, op13_importance_resample,
    )
}
ORACLE: dict[str, str] = {"op7_splitter_shards": oracle.OP7, "op9_ngram_join": oracle.OP9, "op11_phrase_growth": oracle.OP11, "op13_importance_resample": oracle.OP13}
