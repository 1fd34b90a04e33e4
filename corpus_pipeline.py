"""The corpus pipeline: language ID, near duplicates, secrets, mixing, encoding.

A stage's result must be written before the next stage is called (``run`` does
so): each stage call drops the working tables of the call before it. From the
first stage on, the session's Arrow batches are of ``BATCH_BYTES`` at most, or what
it has set below that: they lie beside an executor's heap, and again in its workers.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalframe.llm import bpe_codec, language_id, ngram_join, secret_scan, source_mix
from vitalframe.llm.common import drop, materialize, scratch
from vitalframe.llm.queries import RANK_FILE

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.5
#: In standard deviations of an n-gram: texts lie above -1.3, random letters below -1.9.
LEAST_FIT = -1.75
BATCH_BYTES, BATCH_CONF = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_working: list[tuple[SparkSession, str]] = []


def _bound_batches(spark: SparkSession) -> None:
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_CONF))
    if now > BATCH_BYTES:
        # It must still hold when the result is written, after the stage's call.
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def _stage(f: Stage) -> Stage:
    @functools.wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _bound_batches(spark)
        drop([t for t in _working if t[0] is spark])
        _working.clear()
        with scratch() as tables:
            out = f(spark, docs, sf_dir)
            _working.extend(tables)
        return out

    return call


@_stage
def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a recognised language go: null, empty and
    letterless texts, those whose posterior is below ``LEAST_SCORE``, and those that
    read less like their language than ``LEAST_FIT``: random letters, keys, scripts that
    were not learned. A label learned from few texts fits them and stays. Equal rows
    fare alike; very long texts are scored whole; other columns pass."""
    model = language_id.fit(docs)
    names = docs.columns
    labelled = language_id.predict(docs, model, label_out="__pred", score_out="__score", fit_out="__fit")
    told = (F.col("__pred") != language_id.UNDETERMINED) & (F.col("__score") >= LEAST_SCORE) & (F.col("__fit") >= LEAST_FIT)
    return labelled.where(told).select(*names)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group one document stays, that of least id
    (null ids last; of rows that share an id, the one of least text hash, then of
    least hash of the other columns). Null or wordless texts link with nothing and
    stay; rows that are equal in all columns stay once."""
    order = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    rest = F.md5(F.to_json(F.struct("lang", "source", "n_chars")))
    key = F.concat(F.coalesce(F.concat(F.lit("0"), order), F.lit("1")), F.md5(F.coalesce("text", F.lit(""))), rest)
    keyed = docs.withColumn("__key", key)
    found = ngram_join.link_components(keyed, id_col="__key")
    stays = found.where(F.col("__key") == F.col("component_id")).select("__key")
    return keyed.join(stays, "__key", "left_semi").dropDuplicates(["__key"]).select(*COLUMNS)


@_stage
def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every span becomes a mark; the documents stay, equal rows as
    often as they come. A null text becomes an empty one."""
    found = secret_scan.scan(docs, keep=COLUMNS)
    clean = secret_scan.redact(F.col("text"), F.array_sort(F.concat("base", "added")))
    # A name of its own first: an alias "text" would capture later uses of the column.
    done = found.select("doc_id", clean.alias("__clean"), "lang", "source")
    return done.select("doc_id", F.col("__clean").alias("text"), "lang", "source", F.length("__clean").cast("long").alias("n_chars"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: a document appears as many times as the mix takes it. Empty texts
    have no words and are taken with their pattern's full copies, or not at all; a
    null source is a source of its own."""
    mixed = source_mix.mix(docs, keep=("text", "lang", "source", "n_chars")).where("copies > 0")
    return mixed.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select(*COLUMNS)


@_stage
def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: token counts and digests of ids and decoded bytes, one row
    per row; a null text encodes like an empty one."""
    return bpe_codec.round_trip(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", keep_languages),
    ("ngram_join", drop_near_copies),
    ("secret_scan", hide_secrets),
    ("source_mix", mix_sources),
    ("bpe_codec", encode_texts),
]
#: Language scores and BPE ids are beyond SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
