"""The registered queries of the corpus operators and the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import collocations, decontamination, filter_audit, fingerprints, line_chunks, lm_scoring, mixing, quality, secret_scan, simhash_dedup, token_counts, toxicity, wavelet


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_tokens(C.documents(spark, sf_dir), path, C.new_folder(spark, "token-counts"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(C.documents(spark, sf_dir), C.table(spark, sf_dir, "labels"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(C.documents(spark, sf_dir))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(C.documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(C.documents(spark, sf_dir), C.table(spark, sf_dir, "labels"))


def op6_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encode_corpus(C.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), C.new_folder(spark, "shards"))


def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(C.documents(spark, sf_dir))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(C.documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(C.documents(spark, sf_dir), C.table(spark, sf_dir, "benchmark"))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_lines(C.documents(spark, sf_dir))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(C.documents(spark, sf_dir)))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(C.documents(spark, sf_dir), C.table(spark, sf_dir, "labels"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(C.documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_token_counts, op2_quality, op3_simhash_dedup, op4_lm_scoring, op5_toxicity,
        op6_wavelet_shards, op7_curriculum_mix, op8_fingerprints, op9_decontamination, op10_line_chunks,
        op11_secret_scan, op12_filter_audit, op13_phrases,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op10_line_chunks": line_chunks.SQL, "op12_filter_audit": filter_audit.SQL, "op13_phrases": collocations.SQL}
