"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panoquarry.llm import html_text, ledger, media, mixing, near_dups, packing, pii, quality, repeats, secrets
from panoquarry.llm.runtime import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op3_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_digest(spark, table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(spark, table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark, table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.corpus_totals(spark, table(spark, sf_dir, "documents"))


def op8_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(spark, table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(table(spark, sf_dir, "documents"))


def op10_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(spark, table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_best_fit_packing, op3_minhash_near_dups, op4_mix_sources, op5_html_extraction, op6_quality_rules, op7_token_counts, op8_long_repeats, op9_secret_scan, op10_media_chunks)}

SQL: dict[str, str] = {}
