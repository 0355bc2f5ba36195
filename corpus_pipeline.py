"""A corpus, from documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of
documents. Cases are those of the operators: a null or empty text fails the quality rules, repeated
rows are near-duplicates of each other, empty tables give empty tables, and columns of any other
name are carried through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panoquarry.llm import mixing, near_dups, packing, quality, secrets
from panoquarry.llm.runtime import Scratch, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base gate nor the learned decision list rejects."""
    return quality.keep_good(spark, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: five-word shingles, similarity of 0.8 or more."""
    return near_dups.keep_one(spark, docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets that were found masked."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mixed_documents(spark, docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece, with its place in a sequence of at most 1024 tokens."""
    return packing.pack(spark, docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mix_sources", mix_sources), ("best_fit_packing", best_fit_packing)]

#: Fitting rules and token ids can't be said in SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
