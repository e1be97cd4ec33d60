"""The corpus pipeline: five operators in a row, each on all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents.  run() writes each stage's rows to the shared folder as Parquet and reads them for the next; what a stage read
and what it wrote on the way is deleted once its rows are written, so two copies of the corpus are there at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearopt.llm import langid, minhash, mixing, packing, secrets
from nearopt.llm.util import dropped, scratch, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: no letter, or a margin too narrow."""
    return langid.keep_identified(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near copies: similarity 0.8 or more."""
    return minhash.drop_near_duplicates(docs, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret in the texts by a mark; every document stays."""
    return secrets.redact(docs, thorough=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target weight asks: a row per copy."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the documents' token ids into power-of-two sequences, equal lengths together: a row per sequence, with its ids."""
    return packing.bucketed(packing.pack(docs, with_ids=True))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mix", mix), ("pack", pack)]

#: Compression sizes, verified signatures and token ids are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(written(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)  # lazy: it reads the last stage's table, which stays
