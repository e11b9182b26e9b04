"""A corpus from raw documents to training sequences: language, quality, near copies, packing.

Each stage takes (spark, docs, sf_dir), works on every document that its predecessor kept, and returns the documents' own
columns (the last one the packed pieces). Stages are joined through Parquet in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelflow.llm import language, near_duplicates, packing, quality, queries
from pixelflow.llm.common import materialize, ship

NEAR = 80  # percent of five-word shingles from which this corpus takes two documents for near copies; op5's own is 85


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    ship(spark)
    return language.identify_documents(docs).filter("kept").select("row.*")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's thresholds."""
    ship(spark)
    return quality.filter_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return near_duplicates.keep_one(docs, NEAR)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token streams, placed in sequences."""
    ship(spark)
    return packing.pack(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [("language_id", identify_language), ("quality_rules", apply_quality_rules), ("near_dedup", drop_near_copies), ("packing", pack_sequences)]

#: Language models, MinHash and the packing plan can't be written in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
