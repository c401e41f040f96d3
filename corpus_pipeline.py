"""A training corpus from raw documents in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again for the next one.  All but the last return the
columns of ``documents``.

A document of which no line is left after line dedup stays as an empty text,
and near-dedup keeps one of those.  The mixture holds a row for each copy of a
document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, lines, mixing, packing, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the likelihood ratio keep."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of runs of lines."""
    cut = lines.dedup_lines(docs)
    n_chars = F.when(F.col(cut.columns[-1]).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return cut.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return simhash.keep_one(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture in which no source is repeated more than twice; packing needs no order, so its permutations aren't sorted."""
    return mixing.mix_sources(docs, repetition_limit=2.0).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, separator=0)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mixing", source_mixing), ("best_fit_packing", best_fit_packing)]

#: SQL can't express the quality rules, near-dedup or packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = common.scratch(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
