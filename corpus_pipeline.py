"""Corpus pipeline: quality, near duplicates, benchmark passages, source mix, token output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relatum.llm import decontam, mixing, neardup, quality, tokens
from relatum.llm.common import row_keyed, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, trained on the labels of these documents, does not reject."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the least id, or the first row where ids are null or repeat."""
    rows, key = row_keyed(docs)
    kept = neardup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text")).where("kept").select(F.col("doc_id").alias("kept_row"))
    return rows.join(kept, F.col(key).cast("bigint") == F.col("kept_row"), "left_semi").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    rows, key = row_keyed(docs)
    mixed = mixing.mix_sources(rows.select(F.col(key).alias("doc_id"), "text", "source"))
    taken = mixed.where("copies > 0").select(F.col("doc_id").alias("mixed_row"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("mixed_copy"))
    return rows.join(taken, F.col(key).cast("bigint") == F.col("mixed_row")).select(*[rows[c] for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the token files."""
    return tokens.token_output(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]

#: No SQL: classifier, SimHash search, dependent rounding and a public tokenizer are not expressible in it.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = staged(docs, f"stage{k}")
    return docs
