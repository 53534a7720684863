"""The corpus pipeline: documents in, token digests of the cleaned corpus out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assay.llm import stages

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_dedup),
    ("minhash_dedup", stages.minhash_dedup),
    ("decontaminate", stages.decontaminate),
    ("bpe", stages.bpe_encode),
]

#: language identification is learned, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stages.stored(docs, f"stage-{name}")
    return docs
