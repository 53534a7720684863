"""Queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import bpe, conversations, decontaminate, exact, langid, lines, minhash, quality, substrings, suffixes, topk, toxicity, training, treap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _classified(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select(
        "row.doc_id", training.held_out("row.doc_id").alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _classified(toxicity.score(docs, model), 0.5)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return _classified(quality.score(docs, model), 0.3)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest_columns(lines.remove_repeated_chunks(table(spark, sf_dir, "documents")))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digests(decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "row.doc_id", langid.held_out("row.doc_id").alias("held_out"), "lang_pred", "score")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest_columns(suffixes.remove_repeats(table(spark, sf_dir, "documents")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest_columns(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treap.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(table(spark, sf_dir, "conversations"), damaged=True).drop("repaired")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_toxicity, op2_quality, op3_exact_dedup, op4_line_dedup, op5_bpe, op6_decontaminate, op7_language_id, op8_minhash_dedup,
        op9_suffix_array_dedup, op10_substring_dedup, op11_ranked_search, op12_exact_top_k, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact.ORACLE, "op4_line_dedup": lines.ORACLE, "op6_decontaminate": decontaminate.ORACLE,
            "op8_minhash_dedup": minhash.ORACLE, "op9_suffix_array_dedup": suffixes.ORACLE, "op10_substring_dedup": substrings.ORACLE,
            "op11_ranked_search": treap.ORACLE, "op12_exact_top_k": topk.ORACLE}
