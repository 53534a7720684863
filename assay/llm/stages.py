"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns what is kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.llm import bpe, langid, lines, minhash
from assay.llm import decontaminate as leaks
from assay.session import write_and_read

#: a text has no known language if less than this share of its n-grams is in the best filter
KNOWN = 0.25


def stored(df: DataFrame, name: str) -> DataFrame:
    return write_and_read(df, name)


def _with(docs: DataFrame, rows: DataFrame, text) -> DataFrame:
    """The columns of ``docs`` out of ``row``, with a new text and its length."""
    new = {"text": text, "n_chars": F.length(text).cast("long")} if text is not None else {}
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters or in no language of the labels are rejected."""
    model = langid.fit(docs.where(~langid.held_out()))
    scored = langid.predict(docs, model)
    return _with(docs, scored.where((F.col("lang_pred") != "und") & (F.col("score") >= KNOWN)), None)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of two lines or more that an earlier place has are cut out; a document of which nothing is
    left was a copy and goes, one that had no text stays."""
    done = lines.remove_repeated_runs(docs)
    return _with(docs, done.where((F.col("n_removed") == 0) | (F.col("kept") != "")), F.col("kept"))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays, with or without ids; two
    texts under one id are judged apart."""
    return minhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows are cut out; the rest of each document stays."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    cut = leaks.without_spans(leaks.find_leaks(docs, bench))
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, as digests, checked by decoding."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode_decode(docs, path, public_tokenizers.PATTERN))
