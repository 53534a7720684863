"""What the two text classifiers share: labelled samples, byte counts and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm.words import Words

#: labelled rows that a classifier is fitted on, at most
SAMPLE_ROWS = 20_000


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never read; a row without an id isn't one (and has no label)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


#: hashes are first compared by these leading places
PLACES = 1 << 30


def hash_place(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(PLACES))


def smallest_hashes(column: str, wanted: int, of: int | Column) -> Column:
    """Holds for about twice ``wanted`` of ``of`` rows, among them those with the smallest places."""
    of = F.lit(of) if isinstance(of, int) else of
    return hash_place(column) < F.ceil(F.lit(PLACES) * F.least(F.lit(1.0), F.lit(2.0 * wanted) / F.greatest(of, F.lit(1))))


def sample(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", doc_id: str = "doc_id",
           rows: int = SAMPLE_ROWS) -> DataFrame:
    """``_t, label, part`` of the labelled rows with the smallest id hashes; ``part`` is 0 to 9.

    An id with several labels takes the smallest; ids and labels that are null are left out.
    """
    usable = labels.where(~held_out(doc_id) & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), label)
    # of a large table only about twice the wanted rows are dealt to the one task that picks them
    chosen = (usable.where(smallest_hashes("_id", rows, usable.count()))
              .groupBy("_id").agg(F.min(label).cast("double").alias("label"))
              .orderBy(hash_place("_id"), F.xxhash64("_id"), "_id").limit(rows))
    return (docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").cast("binary").alias("_t"))
            .join(F.broadcast(chosen), "_id")  # SAMPLE_ROWS short rows
            .select("_t", "label", F.pmod(F.xxhash64("_id", F.lit("part")), F.lit(10)).alias("part")))


def byte_counts(words: Words, n: int) -> np.ndarray:
    """How often each byte value occurs in each text, letters in their own case."""
    raw = np.frombuffer(words.raw, dtype=np.uint8)
    doc = np.repeat(np.arange(n), np.diff(words.at))
    counts = np.bincount(doc * 256 + raw, minlength=n * 256).reshape(n, 256)
    counts[:, 32] -= 1  # the blank after each text
    return counts


def per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of a per-word or per-byte array over each text."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[first[1:]] - total[first[:-1]]).astype(float)


def isotonic(scored: DataFrame, score: str, label: str = "label") -> tuple[np.ndarray, np.ndarray]:
    """The steps of an isotonic fit, for np.interp."""
    fit = IsotonicRegression(featuresCol="_x", labelCol=label).fit(scored.select(F.col(score).alias("_x"), label))
    return np.array(fit.boundaries), np.array(fit.predictions)
