"""Toxicity scores from gradient-boosted trees over dense features.

A lexicon of words and of word beginnings is learned from one part of the labelled sample, the
trees from another and the isotonic calibration from a third. Features: lexicon densities, the
lexicon's nearness to words that address the reader, capitals, punctuation and signs of obfuscation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.training import byte_counts, isotonic, per_text, sample
from assay.llm.words import ALNUM, BYTES, U64, Words, byte_class, mix, slices

#: words within this distance of a second-person word are near it; letters of a word beginning
NEAR, STEM = 6, 5
#: lexicon: toxic documents an entry occurs in at least, how much likelier it is there, entries at most
LEAST, RATIO, MAX_ENTRIES = 3, 8.0, 20_000
ROUNDS, DEPTH, PARTS = 30, 4, 6

#: second-person words of some languages
SECOND_PERSON = ("you your yours yourself u ur du dich dir dein deine deiner sie ihr euch tu te toi ton ta tes vous votre vos "
                 "tú ti usted ustedes vosotros tus").split()
#: letters that digits and signs stand for in obfuscated words
LOOKALIKES = bytes.maketrans(b"013457@$!|", b"oieastasii")
#: letters, digits and the signs used inside obfuscated words
DISGUISED = byte_class([(0x00, 0x20), (0x22, 0x22), (0x25, 0x29), (0x2B, 0x2F), (0x3A, 0x3F), (0x5B, 0x60), (0x7B, 0x7B), (0x7D, 0x7F)])


def _stems(w: Words) -> np.ndarray:
    """Hashes of the first STEM characters of each word, 0 for words that are no longer."""
    lead = (w.buf & 0xC0) != 0x80
    count = np.concatenate([[0], np.cumsum(lead)])
    at = np.flatnonzero(lead)
    wanted = count[w.start] + STEM
    longer = count[w.end] > wanted
    end = np.where(longer, np.append(at, len(w.buf))[np.minimum(wanted, len(at))], w.start)
    h = mix(BYTES.runs(BYTES.prefix(BYTES.values[w.buf]), w.start, end) ^ U64(0x5EED))
    return np.where(longer, h, U64(0))


def _member(hashes: np.ndarray, entries: np.ndarray) -> np.ndarray:
    if not len(entries):
        return np.zeros(len(hashes), dtype=bool)
    return entries[np.minimum(np.searchsorted(entries, hashes), len(entries) - 1)] == hashes


@dataclass
class Lexicon:
    """Sorted hashes of words and of word beginnings."""

    words: np.ndarray
    stems: np.ndarray

    def features(self, texts: list[bytes | None]) -> np.ndarray:
        n = len(texts)
        w = Words(texts, ALNUM, lower=True)
        wh = w.hashes()
        n_words = np.diff(w.first).astype(float)
        some = np.maximum(n_words, 1)
        size = (np.diff(w.at) - 1).astype(float)
        chars = np.maximum(size, 1)
        word, stem = _member(wh, self.words), _member(_stems(w), self.stems)
        second = _member(wh, _second_person())
        doc = np.repeat(np.arange(n), np.diff(w.first))
        near = np.zeros(len(wh), dtype=bool)
        for k in range(1, NEAR + 1):
            near[k:] |= second[:-k] & (doc[k:] == doc[:-k])
            near[:-k] |= second[k:] & (doc[:-k] == doc[k:])
        counts = byte_counts(w, n)
        letters = counts[:, [*range(65, 91), *range(97, 123)]].sum(axis=1) + counts[:, 0xC0:].sum(axis=1)
        upper = counts[:, 65:91].sum(axis=1)
        raw = np.frombuffer(w.raw, dtype=np.uint8)
        is_upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
        shout = (is_upper[w.end] - is_upper[w.start] == w.end - w.start) & (w.end - w.start > 2)
        alpha = np.concatenate([[0], np.cumsum(((w.buf >= 97) & (w.buf <= 122)) | (w.buf >= 128))])
        run3 = np.zeros(len(w.buf), dtype=bool)
        run3[2:] = (w.buf[2:] == w.buf[1:-1]) & (w.buf[1:-1] == w.buf[:-2]) & (w.buf[2:] >= 97)
        marks = np.isin(w.buf, list(b"!?*#@$%&"))
        mark_run = np.zeros(len(w.buf), dtype=bool)
        mark_run[1:] = marks[1:] & marks[:-1]
        # words with digits or signs between letters, and what they say without them
        d = Words([(t or b"").lower() for t in texts], DISGUISED)
        d_alpha = np.concatenate([[0], np.cumsum(((d.buf >= 97) & (d.buf <= 122)) | (d.buf >= 128))])
        n_alpha = d_alpha[d.end] - d_alpha[d.start]
        edge = lambda at: ((d.buf[at] >= 97) & (d.buf[at] <= 122)) | (d.buf[at] >= 128)
        odd = (n_alpha < d.end - d.start) & (n_alpha >= 2)
        odd[odd] = edge(d.start[odd]) & edge(d.end[odd] - 1)
        plain = Words([(t or b"").lower().translate(LOOKALIKES) for t in texts], DISGUISED)
        said = np.zeros(len(d.start), dtype=bool)
        if len(plain.start) == len(d.start):
            said = _member(plain.hashes(), self.words) & (n_alpha < d.end - d.start)
        hits, stems, nearby = per_text(word, w.first), per_text(stem, w.first), per_text((word | stem) & near, w.first)
        return np.stack([
            hits / some, np.log1p(hits), stems / some, np.log1p(stems), nearby / some, np.log1p(nearby), per_text(second, w.first) / some,
            upper / np.maximum(letters, 1), per_text(shout, w.first) / some, counts[:, 33] / chars, counts[:, 63] / chars,
            counts[:, list(b"#$%&*@^~|<>")].sum(axis=1) / chars, per_text(mark_run, w.at) / chars,
            per_text(odd, d.first) / some, np.log1p(per_text(said, d.first)), per_text(run3, w.at) / chars, np.log1p(n_words)], axis=1)


def _second_person() -> np.ndarray:
    return np.sort(Words([x.encode() for x in SECOND_PERSON], ALNUM).hashes())


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words and word beginnings that occur far oftener in texts with label 1 than with label 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in slices(pc.binary_length(batch.column(0)).fill_null(0).to_pylist()):
                w = Words(batch.column(0)[lo:hi].to_pylist(), ALNUM, lower=True)
                doc = np.repeat(np.arange(hi - lo), np.diff(w.first))
                for stem, h in ((False, w.hashes()), (True, _stems(w))):
                    order = np.lexsort((h, doc))
                    a, b = doc[order], h[order]
                    new = np.ones(len(a), dtype=bool)
                    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
                    a, b = a[new], b[new]
                    values, at = np.unique(b, return_inverse=True)
                    yes = np.bincount(at, weights=label[lo:hi][a], minlength=len(values)).astype(np.int64)
                    every = np.bincount(at, minlength=len(values)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([stem] * len(values), pa.bool_()), pa.array(values.view(np.int64)), pa.array(yes), pa.array(every)],
                        ["stem", "h", "yes", "every"])

    n = rows.agg(F.sum("label").alias("yes"), F.count("label").alias("every")).first()
    yes, no = n.yes or 0, n.every - (n.yes or 0)
    found = (rows.select("_t", "label").mapInArrow(count, "stem boolean, h long, yes long, every long")
             .groupBy("stem", "h").agg(F.sum("yes").alias("yes"), F.sum("every").alias("every"))
             .withColumn("ratio", (F.col("yes") / F.lit(max(yes, 1))) / ((F.col("every") - F.col("yes") + 0.5) / F.lit(no + 1.0)))
             .where(f"h != 0 AND yes >= {LEAST} AND ratio >= {RATIO}")
             .orderBy(F.desc("yes"), F.desc("ratio"), "h").limit(MAX_ENTRIES).select("stem", "h").toPandas())
    pick = lambda s: np.sort(found.loc[found["stem"] == s, "h"].to_numpy().astype(np.int64).view(U64))
    return Lexicon(pick(False), pick(True))


def _features(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``rows`` with ``_t`` replaced by ``x``, an array of features."""
    sent = rows.sparkSession.sparkContext.broadcast(lexicon)
    others = [c for c in rows.columns if c != "_t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            for lo, hi in slices(pc.binary_length(texts).fill_null(0).to_pylist()):
                x = sent.value.features(texts[lo:hi].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(x), pa.list_(pa.float64())), *[batch.column(i + 1)[lo:hi] for i in range(len(others))]], ["x", *others])

    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), *[rows.schema[c] for c in others]])
    return rows.select("_t", *others).mapInArrow(run, schema)


class ToxicityModel:
    """Lexicon, trees and calibration; the base rate alone, if nothing could be learned."""

    def __init__(self, base: float, lexicon: Lexicon | None = None, trees=None, steps=None):
        self.base, self.lexicon, self.trees, self.steps = base, lexicon, trees, steps


def _margin(trees, features: DataFrame) -> DataFrame:
    return (trees.transform(features.withColumn("_x", array_to_vector("x")))
            .withColumn("_p", vector_to_array("probability")[1]).drop("_x", "x", "rawPrediction", "probability", "prediction"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id") -> ToxicityModel:
    """Fit on at most ``training.SAMPLE_ROWS`` labelled rows: parts 0-4 the lexicon, 5-7 the trees, 8-9
    the calibration. With fewer than 20 rows or one class, all scores are the mean label (0.5
    without any row)."""
    rows = sample(docs, labels, label, text, doc_id).repartition(PARTS).cache()
    by = {(r.grp, r.label): r["count"] for r in rows.groupBy(F.expr("CASE WHEN part < 5 THEN 0 WHEN part < 8 THEN 1 ELSE 2 END").alias("grp"), "label").count().collect()}
    n, ones = sum(by.values()), sum(v for (_, y), v in by.items() if y == 1)
    base = ones / n if n else 0.5
    if n < 20 or not (by.get((1, 0.0)) and by.get((1, 1.0))):
        return ToxicityModel(base)
    lexicon = learn_lexicon(rows.where("part < 5"))
    x = _features(rows.where("part >= 5"), lexicon).cache()
    trees = GBTClassifier(featuresCol="_x", labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, minInstancesPerNode=5, stepSize=0.2, seed=1).fit(
        x.where("part < 8").select(array_to_vector("x").alias("_x"), "label"))
    late = _margin(trees, x.where("part >= 8"))
    steps = isotonic(late, "_p") if by.get((2, 0.0)) or by.get((2, 1.0)) else None
    x.unpersist()
    rows.unpersist()
    return ToxicityModel(base, lexicon, trees, steps)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Every row with its score: ``row`` (a struct of its columns), ``score`` from 0 to 1.

    Null and empty texts have features of zero and are scored like others; rows are independent, so
    repeated rows and rows without an id are scored too. An empty table gives an empty table.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).cast("string").cast("binary").alias("_t"))
    if model.trees is None:
        return rows.select("row", F.lit(float(model.base)).alias("score"))
    scored = _margin(model.trees, _features(rows, model.lexicon))
    if model.steps is None:
        return scored.select("row", F.col("_p").alias("score"))
    return scored.select("row", interpolate("_p", *model.steps).alias("score"))


def interpolate(column: str, x: np.ndarray, y: np.ndarray):
    """np.interp as a column expression, by binary branches."""
    p = F.col(column)

    def between(lo: int, hi: int):
        if hi - lo <= 1:
            if hi == lo or x[hi] == x[lo]:
                return F.lit(float(y[lo]))
            return F.lit(float(y[lo])) + (p - float(x[lo])) * float((y[hi] - y[lo]) / (x[hi] - x[lo]))
        mid = (lo + hi) // 2
        return F.when(p < float(x[mid]), between(lo, mid)).otherwise(between(mid, hi))

    inner = between(0, len(x) - 1)
    return F.when(p <= float(x[0]), float(y[0])).when(p >= float(x[-1]), float(y[-1])).otherwise(inner)
