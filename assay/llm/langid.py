"""Language identification with bit-sliced Bloom filters of character n-grams.

Every language has a Bloom filter of its n-grams. The filters are stored sliced: row r of one table
holds bit r of all filters as a bit mask of languages, so a lookup ANDs the rows of an n-gram's
hashes and gets all languages that contain it. A text's masks are counted per language, the hits
that a filter of its fill gives by chance are taken off, and the language with most hits wins.

N-grams stay within a word and the blank on either side; words are runs of letters, lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from assay.llm.training import hash_place, smallest_hashes
from assay.llm.words import U64, WORDS, mix, slices

#: n-gram lengths; documents a language is learned from at most; n-grams of one filter at most
SIZES, SAMPLE_DOCS, MAX_GRAMS = (2, 3, 4), 2000, 50_000
#: an n-gram is a language's if its rate there is at least this part of its rate in any language
SHARE, HASHES, BITS_PER_GRAM = 0.25, 2, 16


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, n-gram hash) of all n-grams of all texts, and the letters of each text."""
    padded = [f" {(t or '').lower()} " for t in texts]
    size = np.fromiter(map(len, padded), dtype=np.int64, count=len(padded))
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[code]
    doc = np.repeat(np.arange(len(texts)), size)
    n_letters = np.bincount(doc[letter], minlength=len(texts))
    near = letter.copy()
    near[1:] |= letter[:-1]
    near[:-1] |= letter[1:]
    code, doc, letter = np.where(letter, code, 32)[near], doc[near], letter[near]
    prefix = WORDS.prefix(mix(code.astype(U64) + U64(1)))
    docs, hashes = [], []
    for n in SIZES:
        m = len(code) - n + 1
        if m <= 0:
            continue
        ok = letter[:m] | letter[n - 1:]
        for i in range(1, n - 1):
            ok &= letter[i:m + i]
        if n == 2:
            ok &= doc[:m] == doc[1:]
        at = np.flatnonzero(ok)
        docs.append(doc[at])
        hashes.append(mix(WORDS.runs(prefix, at, at + n) + U64(n)))
    if not docs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64), n_letters
    return np.concatenate(docs), np.concatenate(hashes), n_letters


class SlicedFilters:
    """``rows[r]``: bit r of every language's filter, eight languages to a byte."""

    def __init__(self, languages: list[str], found: list[np.ndarray]):
        self.languages = languages
        most = max([len(g) for g in found], default=1)
        self.bits = max(10, int(most * BITS_PER_GRAM - 1).bit_length())
        self.rows = np.zeros((1 << self.bits, (len(languages) + 7) // 8), dtype=np.uint8)
        for i, g in enumerate(found):
            for h in self.places(g):
                self.rows[h, i // 8] |= np.uint8(1 << (i % 8))
        fill = [((self.rows[:, i // 8] >> (i % 8)) & 1).mean() for i in range(len(languages))]
        self.by_chance = np.array(fill) ** HASHES

    def places(self, grams_: np.ndarray) -> list[np.ndarray]:
        low = U64((1 << self.bits) - 1)
        return [((grams_ >> U64(i * 64 // HASHES)) & low).astype(np.int64) for i in range(HASHES)]

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and the share of the n-grams that it contains; ``und`` without letters."""
        doc, h, letters = grams(texts)
        masks = None
        for place in self.places(h):
            row = self.rows[place]
            masks = row if masks is None else masks & row
        total = np.bincount(doc, minlength=len(texts)).astype(float)
        hits = np.zeros((len(texts), len(self.languages)))
        ones = (np.arange(256)[:, None] >> np.arange(8)) & 1
        for w in range(self.rows.shape[1]):
            table = np.bincount(doc * 256 + masks[:, w], minlength=len(texts) * 256).reshape(-1, 256) @ ones
            n = min(8, len(self.languages) - 8 * w)
            hits[:, 8 * w:8 * w + n] = table[:, :n]
        with np.errstate(divide="ignore", invalid="ignore"):
            share = np.nan_to_num((hits / total[:, None] - self.by_chance) / (1 - self.by_chance)).clip(0, 1)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = share.argmax(axis=1)
        names = [self.languages[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist())]
        return names, np.where(letters > 0, share.max(axis=1), 0.0)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> SlicedFilters:
    """Filters from ``labelled``; rows without a language, an id or a text teach nothing.

    Of each language, the ``SAMPLE_DOCS`` documents with the smallest id hashes are read (ties by id).
    """
    rows = labelled.select(F.col(doc_id).alias("_id"), F.col(lang).cast("string").alias("_l"), F.col(text).cast("string").alias("_t"))
    first = W.partitionBy("_l").orderBy(hash_place("_id"), F.xxhash64("_id"), "_id")
    ids = rows.where("_l IS NOT NULL AND _id IS NOT NULL").select("_id", "_l")
    # of a frequent language only about twice the wanted ids are dealt to the task that picks them
    wide = ids.join(F.broadcast(ids.groupBy("_l").agg(F.count(F.lit(1)).alias("_of"))), "_l")  # one row a language
    chosen = (wide.where(smallest_hashes("_id", SAMPLE_DOCS, F.col("_of"))).select("_id", "_l")
              .withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= SAMPLE_DOCS).select("_id", "_l").distinct())
    # SAMPLE_DOCS ids for each language
    sample = rows.join(F.broadcast(chosen), ["_id", "_l"], "left_semi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lo, hi in slices(pc.binary_length(batch.column(1)).fill_null(0).to_pylist()):
                doc, h, _ = grams(batch.column(1)[lo:hi].to_pylist())
                for name in sorted(set(langs[lo:hi])):
                    g, n = np.unique(h[(langs[lo:hi] == name)[doc]], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    counts = (sample.select("_l", "_t").mapInArrow(count, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")).where("n > 1"))
    rate = F.col("n") / F.sum("n").over(W.partitionBy("lang"))
    kept = (counts.withColumn("rate", rate)
            .withColumn("most", F.max("rate").over(W.partitionBy("gram"))).where(F.col("rate") >= SHARE * F.col("most"))
            .withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= MAX_GRAMS))
    got = kept.select("lang", "gram").toPandas()  # MAX_GRAMS for each language
    names = sorted(got["lang"].unique())
    return SlicedFilters(names, [got.loc[got["lang"] == x, "gram"].to_numpy().view(U64) for x in names])


def predict(docs: DataFrame, model: SlicedFilters, text: str = "text") -> DataFrame:
    """Every row with its language: ``row`` (a struct of its columns), ``lang_pred``, ``score``.

    Null texts and texts without a letter are ``und`` with score 0; so is all if nothing was learned.
    Of languages with equal shares the first by name wins. Repeated rows and rows without an id are
    scored like others; an empty table gives an empty table; other columns stay inside ``row``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(pc.binary_length(batch.column(1)).fill_null(0).to_pylist()):
                names, score = sent.value.score(batch.column(1)[lo:hi].to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(names, pa.string()), pa.array(score)], ["row", "lang_pred", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).cast("string").alias("_t"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id", mod: int = 4, rest: int = 2):
    """Rows that teach nothing; rows without an id aren't held out (and teach nothing either)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))
