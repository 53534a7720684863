"""Removal of word passages that an earlier document already has.

Consecutive windows of words that share a minimiser travel as one packed string to the minimiser's
bucket (see ``repeats``), where sorting the windows brings equal ones together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm import repeats
from assay.llm.words import BYTES2, NOT_SPACE, U64, WORDS, WORDS2, Words, mix, slices

WINDOW, GRAM = 50, 20
#: words of a longer text are cut into parts that overlap by a window less one word
PART = 1 << 20


def pieces(texts: list[bytes], width: int = WINDOW, gram: int = GRAM, part: int = PART) -> tuple[np.ndarray, ...]:
    """Text number, minimiser, piece hash, first window and number of windows of all pieces."""
    w = Words(texts, NOT_SPACE)
    wh, other = w.hashes(), w.hashes(BYTES2)
    lows = w.first[:-1]
    highs = np.maximum(lows, w.first[1:] - width + 1)
    out = [(np.zeros(0, dtype=U64), np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    for a in range(0, max(1, len(wh) - width + 1), part):
        z = a + part + width - 1
        grams = mix(WORDS.windows(WORDS.prefix(wh[a:z]), gram))
        most = max(0, len(wh[a:z]) - width + 1)
        at, n, place = repeats.pieces_of(grams, width - gram + 1, np.clip(lows - a, 0, most), np.clip(highs - a, 0, most))
        p = mix(WORDS2.runs(WORDS2.prefix(other[a:z]), at, at + n + width - 1) + n.astype(U64))
        out.append((grams[place], p, at + a, n))
    m, p, at, n = (np.concatenate(x) for x in zip(*out))
    doc = np.searchsorted(w.first, at, "right") - 1
    return doc, m, p, at - w.first[doc], n


def pack(text: bytes, wanted: list[tuple[int, int]], width: int = WINDOW) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[at:at + n + width - 1]) for at, n in wanted]


def sorter(strings: list[bytes], n: list[int], v: list[int], width: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """For each packed string: runs of windows with the smallest document that has them."""
    windows: list[tuple[bytes, int, int]] = []
    least = [np.full(k, x, dtype=np.int64) for k, x in zip(n, v)]
    for i, (s, k) in enumerate(zip(strings, n)):
        buf = np.frombuffer(s, dtype=np.uint8)
        cut = np.concatenate([[-1], np.flatnonzero(buf == 32), [len(s)]])
        windows += [(s[a + 1:z], i, j) for j, (a, z) in enumerate(zip(cut[:k].tolist(), cut[width:width + k].tolist()))]
    windows.sort()
    lo = 0
    for hi in range(1, len(windows) + 1):
        if hi == len(windows) or windows[hi][0] != windows[lo][0]:
            if hi - lo > 1:
                x = min(v[i] for _, i, _ in windows[lo:hi])
                for _, i, j in windows[lo:hi]:
                    least[i][j] = x
            lo = hi
    return [repeats.value_runs(x) for x in least]


def digests(string: bytes, n: int, width: int = WINDOW) -> np.ndarray:
    w = Words([string], NOT_SPACE)
    return np.stack([mix(h.windows(h.prefix(x), width)) for h, x in ((WORDS, w.hashes()), (WORDS2, w.hashes(BYTES2)))])[:, :n]


def remove_repeats(docs: DataFrame, width: int = WINDOW, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id",
                   max_variants: int = repeats.MAX_VARIANTS) -> DataFrame:
    """Every row of ``docs``: ``doc_id``, ``n_words``, ``removed`` (maximal word spans), ``kept``
    (the other words, joined by one space).

    A word goes if a window of ``width`` words that covers it also starts in a document with a
    smaller id. Words are cut at ASCII white space. Null counts as empty; shorter texts lose
    nothing, nor do repeats inside one document or between rows with the same id. A missing id
    counts as smaller than all others. Empty tables give empty tables; other columns are not read.
    """
    docs = repeats.keyed(docs, text, doc_id)
    every = repeats.all_pieces(docs, lambda t: pieces(t, width, gram), slices)
    spans = repeats.repeated_windows(
        docs, every, by_document=True, max_variants=max_variants, pack=lambda t, w: pack(t, w, width),
        sorter=lambda s, n, v: sorter(s, n, v, width), digests=lambda s, n: digests(s, n, width))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, removed array<struct<from: long, to: long>>, kept binary"
    span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in repeats.small(batches, 1):
            total, removed, kept = [], [], []
            for t, s in zip(batch.column(1), batch.column(2)):
                words = t.as_py().split()
                s = repeats.joined([(x["from"], x["to"]) for x in s.as_py() or []], width)
                ends = [0, *[x for ab in s for x in ab], len(words)]
                total.append(len(words))
                removed.append([{"from": a, "to": b} for a, b in s])
                kept.append(b" ".join([x for a, b in zip(ends[::2], ends[1::2]) for x in words[a:b]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())], ["doc_id", "n_words", "removed", "kept"])

    return docs.join(spans, ["d", "th"], "left").select("doc_id", "_t", "spans").mapInArrow(run, schema)


def digest_columns(result: DataFrame) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return result.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, s, md5(array_to_string(ws[s + 1:s + 50], ' ')) AS h
      FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS s FROM d WHERE len(ws) >= 50)),
first AS (SELECT h, min(doc_id) AS f FROM w GROUP BY h),
hit AS (SELECT doc_id, list(s) AS hs FROM w JOIN first USING (h) WHERE f < doc_id GROUP BY doc_id),
gone AS (SELECT doc_id, list_distinct(flatten(list_transform(hs, lambda s: range(s, s + 50)))) AS g FROM hit),
kept AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  CASE WHEN g IS NULL THEN ws ELSE list_transform(list_sort(list_filter(range(0, len(ws)), lambda i: NOT list_contains(g, i))), lambda i: ws[i + 1]) END AS k
  FROM d LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""
