"""Benchmark decontamination by a broadcast hash set of the benchmark's word windows.

Words are runs of digits, a-z and non-ASCII characters after A-Z are lower-cased. An item gives its
windows of ``n`` words, or one window if it is shorter. The distinct windows go to the executors as
a sorted hash set with a bit table in front; documents are scanned window by window, hits are
compared word by word, and what was hit comes back as word and byte spans. A benchmark with more
windows than one set may hold is sent and scanned in blocks of bounded size, one after another.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assay.llm.words import ALNUM, U64, Words, inside, slices, window_hashes
from assay.session import write_and_read

#: windows of one broadcast set, and bits of the table in front of it
BLOCK_WINDOWS, FRONT_BITS = 500_000, 22

SPANS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("word_from", "word_to", "byte_from", "byte_to")]))


def benchmark_windows(bench: DataFrame, n: int = 10, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows: ``window`` (words joined by a space), ``n_window_words``, ``items``
    (ids as strings). Items without words have none; those without an id count under no name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = Words([t], ALNUM, lower=True)
                words = [w.word(j) for j in range(len(w.start))]
                k = min(n, len(words))
                out += [(i, b" ".join(words[j:j + k]).decode(), k) for j in range(len(words) - k + 1) if k]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.string(), pa.int64()))],
                ["item", "window", "n_window_words"])

    rows = bench.select(F.col(item).cast("string"), F.col(text).cast("string").cast("binary"))
    return (rows.mapInArrow(run, "item string, window string, n_window_words long")
            .groupBy("window", "n_window_words").agg(F.collect_set("item").alias("items")))


class WindowSet:
    """The windows of one block, found by hash and confirmed by words."""

    def __init__(self, windows: list[str], items: list[list[str]]):
        by_size: dict[int, list[int]] = {}
        self.windows, self.items = [w.encode() for w in windows], items
        for i, w in enumerate(self.windows):
            by_size.setdefault(w.count(b" ") + 1, []).append(i)
        self.sets: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}
        for k, rows in by_size.items():
            hashes = []
            for lo in range(0, len(rows), 4096):
                w = Words([self.windows[i] for i in rows[lo:lo + 4096]], ALNUM)
                hashes.append(window_hashes(w.hashes(), k)[::k])
            found: dict[int, list[int]] = {}
            for h, i in zip(np.concatenate(hashes).tolist(), rows):
                found.setdefault(h, []).append(i)
            front = np.zeros(1 << FRONT_BITS, dtype=bool)
            front[np.concatenate(hashes) >> U64(64 - FRONT_BITS)] = True
            self.sets[k] = front, found

    def scan(self, words: Words) -> list[tuple[int, int, int]]:
        """Confirmed (first word, words, window) of a batch."""
        hits, wh = [], words.hashes()
        for k, (front, found) in self.sets.items():
            h = window_hashes(wh, k)
            maybe = np.flatnonzero(front[h >> U64(64 - FRONT_BITS)])
            if not len(maybe):
                continue
            maybe = maybe[inside(words.first, k, len(h))[maybe]]
            for at, x in zip(maybe.tolist(), h[maybe].tolist()):
                for i in found.get(x, ()):
                    if b" ".join([words.word(j) for j in range(at, at + k)]) == self.windows[i]:
                        hits.append((at, k, i))
        return hits


_BUILT: dict[str, WindowSet] = {}


def _window_set(name: str, windows: list[str], items: list[list[str]]) -> WindowSet:
    """The set of a broadcast block, built once by each worker process."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = WindowSet(windows, items)
    return _BUILT[name]


def _join_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def find_leaks(docs: DataFrame, bench: DataFrame, n: int = 10, text: str = "text", item: str = "item_id",
               bench_text: str = "text", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Every row of ``docs`` with what the benchmark hit in it.

    Returns ``row`` (a struct of all columns of the document), ``n_words``, ``spans`` (maximal runs
    of hit words, as word numbers and byte offsets, ends exclusive) and ``items`` (distinct ids as
    strings, sorted). Null, empty and wordless texts have no hits; an empty benchmark hits nothing;
    repeated rows and rows with null ids are each scanned; other columns stay inside ``row``.
    """
    windows = write_and_read(benchmark_windows(bench, n, item, bench_text), "benchmark-windows")
    blocks = max(1, math.ceil(windows.count() / block_windows))
    windows = windows.withColumn("_block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.lit(0).cast("long").alias("n_words"),
        F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"),
        F.col(f"`{text}`").cast("string").cast("binary").alias("_t"))
    for b in range(blocks):
        rows = _scan(rows, windows.where(F.col("_block") == b).select("window", "items"))
        if b + 1 < blocks:
            rows = write_and_read(rows, "benchmark-block")
    return rows.drop("_t")


def _scan(rows: DataFrame, block: DataFrame) -> DataFrame:
    """Add one block's hits. The block is about ``block_windows`` long, whatever the benchmark's size."""
    got = block.collect()
    sent, name = rows.sparkSession.sparkContext.broadcast(([r[0] for r in got], [r[1] for r in got])), uuid.uuid4().hex
    names = ("word_from", "word_to", "byte_from", "byte_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _window_set(name, *sent.value)
        for batch in batches:
            texts = batch.column(4)
            for lo, hi in slices(pc.binary_length(texts).fill_null(0).to_pylist()):
                words = Words(texts[lo:hi].to_pylist(), ALNUM, lower=True)
                ranges = [[(s["word_from"], s["word_to"]) for s in old] for old in batch.column(2)[lo:hi].to_pylist()]
                items = [set(x) for x in batch.column(3)[lo:hi].to_pylist()]
                for at, k, i in windows.scan(words):
                    d = int(np.searchsorted(words.first, at, "right")) - 1
                    a = at - int(words.first[d])
                    ranges[d].append((a, a + k))
                    items[d].update(windows.items[i])
                spans = []
                for d, found in enumerate(ranges):
                    w0, b0 = int(words.first[d]), int(words.at[d])
                    spans.append([dict(zip(names, (a, z, int(words.start[w0 + a]) - b0, int(words.end[w0 + z - 1]) - b0)))
                                  for a, z in _join_spans(found)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], pa.array(np.diff(words.first).astype(np.int64)),
                     pa.array(spans, pa.list_(pa.struct([(c, pa.int64()) for c in names]))),
                     pa.array([sorted(x) for x in items], pa.list_(pa.string())), texts[lo:hi]],
                    ["row", "n_words", "spans", "items", "_t"])

    return rows.mapInArrow(run, rows.schema)


def hit_words(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["word_to"] - s["word_from"])


def digests(leaks: DataFrame) -> DataFrame:
    return leaks.select(
        "row.doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit_words() > 0).alias("contaminated"))


def without_spans(leaks: DataFrame, text: str = "text") -> DataFrame:
    """The documents' own columns, the hit words cut out of ``text``."""
    # bytes: Latin-1 gives each byte one character, so that byte offsets can be used
    whole = F.decode(F.encode(F.col(f"row.{text}"), "UTF-8"), "ISO-8859-1")
    cut = F.aggregate(
        F.col("spans"), F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["kept"], F.substring(whole, (acc["at"] + 1).cast("int"), (s["byte_from"] - acc["at"]).cast("int"))).alias("kept"),
            s["byte_to"].alias("at")),
        lambda acc: F.concat(acc["kept"], F.substring(whole, (acc["at"] + 1).cast("int"), F.length(whole))))
    kept = F.decode(F.encode(cut, "ISO-8859-1"), "UTF-8")
    fields = leaks.schema["row"].dataType.names
    return leaks.select(*[
        (F.when(F.size("spans") > 0, kept).otherwise(F.col(f"row.{c}")) if c == text else F.col(f"row.{c}")).alias(c) for c in fields])


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, k, array_to_string(ws[s + 1:s + k], ' ') AS t
        FROM (SELECT item_id, ws, least(10, len(ws)) AS k, unnest(range(0, len(ws) - least(10, len(ws)) + 1)) AS s FROM bw WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT k FROM win),
run AS (SELECT doc_id, s, k, array_to_string(ws[s + 1:s + k], ' ') AS t
        FROM (SELECT doc_id, ws, k, unnest(range(0, len(ws) - k + 1)) AS s FROM dw, ks WHERE len(ws) >= k)),
hit AS (SELECT doc_id, s, run.k, item FROM run JOIN win ON run.t = win.t AND run.k = win.k),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS i FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
