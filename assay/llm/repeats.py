"""Windows that occur elsewhere, without shipping every window.

A window is W consecutive units (bytes or words) of a document. Its minimiser is the K-gram with
the smallest hash inside it (the leftmost of equals), so equal windows have equal minimisers at the
same place. Consecutive windows that share a minimiser form a piece. The steps:

1. Pieces' minimisers are counted, partly before the shuffle; most occur once, and with them go all
   windows that can't repeat.
2. Of the rest, equal pieces collapse to one variant with a value (how many, or the smallest id).
3. If a minimiser has one variant, its windows all share the variant's value. Otherwise one copy
   of each variant travels as a packed string to the minimiser's bucket, where a sorter compares
   windows with each other. A minimiser with more than ``MAX_VARIANTS`` variants is not collected:
   its windows become 128-bit digests that Spark groups, partly before the shuffle.
4. The values of windows go back to the pieces of all documents, and each document gets its spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm import identity
from assay.llm.words import U64, slices
from assay.session import write_and_read

#: variants of one minimiser that one task compares
MAX_VARIANTS = 20_000
PLACE_BITS = 24
NO_ID = -(1 << 63)


def pieces_of(grams: np.ndarray, span: int, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, place of the minimiser) of all pieces.

    ``grams`` are the K-gram hashes by place, fewer than 2**24; a window has ``span`` of them.
    Text j has the windows lows[j]:highs[j].
    """
    none = np.zeros(0, dtype=np.int64)
    if len(grams) < span:
        return none, none, none
    place = U64((1 << PLACE_BITS) - 1)
    key = (grams & ~place) | np.arange(len(grams), dtype=U64)
    rows = -(-len(key) // span)
    grid = np.full(rows * span, ~U64(0), dtype=U64)
    grid[:len(key)] = key
    grid = grid.reshape(rows, span)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(key) - span + 1
    least = (np.minimum(behind[:n], ahead[span - 1:span - 1 + n]) & place).astype(np.int64)
    ok = np.zeros(n + 1, dtype=np.int64)
    some = highs > lows
    np.add.at(ok, lows[some], 1)
    np.add.at(ok, highs[some], -1)
    valid = np.cumsum(ok[:n]) > 0
    edge = np.zeros(n + 1, dtype=bool)
    edge[lows[some]] = True
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1] | edge[1:n]
    at = np.flatnonzero(new)
    last = valid.copy()
    last[:-1] &= new[1:] | ~valid[1:]
    return at, np.flatnonzero(last) + 1 - at, least[at]


def keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``d`` (NO_ID for a missing id) and ``th`` (128 bits) name a row; rows alike in both are alike in all that counts here."""
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("_t"))
    return identity.ordered(docs, "doc_id", NO_ID).select("d", identity.digest("_t").alias("th"), "doc_id", "_t")


Pieces = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
Pack = Callable[[bytes, list[tuple[int, int]]], list[bytes]]
Sorter = Callable[[list[bytes], list[int], list[int]], list[list[tuple[int, int, int]]]]
Digests = Callable[[bytes, int], np.ndarray]


def small(batches: Iterator[pa.RecordBatch], texts: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of little text; ``texts`` is the column that holds it."""
    for batch in batches:
        for lo, hi in slices(pc.binary_length(batch.column(texts)).fill_null(0).to_pylist()):
            yield batch.slice(lo, hi - lo)


def all_pieces(docs: DataFrame, pieces: Pieces, batches_of: Callable[[list[int]], Iterator[tuple[int, int]]]) -> DataFrame:
    """``m`` minimiser, ``p`` hash of the piece, ``d``, ``th``, ``at`` first window, ``n`` windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in batches_of(pc.binary_length(batch.column(2)).to_pylist()):
                doc, m, p, at, n = pieces(batch.column(2)[lo:hi].to_pylist())
                take = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m.view(np.int64)), pa.array(p.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take),
                     pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], ["m", "p", "d", "th", "at", "n"])

    return docs.select("d", "th", "_t").mapInArrow(run, "m long, p long, d long, th binary, at int, n int")


def repeated_windows(docs: DataFrame, every: DataFrame, *, by_document: bool, pack: Pack, sorter: Sorter, digests: Digests,
                     max_variants: int = MAX_VARIANTS) -> DataFrame:
    """``d``, ``th``, ``spans`` (array of struct from, to: windows) of documents with repeated windows.

    ``by_document``: a window counts as repeated if a smaller id has it too, else if it occurs twice.
    """
    value = F.min("d") if by_document else F.count(F.lit(1))
    again = F.min("d") < F.max("d") if by_document else F.count(F.lit(1)) > 1
    live_m = write_and_read(every.groupBy("m").agg(again.alias("again")).where("again").select("m"), "windows-minimisers")
    live = write_and_read(every.join(live_m, "m"), "windows-pieces")

    one = F.min(F.struct("d", "th", "at"))
    variants = write_and_read(live.groupBy("m", "p", "n").agg(value.alias("v"), one.alias("one")), "windows-variants")
    per_m = write_and_read(variants.groupBy("m").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "windows-contested")
    alone = variants.join(per_m, "m", "left_anti").select("m", "p", F.array(_run(F.lit(0), F.col("n"), F.col("v"))).alias("runs"))

    contested = variants.join(per_m, "m").select("m", "p", "v", "n", "k", "one.*")
    lists = contested.groupBy("d", "th").agg(F.collect_list(F.struct("at", "n", "m", "p", "v", "k")).alias("list"))
    packed = write_and_read(_packed(docs.join(lists, ["d", "th"]), pack), "windows-packed")
    usual = _sorted(packed.where(F.col("k") <= max_variants), sorter)
    hot = _grouped(packed.where(F.col("k") > max_variants), digests, by_document)
    runs = write_and_read(alone.union(usual).union(hot), "windows-runs")

    here = F.explode("runs")
    found = (live.join(runs, ["m", "p"]).select("d", "th", "at", here.alias("r"))
             .where(F.col("r.v") < F.col("d") if by_document else F.col("r.v") > 1)
             .select("d", "th", F.struct((F.col("at") + F.col("r.from")).alias("from"), (F.col("at") + F.col("r.to")).alias("to")).alias("s")))
    return found.groupBy("d", "th").agg(F.collect_set("s").alias("spans"))


def _run(lo: Column, hi: Column, v: Column) -> Column:
    return F.struct(lo.cast("int").alias("from"), hi.cast("int").alias("to"), v.cast("long").alias("v"))


def _packed(lists: DataFrame, pack: Pack) -> DataFrame:
    """One row for each variant, with its string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 0):
            rows, strings = [], []
            for text, pieces in zip(batch.column(0), batch.column(1)):
                mine = pieces.as_py()
                rows += mine
                strings += pack(text.as_py(), [(r["at"], r["n"]) for r in mine])
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([r[c] for r in rows], t) for c, t in (("m", pa.int64()), ("p", pa.int64()), ("v", pa.int64()), ("k", pa.int64()), ("n", pa.int32()))],
                 pa.array(strings, pa.binary())], ["m", "p", "v", "k", "n", "packed"])

    # rows alike in id and text give the same strings: one of them is enough
    return lists.select("_t", "list").mapInArrow(run, "m long, p long, v long, k long, n int, packed binary")


RUNS = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("v", pa.int64())]))
RUNS_SQL = "array<struct<from: int, to: int, v: long>>"


def _sorted(packed: DataFrame, sorter: Sorter, rows_at_once: int = 2048) -> DataFrame:
    """Runs of windows with one value, for each variant; a task compares whole buckets in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, p, v, n, s = [], [], [], [], []

        def flush(upto: int) -> pa.RecordBatch:
            runs = sorter(s[:upto], n[:upto], v[:upto])
            out = pa.RecordBatch.from_arrays(
                [pa.array(m[:upto], pa.int64()), pa.array(p[:upto], pa.int64()),
                 pa.array([[{"from": a, "to": b, "v": x} for a, b, x in r] for r in runs], RUNS)], ["m", "p", "runs"])
            for x in (m, p, v, n, s):
                del x[:upto]
            return out

        for batch in batches:
            for lo in range(0, batch.num_rows, rows_at_once):
                for x, c in zip((m, p, v, n, s), batch.slice(lo, rows_at_once).columns):
                    x += c.to_pylist()
                if len(m) >= rows_at_once:
                    upto = len(m)
                    while upto and m[upto - 1] == m[-1]:  # the last bucket may go on
                        upto -= 1
                    if upto:
                        yield flush(upto)
        if m:
            yield flush(len(m))

    return (packed.select("m", "p", "v", "n", "packed").distinct().repartition("m").sortWithinPartitions("m")
            .mapInArrow(run, f"m long, p long, runs {RUNS_SQL}"))


def _grouped(packed: DataFrame, digests: Digests, by_document: bool) -> DataFrame:
    """The same for buckets too large to collect: windows as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, p, v, n, s in zip(*[c.to_pylist() for c in batch.columns]):
                two = digests(s, n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(two[0].view(np.int64)), pa.array(two[1].view(np.int64)), pa.array([m] * n, pa.int64()), pa.array([p] * n, pa.int64()),
                     pa.array([v] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32))], ["w1", "w2", "m", "p", "v", "i"])

    windows = packed.select("m", "p", "v", "n", "packed").distinct().mapInArrow(run, "w1 long, w2 long, m long, p long, v long, i int")
    total = windows.groupBy("w1", "w2").agg((F.min("v") if by_document else F.sum("v")).alias("all"))
    return (windows.join(write_and_read(total, "windows-digests"), ["w1", "w2"]).groupBy("m", "p")
            .agg(F.collect_list(_run(F.col("i"), F.col("i") + 1, F.col("all"))).alias("runs")))


def value_runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(from, to, value) of runs of equal values."""
    cut = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return [(a, b, int(values[a])) for a, b in zip(cut, cut[1:])]


def joined(spans: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """Windows from:to, each ``width`` units long, as maximal covered runs of units."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        b += width - 1
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out
