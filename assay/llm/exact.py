"""Exact dedup through counting quotient filters.

Each partition puts its fingerprints into one counting quotient filter for each block (the leading bits).
Inside a block the upper bits of a fingerprint are its quotient: a bit says whether the quotient occurs,
its remainders form a sorted run, and a bit ends the run, so a slot holds remainder bits only. A count above
one is a marked slot and a number of one byte or more. Filters of a block meet in one task and merge run by
run in their order, without loss; counters add up. A fingerprint counted a million times is one slot, so no
key is hot. Only rows whose fingerprint is counted more than once go on to the comparison of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.llm.words import U64
from assay.session import write_and_read

#: bits of a fingerprint; texts that share one are told apart by their bytes
WIDTH = 56


def _packed(values: np.ndarray, bits: int) -> bytes:
    if not bits:
        return b""
    return np.packbits(((values[:, None] >> np.arange(bits, dtype=U64)) & U64(1)).astype(np.uint8)).tobytes()


def _unpacked(data: bytes, n: int, bits: int) -> np.ndarray:
    if not bits or not n:
        return np.zeros(n, dtype=U64)
    each = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits).reshape(n, bits).astype(U64)
    return (each << np.arange(bits, dtype=U64)).sum(axis=1, dtype=U64)


def _numbers(values: np.ndarray) -> bytes:
    """Numbers in groups of seven bits, low ones first; the eighth bit says that more follow."""
    size = np.maximum(1, np.ceil(np.log2(values.astype(float) + 1) / 7).astype(int)) if len(values) else np.zeros(0, dtype=int)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    groups = (np.repeat(values, size) >> (7 * place)) & 127
    return (groups + np.where(place + 1 < np.repeat(size, size), 128, 0)).astype(np.uint8).tobytes()


def _read_numbers(data: bytes) -> np.ndarray:
    each = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    start = np.concatenate([[True], each[:-1] < 128]) if len(each) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(start)
    place = np.arange(len(each)) - np.repeat(at, np.diff(np.append(at, len(each))))
    return np.add.reduceat((each & 127) << (7 * place), at) if len(at) else each


class CountingQuotientFilter:
    """Counts of distinct ``width``-bit fingerprints, as quotient and run-end bits, remainders and counters."""

    def __init__(self, fingerprints: np.ndarray, counts: np.ndarray | None = None, width: int = 64):
        distinct, at = np.unique(fingerprints, return_inverse=True)
        n = np.ones(len(fingerprints), dtype=np.int64) if counts is None else counts
        self._set(distinct, np.bincount(at, n, len(distinct)).astype(np.int64), width)

    def _set(self, sorted_distinct: np.ndarray, counts: np.ndarray, width: int) -> None:
        """Slots of fingerprints that come in order."""
        n = len(sorted_distinct)
        self.width, self.quotient_bits = width, min(width - 1, max(0, (n - 1).bit_length()) if n else 0)
        self.remainder_bits = width - self.quotient_bits
        # a shift by all 64 bits is no shift
        quotient = sorted_distinct >> U64(self.remainder_bits) if self.quotient_bits else np.zeros(n, dtype=U64)
        self.occupied = np.zeros(1 << self.quotient_bits, dtype=bool)
        self.occupied[quotient.astype(np.int64)] = True
        self.run_end = np.append(quotient[1:] != quotient[:-1], True) if n else np.zeros(0, dtype=bool)
        mask = U64((1 << self.remainder_bits) - 1)
        self.remainders, self.counts = sorted_distinct & mask, counts

    def fingerprints(self) -> np.ndarray:
        run = np.cumsum(self.run_end) - self.run_end
        quotient = np.flatnonzero(self.occupied).astype(U64)[run] if len(run) else np.zeros(0, dtype=U64)
        return (quotient << U64(self.remainder_bits)) | self.remainders if self.quotient_bits else self.remainders

    def count_of(self, fingerprint: int) -> int:
        """By rank and select: the run of the quotient, then the remainder inside."""
        quotient, remainder = fingerprint >> self.remainder_bits, fingerprint & ((1 << self.remainder_bits) - 1)
        if not len(self.run_end) or not self.occupied[quotient]:
            return 0
        run, ends = int(self.occupied[:quotient].sum()), np.flatnonzero(self.run_end)
        lo, hi = int(ends[run - 1]) + 1 if run else 0, int(ends[run]) + 1
        at = lo + int(np.searchsorted(self.remainders[lo:hi], U64(remainder)))
        return int(self.counts[at]) if at < hi and self.remainders[at] == remainder else 0

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """Both filters' slots in order, walked once; equal neighbours add up."""
        a, b = self.fingerprints(), other.fingerprints()
        at = np.arange(len(b)) + np.searchsorted(a, b, side="right")
        both, counts = np.empty(len(a) + len(b), dtype=U64), np.empty(len(a) + len(b), dtype=np.int64)
        mine = np.ones(len(both), dtype=bool)
        mine[at] = False
        both[at], both[mine], counts[at], counts[mine] = b, a, other.counts, self.counts
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, dtype=np.int64)
        out = CountingQuotientFilter.__new__(CountingQuotientFilter)
        out._set(both[first], np.add.reduceat(counts, first) if len(first) else counts, self.width)
        return out

    @staticmethod
    def merged(parts: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """In pairs, so that each slot is walked once for each doubling."""
        while len(parts) > 1:
            parts = [a.merge(b) for a, b in zip(parts[::2], parts[1::2])] + (parts[-1:] if len(parts) % 2 else [])
        return parts[0]

    def to_bytes(self) -> bytes:
        many = self.counts > 1
        bits = [np.packbits(x).tobytes() for x in (self.occupied, self.run_end, many)]
        counters = _numbers(self.counts[many])
        return b"".join([np.array([self.width, self.quotient_bits], dtype=np.uint8).tobytes(), np.array([len(self.counts), len(counters)], dtype="<u4").tobytes(),
                         *bits, counters, _packed(self.remainders, self.remainder_bits)])

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        out = cls.__new__(cls)
        out.width, out.quotient_bits = data[0], data[1]
        out.remainder_bits = out.width - out.quotient_bits
        n, size = (int(x) for x in np.frombuffer(data[2:10], dtype="<u4"))
        at, bits = 10, []
        for count in (1 << out.quotient_bits, n, n):
            bits.append(np.unpackbits(np.frombuffer(data[at:at + -(-count // 8)], dtype=np.uint8), count=count).astype(bool))
            at += -(-count // 8)
        out.occupied, out.run_end, many = bits
        out.counts = np.ones(n, dtype=np.int64)
        out.counts[many] = _read_numbers(data[at:at + size])
        out.remainders = _unpacked(data[at + size:], n, out.remainder_bits)
        return out


def repeated_fingerprints(fingerprints: DataFrame, block_bits: int, width: int = WIDTH) -> DataFrame:
    """``fp``, ``n`` for the values of the column ``fp`` (whole numbers of ``width`` bits) that occur more than once."""
    inner = width - block_bits

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters: list[CountingQuotientFilter] = []
        for batch in batches:
            filters.append(CountingQuotientFilter(batch.column(0).to_numpy(zero_copy_only=False).view(U64), width=width))
            if len(filters) == 16:
                filters = [CountingQuotientFilter.merged(filters)]
        if not filters:
            return
        whole = CountingQuotientFilter.merged(filters)
        f, counts = whole.fingerprints(), whole.counts
        edges = np.searchsorted(f, np.arange(1 << block_bits, dtype=U64) << U64(inner)).tolist() + [len(f)]
        rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo]
        mask = U64((1 << inner) - 1)
        for at in range(0, len(rows), 256):
            part = rows[at:at + 256]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in part], pa.int32()),
                 pa.array([CountingQuotientFilter(f[lo:hi] & mask, counts[lo:hi], inner).to_bytes() for _, lo, hi in part], pa.binary())], ["block", "filter"])

    def merge(table: pa.Table) -> pa.Table:
        q = CountingQuotientFilter.merged([CountingQuotientFilter.from_bytes(x) for x in table.column("filter").to_pylist()])
        many, block = q.counts > 1, U64(table.column("block")[0].as_py() << inner)
        return pa.table({"fp": pa.array((q.fingerprints()[many] | block).view(np.int64)), "n": pa.array(q.counts[many])})

    return (fingerprints.select("fp").mapInArrow(build, "block int, filter binary")
            .groupBy("block").applyInArrow(merge, "fp long, n long"))


def fingerprint(text: str):
    return F.shiftrightunsigned(F.xxhash64(text), 64 - WIDTH)


def normalised(text: str = "text"):
    """White space runs as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are after each run of ASCII white space becomes one space; null counts
    as empty, and empty texts equal each other. The smallest id of a group stays; a group in which
    no id is known has a null ``keep_id`` and is kept. Rows that repeat an id with its text count
    each in ``group_size`` and get the same verdict. An empty table gives an empty table; other
    columns are not read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), normalised(f"`{text}`").alias("norm"))
    ids = write_and_read(
        source.select("doc_id", fingerprint("norm").alias("fp"), F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256")), "exact-ids")
    # a few blocks of quotients for each reducer
    again = write_and_read(repeated_fingerprints(ids, (4 * parts).bit_length()), "exact-repeated").select("fp")
    # comparison of bytes: equal texts are grouped by their whole text, partly before the shuffle
    classes = (
        source.withColumn("fp", fingerprint("norm")).join(again, "fp", "left_semi")
        .groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"), "keep_id", "group_size"))
    return ids.join(classes, "text_sha256", "left").select(
        "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("group_size").isNull() | F.col("keep_id").isNull()).alias("kept"),
        "text_sha256")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
