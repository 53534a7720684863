"""Near-duplicate groups of documents by MinHash.

Each document's set of word shingles gets many minima of universal hash functions. Documents with
equal sets are one class. Classes that agree on a band of minima share a bucket. In each bucket all
members are paired with the smallest one; signatures drop hopeless pairs, full sets confirm the
rest, and alternating large-star and small-star give the components. Buckets that still hold several
components are looked at again, equal buckets once: blocks of members meet inside tasks, pairs of
different components are taken from the likeliest signatures down and confirmed on the full sets,
and each confirmed one joins two components there. So a task returns fewer links than it has
members, whatever the number of pairs, and no pair that signatures allow is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm import identity
from assay.llm.components import connected_components
from assay.llm.words import NOT_SPACE, U64, WORDS, Words, inside, mix, slices
from assay.session import write_and_read

#: bands and minima in each. A pair at similarity 0.8 misses all bands with probability 4e-7.
BANDS, PER_BAND = 28, 4
#: signatures may understate the similarity by this much (over five standard deviations)
SLACK = 0.2
#: members of a bucket in one block; a task meets two blocks at a time
BLOCK = 1024


@cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    n = BANDS * PER_BAND
    return (rng.integers(0, 1 << 63, n, dtype=U64) << U64(1)) | U64(1), rng.integers(0, 1 << 63, n, dtype=U64)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct ``k``-word shingles; all words as one if there are fewer."""
    w = Words(texts, NOT_SPACE, lower=True)
    prefix = WORDS.prefix(w.hashes())
    every = mix(WORDS.windows(prefix, k))
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(every[a:b - k + 1]))
        elif b > a:
            out.append(mix(WORDS.runs(prefix, np.array([a]), np.array([b])) + U64(b - a)))
        else:
            out.append(np.zeros(0, dtype=U64))
    return out


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return np.array([mix(hashes).sum(dtype=U64), mix(hashes ^ U64(0xC0FFEE)).sum(dtype=U64)], dtype=">u8").tobytes()


def minima(hashes: np.ndarray) -> np.ndarray:
    a, b = _functions()
    least = np.full(len(a), 0xFFFFFFFF, dtype=U64)
    for lo in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[lo:lo + 1024, None] * a + b) >> U64(32)).min(axis=0), out=least)
    return least.astype("<u4")


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(pc.binary_length(batch.column(1)).fill_null(0).to_pylist()):
                sets = shingle_sets(batch.column(1)[lo:hi].to_pylist(), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.binary()),
                     pa.array([minima(s).tobytes() for s in sets], pa.binary())], ["doc_id", "th", "n_shingles", "key", "minima"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "_t", "th").mapInArrow(run, f"doc_id {id_type}, th binary, n_shingles long, key binary, minima binary")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(pc.binary_length(batch.column(0)).fill_null(0).to_pylist()):
                sets = shingle_sets(batch.column(0)[lo:hi].to_pylist(), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "members"])

    return docs.select("_t").mapInArrow(run, "key binary, members binary")


def _bands(classes: DataFrame) -> DataFrame:
    """``bucket``, ``key``: one row for each class and band."""
    size = 4 * PER_BAND
    return classes.select("key", F.explode(F.array(*[
        F.xxhash64(F.lit(b), F.substring("minima", 1 + b * size, size)) for b in range(BANDS)])).alias("bucket"))


def _by_signature(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs whose minima agree often enough."""
    sig = classes.select("key", "minima")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u4").reshape(batch.num_rows, -1) for i in (2, 3))
                ok = pa.array((x == y).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return (pairs.join(sig.withColumnsRenamed({"key": "b", "minima": "y"}), "b")
            .join(sig.withColumnsRenamed({"key": "a", "minima": "x"}), "a").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary"))


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted sets."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that are linked by their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = pa.array([_linked(np.frombuffer(x.as_py(), dtype=U64), np.frombuffer(y.as_py(), dtype=U64), percent)
                           for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], ["a", "b"])

    return (pairs.join(sets.withColumnsRenamed({"key": "b", "members": "y"}), "b")
            .join(sets.withColumnsRenamed({"key": "a", "members": "x"}), "a").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary"))


def _across(mixed: DataFrame, classes: DataFrame, sets: DataFrame, least: float, percent: int, block: int) -> DataFrame:
    """Confirmed links between components that share a bucket: enough to join all components that
    any pair in the bucket links. ``mixed`` has bucket, n, key, comp."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = (mixed.withColumn("blk", F.pmod(F.xxhash64("key"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .withColumn("lo", F.least("blk", "other")).withColumn("hi", F.greatest("blk", "other"))
             .join(classes.select("key", "minima"), "key").join(sets, "key"))

    def compare(table: pa.Table) -> pa.Table:
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        key, comp = table.column("key").to_pylist(), table.column("comp").to_pylist()
        blk = table.column("blk").to_numpy()
        sig = np.frombuffer(b"".join(table.column("minima").to_pylist()), dtype="<u4").reshape(len(key), -1)
        full = [np.frombuffer(x.as_py(), dtype=U64) for x in table.column("members")]
        size = np.array([len(x) for x in full])
        number = {c: i for i, c in enumerate(dict.fromkeys(comp))}
        group = np.array([number[c] for c in comp])
        root = list(range(len(number)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        left, right = np.flatnonzero(blk == lo), np.flatnonzero(blk == hi)
        found = []
        for i in left.tolist():
            other = right[right > i] if lo == hi else right
            other = other[(group[other] != group[i]) & (100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i]))]
            same = (sig[other] == sig[i]).mean(axis=1)
            good = same >= least
            found.append(np.stack([np.full(int(good.sum()), i), other[good], (same[good] * 1e6).astype(np.int64)]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((3, 0), dtype=np.int64)
        pairs = pairs[:, np.lexsort((pairs[1], pairs[0], -pairs[2]))]
        out = []
        for i, j in zip(pairs[0].tolist(), pairs[1].tolist()):
            a, b = find(int(group[i])), find(int(group[j]))
            if a != b and _linked(full[i], full[j], percent):
                root[a] = b
                out.append((min(key[i], key[j]), max(key[i], key[j])))
        return pa.table({c: pa.array([r[i] for r in out], pa.binary()) for i, c in enumerate(("a", "b"))})

    return (dealt.select("bucket", "lo", "hi", "key", "comp", "blk", "minima", "members").groupBy("bucket", "lo", "hi")
            .applyInArrow(compare, "a binary, b binary").distinct())


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``doc_id``, ``th`` (digest of the text; both name a row), ``_t``."""
    t = F.col(f"`{text}`").cast("string").cast("binary")
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), identity.digest(t).alias("th"), t.alias("_t"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def _row() -> Column:
    """Name of a row; the order is by id, rows without one last."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")


def _components(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (``doc_id, th, n_shingles, key``) and classes (``key, rep``: first row of the component). Classes are named by
    their sets' keys throughout, so whether their rows have ids changes no link."""
    rows = write_and_read(_sketches(docs, shingle), "minhash-rows")
    classes = write_and_read(rows.where("n_shingles > 0").groupBy("key").agg(F.min(_row()).alias("rep"), F.min("minima").alias("minima")), "minhash-classes")
    least = percent / 100 - SLACK

    bands = _bands(classes)
    buckets = write_and_read(bands.groupBy("bucket").agg(F.min("key").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1"), "minhash-buckets")
    members = write_and_read(bands.join(buckets, "bucket"), "minhash-members")  # bucket, key, hub, n
    wanted = classes.join(members.select("key").distinct(), "key", "left_semi").select("rep.doc_id", "rep.th")
    sets = write_and_read(_sets(docs.join(wanted, _same(docs, wanted), "left_semi"), shingle)
                          .groupBy("key").agg(F.min("members").alias("members")), "minhash-sets")

    checked = write_and_read(members.where("key != hub").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct(), "minhash-pairs")
    edges = write_and_read(_confirmed(_by_signature(checked, classes, least), sets, percent), "minhash-edges")
    stars = connected_components(edges)

    comp = F.coalesce("v", "key")
    now = members.where("n > 2").join(stars.withColumnRenamed("u", "key"), "key", "left").select("bucket", "n", "key", comp.alias("comp"))
    # several components; of buckets with equal members one is enough
    several = (now.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.bit_xor(F.xxhash64("key")).alias("h"),
                                         F.min("key").alias("first"), F.max("key").alias("last"), F.max("n").alias("n"))
               .where("x != y").groupBy("h", "first", "last", "n").agg(F.min("bucket").alias("bucket")).select("bucket"))
    more = write_and_read(_across(now.join(several, "bucket", "left_semi"), classes, sets, least, percent, BLOCK), "minhash-more")
    if not more.isEmpty():
        stars = connected_components(edges.union(more))

    named = classes.select("key", "rep").join(stars.withColumnRenamed("u", "key"), "key", "left").select("key", "rep", F.coalesce("v", "key").alias("comp"))
    first = named.groupBy("comp").agg(F.min("rep").alias("first"))
    return rows, write_and_read(named.join(first, "comp").select("key", F.col("first").alias("rep")), "minhash-verdict")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Sets of ``shingle`` consecutive words are linked when 100 * intersection >= percent * union;
    words are cut at ASCII white space, A-Z lower-cased, and a shorter text is one shingle. The
    smallest id of a component stays. Null, empty and blank texts have no shingles and stay alone.
    Rows that repeat an id and text get the same verdict; an id on several texts has one for each. Rows without an
    id link like others; they are kept only if their component has no id at all (use ``one_of_each`` to get
    one row of those too). Ids may be of any orderable type. Empty tables give empty tables; other columns are not read.
    """
    rows, verdict = _components(_keyed(docs, text, doc_id), shingle, percent)
    alone, component = F.col("n_shingles") == 0, F.col("rep.doc_id")
    return rows.join(verdict, "key", "left").select(
        "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(component).alias("component_id"),
        (alone | F.col("doc_id").eqNullSafe(component)).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``docs``, whole: one of each component of ``near_duplicates`` (of smallest id, those without one last, then
    smallest digest of the text), and all without shingles. Rows are judged by id and text, so of two texts under one id one may
    go; of rows that repeat both one stays."""
    rows, verdict = _components(_keyed(docs, text, doc_id), shingle, percent)
    judged = write_and_read(rows.where("n_shingles > 0").join(verdict, "key").select("doc_id", "th", (_row() == F.col("rep")).alias("stays")), "minhash-judged")
    goes = judged.where("NOT stays").select("doc_id", "th").distinct()
    repeated = write_and_read(judged.where("stays").groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "minhash-repeated")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.select(F.struct(*columns).alias("row"), F.col(f"`{doc_id}`").alias("doc_id"), identity.digest(F.col(f"`{text}`").cast("string").cast("binary")).alias("th"))
    out = named.join(goes, _same(named, goes), "left_anti")
    if not repeated.isEmpty():
        out = out.join(repeated, _same(out, repeated), "left_anti").union(
            out.join(repeated, _same(out, repeated), "left_semi").dropDuplicates(["doc_id", "th"]))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(reach.b) AS component_id, w.doc_id = min(reach.b) AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id, n.n
"""
