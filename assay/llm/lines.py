"""Removal of repeated multi-line chunks, with DataFrame functions only.

A text's lines are cut into chunks where a rolling hash over the hashes of the last ``ROLL`` lines
is divisible by ``DIVISOR``, so the same lines give the same cuts wherever they stand. Of cuts on
neighbouring lines the first holds, and none leaves a first or last chunk of one line, so all chunks
have at least two lines in texts that do. Chunks whose digest occurs more than once are compared by
their bytes, equal ones partly grouped before the shuffle; all but the first go.

``remove_repeated_runs`` needs no cuts: it looks at every two neighbouring lines, so that a repeated
passage goes wherever it begins and ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.llm import identity
from assay.session import write_and_read

ROLL, BASE, DIVISOR = 3, 31, 4
NO_ID = (1 << 63) - 1


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _cut(docs: DataFrame) -> DataFrame:
    """``docs`` with ``lines`` and ``chunks`` (array of struct from, to: line numbers, end exclusive)."""
    hashed = docs.withColumn("lines", F.split(F.coalesce("t", F.lit("")), "\n", -1)).withColumn("hs", F.transform("lines", _line_hash))
    roll = lambda h, i: sum(
        (F.coalesce(F.get("hs", i - j), F.lit(0)) * BASE ** j for j in range(1, ROLL)), h) % DIVISOR == 0
    last = F.size("lines") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (
        (i > 0) & (i < last - 1) & F.get("at", i) & ~F.get("at", i - 1)))
    return (hashed.withColumn("at", F.transform("hs", roll)).withColumn("ends", ends)
            .withColumn("chunks", F.transform("ends", lambda e, k: F.struct(
                F.when(k == 0, 0).otherwise(F.get("ends", k - 1) + 1).alias("from"), (e + 1).alias("to"))))
            .drop("hs", "at", "ends"))


def _text(lines: Column | str, c: Column) -> Column:
    return F.array_join(F.slice(lines, c["from"] + 1, c["to"] - c["from"]), "\n")


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``row``, ``t``, and ``d`` and ``th`` that name a row."""
    name = lambda c: F.col(f"`{c}`")
    base = docs.select(F.struct(*[name(c) for c in docs.columns]).alias("row"), name(text).cast("string").alias("t"), name(doc_id).alias("_key"))
    return identity.ordered(base, "_key", NO_ID).select("row", "t", "d", F.xxhash64(F.col("_key").isNull(), "t").alias("th"))


def remove_repeated_chunks(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every row of ``docs``: ``row`` (a struct of its columns), ``kept`` (its text without the chunks
    that an earlier chunk equals), ``n_lines``, ``n_removed`` (lines).

    Earlier is a smaller id, then a smaller place; a missing id comes last. Chunks of one line and
    blank chunks stay. A null text stays null and counts one empty line. Rows that repeat an id and
    text get the same verdict. Should different texts share a digest, all of them stay. An empty table
    gives an empty table; other columns stay inside ``row``.
    """
    base = _keyed(docs, text, doc_id)
    cut = _cut(base.select("d", "th", "t"))
    chunks = write_and_read(
        cut.select("d", "th", F.explode(F.transform("chunks", lambda c, k: F.struct(
            k.alias("k"), c["from"].alias("from"), c["to"].alias("to"), F.md5(_text("lines", c).cast("binary")).alias("h")))).alias("c"))
        .select("d", "th", "c.*"), "lines-chunks")
    long = F.col("to") - F.col("from") > 1
    again = write_and_read(chunks.where(long).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "lines-repeated")

    # comparison of bytes
    wanted = (chunks.where(long).join(again, "h").groupBy("d", "th")
              .agg(F.collect_set(F.struct("k", "from", "to", "h")).alias("wanted")))
    texts = (base.select("d", "th", "t").join(wanted, ["d", "th"]).withColumn("lines", F.split("t", "\n", -1))
             .select("d", F.explode(F.transform("wanted", lambda c: F.struct(c["k"].alias("k"), c["h"].alias("h"), _text("lines", c).alias("x")))).alias("c"))
             .select("d", "c.*").where(F.trim(F.regexp_replace("x", r"\s+", " ")) != ""))
    equal = texts.groupBy("h", "x").agg(F.min(F.struct("d", "k")).alias("first"))
    sure = write_and_read(equal.groupBy("h").agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first")).where("texts = 1").select("h", "first"), "lines-sure")

    goes = F.coalesce(F.struct("d", "k") != F.col("first"), F.lit(False))
    judged = (chunks.join(sure, "h", "left")
              .select("d", "th", F.struct("k", "from", "to", (goes & long).alias("goes")).alias("c")).groupBy("d", "th")
              .agg(F.array_sort(F.collect_set("c")).alias("judged"), F.max("c.goes").alias("any")).where("any").select("d", "th", "judged"))
    stay = F.filter("judged", lambda c: ~c["goes"])
    gone = F.aggregate("judged", F.lit(0).cast("long"), lambda n, c: n + F.when(c["goes"], c["to"] - c["from"]).otherwise(0))
    return (base.join(judged, ["d", "th"], "left").withColumn("lines", F.split(F.coalesce("t", F.lit("")), "\n", -1))
            .select("row", F.when(F.col("judged").isNull(), F.col("t")).otherwise(
                F.array_join(F.transform(stay, lambda c: _text("lines", c)), "\n")).alias("kept"),
                F.size("lines").cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0).cast("long")).alias("n_removed")))


def remove_repeated_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The columns of ``remove_repeated_chunks``; ``kept`` is the text without any line that lies in two
    neighbouring lines which an earlier place has too, so without all repeated runs of two lines or more.

    Earlier is a smaller id, then a smaller hash of the text, then a smaller place; a missing id comes
    last. Two blank lines don't count as repeated. A line that goes is still there at an earlier place.
    Null texts, rows that repeat an id and text, digests (128 bits here) and other columns are treated
    as there.
    """
    base = _keyed(docs, text, doc_id)
    split, digest = F.split(F.coalesce("t", F.lit("")), "\n", -1), ["h1", "h2"]
    pairs = write_and_read(
        base.select("d", "th", split.alias("lines"))
        .select("d", "th", F.posexplode(F.arrays_zip(F.slice("lines", 1, F.size("lines") - 1).alias("a"), F.slice("lines", 2, F.size("lines") - 1).alias("b"))).alias("k", "c"))
        .select("d", "th", "k", F.concat_ws("\n", "c.a", "c.b").alias("x")).where(F.col("x").rlike(r"\S"))
        .select("d", "th", "k", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), "x").alias("h2")), "lines-pairs")
    again = pairs.groupBy(*digest).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*digest)
    pairs = write_and_read(pairs.join(again, digest, "left_semi"), "lines-repeated")

    # comparison of bytes
    wanted = pairs.groupBy("d", "th").agg(F.collect_set(F.struct("k", *digest)).alias("wanted"))
    texts = (base.select("d", "th", "t").join(wanted, ["d", "th"]).withColumn("lines", split)
             .select("d", "th", F.explode(F.transform("wanted", lambda c: F.struct(
                 c["k"].alias("k"), c["h1"].alias("h1"), c["h2"].alias("h2"), F.array_join(F.slice("lines", c["k"] + 1, 2), "\n").alias("x")))).alias("c"))
             .select("d", "th", "c.*"))
    equal = texts.groupBy(*digest, "x").agg(F.min(F.struct("d", "th", "k")).alias("first"))
    sure = equal.groupBy(*digest).agg(F.count(F.lit(1)).alias("texts"), F.min("first").alias("first")).where("texts = 1").select(*digest, "first")
    sure = write_and_read(sure, "lines-sure")

    judged = (pairs.join(sure, digest).where(F.struct("d", "th", "k") != F.col("first"))
              .groupBy("d", "th").agg(F.array_sort(F.collect_set("k")).alias("ks")))
    n = F.size("lines")
    after = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("ks", i - 1) + 2)
    stay = F.flatten(F.transform(F.array_append("ks", n), lambda k, i: F.slice("lines", after(i) + 1, F.greatest(k - after(i), F.lit(0)))))
    return (base.join(judged, ["d", "th"], "left").withColumn("lines", split).withColumn("stay", stay)
            .select("row", F.when(F.col("ks").isNull(), F.col("t")).otherwise(F.array_join("stay", "\n")).alias("kept"),
                    n.cast("long").alias("n_lines"), F.when(F.col("ks").isNull(), 0).otherwise(n - F.size("stay")).cast("long").alias("n_removed")))


def digest_columns(result: DataFrame) -> DataFrame:
    return result.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
h AS (SELECT doc_id, ls, list_transform(ls, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS hs FROM d),
a AS (SELECT doc_id, ls, list_transform(range(1, len(hs) + 1), lambda i:
  (hs[i] + CASE WHEN i > 1 THEN {BASE} * hs[i - 1] ELSE 0 END + CASE WHEN i > 2 THEN {BASE ** 2} * hs[i - 2] ELSE 0 END) % {DIVISOR} = 0) AS at_ FROM h),
e AS (SELECT doc_id, ls, list_filter(range(1, len(ls) + 1), lambda i: i = len(ls) OR (i > 1 AND i < len(ls) - 1 AND at_[i] AND NOT at_[i - 1])) AS es FROM a),
c AS (SELECT doc_id, k, CASE WHEN k = 1 THEN 1 ELSE es[k - 1] + 1 END AS a, es[k] AS z, ls FROM (SELECT *, unnest(range(1, len(es) + 1)) AS k FROM e)),
x AS (SELECT doc_id, k, z - a + 1 AS n, array_to_string(ls[a:z], chr(10)) AS t FROM c),
f AS (SELECT t, min((doc_id, k)) AS first FROM x WHERE n > 1 AND trim(regexp_replace(t, '\s+', ' ', 'g')) <> '' GROUP BY t),
j AS (SELECT x.*, coalesce(x.n > 1 AND (x.doc_id, x.k) <> f.first, false) AS goes FROM x LEFT JOIN f USING (t))
SELECT doc_id, sum(n)::BIGINT AS n_lines, sum(CASE WHEN goes THEN n ELSE 0 END)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (NOT goes), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
