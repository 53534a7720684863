"""Repeated windows of bytes and words against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import repeats, substrings, suffixes


def corpus(seed, letters, n=60, size=120):
    """Texts over few letters, with passages of one put into others, and copies."""
    rng = np.random.default_rng(seed)
    make = lambda k: "".join(rng.choice(list(letters), k).tolist())
    shared = make(50)
    out = []
    for i in range(n):
        t = make(int(rng.integers(0, size)))
        if i % 3 == 0:
            at = int(rng.integers(0, len(t) + 1))
            t = t[:at] + shared[int(rng.integers(0, 10)):int(rng.integers(35, 50))] + t[at:]
        out.append((i, t))
    out += [(100, out[5][1]), (101, out[5][1]), (102, "a" * 90), (103, "ab" * 40), (104, ""), (105, None), (100, out[5][1]), (106, "né" * 30 + shared)]
    return [out[i] for i in rng.permutation(len(out))]


def bytes_by_hand(rows, width):
    starts = {}
    texts = [(t or "").encode() for _, t in rows]
    for i, t in enumerate(texts):
        for s in range(len(t) - width + 1):
            starts.setdefault(t[s:s + width], []).append((i, s))
    hit = [set() for _ in rows]
    for where in starts.values():
        if len(where) > 1:
            for i, s in where:
                hit[i] |= set(range(s, s + width))
    return sorted(((r[0], len(t), len(h), sum(x - 1 not in h for x in h), hashlib.sha256(bytes(b for j, b in enumerate(t) if j not in h)).hexdigest())
                   for r, t, h in zip(rows, texts, hit)), key=repr)


@pytest.mark.parametrize("letters,width,gram,most", [("ab", 20, 8, 10**6), ("abcd", 12, 5, 10**6), ("ab", 20, 8, 3), ("abcdefgh ", 16, 16, 2)])
def test_bytes(spark, letters, width, gram, most):
    rows = corpus(1, letters)
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, d int, spans string")
    got = suffixes.digest_columns(suffixes.remove_repeats(docs, width, gram, max_variants=most))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == bytes_by_hand(rows, width)
    assert suffixes.remove_repeats(docs.limit(0), width, gram).count() == 0


def words_by_hand(rows, width):
    first, out = {}, []
    cut = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in cut:
        for s in range(len(w) - width + 1):
            k = tuple(w[s:s + width])
            first[k] = min(first.get(k, i), i)
    for i, w in cut:
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s:s + width])] < i:
                gone |= set(range(s, s + width))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("letters,width,gram,most", [("abcd", 6, 3, 10**6), ("abc", 5, 2, 10**6), ("abcd", 6, 3, 2), ("ab", 9, 9, 2)])
def test_words(spark, letters, width, gram, most):
    rows = [(i, t and " \t".join(t)) for i, t in corpus(2, letters)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, th int, kept string")
    got = substrings.digest_columns(substrings.remove_repeats(docs, width, gram, max_variants=most))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == words_by_hand(rows, width)
    assert substrings.remove_repeats(docs.limit(0), width, gram).count() == 0


def test_missing_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f g"), (None, "a b c d e f g"), (3, "a b c d e f g")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in substrings.digest_columns(substrings.remove_repeats(docs, 4, 2)).collect()) == [(0, 0), (0, 0), (3, 7)]
    assert {r.n_removed for r in suffixes.digest_columns(suffixes.remove_repeats(docs, 4, 2)).collect()} == {13}


def test_texts_that_share_a_short_hash(spark):
    """Rows without an id, and rows under one id, are told apart by more than 32 bits of their texts."""
    texts = spark.range(200_000).select(F.concat(*[F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(i))) for i in range(10)]).alias("t"))
    pair = texts.groupBy(F.hash("t", F.lit(5))).agg(F.collect_list("t").alias("ts")).where("size(ts) > 1").first().ts[:2]
    a, b = pair
    for i in (None, 3):
        docs = spark.createDataFrame([(i, a), (i, b), (7, a)], "doc_id long, text string")
        got = {(r.doc_id, bytes(r.kept).decode()) for r in suffixes.remove_repeats(docs).collect()}
        assert got == {(i, ""), (i, b), (7, "")}
        words = spark.createDataFrame([(i, " ".join(a)), (i, " ".join(b)), (7, " ".join(a))], "doc_id long, text string")
        got = {(r.doc_id, bytes(r.kept).decode().replace(" ", "")) for r in substrings.remove_repeats(words).collect()}
        assert got == {(i, a), (i, b), (7, "")}


def test_text_ids_and_odd_names(spark):
    docs = spark.createDataFrame([("b", "x y z w v", 1), ("a", "x y z w v", 1), (None, "q x y z w", 2), ("c", None, 3)], "`my.id` string, `the.text` string, th int")
    got = substrings.remove_repeats(docs, 4, 2, text="the.text", doc_id="my.id")
    assert sorted((r.doc_id or "", r.kept.decode()) for r in got.collect()) == [("", "q x y z w"), ("a", "v"), ("b", ""), ("c", "")]
    got = suffixes.remove_repeats(docs, 5, 3, text="the.text", doc_id="my.id")
    assert sorted((r.doc_id or "", len(r.kept)) for r in got.collect()) == [("", 2), ("a", 0), ("b", 0), ("c", 0)]


def test_order_and_parts():
    rng = np.random.default_rng(4)
    for letters, n, width in ((2, 9000, 70), (26, 6000, 45), (1, 500, 20), (3, 5000, 12)):
        data = bytes((97 + rng.integers(0, letters, n)).tolist())
        data = data + data[100:400]
        starts = np.arange(len(data) - width + 1)
        groups = [g.tolist() for g in suffixes.suffix_order(data, starts, width)]
        keys = [data[g[0]:g[0] + width] for g in groups]
        assert keys == sorted(set(data[s:s + width] for s in starts))
        assert all(data[i:i + width] == k for g, k in zip(groups, keys) for i in g) and sum(map(len, groups)) == len(starts)
    text = bytes((97 + rng.integers(0, 4, 5000)).tolist())
    whole, parts = (suffixes.pieces([b"x", text], 50, 20, part) for part in (1 << 22, 333))
    windows = lambda r: {(int(d), int(a) + i, int(m)) for d, m, _, a, n in zip(*r) for i in range(n)}
    assert windows(whole) == windows(parts) and len(windows(whole)) == 4951
    assert repeats.joined([(0, 1), (5, 7), (1, 2)], 4) == [(0, 10)]


def test_very_long_text(spark):
    rng = np.random.default_rng(5)
    text = " ".join(map(str, rng.integers(0, 10**6, 900_000).tolist()))
    docs = spark.createDataFrame([(1, text), (2, text[1000:2000]), (3, text[-500:])], "doc_id long, text string")
    got = {r.doc_id: r for r in suffixes.digest_columns(suffixes.remove_repeats(docs)).collect()}
    assert got[1].n_removed == 1500 and got[2].n_removed == 1000 and got[3].n_removed == 500 and got[1].n_spans == 2
    words = {r.doc_id: r for r in substrings.digest_columns(substrings.remove_repeats(docs)).collect()}
    assert words[1].n_removed == 0 and words[2].n_removed >= 140 and words[3].n_removed >= 60
