"""Encoding against an independent encoder, leaks and exact groups against brute force."""

import hashlib
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
import tiktoken

from assay.llm import bpe, decontaminate, exact

TEXTS = [
    (1, "Hello, hello world! it's 12345 naïve Straße 日本語 \U0001f600\U0001f600"), (2, ""), (3, None),
    (4, "a" * 3000 + " " + "ab" * 2000 + " " * 500 + "x"), (5, "<|endoftext|> \t\n  \r\n mixed space   "),
    (6, "abcabcabd zzzzzzzz \x00\x01 ÿ"), (6, "abcabcabd zzzzzzzz \x00\x01 ÿ"), (None, "no id here"),
]


@pytest.fixture(scope="module")
def own():
    ranks = bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, own):
    docs = spark.createDataFrame([(i, t, 7) for i, t in TEXTS], "doc_id long, text string, ids int")
    got = bpe.encode_decode(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert len(got) == len(TEXTS)
    for row, (_, text) in zip(sorted(got, key=lambda r: bytes(r.decoded)), sorted(TEXTS, key=lambda r: (r[1] or "").encode())):
        assert np.frombuffer(row.ids, "<u4").tolist() == own.encode_ordinary(text or "")
        assert bytes(row.decoded) == (text or "").encode()
    empty = bpe.digests(bpe.encode_decode(docs.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_bpe_pieces(own):
    """Random pieces over few letters, where longest matches often have to be taken back."""
    encoder = bpe.Encoder(bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()))
    rng = np.random.default_rng(3)
    for letters in (b"ab", b"etaoin", b"the singer", bytes(range(256))):
        for n in (1, 2, 3, 7, 20, 60):
            for _ in range(60):
                piece = bytes(rng.choice(list(letters), n).tolist())
                assert encoder.encode_piece(piece) == own._encode_single_piece(piece)


def leaks_by_hand(docs, bench, n):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    out = []
    for i, text in docs:
        words, hit, items = find(low(text)), set(), set()
        for item, other in bench:
            ws = find(low(other))
            k = min(n, len(ws))
            wins = {tuple(ws[j:j + k]) for j in range(len(ws) - k + 1)} if k else set()
            for j in range(len(words) - k + 1 if k else 0):
                if tuple(words[j:j + k]) in wins:
                    hit |= set(range(j, j + k))
                    if item is not None:
                        items.add(str(item))
        out.append((i, len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


DOCS = [(1, "one two three four five six"), (2, "ONE  two, three! Four five"), (3, None), (4, ""), (5, "!!! ..."),
        (6, "é2 short x" * 3), (7, "a b " * 4000 + "three FOUR five"), (8, "ünïque two three four five six seven"), (8, "short"), (None, "one two three")]
BENCH = [(10, "one two three four"), (9, "Three four FIVE"), (11, "short"), (12, None), (None, "six seven"), (10, "two three four five"), (13, "--")]


@pytest.mark.parametrize("block", [100, 2])
def test_leaks(spark, block):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in DOCS], "doc_id long, text string, spans string, n_words int")
    bench = spark.createDataFrame([(i, t) for i, t in BENCH], "item_id long, text string")
    leaks = decontaminate.find_leaks(docs, bench, 3, block_windows=block)
    got = sorted((tuple(r) for r in decontaminate.digests(leaks).collect()), key=repr)
    assert got == leaks_by_hand(DOCS, BENCH, 3)
    cut = decontaminate.without_spans(leaks)
    assert cut.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[1] == " six" and texts[3] is None and texts[5] == "!!! ..." and texts[2] == ""
    assert decontaminate.digests(decontaminate.find_leaks(docs.limit(0), bench, 3)).count() == 0
    assert decontaminate.digests(decontaminate.find_leaks(docs, bench.limit(0), 3)).where("contaminated").count() == 0


def test_exact(spark):
    rows = [(5, "a b"), (2, "a\t\n b"), (9, "a  b"), (3, " a b"), (4, None), (1, ""), (7, "x" * 100_000), (8, "x" * 100_000),
            (None, "lonely"), (None, "a b"), (6, "only"), (6, "only"), (10, "a b")] + [(100 + i, "hot") for i in range(300)]
    docs = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "doc_id long, text string, fp int, norm string")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    got = exact.exact_groups(docs)
    # an id that is null keeps nothing out, nothing stands for it
    fix = sorted(((i, k, n, kept or k is None, h) for i, k, n, kept, h in want), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == fix
    assert exact.exact_groups(docs.limit(0)).count() == 0


def test_filters_merge():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 1 << 63, 500, dtype=np.uint64)[rng.integers(0, 500, 3000)]
    parts = [exact.CountingQuotientFilter(x) for x in np.array_split(f, 7)]
    m = exact.CountingQuotientFilter.merged(parts)
    v, n = np.unique(f, return_counts=True)
    assert (m.fingerprints() == v).all() and (m.counts == n).all()


def test_filter_bits():
    """Bytes carry all counts; a slot takes its remainder and some bits, below eight bytes in all."""
    rng = np.random.default_rng(2)
    for n, width in ((0, 56), (1, 56), (2, 7), (50, 6), (5000, 50), (20_000, 64)):
        f = rng.integers(0, 1 << min(width, 63), n, dtype=np.uint64)
        f = np.concatenate([f, np.repeat(f[:3], 300), f[: n // 9]])
        q = exact.CountingQuotientFilter(f, width=width)
        again = exact.CountingQuotientFilter.from_bytes(q.to_bytes())
        v, c = np.unique(f, return_counts=True)
        assert (again.fingerprints() == v).all() and (again.counts == c).all()
        assert all(again.count_of(int(x)) == k for x, k in list(zip(v, c))[:200]) and again.count_of((1 << width) - 2) == dict(zip(v.tolist(), c)).get((1 << width) - 2, 0)
        if n == 5000:
            assert len(q.to_bytes()) < 6 * len(v)
        both = again.merge(exact.CountingQuotientFilter(f[::2], width=width))
        v, c = np.unique(np.concatenate([f, f[::2]]), return_counts=True)
        assert (both.fingerprints() == v).all() and (both.counts == c).all()


def test_filters_of_partitions(spark):
    fp = spark.range(20_000).selectExpr("shiftrightunsigned(xxhash64(id % 17000), 8) AS fp").union(spark.range(3000).selectExpr("77L AS fp")).repartition(7)
    got = {r.fp: r.n for r in exact.repeated_fingerprints(fp, 5).collect()}
    assert got == {r.fp: r.n for r in fp.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").collect()} and got[77] == 3000
