"""Ranked lexical search against all scores."""

import math
import random
import re

import numpy as np
import pytest

from assay.llm import treap

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def by_hand(docs, items, k):
    own = [(d, words(t)) for d, t in docs]
    own = [(d, w) for d, w in own if w]
    n, total = len(own), sum(len(w) for _, w in own)
    out = []
    for item, text in items:
        scores = []
        for d, w in own:
            m, s = 100 - 25 + 25 * len(w) * n // total, 0
            for t in words(text):
                tf, df = w.count(t), sum(t in x for _, x in own)
                s += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1000000000 * tf // (1000 * tf + 12 * m))
            if s:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_random(spark, seed, monkeypatch):
    """Small shards, so that results of several are merged; copies give equal scores."""
    monkeypatch.setattr(treap, "OPEN", 4)
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "abcdeé" for b in ("", "x", "Y", "1")]
    docs = [(i, " ".join(rng.choices(vocabulary, [1 / (j + 1) for j in range(24)], k=rng.randint(0, 30)))) for i in range(120)]
    docs += [(i + 1000, docs[i % 3][1]) for i in range(60)] + [(None, docs[1][1]), (5, docs[1][1]), (7, None), (8, ""), (9, "... -")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for i in range(15)] + [(None, "a b"), (3, "zz"), (4, None), (50, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert got(treap.ranked_search(d, q, 6)) == by_hand(docs, items, 6)
    if seed == 0:
        monkeypatch.setattr(treap, "ITEMS", 4)
        assert got(treap.ranked_search(d, q, 6)) == by_hand(docs, items, 6)


def test_treap_is_the_grid():
    rng = np.random.default_rng(4)
    for rows, columns, n in ((5, 300, 400), (300, 5, 400), (64, 64, 1), (1, 1, 1), (40, 1000, 5000)):
        cell = np.unique(rng.integers(0, rows * columns, n))
        row, column, impact = cell // columns, cell % columns, rng.integers(1, 100, len(cell))
        t = treap.Treap(row, column, impact, rows, columns)
        grid = np.zeros((rows, columns), dtype=np.int64)
        grid[row, column] = impact
        for _ in range(10):
            terms = rng.choice(rows, min(rows, 4), replace=False)
            weight = rng.integers(0, 9, len(terms))
            score = weight @ grid[terms]
            top = sorted(((-int(s), c) for c, s in enumerate(score) if s > 0))[:7]
            assert t.best(terms, weight, 7) == [(-s, c) for s, c in top]


def test_terms_are_compared_by_bytes(monkeypatch):
    """All words of a length share a hash here."""
    monkeypatch.setattr(treap.Words, "hashes", lambda self: (self.end - self.start).astype(np.uint64))
    size, doc, term, tf = treap.postings([b"aa bb aa cc", b"dd a", None], treap.Terms([b"aa", b"a", b"cc", b"zz"]))
    assert size.tolist() == [4, 2, 0] and list(zip(doc, term, tf)) == [(0, 0, 2), (0, 2, 1), (1, 1, 1)]


def test_odd_tables(spark):
    docs = spark.createDataFrame([("x", "Hello", 1, 2)], "doc_id string, text string, item int, score int")
    items = spark.createDataFrame([(1, "hello hello"), (1, "HELLO")], "item_id int, text string")
    assert [r[:3] for r in got(treap.ranked_search(docs, items))] == [(1, 1, "x"), (1, 1, "x")]
    assert treap.ranked_search(docs.limit(0), items).count() == 0 and treap.ranked_search(docs, items.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "w " * 300_000), (2, "w v")], "doc_id long, text string")
    assert [r[2] for r in got(treap.ranked_search(long, items.limit(1).selectExpr("item_id", "'v w' AS text")))] == [2, 1]
