"""Line chunks and near-duplicates against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from assay.llm import components, lines, minhash, stages


def chunks_by_hand(rows):
    def cut(t):
        ls = (t or "").split("\n")
        hs = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in ls]
        at = [sum(hs[i - j] * lines.BASE ** j for j in range(lines.ROLL) if i >= j) % lines.DIVISOR == 0 for i in range(len(ls))]
        ends = [i for i in range(len(ls)) if i == len(ls) - 1 or (0 < i < len(ls) - 2 and at[i] and not at[i - 1])]
        return [ls[a:z] for a, z in zip([0, *[e + 1 for e in ends]], [e + 1 for e in ends])]

    first = {}
    for i, t in rows:
        for k, c in enumerate(cut(t)):
            if len(c) > 1 and "".join(c).strip():
                key = (1 << 63 if i is None else i, k)
                first[tuple(c)] = min(first.get(tuple(c), key), key)
    out = []
    for i, t in rows:
        kept, gone = [], 0
        for k, c in enumerate(cut(t)):
            if first.get(tuple(c), (1 << 63 if i is None else i, k)) != (1 << 63 if i is None else i, k):
                gone += len(c)
            else:
                kept += c
        out.append((i, len((t or "").split("\n")), gone, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_lines(spark):
    rng = np.random.default_rng(9)
    word = lambda: f"line {rng.integers(0, 10**6)} é"
    shared = [word() for _ in range(12)]
    rows = []
    for i in range(60):
        ls = [word() for _ in range(int(rng.integers(0, 15)))]
        if i % 2:
            at = int(rng.integers(0, len(ls) + 1))
            ls[at:at] = shared[int(rng.integers(0, 3)):int(rng.integers(8, 12))]
        rows.append((i, "\n".join(ls)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (200, rows[3][1]), (202, "\n\n\n\n"), (203, "\n\n\n\n"), (204, None), (205, ""), (None, rows[3][1]),
             (206, "a\nb"), (207, "a\nb"), (208, "a\nb\n"), (209, "\n".join(shared * 2000)), (210, "one"), (211, "one")]
    docs = spark.createDataFrame([(i, t, 3, "h") for i, t in rows], "doc_id long, text string, lines int, d string")
    got = lines.remove_repeated_chunks(docs)
    assert sorted((tuple(r) for r in lines.digest_columns(got).collect()), key=repr) == chunks_by_hand(rows)
    assert [r.kept for r in got.where("row.doc_id = 204").collect()] == [None]
    assert lines.digest_columns(lines.remove_repeated_chunks(docs.limit(0))).count() == 0


def runs_by_hand(rows):
    """(id, lines, removed, kept text) of rows with different ids."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ls, gone = (t or "").split("\n"), set()
        for k in range(len(ls) - 1):
            if (ls[k] + ls[k + 1]).strip():
                gone |= {k, k + 1} if (ls[k], ls[k + 1]) in seen else set()
                seen.add((ls[k], ls[k + 1]))
        out.append((i, len(ls), len(gone), t if not gone else "\n".join(x for k, x in enumerate(ls) if k not in gone)))
    return sorted(out, key=repr)


def test_runs(spark):
    rng = np.random.default_rng(4)
    word = lambda: f"line {rng.integers(0, 10**6)} é" if rng.integers(0, 8) else " " * int(rng.integers(0, 2))
    shared = [word() for _ in range(12)]
    rows = []
    for i in range(60):
        ls = [word() for _ in range(int(rng.integers(0, 15)))]
        if i % 2:
            at, lo = int(rng.integers(0, len(ls) + 1)), int(rng.integers(0, 10))
            ls[at:at] = shared[lo:lo + int(rng.integers(2, 6))]
        rows.append((i, "\n".join(ls)))
    rows += [(200, rows[3][1]), (202, "\n\n\n\n"), (203, "\n\n\n\n"), (204, None), (205, ""), (206, "a\nb"), (207, "a\nb"), (208, "a\nb\n"),
             (209, "\n".join(shared * 2000)), (210, "one"), (211, "one"), (212, "b\nb\nb\nb"), (213, "x\na\nb\ny"), (None, rows[5][1])]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, lines int")
    got = lines.remove_repeated_runs(docs)
    out = sorted(((r.row.doc_id, r.n_lines, r.n_removed, r.kept) for r in got.collect()), key=repr)
    assert out == runs_by_hand(rows)
    assert (213, 4, 2, "x\ny") in out and (207, 2, 2, "") in out  # a cut by hashes leaves the first: its ends are no cuts
    assert {r.doc_id: r.text for r in stages.line_dedup(spark, docs, "").collect()}[213] == "x\ny"
    assert lines.remove_repeated_runs(docs.limit(0)).count() == 0


def groups_by_hand(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        c = min((rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None), default=None)
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [512, 4])
def test_minhash(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = np.random.default_rng(6)
    text = lambda n: [str(x) for x in rng.integers(0, 5000, n)]
    rows = []
    for g in range(6):  # families: single edits, and chains that drift from their start
        base = text(60)
        for i in range(14):
            t = list(base)
            for _ in range(1 + g % 3):
                t[int(rng.integers(0, 60))] = "new" + str(rng.integers(0, 10**6))
            if g % 2:
                base = t
            rows.append((len(rows), " ".join(t)))
    rows += [(1000 + i, " ".join(text(40))) for i in range(10)]
    rows += [(500, "a b"), (501, "A  b\n"), (502, "a"), (503, ""), (504, None), (505, " \n"), (None, "a b"), (None, rows[0][1]), (None, "no other"),
             (3, rows[3][1]), (600, rows[3][1].upper()), (700, "x y z " * 30000), (701, "x y z " * 30001)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, n int")
    got = minhash.near_duplicates(docs, 4)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == groups_by_hand(rows, 4, 80)
    assert minhash.near_duplicates(docs.limit(0), 4).count() == 0


def test_bridge_without_id(spark):
    """A row without an id links its neighbours as one with an id does."""
    w = [f"w{i}" for i in range(76)]
    for middle, out in ((2, {(1, 1), (2, 1), (3, 1)}), (None, {(1, 1), (None, 1), (3, 1)})):
        docs = spark.createDataFrame([(1, " ".join(w[:60])), (middle, " ".join(w[:68])), (3, " ".join(w))], "doc_id long, text string")
        assert {(r.doc_id, r.component_id) for r in minhash.near_duplicates(docs).collect()} == out
        assert [r.doc_id for r in minhash.one_of_each(docs).collect()] == [1]


def test_one_of_each(spark):
    """Copies without ids go, clean texts that share an id with a copy stay, repeated rows leave one."""
    t, u, v = (" ".join(f"{x}{i}" for i in range(40)) for x in "tuv")
    rows = [(1, t, "a"), (None, t, "a"), (None, t, "b"), (5, u, "a"), (5, t, "a"), (6, v, "a"), (6, v, "a"), (None, "no id", "c"), (None, "no id", "c"), (8, "", "a"), (9, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `th.x` string").withColumn("key", F.lit(1)).withColumn("row", F.lit(2))
    out = minhash.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, t), (5, u), (6, v), (None, "no id"), (8, ""), (9, None)], key=repr)
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.component_id for r in minhash.near_duplicates(named).where("n_shingles > 0").collect()} == {"d1", "d5", "d6", None}


def test_lines_of_text_ids(spark):
    t = "one line\ntwo lines\nthree lines\nfour lines"
    docs = spark.createDataFrame([("b", t), ("a", t), (None, t)], "doc_id string, text string").withColumn("ids.x", F.lit(1))
    for f in (lines.remove_repeated_chunks, lines.remove_repeated_runs):
        assert sorted((r.row.doc_id or "", r.n_removed) for r in f(docs).collect()) == [("", 4), ("a", 0), ("b", 4)]


def test_components(spark):
    rng = np.random.default_rng(2)
    path = rng.permutation(40).tolist()
    edges = list(zip(path, path[1:])) + [(100, 101), (101, 102), (103, 102)] + [(200, x) for x in range(201, 230)]
    got = {r.u: r.v for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{x: 0 for x in range(1, 40)}, 101: 100, 102: 100, 103: 100, **{x: 200 for x in range(201, 230)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
