"""The registered queries: SQL, held-out accuracy, the pipeline against brute force."""

import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from assay.llm import bpe, langid, minhash, quality, registry, stages, toxicity, training
from tests.llm.test_bpe_leaks_exact import leaks_by_hand
from tests.llm.test_lines_minhash import groups_by_hand, runs_by_hand
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    assert difference(registry.queries()[name](spark, SF), connect(SF), registry.oracle_sql()[name]) is None


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_language_accuracy(spark):
    got = registry.op7_language_id(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(got) == 1000 and len(held) > 200 and (held["lang"] == held["lang_pred"]).mean() > 0.99
    assert got["score"].between(0, 1).all()


def area(label, score):
    """Chance that a row with label 1 scores above one with label 0."""
    a, b = score[label == 1][:, None], score[label == 0][None, :]
    return float((a > b).mean() + (a == b).mean() / 2)


@pytest.mark.parametrize("name,label,least", [("op1_toxicity", "toxic", 0.75), ("op2_quality", "quality", 0.95)])
def test_classifiers(spark, name, label, least):
    got = registry.queries()[name](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id", "left").toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    held = got[got["held_out"] & got[label].notna()]
    assert area(held[label].to_numpy(), held["score"].to_numpy()) > least


ODD = [(1, "Hello you stupid world", "en", 0), (2, "", "en", 0), (3, None, "fr", 0), (4, "!!! 123", None, 0), (None, "no id", "en", 0),
       (5, "b" * 200_000, "en", 0), (5, "b" * 200_000, "en", 0), (6, "mot école été", "fr", 0)]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(1, 1, 1), (5, 0, 0), (6, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for rows, given in ((docs, labels), (docs.limit(0), labels.limit(0)), (docs, labels.limit(0))):
        for module in (toxicity, quality):
            out = module.score(rows, module.fit(rows, given)).toPandas()
            assert len(out) == rows.count() and out["score"].between(0, 1).all()
        out = langid.predict(rows, langid.fit(rows)).toPandas()
        assert len(out) == rows.count() and out["score"].between(0, 1).all()
    names = {(r.row.doc_id, r.row.text): r.lang_pred for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert names[2, ""] == names[3, None] == names[4, "!!! 123"] == "und" and names[6, "mot école été"] == "fr"


def test_held_out_labels_teach_nothing(spark):
    """Turning the held-out labels round changes no score."""
    docs, labels = registry.table(spark, SF, "documents"), registry.table(spark, SF, "labels")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = (quality.score(docs, quality.fit(docs, x)).select("row.doc_id", "score").toPandas().set_index("doc_id")["score"] for x in (labels, turned))
    assert np.allclose(a, b.loc[a.index], atol=1e-9)


def test_ridge_is_the_minimum():
    """The gradient of the penalised squares vanishes at the weights."""
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(300, 4)), rng.integers(0, 2, 300).astype(float)
    model = quality.QualityModel(0.5, x.mean(axis=0), x.std(axis=0))
    z = model.features(x)
    penalty = quality.RIDGE * len(x) / quality.FEATURES
    w = np.linalg.solve(z.T @ z + penalty * np.eye(z.shape[1]), z.T @ y)
    assert np.abs(z.T @ (z @ w - y) + penalty * w).max() < 1e-8
    kernel = np.exp(-((((x[:50, None] - x[None, :50]) / x.std(axis=0)) ** 2).sum(axis=2)) / (2 * quality.WIDTH ** 2 * 4))
    assert np.abs(z[:50, :-1] @ z[:50, :-1].T - kernel).mean() < 0.06


def test_words_of_features():
    a = quality.statistics([b"Some text here.", None, b"", b"Some text here."])
    assert (a[0] == a[3]).all() and not a[1].any() and not a[2].any()
    lex = toxicity.Lexicon(np.sort(toxicity.Words([b"idiot"], toxicity.ALNUM).hashes()), np.zeros(0, dtype=np.uint64))
    f = lex.features([b"you idiot", b"you 1d10t", b"nothing", None])
    assert f[0, 1] > 0 and f[0, 5] > 0 and f[1, 14] > 0 and not f[2, :6].any()
    assert training.SAMPLE_ROWS == 20_000


def test_pipeline(spark):
    """Each stage against brute force on the rows it was given."""
    docs, bench = registry.table(spark, SF, "documents"), registry.table(spark, SF, "benchmark").collect()
    cols, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stages.stored(stage(spark, docs, SF), f"test-{name}")
        after = docs.collect()
        seen[name] = len(before), len(after)
        if name != "bpe":
            assert docs.columns == cols
        if name == "language_id":
            assert [r for r in before if r not in after and any(c.isalpha() for c in r.text or "")] == []
        elif name == "line_dedup":
            by_hand = runs_by_hand([(r.doc_id, r.text) for r in before])
            assert {r.doc_id: r.text for r in after} == {d: t for d, n, gone, t in by_hand if t or not gone}
            assert len(after) < len(before) and any(gone and t for d, n, gone, t in by_hand)
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "minhash_dedup":
            pairs = [(r.doc_id, r.text) for r in before]
            assert {r.doc_id for r in after} == {d for d, n, c, kept in groups_by_hand(pairs, 5, 80) if kept or not n}
        elif name == "decontaminate":
            hits = {r[0] for r in leaks_by_hand([(r.doc_id, r.text) for r in before], [(b.item_id, b.text) for b in bench], 10) if r[5]}
            old = {r.doc_id: r.text for r in before}
            assert hits and {r.doc_id for r in after if r.text != old[r.doc_id]} == hits and len(after) == len(before)
            assert all(r.n_chars == len(r.text) for r in after if r.doc_id in hits)
        elif name == "bpe":
            own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})
            got = {r.doc_id: r for r in after}
            for r in before:
                ids = own.encode_ordinary(r.text)
                assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
                assert got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert seen["minhash_dedup"][0] > seen["minhash_dedup"][1]
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).collect()} == {tuple(r) for r in after}


def test_pipeline_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, n_chars int")
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            rows = stages.stored(stage(spark, rows, SF), "odd")
        assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
