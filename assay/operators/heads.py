"""Model heads on (path, y, features ARRAY<DOUBLE>). Every head returns posteriors
(path, y, p ARRAY<DOUBLE>) for the rows to score; fits run on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F

from assay.functions.hashing import h32
from assay.operators import blocks, boosting, forest, linear
from assay.operators.metrics import class_balance_weights

#: rows of a block; a row travels to all rows over this many blocks
KNN_BLOCK = 16384
KNN_PIVOTS = 256
#: distances in memory at once, in a task
KNN_AT_ONCE = 1 << 21


def _vec(rows: DataFrame) -> DataFrame:
    return rows.withColumn("x", array_to_vector(F.col("features").cast("array<double>"))).withColumn("label", F.col("y").cast("double"))


def balanced(rows: DataFrame) -> DataFrame:
    """Adds ``w``, the class balance weight; the weights sum to the number of rows."""
    return rows.join(F.broadcast(class_balance_weights(rows, "y").select("y", F.col("weight").alias("w"))), "y")


def logreg_model(train: DataFrame, c: float = 1.0, max_iter: int = 3000, balance: bool = True):
    """Multinomial logistic regression with the penalty of strength C per row."""
    d = _vec(balanced(train) if balance else train.withColumn("w", F.lit(1.0)))
    total = d.agg(F.sum("w")).first()[0]
    lr = LogisticRegression(featuresCol="x", labelCol="label", weightCol="w", family="multinomial", maxIter=max_iter,
                            regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, tol=1e-4)
    return lr.fit(d)


def score(model, rows: DataFrame) -> DataFrame:
    out = model.transform(_vec(rows))
    return out.select("path", "y", vector_to_array("probability").alias("p"))


def logreg_head(train, evalu, k, c=1.0, max_iter=3000, balance=True) -> DataFrame:
    return score(logreg_model(train, c, max_iter, balance), evalu)


def random_forest_head(train, evalu, k, trees=500, min_leaf=1, max_depth=30, seed=42) -> DataFrame:
    """A forest of full trees; 30 levels are the most that Spark's trees can have. Rows of one matrix block are grown in tasks that share
    the trees; with more blocks Spark ML grows them."""
    one = train.select(F.lit(0).alias("candidate"), "path", "y", "features", F.lit(1.0).alias("weight"))
    block = blocks.to_blocks(one)
    if block.count() == 1:
        return forest.forest_posteriors(block, one, evalu, k, trees, max_depth, min_leaf, seed)
    rf = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, minInstancesPerNode=min_leaf,
                                maxDepth=max_depth, featureSubsetStrategy="sqrt", seed=seed)
    return score(rf.fit(_vec(train)), evalu)


def linear_svm_head(train, evalu, k, c=1.0, folds=3, gap=1e-3) -> DataFrame:
    """Linear machines of all classes and folds, fitted together; posteriors are the folds' mean of sigmoids of
    the margins, each sigmoid fitted on the rows that its machine hasn't seen."""
    one = lambda x: x.withColumn("candidate", F.lit(0)).withColumn("weight", F.lit(1.0))
    return linear.many_posteriors(one(train), one(evalu), linear.LinearSvm(k, [c], folds, gap)).select("path", "y", "p")


def boosted_trees_head(train, evalu, k, rounds=1200, depth=6, weights: DataFrame | None = None, seed=42, **settings) -> DataFrame:
    """Softmax boosting over histograms, all classes together. ``weights`` is (path, weight) and optional."""
    d = train.join(weights, "path") if weights is not None else train.withColumn("weight", F.lit(1.0))
    one = lambda x: x.withColumn("candidate", F.lit(0))
    return boosting.boosted_posteriors(one(d), one(evalu), k, boosting.Settings(rounds=rounds, depth=depth, seed=seed, **settings)).drop("candidate")


def fourier_features(rows: DataFrame, dim: int, gamma: float, size: int, seed: int) -> DataFrame:
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), (dim, size))
    b = rng.uniform(0.0, 2 * math.pi, size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["features"].to_numpy()).astype(np.float64)
            yield pdf.assign(features=list(math.sqrt(2.0 / size) * np.cos(x @ w + b)))

    return rows.select("path", "y", "features").mapInPandas(run, "path string, y int, features array<double>")


def rbf_head_approx(train, evalu, k, c=1.0, size=256, seed=42) -> DataFrame:
    """APPROXIMATE radial-basis head: random Fourier features, gamma = 1/(D var), then the
    logistic head."""
    from assay.operators.features import column_moments

    _, mean, sd = column_moments(train)
    var = float((sd ** 2).mean() + ((mean - mean.mean()) ** 2).mean())
    gamma = 1.0 / (len(mean) * var) if var > 0 else 1.0
    a, b = (fourier_features(d, len(mean), gamma, size, seed) for d in (train, evalu))
    return logreg_head(a, b, k, c=c)


def _pivots(train: DataFrame) -> np.ndarray:
    """Train vectors in hash order, at most KNN_PIVOTS of them: cells of about KNN_BLOCK rows."""
    n = train.count()
    want = max(1, min(KNN_PIVOTS, n // KNN_BLOCK))
    rows = train.select("path", "features").orderBy(h32(F.col("path")), "path").limit(want).collect()
    return np.asarray([r["features"] for r in rows], dtype=np.float64)


def rounded(d: np.ndarray) -> np.ndarray:
    return np.round(np.maximum(d, 0.0), 9)


def nearest(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k least of each row of ``d`` at nine decimals, the first column of a tie, without sorting the rest."""
    if d.shape[1] <= k:
        i, j = np.indices(d.shape)
        i, j = i.ravel(), j.ravel()
    else:
        # the k-th least of the least of some groups of columns is no less than the k-th of all, and hardly more
        groups = min(d.shape[1], 32 * k)
        size = d.shape[1] // groups
        least = d[:, :groups * size].reshape(len(d), size, groups).min(axis=1)
        # what rounding can bring to the k-th value or below it
        at = np.flatnonzero(d <= np.maximum(np.partition(least, k - 1, axis=1)[:, k - 1:k], 0.0) + 2e-9)
        i, j = np.divmod(at, d.shape[1])
    order = np.lexsort((j, rounded(d[i, j]), i))
    i, j = i[order], j[order]
    top = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[top], j[top]


def nearest_neighbours(train: DataFrame, evalu: DataFrame, k: int) -> DataFrame:
    """(path, y, neighbour, ny, d2, rank): the exact k nearest train rows of each row, ties by path.

    Train rows go to the cell of their nearest pivot. A row to score takes an upper bound of its
    k-th distance from the pivots and visits only cells that can hold something closer. Cells
    and visits are cut into blocks; a task sees one block pair and returns k rows per row scored,
    so neither all pairs nor a whole cell ever travels.
    """
    piv = _pivots(train)

    def to_pivots(x: np.ndarray) -> np.ndarray:
        d = (x * x).sum(1)[:, None] - 2 * x @ piv.T + (piv * piv).sum(1)[None, :]
        return np.sqrt(np.maximum(d, 0.0))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            d = to_pivots(np.stack(pdf["features"].to_numpy()).astype(np.float64))
            cell = d.argmin(axis=1)
            yield pdf.assign(cell=cell.astype(np.int32), pd=d[np.arange(len(d)), cell])

    placed = train.select("path", "y", "features").mapInPandas(
        assign, "path string, y int, features array<double>, cell int, pd double")
    rank = Window.partitionBy("cell").orderBy("pd")
    # per pivot: radius, size, and the k-th smallest distance (the rank limit runs before the shuffle)
    kth = placed.select("cell", "pd").withColumn("r", F.row_number().over(rank)).where(F.col("r") <= k).groupBy("cell").agg(
        F.max("pd").alias("kth"), F.count(F.lit(1)).alias("have"))
    stats = {r["cell"]: r for r in placed.groupBy("cell").agg(F.max("pd").alias("radius"), F.count(F.lit(1)).alias("n")).join(kth, "cell").collect()}
    cells = sorted(stats)
    radius = np.array([stats[c]["radius"] for c in cells])
    bound = np.array([stats[c]["kth"] if stats[c]["have"] == k else np.inf for c in cells])
    blocks = np.array([-(-stats[c]["n"] // KNN_BLOCK) for c in cells])

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            d = to_pivots(np.stack(pdf["features"].to_numpy()).astype(np.float64))[:, cells]
            limit = (d + bound[None, :]).min(axis=1)
            near = d - radius[None, :] <= limit[:, None] + 1e-9
            yield pdf.assign(cells=[np.asarray(cells, dtype=np.int32)[n] for n in near])

    # a row is copied to its cells by Spark, after it has left Python
    visits = evalu.select("path", "y", "features").mapInPandas(
        visit, "path string, y int, features array<double>, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")
    size = F.get(F.array(*[F.lit(int(x)) for x in np.bincount(cells, weights=blocks, minlength=max(cells) + 1)]), F.col("cell"))
    per_cell = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / KNN_BLOCK).cast("int").alias("vb"))
    v = visits.join(per_cell, "cell").withColumn("q", F.pmod(h32(F.col("path")), F.col("vb")).cast("int")).withColumn(
        "b", F.explode(F.sequence(F.lit(0), size - 1))).drop("vb")
    t = placed.drop("pd").withColumn("b", F.pmod(h32(F.col("path")), size).cast("int")).join(per_cell, "cell").withColumn(
        "q", F.explode(F.sequence(F.lit(0), F.col("vb") - 1))).drop("vb")

    schema = pa.schema([("path", pa.string()), ("y", pa.int32()), ("neighbour", pa.string()), ("ny", pa.int32()), ("d2", pa.float64())])

    def matrix(rows: pa.Table) -> np.ndarray:
        return rows.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)

    def block(rows: pa.Table, near: pa.Table) -> pa.Table:
        if not rows.num_rows or not near.num_rows:
            return schema.empty_table()
        near = near.sort_by("path")
        a, b = matrix(rows), matrix(near)
        square = (b * b).sum(1)
        parts = []
        step = max(1, KNN_AT_ONCE // len(b))
        for s in range(0, len(a), step):
            x = a[s:s + step]
            d = (-2 * x) @ b.T
            d += (x * x).sum(1)[:, None]
            d += square
            i, j = nearest(d, k)
            parts.append((s + i, j, rounded(d[i, j])))
        i, j, d2 = (np.concatenate(p) for p in zip(*parts))
        of, to = rows.select(["path", "y"]).take(pa.array(i)), near.select(["path", "y"]).take(pa.array(j))
        return pa.Table.from_arrays([of.column(0), of.column(1), to.column(0), to.column(1), pa.array(d2)], names=schema.names).cast(schema)

    keys = ["cell", "b", "q"]
    found = v.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInArrow(
        block, "path string, y int, neighbour string, ny int, d2 double")
    w = Window.partitionBy("path").orderBy("d2", "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_head(train, evalu, k, neighbours=5) -> DataFrame:
    """Vote shares of the nearest train rows."""
    nn = nearest_neighbours(train, evalu, neighbours)
    votes = [F.sum((F.col("ny") == c).cast("int")) / F.count(F.lit(1)) for c in range(k)]
    return nn.groupBy("path").agg(F.first("y").alias("y"), F.array(*votes).alias("p"))


HEADS = {
    "logreg": logreg_head, "rf": random_forest_head, "knn": knn_head, "linsvm": linear_svm_head,
    "rbf": rbf_head_approx, "gbt": boosted_trees_head,
}


def fit_head(kind: str, train: DataFrame, evalu: DataFrame, k: int, **kwargs) -> DataFrame:
    if kind not in HEADS:
        raise ValueError(f"unknown head {kind!r}; known: {sorted(HEADS)}")
    return HEADS[kind](train, evalu, k, **kwargs)
