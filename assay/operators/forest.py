"""Forests of full trees: trees are dealt over tasks, each grown on its own draw of the rows of one matrix block.

Features are cut into bins once, by quantiles. A level of a tree takes one histogram of the classes by (bin, node,
drawn feature), some nodes at a time, and splits every impure node by the largest fall of the Gini index. Trees stay
in the shared folder, some in a row; a task scores a batch of rows by one such row, and the shares are added up.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assay.operators.blocks import Block
from assay.operators.boosting import binned, edges_of
from assay.session import write_and_read

BINS = 32
CELLS = 1 << 18  # cells of the nodes whose histograms are taken together
GROUP = 8        # trees of one task
SCORED = 8192    # expected rows of a batch


def grow(bins: np.ndarray, y: np.ndarray, w: np.ndarray, k: int, drawn: int, depth: int, min_leaf: int, rng: np.random.Generator, width: int = BINS):
    """One tree by row counts ``w``: (feature, cut, left child, class shares) of its nodes. A row goes left with bin <= cut; the
    right child follows the left one, and a feature below 0 marks a leaf."""
    rows = np.flatnonzero(w)
    at = np.zeros(len(rows), dtype=np.int64)  # place of the row's node among this level's
    parts = []
    first, level = 0, 0
    here = np.bincount(y[rows], w[rows], k)[None, :]  # class counts of this level's nodes
    while len(here):
        n = len(here)
        feature, cut, left = np.full(n, -1, dtype=np.int16), np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.int32)
        total = here.sum(axis=1)
        open_ = (here.max(axis=1) < total) & (total >= 2 * min_leaf) & (level < depth)
        pick = np.sort(np.argpartition(rng.random((n, bins.shape[1])), drawn - 1, axis=1)[:, :drawn], axis=1)
        keep = open_[at]
        rows, at = rows[keep], at[keep]
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        some = max(1, CELLS // (width * drawn * k))
        todo, below, children = np.flatnonzero(open_), [], 0
        for i in range(0, len(todo), some):
            own = todo[i:i + some]
            lo, hi = np.searchsorted(at, [own[0], own[-1] + 1])
            slot = np.searchsorted(own, at[lo:hi])
            b = bins[rows[lo:hi, None], pick[at[lo:hi]]].astype(np.int64)
            cell = ((b * len(own) + slot[:, None]) * drawn + np.arange(drawn)) * k + y[rows[lo:hi], None]
            low = np.bincount(cell.ravel(), np.repeat(w[rows[lo:hi]], drawn), width * len(own) * drawn * k).reshape(width, len(own), drawn, k)
            for j in range(1, width):
                low[j] += low[j - 1]
            high = here[own][None, :, None, :] - low
            nl = low.sum(axis=3)
            nr = total[own][None, :, None] - nl
            low *= low
            high *= high
            score = low.sum(axis=3) / np.maximum(nl, 1) + high.sum(axis=3) / np.maximum(nr, 1)
            score[(nl < min_leaf) | (nr < min_leaf)] = -1.0
            score = score.transpose(1, 2, 0).reshape(len(own), -1)  # the first feature, then the lowest cut, wins a tie
            best = score.argmax(axis=1)
            good = score[np.arange(len(own)), best] > (here[own] ** 2).sum(axis=1) / total[own] * (1 + 1e-12)
            j, c = best[good] // width, best[good] % width
            own = own[good]
            feature[own], cut[own] = pick[own, j], c
            left[own] = first + n + 2 * (children + np.arange(len(own)))
            children += len(own)
        parts.append((feature, cut, left, (here / total[:, None]).astype(np.float32)))
        keep = feature[at] >= 0
        rows, at = rows[keep], at[keep]
        right = bins[rows, feature[at]] > cut[at]
        at = left[at] - first - n + right
        here = np.bincount(at * k + y[rows], w[rows], 2 * children * k).reshape(-1, k)
        first, level = first + n, level + 1
    return tuple(np.concatenate(x) for x in zip(*parts))


def shares(tree, bins: np.ndarray) -> np.ndarray:
    """Class shares of each row's leaf."""
    feature, cut, left, share = tree
    node, row = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    while len(row):
        row = row[feature[node[row]] >= 0]
        at = node[row]
        node[row] = left[at] + (bins[row, feature[at]] > cut[at])
    return share[node]


def forest_posteriors(block: DataFrame, train: DataFrame, evalu: DataFrame, k: int, trees: int, depth: int, min_leaf: int, seed: int) -> DataFrame:
    """(path, y, p): the mean of the trees' shares. ``block`` is the only block of ``train`` (candidate 0, ...)."""
    spark, edges = train.sparkSession, edges_of(train, BINS)[0]
    drawn, groups = max(1, int(np.ceil(np.sqrt(len(edges))))), -(-trees // GROUP)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pydict({"x": [binned(Block.of(row).x, edges).tobytes()], "y": [row["y"]]})

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                y, made = np.frombuffer(row["y"], dtype=np.int64), []
                x = np.frombuffer(row["x"], dtype=np.uint8).reshape(len(y), -1)
                for t in range(row["grp"] * GROUP, min(trees, (row["grp"] + 1) * GROUP)):
                    rng = np.random.default_rng([seed, t])
                    made.append(grow(x, y, rng.poisson(1.0, len(x)).astype(float), k, drawn, depth, min_leaf, rng))
                yield pa.RecordBatch.from_pydict({"grp": pa.array([row["grp"]], pa.int32()), "trees": pa.array([zlib.compress(pickle.dumps(made), 1)], pa.binary())})

    each = spark.range(groups).select(F.col("id").cast("int").alias("grp"))
    # the block's bins, a byte each, go to every task; they don't pass through the driver
    ground = write_and_read(block.mapInArrow(packed, "x binary, y binary"), "forest-rows").crossJoin(F.broadcast(each))
    planted = write_and_read(ground.repartitionByRange(groups, "grp").mapInArrow(plant, "grp int, trees binary"), "forest")

    def bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = binned(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), edges)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["path", "y", "x"])

    d = evalu.select(F.col("path").cast("string").alias("path"), F.col("y").cast("int").alias("y"), F.col("features").cast("array<double>").alias("features"))
    d = d.mapInArrow(bytes_of, "path string, y int, x binary")

    def walk(near: pd.DataFrame, grown: pd.DataFrame) -> pd.DataFrame:
        if near.empty or grown.empty:
            return pd.DataFrame({"path": [], "y": [], "p": []}, dtype=object)
        x = np.frombuffer(b"".join(near["x"]), dtype=np.uint8).reshape(len(near), -1)
        total = np.zeros((len(x), k))
        for tree in pickle.loads(zlib.decompress(grown["trees"].iloc[0])):
            total += shares(tree, x)
        return pd.DataFrame({"path": near["path"].to_numpy(), "y": near["y"].to_numpy(), "p": list(total)})

    many = F.greatest(F.lit(1), F.ceil(F.col("n") / SCORED)).cast("int")
    size = d.agg(F.count(F.lit(1)).alias("n")).select(many.alias("parts"))
    spread = d.crossJoin(F.broadcast(size)).withColumn("part", F.pmod(F.xxhash64("path"), F.col("parts")).cast("int")).drop("parts")
    rows = spread.crossJoin(F.broadcast(each))
    copies = planted.crossJoin(F.broadcast(size)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    keys = ["grp", "part"]
    got = rows.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInPandas(walk, "path string, y int, p array<double>")
    return got.groupBy("path").agg(F.first("y").alias("y"), F.array(*[F.sum(F.get("p", F.lit(c))) / F.lit(float(trees)) for c in range(k)]).alias("p"))
