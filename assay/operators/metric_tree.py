"""Range join of unit grids under the eight orientations, by a tree of splits that loses no pair.

The distance of two grids is the least over the orientations; it is a metric. Each split of the
tree is a number no two grids can differ in by more than their distance:

- the projection of the *ordered* grid (values sorted inside each orbit of cells) on a unit
  direction, here a main direction of the node's own rows;
- the distance to a pivot, one of the node's own rows (the triangle inequality).

A left item goes to one side of a cut, a right item to every side within reach of it, so each
pair meets in the left item's leaf. A node takes the cut with the fewest remaining comparisons on
a bounded sample. A tree that saves less than a fifth of a cell's comparisons isn't used: the
cell stays whole. Trees grow in rounds: each round splits all full cells at once, and a round's
tree is one row of bounded size that meets the cell's rows in salted groups.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from assay.functions.vectors import orbits, scan_orders
from assay.session import write_and_read

SAMPLE_ROWS = 8192    # expected rows of each side that decide a cell's splits
NODES = 127           # cuts of one tree
GROUP_ROWS = 8192     # expected rows of a task's group while rows are dealt
PIVOTS = 5
DIRECTIONS = 3
GAIN = 0.8            # a tree must leave at most this share of a cell's comparisons
LEAST = 0.02          # a cut must save this share of its node's, and half the share of rows it copies
SHARES = np.array([0.01, 0.02, 0.03, 0.05, 0.07] + [k / 20 for k in range(2, 19)])  # quantiles tried as cuts
ROUNDING = 1e-6       # distances near zero carry the root of the rounding error


def reach_of(t: float) -> float:
    """Distance within which every pair of correlation ``t`` lies."""
    return math.sqrt(2 * (1 - t) + 4e-12) + ROUNDING


def ordered(unit: np.ndarray, side: int) -> np.ndarray:
    """Values sorted inside each orbit: no orientation changes them, and distances only shrink."""
    return np.concatenate([np.sort(unit[:, cells], axis=1) for cells in orbits(side)], axis=1)


def distances(unit: np.ndarray, pivots: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """(rows, pivots) least distances over the orientations."""
    best = np.max([unit @ pivots[:, o].T for o in orders], axis=0)
    return np.sqrt(np.maximum(2 - 2 * best, 0.0))


def _cut(both: np.ndarray, rows: np.ndarray, n: int, orders: np.ndarray, reach: float, rng: np.random.Generator):
    """The best cut of a node whose first ``n`` rows are left ones: (is pivot, vector, cut,
    values) or None. ``both`` holds the ordered grids of ``rows``."""
    centred = both - both.mean(axis=0)
    directions = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :DIRECTIONS]
    pivots = rows[rng.choice(len(rows), min(PIVOTS, len(rows)), replace=False)]
    values = np.concatenate([both @ directions, distances(rows, pivots, orders)], axis=1)
    best, m = None, len(rows) - n
    for c in range(values.shape[1]):
        v = np.sort(values[:, c])
        gaps = np.diff(v).argsort()[-3:]
        cuts = np.concatenate([np.quantile(v, SHARES), (v[gaps] + v[gaps + 1]) / 2])
        sh, sg = np.sort(values[:n, c]), np.sort(values[n:, c])
        low = np.searchsorted(sh, cuts, "right")
        g_low, g_high = np.searchsorted(sg, cuts + reach, "right"), m - np.searchsorted(sg, cuts - reach, "left")
        left = (low * g_low + (n - low) * g_high) / (n * m)
        left[left > 1 - np.maximum(LEAST, (g_low + g_high - m) / m / 2)] = 2.0
        k = int(left.argmin())
        if left[k] <= 1 and (best is None or left[k] < best[0]):
            best = (left[k], c, float(cuts[k]))
    if best is None:
        return None
    _, c, cut = best
    far = c >= DIRECTIONS
    return far, pivots[c - DIRECTIONS] if far else directions[:, c], cut, values[:, c]


def grow(h: np.ndarray, g: np.ndarray, nh: int, ng: int, side: int, reach: float, leaf_rows: int, seed: int) -> dict:
    """A tree of at most NODES cuts from samples ``h`` and ``g`` of nh and ng rows, the fullest
    node first.

    Children below 0 are leaves; ``whole`` names the leaves that no cut helps. No cuts at all:
    the cell stays whole.
    """
    orders, rng = scan_orders(side), np.random.default_rng(seed)
    fh, fg = ordered(h, side), ordered(g, side)
    wh, wg = nh / max(len(h), 1), ng / max(len(g), 1)
    tree = {"pivot": [], "cut": [], "vec": [], "left": [], "right": [], "whole": []}
    leaves, remaining = 0, 0
    # (-comparisons, tie, left rows, right rows, slot of the parent that will point here)
    heap = [(-len(h) * len(g), 0, np.arange(len(h)), np.arange(len(g)), None)]
    tie = 0
    while heap:
        _, _, hi, gi, slot = heapq.heappop(heap)
        small = len(hi) * wh <= leaf_rows and len(gi) * wg <= leaf_rows
        few = not len(hi) or not len(gi) or (len(hi) + len(gi) < 64 and wh + wg > 2)
        best = None
        if not small and not few and len(tree["cut"]) < NODES:
            best = _cut(np.concatenate([fh[hi], fg[gi]]), np.concatenate([h[hi], g[gi]]), len(hi), orders, reach, rng)
            if best is None:
                tree["whole"].append(leaves)
        if best is None:
            leaves += 1
            remaining += len(hi) * len(gi)
            me = -leaves
        else:
            far, vec, cut, value = best
            me = len(tree["cut"])
            for name, part in (("pivot", int(far)), ("cut", cut), ("vec", vec), ("left", 0), ("right", 0)):
                tree[name].append(part)
            x, y = value[:len(hi)], value[len(hi):]
            for name, a, b in (("left", hi[x <= cut], gi[y <= cut + reach]), ("right", hi[x > cut], gi[y >= cut - reach])):
                tie += 1
                heapq.heappush(heap, (-len(a) * len(b), tie, a, b, (name, me)))
        if slot:
            tree[slot[0]][slot[1]] = me
    if tree["cut"] and remaining > GAIN * len(h) * len(g):
        return {"pivot": [], "cut": [], "vec": [], "left": [], "right": [], "whole": [0]}
    return tree


def route(unit: np.ndarray, tree: dict, side: int, reach: float, guest: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf): one leaf per row, or with ``guest`` every leaf within reach."""
    f, orders = ordered(unit, side), scan_orders(side)
    rows, leaves = [], []
    todo = [(0, np.arange(len(unit)))]
    while todo:
        at, idx = todo.pop()
        if at < 0:
            rows.append(idx)
            leaves.append(np.full(len(idx), -at - 1))
            continue
        if not len(idx):
            continue
        vec, cut = tree["vec"][at], tree["cut"][at]
        x = distances(unit[idx], vec[None, :], orders)[:, 0] if tree["pivot"][at] else f[idx] @ vec
        extra = reach if guest else 0.0
        todo.append((tree["left"][at], idx[x <= cut + extra]))
        todo.append((tree["right"][at], idx[x >= cut - extra] if guest else idx[x > cut]))
    return np.concatenate(rows or [np.empty(0, int)]), np.concatenate(leaves or [np.empty(0, int)])


def _fit(side: int, reach: float, leaf_rows: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["guest", "item"])  # the same sample grows the same tree
        unit = np.stack(pdf["unit"].to_numpy())
        guest = pdf["guest"].to_numpy(dtype=bool)
        cell, nh, ng = pdf["cell"].iloc[0], int(pdf["nh"].iloc[0]), int(pdf["ng"].iloc[0])
        tree = grow(unit[~guest], unit[guest], nh, ng, side, reach, leaf_rows, len(cell))
        if not tree["cut"]:
            return pd.DataFrame({c: [] for c in ("cell", "pivot", "cut", "vec", "left", "right", "whole")}, dtype=object)
        return pd.DataFrame({
            "cell": [cell], "pivot": [tree["pivot"]], "cut": [tree["cut"]], "vec": [np.concatenate(tree["vec"])],
            "left": [tree["left"]], "right": [tree["right"]], "whole": [tree["whole"]]})

    return run


def _deal(side: int, reach: float, guest: bool, columns: list[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or trees.empty:
            return pd.DataFrame({c: [] for c in columns}, dtype=object)
        t = trees.iloc[0]
        tree = {c: list(t[c]) for c in ("pivot", "cut", "left", "right")}
        tree["vec"] = np.asarray(t["vec"], dtype=float).reshape(-1, side * side)
        whole = set(t["whole"])
        idx, leaf = route(np.stack(rows["unit"].to_numpy()), tree, side, reach, guest)
        name = {k: f"{t['cell']}/{k}" + ("!" if k in whole else "") for k in set(leaf.tolist())}
        return rows.iloc[idx].assign(cell=[name[k] for k in leaf.tolist()])[columns]

    return run


def cell_sizes(home: DataFrame, guest: DataFrame) -> DataFrame:
    """(cell, nh, ng) of the cells both sides use."""
    n = lambda d, c: d.groupBy("cell").agg(F.count(F.lit(1)).alias(c))
    return n(home, "nh").join(n(guest, "ng"), "cell")


def metric_cells(left: DataFrame, right: DataFrame, side: int, t: float, leaf_rows: int) -> tuple[DataFrame, DataFrame]:
    """The left items (item, unit, ...) with their ``cell``, each once, and the right items in
    every cell where a left item of correlation >= ``t`` may be.

    Cells above ``leaf_rows`` are those that no cut helps.
    """
    reach = reach_of(t)
    # fresh column names for each side, so that a table can meet itself
    start = lambda d: d.select(F.lit("").alias("cell"), *[F.col(c).alias(c) for c in d.columns])
    home, guest = start(left), start(right)
    kept: list[tuple[DataFrame, DataFrame]] = []
    while True:  # a tree leaves at most GAIN of a cell's comparisons, so the rounds end
        sizes = cell_sizes(home, guest).where(
            ~F.col("cell").endswith("!") & ((F.col("nh") > leaf_rows) | (F.col("ng") > leaf_rows)))
        full = write_and_read(sizes, "full-cells")
        if full.isEmpty():
            break

        def picked(d: DataFrame, n: str, is_guest: bool) -> DataFrame:
            share = F.lit(float(SAMPLE_ROWS)) / F.col(n)
            draw = F.pmod(F.xxhash64("item", "cell", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
            return d.join(full, "cell").where(draw < share).select("cell", "nh", "ng", "item", "unit", F.lit(is_guest).alias("guest"))

        trees = write_and_read(
            picked(home, "nh", False).unionByName(picked(guest, "ng", True)).groupBy("cell").applyInPandas(
                _fit(side, reach, leaf_rows),
                "cell string, pivot array<int>, cut array<double>, vec array<double>, left array<int>, right array<int>, whole array<int>"),
            "trees")
        split = write_and_read(full.join(trees.select("cell"), "cell"), "split-cells")
        stay = lambda d: d.join(split.select("cell"), "cell", "left_anti")
        kept.append((stay(home), stay(guest)))

        def dealt(d: DataFrame, n: str, is_guest: bool) -> DataFrame:
            salts = F.ceil(F.col(n) / F.lit(GROUP_ROWS)).cast("int")
            rows = d.join(split.select("cell", salts.alias("k")), "cell").withColumn(
                "salt", F.pmod(F.xxhash64("item", F.lit("salt")), F.col("k")).cast("int"))
            copies = trees.join(split.select("cell", salts.alias("k")), "cell").withColumn(
                "salt", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
            return rows.groupBy("cell", "salt").cogroup(copies.groupBy("cell", "salt")).applyInPandas(
                _deal(side, reach, is_guest, d.columns), d.schema)

        home, guest = write_and_read(dealt(home, "nh", False), "home"), write_and_read(dealt(guest, "ng", True), "guest")
    kept.append((home, guest))
    out = kept[0]
    for h, g in kept[1:]:
        out = (out[0].unionByName(h), out[1].unionByName(g))
    return out
