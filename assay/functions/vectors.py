"""Vectors that are flattened square grids: orientation, normalisation, comparison.

Column functions are plain Spark expressions. Where a lambda needs a row constant it is bound
once with ``let``; written inline, it would be evaluated again for every element.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from assay.functions.posterior import asum, let

# Names of the eight orientations in the order of a corpus scan ...
SCAN_NAMES = ("id", "rot90", "rot180", "rot270", "flip", "flip_rot90", "flip_rot180", "flip_rot270")
# ... and in the order of a pair verification.
VERIFY_NAMES = ("identity", "flip", "rot90", "rot90+flip", "rot180", "rot180+flip", "rot270", "rot270+flip")


def scan_orders(side: int) -> np.ndarray:
    """(8, side*side): where each orientation takes its cells from; four turns, then the same mirrored."""
    grid = np.arange(side * side).reshape(side, side)
    turns = [np.rot90(g, r) for g in (grid, grid[:, ::-1]) for r in range(4)]
    return np.stack([t.ravel() for t in turns])


def verify_orders(side: int) -> np.ndarray:
    """(8, side*side): each turn followed by its mirror."""
    grid = np.arange(side * side).reshape(side, side)
    both = [v for r in range(4) for v in (np.rot90(grid, r), np.rot90(grid, r)[:, ::-1])]
    return np.stack([t.ravel() for t in both])


def orbits(side: int) -> list[list[int]]:
    """Cells that the eight orientations map onto each other."""
    table = scan_orders(side)
    return [list(t) for t in sorted({tuple(sorted(set(table[:, i].tolist()))) for i in range(side * side)})]


def ints(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def moments(v: Column) -> Column:
    """struct(mean, sd): population SD."""
    return let(asum(v) / F.size(v), lambda m: F.struct(
        m.alias("mean"),
        F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(v)).alias("sd")))


def znorm(v: Column) -> Column:
    """Zero mean, unit variance; a constant vector becomes zeros."""
    return let(moments(v), lambda s: F.transform(
        v, lambda x: F.when(s["sd"] <= 1e-6, F.lit(0.0)).otherwise((x - s["mean"]) / s["sd"])))


def affine_residual(x: Column, b: Column) -> Column:
    """Mean |a*x + c - b| under the least-squares brightness and contrast (a, c)."""
    means = F.struct((asum(x) / F.size(x)).alias("mx"), (asum(b) / F.size(b)).alias("mb"))

    def slope(m: Column) -> Column:
        xx = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - m["mx"]) * (v - m["mx"]))
        xb = F.aggregate(F.arrays_zip(x.alias("x"), b.alias("b")), F.lit(0.0),
                         lambda s, p: s + (p["x"] - m["mx"]) * (p["b"] - m["mb"]))
        return let(F.struct(xx.alias("xx"), xb.alias("xb")),
                   lambda q: F.struct(m["mx"].alias("mx"), m["mb"].alias("mb"),
                                      F.when(q["xx"] > 0, q["xb"] / q["xx"]).otherwise(F.lit(0.0)).alias("a")))

    return let(let(means, slope), lambda m: F.aggregate(
        F.zip_with(x, b, lambda u, w: F.abs(m["a"] * (u - m["mx"]) - (w - m["mb"]))),
        F.lit(0.0), lambda s, v: s + v) / F.size(x))


def reorient(v: Column, order) -> Column:
    return F.transform(ints(order), lambda i: F.get(v, i))


def canonical_grid_key(v: Column, side: int, levels: int = 4) -> Column:
    """Content key that all eight orientations share: scale to a few levels, write every
    orientation out, keep the smallest, hash it."""
    span = F.struct(F.array_min(v).alias("lo"), F.array_max(v).alias("hi"))
    q = let(span, lambda s: F.transform(v, lambda x: F.when(
        s["hi"] > s["lo"], F.rint((x - s["lo"]) / (s["hi"] - s["lo"]) * (levels - 1))).otherwise(F.lit(0.0)).cast("int").cast("string")))
    return let(q, lambda d: F.md5(F.least(*[
        F.array_join(F.transform(ints(o), lambda i: F.get(d, i)), "") for o in scan_orders(side)]).cast("binary")))


def mean_row_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
