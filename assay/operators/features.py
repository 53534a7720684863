"""Feature tables: health, block statistics, train-fitted standardisation and PCA."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from threading import Lock

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window, functions as F

from assay.functions.vectors import mean_row_norm

SAME_TABLE_GAP = 0.002  # fixed value: relative gap of mean row norms below which tables are the same
VIEW_PART = 32
#: the decomposition in the driver's JVM fails now and then when two run at the same time
PCA_ALONE = Lock()


def finite_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.when(_bad(x), 0.0).otherwise(x.cast("double")))


def _bad(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def feature_health(features: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, non-finite values, checksum and mean row norm per key; one pass."""
    d = features.select(*keys, F.size(F.filter("features", _bad)).alias("bad"), finite_sum(F.col("features")).alias("s"),
                        mean_row_norm(F.col("features").cast("array<double>")).alias("norm"))
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("bad").cast("bigint").alias("nonfinite"),
        F.sum("s").alias("checksum"), F.avg("norm").alias("mean_row_norm"))


def feature_block_stats(features: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population SD over all values of a block, and its width."""
    vals = features.select(*keys, F.size("features").alias("dim"), F.explode(F.col("features").cast("array<double>")).alias("x"))
    return vals.groupBy(*keys).agg(F.max("dim").alias("dim"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


def view_average(views: DataFrame, keys: list[str]) -> DataFrame:
    """Mean feature vector over the views of an item: the plain sum in their order over their number, which a running mean misses by
    a digit now and then. Vectors are cut into parts of VIEW_PART values, so that none is collected over the views."""
    x = F.col("features").cast("array<double>")
    last = F.floor((F.greatest(F.size(x), F.lit(1)) - 1) / VIEW_PART).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(x, j * VIEW_PART + 1, VIEW_PART))
    d = views.select(*keys, F.posexplode(parts).alias("_part", "_x"))
    means = d.groupBy(*keys, "_part").agg(F.max(F.size("_x")).alias("_n"), *[F.avg(F.get("_x", F.lit(i))).alias(f"_m{i}") for i in range(VIEW_PART)])
    each = means.select(*keys, F.struct("_part", F.slice(F.array(*[f"_m{i}" for i in range(VIEW_PART)]), F.lit(1), F.col("_n")).alias("x")).alias("_s"))
    return each.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["x"])).alias("features"))


def view_setting_classifier(norms: DataFrame, single: dict[tuple[str, str], str] | None = None, strict: bool = True) -> DataFrame:
    """Which tables of a (backbone, role) hold plain features and which a mean over views.

    ``norms`` is (backbone, role, variant, rows, mean_row_norm), a row per table. The mean over
    views has the smaller norm. Tables within 0.2% of each other are the same table. A single
    train table is plain; ``single`` fixes the setting of other single tables by (backbone,
    role), else they stay undetermined. Three different tables are an error: a norm orders a pair
    only. Without ``strict`` they are undetermined.
    """
    w = Window.partitionBy("backbone", "role")
    by_norm = w.orderBy(F.desc("mean_row_norm"), "variant")
    prev = F.lag("mean_row_norm").over(by_norm)
    d = norms.withColumn("gap", (prev - F.col("mean_row_norm")) / F.greatest(prev, F.lit(1e-12)))
    new = (F.col("gap") > SAME_TABLE_GAP).cast("int")
    d = d.withColumn("step", F.sum(F.coalesce(new, F.lit(0))).over(by_norm)).withColumn("tables", F.max("step").over(w) + 1)
    one = F.col("tables") == 1
    many = F.raise_error(F.concat_ws(" ", F.lit("more than two tables for"), "backbone", "role")).cast("string") if strict else F.lit("undetermined")
    setting = F.when(F.col("tables") == 2, F.when(F.col("step") == 0, "plain").otherwise("view mean")).when(
        one & (F.col("role") == "train"), "plain")
    for (backbone, role), name in (single or {}).items():
        setting = setting.when(one & (F.col("backbone") == backbone) & (F.col("role") == role), name)
    setting = setting.when(F.col("tables") > 2, many).otherwise("undetermined")
    return d.select("backbone", "role", "variant", F.col("tables").cast("int").alias("tables"), setting.alias("setting"))


@dataclass
class Representation:
    """Train-fitted standardisation and projection; a few vectors of feature width."""

    mode: str
    mean: np.ndarray
    sd: np.ndarray
    centre: np.ndarray | None = None
    components: np.ndarray | None = None
    explained: float = 1.0
    extra: dict = field(default_factory=dict)

    @property
    def n_components(self) -> int:
        return len(self.mean) if self.components is None else self.components.shape[1]

    def apply(self, rows: DataFrame) -> DataFrame:
        """Replace ``features`` by the transformed vector, batch by batch."""
        mean, sd, centre, comp = self.mean, self.sd, self.centre, self.components
        others = [f for f in rows.schema.fields if f.name != "features"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if pdf.empty:
                    continue
                z = (np.stack(pdf["features"].to_numpy()).astype(np.float64) - mean) / sd
                if comp is not None:
                    z = (z - centre) @ comp
                yield pdf.assign(features=list(z))

        names = [f.name for f in others]
        schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["features array<double>"])
        return rows.select(*names, "features").mapInPandas(run, schema)


def extended_moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, population variance) per dimension in extended precision. Each task sums so, off some row's values, and the order of
    rows and the number of tasks don't reach the last digit of a double."""
    d = rows.select(F.col("features").cast("array<double>").alias("x"))
    some = d.first()
    if some is None:
        raise ValueError("no rows to take moments of")
    shift = np.asarray(some["x"], dtype=np.longdouble)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((2, len(shift)), dtype=np.longdouble)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - shift
                n, total = n + batch.num_rows, total + np.stack([x.sum(axis=0), (x * x).sum(axis=0)])
        high = total.astype(np.float64)
        low = (total - high).astype(np.float64)
        yield pa.RecordBatch.from_pydict({"n": [n], "high": [high.ravel().tolist()], "low": [low.ravel().tolist()]})

    parts = d.mapInArrow(run, "n long, high array<double>, low array<double>").toPandas()  # a row for each task
    n = int(parts["n"].sum())
    total = sum(np.asarray(p, dtype=np.longdouble) for c in ("high", "low") for p in parts[c]).reshape(2, -1)
    off, square = total / n
    return n, shift + off, np.maximum(square - off * off, 0)


def column_moments(rows: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, population SD) per dimension."""
    n, mean, variance = extended_moments(rows)
    return n, mean.astype(np.float64), np.sqrt(variance).astype(np.float64)


def fit_representation(train: DataFrame, mode: str = "per_dim", pca_variance: float = 0.0,
                       dims: list[int] | None = None) -> Representation:
    """Standardise per dimension, per block or not at all, then keep the components that carry
    more than ``pca_variance`` of the variance. Fitted on the rows given, which must be train rows.
    """
    n, exact, variance = extended_moments(train)
    mean, sd = exact.astype(np.float64), np.sqrt(variance).astype(np.float64)
    if mode == "per_dim":
        # variance lost in rounding counts as constant
        rep = Representation(mode, mean, np.where(sd > 10 * np.finfo(float).eps * np.maximum(1.0, np.abs(mean)), sd, 1.0))
    elif mode == "per_block":
        if not dims or sum(dims) != len(mean):
            raise ValueError("per_block needs the block widths")
        m, s, off = np.zeros(len(mean)), np.ones(len(mean)), 0
        for d in dims:
            block = slice(off, off + d)
            # in extended precision, too: the last digit of these two is in every value
            mu = exact[block].mean()
            # variance over all values of the block = mean within + between the columns
            var = variance[block].mean() + ((exact[block] - mu) ** 2).mean()
            m[block], s[block] = mu, np.sqrt(var) or 1.0
            off += d
        rep = Representation(mode, m, s)
    elif mode == "none":
        rep = Representation(mode, np.zeros(len(mean)), np.ones(len(mean)))
    else:
        raise ValueError(f"unknown standardisation mode {mode!r}")
    if pca_variance > 0:
        z = rep.apply(train.select("features"))
        rep.centre = (mean - rep.mean) / rep.sd
        with PCA_ALONE:
            model = PCA(k=len(mean), inputCol="x", outputCol="o").fit(
                z.select(array_to_vector("features").alias("x")))
        share = np.cumsum(model.explainedVariance.toArray())
        k = min(int(np.searchsorted(share, pca_variance, side="right")) + 1, len(mean))
        rep.components, rep.explained = model.pc.toArray()[:, :k], float(share[k - 1])
    return rep
