"""Bootstrap and permutation tests on sufficient statistics.

Predictions shrink to one row per group before any resampling: a vector of counts (for a
confusion cube: every method, unit and cell). A replicate is then weights times counts, done
block-wise in the tasks, so no table of draws is ever shuffled: a task receives one block of
groups and returns one summed vector per replicate.

All methods and units share the draws. Draws come from integer arithmetic on (seed, replicate,
stratum, slot), so they do not depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from assay.functions.hashing import h32
from assay.operators import metrics as me
from assay.operators.metrics import METRICS

PRIME = 2147483647  # 2**31 - 1, so products of two residues fit 63 bits
BLOCK_GROUPS = 50_000
#: draws in memory at once, in a task
DRAWS = 1_000_000
#: hash buckets of a stratum: this many for each block, so that a block never grows with the table
BUCKETS_PER_BLOCK, LEAST_BUCKETS = 64, 4096


def mix(seed: int, rep: np.ndarray, stratum: int, slot: np.ndarray) -> np.ndarray:
    """Uniform residues below PRIME for each (replicate, slot), by two squaring rounds."""
    s0 = (rep * 1000003 + slot * 10007 + stratum * 101 + seed) % PRIME
    s1 = (s0 * 48271 + 11) % PRIME
    s2 = (s1 * s1 + s0) % PRIME
    s3 = (s2 * 69621 + 17) % PRIME
    return (s3 * s3 + s1) % PRIME


def _block_plan(groups: DataFrame) -> tuple[dict[int, list[int]], DataFrame]:
    """Cut each stratum into blocks of about BLOCK_GROUPS groups along the group hash.

    The driver sees one count per bucket. Returns the block sizes per stratum and the
    (stratum, bucket) -> block table.
    """
    counts = groups.groupBy("stratum", "bucket").count().collect()
    sizes: dict[int, list[int]] = {}
    rows = []
    for st in sorted({r["stratum"] for r in counts}):
        blocks, cur = [], 0
        for b, n in sorted((r["bucket"], r["count"]) for r in counts if r["stratum"] == st):
            if cur and cur + n > BLOCK_GROUPS:
                blocks.append(cur)
                cur = 0
            cur += n
            rows.append((st, b, len(blocks)))
        blocks.append(cur)
        sizes[st] = blocks
    table = groups.sparkSession.createDataFrame(rows, "stratum int, bucket int, block int")
    return sizes, table


def block_draws(seed: int, stratum: int, sizes: list[int], block: int, reps: np.ndarray) -> np.ndarray:
    """How many of the stratum's draws fall into ``block``, per replicate.

    The multinomial over blocks is split by halves with binomials seeded by the half, so all
    blocks of a stratum agree without talking to each other. A draw depends on the seed, the
    stratum, the half and the replicate alone, not on how replicates are dealt to tasks.
    """
    total = sum(sizes)
    n = np.full(len(reps), total, dtype=np.int64)
    lo, hi = 0, len(sizes)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        share = sum(sizes[lo:mid]) / sum(sizes[lo:hi])
        left = np.array([np.random.default_rng([seed, stratum, lo, hi, r]).binomial(k, share)
                         for r, k in zip(reps.tolist(), n.tolist())], dtype=np.int64)
        if block < mid:
            n, hi = left, mid
        else:
            n, lo = n - left, mid
    return n


def _weights(seed: int, stratum: int, block: int, reps: np.ndarray, m: np.ndarray, n_groups: int) -> np.ndarray:
    """(replicates, groups) how often each group of the block is drawn, in ``m`` draws per replicate."""
    slots = np.arange(int(m.max()), dtype=np.int64)
    rank = mix(seed + 7919 * block, reps[:, None], stratum, slots[None, :]) * n_groups // PRIME
    flat = rank + np.arange(len(reps), dtype=np.int64)[:, None] * n_groups
    if int(m.min()) < len(slots):
        flat = flat[slots[None, :] < m[:, None]]
    return np.bincount(flat.ravel(), minlength=len(reps) * n_groups).reshape(len(reps), n_groups)


def cluster_replicates(groups: DataFrame, n_rep: int = 2000, seed: int = 42, chunk: int = 250) -> DataFrame:
    """(rep, v): summed vector of each replicate.

    ``groups`` is (stratum INT, grp STRING, v ARRAY<DOUBLE>), one row per group. Within each
    stratum as many groups are drawn, with replacement, as it has.
    """
    wanted = BUCKETS_PER_BLOCK * groups.count() // BLOCK_GROUPS
    buckets = min(2**31, max(LEAST_BUCKETS, 1 << (wanted - 1).bit_length() if wanted else 1))
    g = groups.withColumn("bucket", (h32(F.col("grp")) / F.lit(2**32 // buckets)).cast("int"))
    sizes, plan = _block_plan(g)
    n_blocks = sum(len(b) for b in sizes.values())
    # a few large blocks would leave cores idle, so replicates are cut too
    par = groups.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, min(-(-n_rep // chunk), -(-4 * par // n_blocks)))
    per = -(-n_rep // chunks)
    each = g.join(F.broadcast(plan), ["stratum", "bucket"]).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        st, block, ch = (int(pdf[c].iloc[0]) for c in ("stratum", "block", "chunk"))
        pdf = pdf.sort_values("grp")
        values = np.stack(pdf["v"].to_numpy()).astype(np.float64)
        first, last = ch * per, min(n_rep, (ch + 1) * per)
        out = []
        for a in range(first, last, chunk):
            reps = np.arange(a, min(last, a + chunk), dtype=np.int64)
            draws = block_draws(seed, st, sizes[st], block, reps)
            step = max(1, DRAWS // max(1, int(draws.max())))
            for s in range(0, len(reps), step):
                w = _weights(seed, st, block, reps[s:s + step], draws[s:s + step], len(values))
                out.append(w @ values)
        m = np.concatenate(out) if out else np.zeros((0, values.shape[1]))
        return pd.DataFrame({"rep": np.arange(first, first + len(m), dtype=np.int32), "v": list(m)})

    # few bytes and much work: a number of partitions of its own, which is not merged by size
    keys = ["stratum", "block", "chunk"]
    parts = each.repartition(max(par, 2 * n_blocks * chunks), *keys).groupBy(*keys).applyInPandas(run, "rep int, v array<double>")
    width = groups.select(F.size("v").alias("n")).first()["n"]
    return parts.groupBy("rep").agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(width)]).alias("v"))


def method_cells(methods: list[str], units: list[str], k: int) -> list[tuple[str, str, int, int]]:
    return [(m, u, y, p) for m in methods for u in units for y in range(k) for p in range(k)]


def group_cubes(preds: DataFrame, methods: list[str], k: int, pools: tuple[str, ...] = ("majority_vote", "mean_probability")) -> DataFrame:
    """(stratum, grp, v): one row per group with its confusion counts for every method and
    unit. One shuffle on (method, group), one on group, both after map-side aggregation."""
    keys = ["method", "patient_id"]
    cells = [F.sum(((F.col("y_true") == y) & (F.col("y_pred") == p)).cast("int")).alias(f"c{y}_{p}")
             for y in range(k) for p in range(k)]
    means = [F.avg(F.get("p", F.lit(i))).alias(f"m{i}") for i in range(k)] if "mean_probability" in pools else []
    per = preds.groupBy(*keys).agg(F.min("y_true").alias("y_true"), *cells, *means)
    from assay.functions.posterior import argmax_of
    votes = [sum((F.col(f"c{y}_{p}") for y in range(1, k)), F.col(f"c0_{p}")) for p in range(k)]
    decided = {"majority_vote": argmax_of(votes)}
    if means:
        decided["mean_probability"] = argmax_of([F.col(f"m{i}") for i in range(k)])
    per = per.withColumns({f"d_{u}": decided[u] for u in pools})
    vec = [F.col(f"c{y}_{p}").cast("double") for y in range(k) for p in range(k)]
    for u in pools:
        vec += [((F.col("y_true") == y) & (F.col(f"d_{u}") == p)).cast("double") for y in range(k) for p in range(k)]
    per = per.select(*keys, "y_true", F.array(*vec).alias("v"))
    cols = [F.first(F.when(F.col("method") == m, F.col("v")), ignorenulls=True) for m in methods]
    return per.groupBy("patient_id").agg(
        F.min("y_true").cast("int").alias("stratum"), F.concat(*cols).alias("v")).select(
        "stratum", F.col("patient_id").alias("grp"), "v")


def replicate_metrics(reps: DataFrame, methods: list[str], units: list[str], k: int) -> DataFrame:
    """(rep, method, unit, accuracy, balanced_accuracy, macro_f1) from summed cube vectors.

    Row-wise arithmetic: the vector of a replicate already holds every cell.
    """
    cols = [c for c in reps.columns if c != "v"]
    names = [(m, u) for m in methods for u in units]
    parts = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(u).alias("unit"),
                               F.slice("v", i * k * k + 1, k * k).alias("c")) for i, (m, u) in enumerate(names)])
    d = reps.select(*cols, F.explode(parts).alias("m")).select(*cols, "m.*")
    c = [[F.get("c", F.lit(y * k + p)) for p in range(k)] for y in range(k)]
    actual = [sum(c[y][1:], c[y][0]) for y in range(k)]
    predicted = [sum((c[y][p] for y in range(1, k)), c[0][p]) for p in range(k)]
    tp = [c[i][i] for i in range(k)]
    rec = [me.ratio(tp[i], actual[i]) for i in range(k)]
    f1 = [me.ratio(2 * tp[i], actual[i] + predicted[i]) for i in range(k)]
    return d.select(
        *cols, "method", "unit", (sum(tp[1:], tp[0]) / sum(actual[1:], actual[0])).alias("accuracy"),
        (sum(rec[1:], rec[0]) / k).alias("balanced_accuracy"), (sum(f1[1:], f1[0]) / k).alias("macro_f1"))


def long_metrics(d: DataFrame, keys: list[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])
    return d.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.*")


def _units(pools: tuple[str, ...]) -> list[str]:
    return ["slice_clustered", *pools]


def bootstrap_tables(preds: DataFrame, methods: list[str], k: int, n_rep: int = 2000, seed: int = 42,
                     pools: tuple[str, ...] = ("majority_vote", "mean_probability")) -> tuple[DataFrame, DataFrame]:
    """(point, replicates) metrics per method and unit; the cube is written once and read twice."""
    from assay.session import write_and_read

    if n_rep < 100:
        raise ValueError("use at least 100 resamples")
    cubes = write_and_read(group_cubes(preds, methods, k, pools), "cubes")
    width = len(methods) * (1 + len(pools)) * k * k
    point = cubes.agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(width)]).alias("v"))
    reps = cluster_replicates(cubes, n_rep, seed)
    units = _units(pools)
    return replicate_metrics(point, methods, units, k), replicate_metrics(reps, methods, units, k)


def percentile_ci(d: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Linear-interpolated 95% interval per key over the replicates."""
    return d.groupBy(*keys).agg(
        F.percentile(value, F.lit(0.025)).alias("ci95_low"), F.percentile(value, F.lit(0.975)).alias("ci95_high"))


def stratified_cluster_bootstrap(preds: DataFrame, methods: list[str], k: int, n_rep: int = 2000, seed: int = 42,
                                 pools: tuple[str, ...] = ("majority_vote", "mean_probability")) -> DataFrame:
    """Estimate and percentile interval per (method, unit, metric)."""
    point, reps = bootstrap_tables(preds, methods, k, n_rep, seed, pools)
    keys = ["method", "unit", "metric"]
    est = long_metrics(point, ["method", "unit"]).withColumnRenamed("value", "estimate")
    return est.join(percentile_ci(long_metrics(reps, ["method", "unit"]), keys), keys)


def _difference(d: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    side = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    return d.where(F.col("method").isin(a, b)).groupBy(*keys, "unit").agg(
        *[(side(a, c) - side(b, c)).alias(c) for c in METRICS])


def paired_difference_ci(preds: DataFrame, a: str, b: str, k: int, n_rep: int = 2000, seed: int = 42,
                         pools: tuple[str, ...] = ("majority_vote", "mean_probability")) -> DataFrame:
    """Metric difference a - b with its interval over the shared replicates."""
    point, reps = bootstrap_tables(preds, [a, b], k, n_rep, seed, pools)
    keys = ["unit", "metric"]
    obs = long_metrics(_difference(point, a, b, []), ["unit"]).withColumnRenamed("value", "difference")
    ci = percentile_ci(long_metrics(_difference(reps, a, b, ["rep"]), ["unit"]), keys)
    return obs.join(ci, keys).withColumn("comparison", F.lit(f"{a} minus {b}"))


def _hits(preds: DataFrame, methods: list[str]) -> DataFrame:
    """(stratum 0, grp, v): rows and correct rows per method of each group."""
    ok = (F.col("y_true") == F.col("y_pred"))
    v = []
    for m in methods:
        mine = F.col("method") == m
        v += [F.sum((mine & ok).cast("double")), F.sum(mine.cast("double"))]
    return preds.groupBy("patient_id").agg(F.array(*v).alias("v")).select(
        F.lit(0).alias("stratum"), F.col("patient_id").alias("grp"), "v")


def cluster_bootstrap_accuracy(preds: DataFrame, methods: list[str], n_rep: int = 2000, seed: int = 42) -> DataFrame:
    """Accuracy under resampling of groups: mean, interval, number of groups, per method."""
    return cluster_bootstrap_hits(_hits(preds, methods), methods, n_rep, seed)


def summed_hits(counts: DataFrame, methods: list[str]) -> DataFrame:
    """As ``_hits``, from (method, patient_id, ok, n): correct rows and rows."""
    v = [F.coalesce(F.sum(F.when(F.col("method") == m, F.col(c))).cast("double"), F.lit(0.0)) for m in methods for c in ("ok", "n")]
    return counts.groupBy("patient_id").agg(F.array(*v).alias("v")).select(
        F.lit(0).alias("stratum"), F.col("patient_id").alias("grp"), "v")


def cluster_bootstrap_hits(hits: DataFrame, methods: list[str], n_rep: int = 2000, seed: int = 42) -> DataFrame:
    """As ``cluster_bootstrap_accuracy``, from (stratum 0, grp, v): correct rows and rows per method of each group."""
    from assay.session import write_and_read

    g = write_and_read(hits, "hits")
    reps = cluster_replicates(g, n_rep, seed)
    acc = F.array(*[F.struct(F.lit(m).alias("method"), (F.get("v", F.lit(2 * i)) / F.get("v", F.lit(2 * i + 1))).alias("acc"))
                    for i, m in enumerate(methods)])
    d = reps.select(F.explode(acc).alias("x")).select("x.*")
    n = g.agg(F.count(F.lit(1)).alias("n_units"))
    return d.groupBy("method").agg(
        F.avg("acc").alias("mean"), F.percentile("acc", F.lit(0.025)).alias("lo"),
        F.percentile("acc", F.lit(0.975)).alias("hi")).join(F.broadcast(n))


def iid_bootstrap(cm: DataFrame, keys: list[str], k: int, n_rep: int = 1000, seed: int = 42) -> DataFrame:
    """Accuracy and balanced accuracy (classes present in the draw) under resampling of rows.

    Resampling n rows is one multinomial draw over the k*k confusion cells, so the work is
    replicates x cells whatever the number of rows. ``cm`` has keys x k*k rows.
    """
    cells = F.array(*[F.coalesce(F.sum(F.when((F.col("y_true") == y) & (F.col("y_pred") == p), F.col("n"))), F.lit(0))
                      for y in range(k) for p in range(k)])
    per_key = cm.groupBy(*keys).agg(cells.alias("cells"))
    each = per_key.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            acc, bal = [], []
            for c, rep in zip(pdf["cells"], pdf["rep"]):
                c = np.asarray(c, dtype=np.int64)
                n = int(c.sum())
                d = np.random.default_rng([seed, int(rep)]).multinomial(n, c / n).reshape(k, k)
                support = d.sum(axis=1)
                seen = support > 0
                acc.append(np.trace(d) / n)
                bal.append(float((np.diag(d)[seen] / support[seen]).mean()))
            yield pdf[keys + ["rep"]].assign(acc=acc, bal=bal)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in per_key.select(*keys).schema.fields)
    reps = each.mapInPandas(run, f"{schema}, rep int, acc double, bal double")
    out = reps.groupBy(*keys).agg(
        F.avg("acc").alias("mean"),
        F.percentile("acc", F.lit(0.025)).alias("acc_ci_low"), F.percentile("acc", F.lit(0.975)).alias("acc_ci_high"),
        F.percentile("bal", F.lit(0.025)).alias("bal_ci_low"), F.percentile("bal", F.lit(0.975)).alias("bal_ci_high"))
    return out


def ci_width_ratio(cluster: DataFrame, iid: DataFrame, key: str) -> DataFrame:
    """Width of the clustered interval over that of the row-wise one; null for a zero width."""
    j = cluster.select(key, (F.col("hi") - F.col("lo")).alias("cw")).join(
        iid.select(key, (F.col("acc_ci_high") - F.col("acc_ci_low")).alias("iw")), key)
    return j.select(key, F.when(F.col("iw") > 0, F.col("cw") / F.col("iw")).alias("ci_width_ratio"))


def paired_group_sums(pairs: DataFrame, comparisons: list[str]) -> DataFrame:
    """(grp, g, v): per group the summed accuracy difference of each comparison and the rows.

    ``pairs`` is (patient_id, baseline, y_true, pred_a, pred_b).
    """
    delta = (F.col("pred_a") == F.col("y_true")).cast("double") - (F.col("pred_b") == F.col("y_true")).cast("double")
    v = []
    for c in comparisons:
        mine = F.col("baseline") == c
        v += [F.sum(F.when(mine, delta).otherwise(0.0)), F.sum(mine.cast("double"))]
    return pairs.groupBy("patient_id").agg(F.array(*v).alias("v")).select(F.col("patient_id").alias("grp"), "v")


def sign_flip_nulls(groups: DataFrame, n_rep: int, seed: int, width: int) -> DataFrame:
    """(rep, nulls): sums of the group differences under random signs, shared by comparisons.

    The sign of a group comes from its own 64-bit hash, so any partition can do its groups alone; a
    partition returns one vector per replicate.
    """
    d = groups.select(h32(F.col("grp")).alias("g"), h32(F.concat(F.lit("sign|"), F.col("grp"))).alias("g2"), F.array(*[F.get("v", F.lit(2 * i)) for i in range(width)]).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((n_rep, width))
        reps = np.arange(n_rep, dtype=np.int64)
        seen = False
        for pdf in batches:
            if pdf.empty:
                continue
            seen = True
            g = pdf["g"].to_numpy(dtype=np.int64) % PRIME
            g2 = pdf["g2"].to_numpy(dtype=np.int64) % PRIME
            s = np.stack(pdf["s"].to_numpy()).astype(np.float64)
            for a in range(0, len(g), 2000):
                bits = (mix(seed, reps[:, None], 5, g[None, a:a + 2000]) // 1024 + mix(seed, reps[:, None], 6, g2[None, a:a + 2000]) // 1024) % 2
                total += (1 - 2 * bits) @ s[a:a + 2000]
        if seen:
            yield pd.DataFrame({"rep": reps.astype(np.int32), "v": list(total)})

    parts = d.mapInPandas(run, "rep int, v array<double>")
    return parts.groupBy("rep").agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(width)]).alias("nulls"))


def paired_sign_flip_test(pairs: DataFrame, comparisons: list[str], n_rep: int = 2000, seed: int = 42) -> DataFrame:
    """Per comparison: accuracy difference, group bootstrap interval, sign-flip p and groups.

    p is (extreme + 1) / (replicates + 1), where a null sum counts as extreme when it reaches
    the observed one within 1e-12. Fewer than two groups is an error.
    """
    from assay.session import write_and_read

    g = write_and_read(paired_group_sums(pairs, comparisons), "pair-sums")
    width = len(comparisons)
    obs = g.agg(F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(2 * width)]).alias("obs"), F.count(F.lit(1)).alias("n_groups"))
    boot = cluster_replicates(g.select(F.lit(0).alias("stratum"), "grp", "v"), n_rep, seed)
    nulls = sign_flip_nulls(g, n_rep, seed, width)
    each = F.array(*[F.struct(F.lit(c).alias("baseline"), F.lit(i).alias("declared"), F.get("v", F.lit(2 * i)).alias("d"),
                              F.get("v", F.lit(2 * i + 1)).alias("n"), F.get("nulls", F.lit(i)).alias("null"),
                              F.get("obs", F.lit(2 * i)).alias("od"), F.get("obs", F.lit(2 * i + 1)).alias("on"))
                     for i, c in enumerate(comparisons)])
    d = boot.join(nulls, "rep").join(F.broadcast(obs)).select("n_groups", F.explode(each).alias("x")).select("n_groups", "x.*")
    extreme = (F.abs("null") >= F.abs("od") - 1e-12).cast("int")
    few = F.raise_error(F.lit("fewer than two independent groups")).cast("bigint")
    return d.groupBy("baseline", "declared").agg(
        F.first(F.col("od") / F.col("on")).alias("delta_accuracy"),
        F.percentile(F.col("d") / F.col("n"), F.lit(0.025)).alias("ci_low"),
        F.percentile(F.col("d") / F.col("n"), F.lit(0.975)).alias("ci_high"),
        ((F.sum(extreme) + 1) / (F.count(F.lit(1)) + 1)).alias("p_raw"),
        F.first(F.when(F.col("n_groups") < 2, few).otherwise(F.col("n_groups"))).alias("n_groups"))


def comparison_family(pairs: DataFrame, comparisons: list[str], n_rep: int = 2000, seed: int = 42) -> DataFrame:
    """All declared comparisons with step-down adjusted p, in declared order."""
    from assay.operators.tests_paired import holm_adjust

    t = paired_sign_flip_test(pairs, comparisons, n_rep, seed).withColumn("_f", F.lit(0))
    return holm_adjust(t, ["_f"], "p_raw", "declared").drop("_f")
