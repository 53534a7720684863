"""Choices made on validation scores: best configuration, thresholds, temperature, weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from assay.functions import posterior as po
from assay.operators import joins, metrics
from assay.operators.ranks import block_rank, running_max
from assay.session import write_and_read


def cost_table(classes: DataFrame, normal_idx: int | None, miss: float = 10.0, wrong_type: float = 4.0,
               false_alarm: float = 1.0) -> DataFrame:
    """(y_true, y_pred, cost) over the class codes of ``classes`` (y_true); k*k rows."""
    codes = classes.agg(F.array_sort(F.collect_set("y_true")).alias("codes"))  # one per class
    grid = codes.select("codes", F.explode("codes").alias("y_true")).select("y_true", F.explode("codes").alias("y_pred"))
    t, p = F.col("y_true"), F.col("y_pred")
    cost = F.when(t == p, 0.0)
    if normal_idx is not None:
        cost = cost.when((t != normal_idx) & (p == normal_idx), miss).when((t == normal_idx) & (p != normal_idx), false_alarm)
    return grid.withColumn("cost", cost.otherwise(wrong_type))


def distinct_posteriors(preds: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, p, n): equal posteriors counted, for figures that need no single row. Equal ones meet before the shuffle."""
    return preds.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("n"))


def rule_columns(p: Column, calibrated: Column, thresholds: list[float], k: int, normal_idx: int | None) -> dict[str, Column]:
    """Decision of each rule; ``calibrated`` is the posterior after the temperature."""
    cost = po.cost_matrix(k, normal_idx)
    return {
        "argmax": po.argmax_lowest(p, k),
        "threshold": po.threshold_rule(p, thresholds, k, normal_idx),
        "bayes": po.bayes_rule(p, cost),
        "bayes_cal": po.bayes_rule(calibrated, cost),
    }


def decision_rules(preds: DataFrame, thresholds: list[float], k: int, normal_idx: int | None,
                   temperature: float, carry: tuple[str, ...] = ("path", "y_true")) -> DataFrame:
    """Long table (method, path, y_true, rule, decision) of the four rules on one posterior; ``carry`` names the columns
    after the method."""
    p = F.col("p")
    rules = rule_columns(p, F.col("_cal"), thresholds, k, normal_idx)
    each = F.array(*[F.struct(F.lit(r).alias("rule"), c.alias("decision")) for r, c in rules.items()])
    d = preds.withColumn("_cal", po.temperature_apply(p, temperature, k))
    return d.select("method", *carry, F.explode(each).alias("r")).select("method", *carry, "r.*")


def leaderboard(results: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Top ``n`` rows; planned as one take-ordered step, no global sort."""
    return results.orderBy(*order).limit(n)


def select_best(grid: DataFrame, keys: list[str], score: str, idx: str) -> DataFrame:
    """Best score per key; the first candidate wins an exact tie. An aggregate, not a window."""
    return grid.groupBy(*keys).agg(
        F.max_by(idx, F.struct(F.col(score), (-F.col(idx)).alias("_i"))).alias(idx), F.max(score).alias(score))


def select_by_score_then_risk(grid: DataFrame, keys: list[str], score: str, risk: str, idx: str) -> DataFrame:
    """Best score at 6 decimals, then the smallest risk, then the first candidate."""
    rank = F.struct(F.round(score, 6).alias("a"), (-F.col(risk)).alias("b"), (-F.col(idx)).alias("c"))
    return grid.groupBy(*keys).agg(F.max_by(idx, rank).alias(idx))


def examples_per_category(pairs: DataFrame, category: str, order: list[str], n: int) -> DataFrame:
    """At most ``n`` examples per category; the group limit runs before the shuffle."""
    w = Window.partitionBy(category).orderBy(*order)
    return pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def topk_candidates(pairs: DataFrame, row: str, score: str, partner: str, k: int) -> DataFrame:
    """The k best-scoring partners per row."""
    w = Window.partitionBy(row).orderBy(F.desc(score), partner)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def early_stop(log: DataFrame, keys: list[str], epoch: str, score: str, patience: int, width: int) -> DataFrame:
    """Per run: the chosen epoch, its score, and the epoch training stopped at (null if never).

    An epoch improves when it beats every earlier one. Training stops at the first epoch with
    ``patience`` epochs since the last improvement; the last improvement before it is chosen.
    """
    d = block_rank(log, keys, epoch, width, "_rn")
    d = running_max(d, keys, epoch, width, score, "_prev", inclusive=False)
    d = d.withColumn("_imp", F.when(F.col("_prev").isNull() | (F.col(score) > F.col("_prev")), F.col("_rn")))
    d = running_max(d, keys, epoch, width, "_imp", "_last")
    stop = d.where(F.col("_rn") - F.col("_last") >= patience).groupBy(*keys).agg(F.min(epoch).alias("stop_epoch"))
    kept = d.where(F.col("_imp").isNotNull()).join(stop, keys, "left").where(
        F.col("stop_epoch").isNull() | (F.col(epoch) <= F.col("stop_epoch")))
    return kept.groupBy(*keys).agg(
        F.max(epoch).alias("chosen_epoch"), F.max(score).alias("best_score"), F.max("stop_epoch").alias("stop_epoch"))


THRESHOLD_GRID = [round(0.05 + 0.025 * i, 3) for i in range(37)]


def threshold_bin(p: Column) -> Column:
    """How many grid thresholds lie at or below ``p``, which has at most 9 decimals.

    The small shift keeps a value on a grid point on its upper side and is below the
    distance of the next 9-decimal value.
    """
    b = F.floor((p - F.lit(THRESHOLD_GRID[0])) * F.lit(40.0) + F.lit(1e-8)) + 1
    return F.greatest(F.lit(0), F.least(F.lit(len(THRESHOLD_GRID)), b)).cast("int")


def _passed(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and candidate i with threshold t: rows of either kind (P, N) and those at or above t (tp, fp)."""
    at = hist.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(THRESHOLD_GRID) - 1))))
    passed = F.col("bin") > F.col("i")
    d = at.groupBy(*keys, "i").agg(
        F.sum("np").alias("P"), F.sum("nn").alias("N"),
        F.sum(F.when(passed, F.col("np")).otherwise(0)).alias("tp"),
        F.sum(F.when(passed, F.col("nn")).otherwise(0)).alias("fp"))
    return d.withColumn("t", F.get(F.array(*[F.lit(t) for t in THRESHOLD_GRID]), F.col("i")))


def _tune_two(rows: DataFrame, keys: list[str], metric: str, min_recall: float, normal_idx: int | None) -> DataFrame:
    """The positive class's threshold; the other keeps 0.5. The score of a search by the positive
    F1 is the balanced accuracy at the threshold found."""
    pos = 1 - normal_idx if normal_idx in (0, 1) else 1
    hit = (F.col("y_true") == pos).cast("int")
    hist = rows.select(*keys, threshold_bin(po.round9(F.get("p", F.lit(pos)))).alias("bin"), hit.alias("pos")).groupBy(
        *keys, "bin").agg(F.sum("pos").alias("np"), F.sum(1 - F.col("pos")).alias("nn"))
    d = _passed(hist, keys)
    P, N, tp, fp = (F.col(c) for c in ("P", "N", "tp", "fp"))
    tn, fn = N - fp, P - tp
    share = lambda a, b: F.when(b > 0, a / b)
    f1 = lambda hits, wrong: metrics.ratio(2 * hits, 2 * hits + wrong)
    balanced = F.coalesce((share(tp, P) + share(tn, N)) / 2, share(tp, P), share(tn, N))
    value = {"accuracy": (tp + tn) / (P + N), "f1_pos": f1(tp, fp + fn), "f1_macro": (f1(tp, fp + fn) + f1(tn, fp + fn)) / 2}.get(metric, balanced)
    enough = F.coalesce(share(tp, P), F.lit(0.0)) >= min_recall if min_recall > 0 else F.lit(True)
    d = d.withColumn("v", F.when(enough, value)).withColumn("shown", balanced if metric == "f1_pos" else value)
    rank = F.when(F.col("v").isNotNull(), F.struct(F.round("v", 12).alias("v"), (-F.col("t")).alias("nt")))
    # nothing reaches the recall: 0.5, which is on the grid
    half = lambda c: F.max(F.when(F.abs(F.col("t") - 0.5) < 1e-9, F.col(c)))
    best = d.groupBy(*keys).agg(F.coalesce(F.max_by("t", rank), F.lit(0.5)).alias("t"), F.coalesce(F.max_by("shown", rank), half("shown")).alias("score"))
    both = F.array(*[F.struct(F.lit(c).alias("cls"), (F.col("t") if c == pos else F.lit(0.5)).alias("threshold")) for c in (0, 1)])
    return best.select(*keys, "score", F.explode(both).alias("b")).select(*keys, "b.cls", "b.threshold", "score")


def tune_thresholds(rows: DataFrame, keys: list[str], k: int, metric: str = "bal_acc",
                    min_recall: float = 0.0, normal_idx: int | None = None) -> DataFrame:
    """(keys, cls, threshold, score): best one-vs-rest threshold on the 37-point grid, the
    smallest on ties, 0.5 where a class has no rows or nothing reaches ``min_recall``.

    Rows shrink to a histogram (keys, class, bin, hit) in one pass; the 37 candidates are
    then running sums over 38 bins. With two classes only the one that isn't normal (the second
    without a normal class) is tuned, on the decisions of both.
    """
    if k == 2:
        return _tune_two(rows, keys, metric, min_recall, normal_idx)
    sides = F.array(*[
        F.struct(F.lit(c).alias("cls"), threshold_bin(po.round9(F.get("p", F.lit(c)))).alias("bin"),
                 (F.col("y_true") == c).cast("int").alias("pos")) for c in range(k)])
    hist = (rows.select(*keys, F.explode(sides).alias("s")).select(*keys, "s.*")
            .groupBy(*keys, "cls", "bin").agg(F.sum("pos").alias("np"), F.sum(1 - F.col("pos")).alias("nn")))
    d = _passed(hist, [*keys, "cls"])
    P, N = F.col("P"), F.col("N")
    tp, fp = F.col("tp"), F.col("fp")
    rec = F.when(P > 0, tp / P).otherwise(F.lit(0.0))
    value = {
        "accuracy": (tp + N - fp) / (P + N),
        "bal_acc": F.when(N > 0, (tp / P + (N - fp) / N) / 2).otherwise(tp / P),
        "f1_macro": metrics.ratio(2 * tp, P + tp + fp),
        "f1_pos": metrics.ratio(2 * tp, P + tp + fp),
    }.get(metric, rec)
    ok = F.col("P") > 0
    if min_recall > 0:
        free = F.lit(False) if normal_idx is None else (F.col("cls") == normal_idx)
        ok = ok & (free | (rec >= min_recall))
    d = d.withColumn("v", F.when(ok, value))
    best = d.groupBy(*keys, "cls").agg(
        F.max_by("t", F.when(F.col("v").isNotNull(), F.struct(F.col("v"), (-F.col("t")).alias("nt")))).alias("threshold"),
        F.max("v").alias("score"))
    return best.withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))


def weight_grid(n: int, step: float = 0.1) -> list[list[float]]:
    """All weights on the simplex with the given step, in lexicographic order."""
    units = round(1.0 / step)
    if n == 1:
        return [[1.0]]
    tails = [[u] for u in range(units + 1)]
    grids: list[list[int]] = tails
    for _ in range(n - 2):
        grids = [g + [u] for g in grids for u in range(units - sum(g) + 1)]
    return [[u / units for u in g + [units - sum(g)]] for g in grids if sum(g) <= units]


def ensemble_weight_search(preds: DataFrame, members: list[str], k: int, step: float = 0.1) -> DataFrame:
    """Best weights on the simplex by balanced accuracy, thresholds re-tuned at every point.

    The default weights come first (wid -1) and win ties, then the grid in order. The members' posteriors
    are joined and written once; each of the two passes turns rows into counts of all points where they lie.
    """
    from assay.operators.blocks import RowSums
    from assay.operators.ensemble import WeightSearch

    units = round(1.0 / step)
    rows = joins.member_posteriors(preds.select("method", "path", "y_true", "p"), members).where(~F.exists("ps", lambda p: p.isNull()))
    rows = write_and_read(rows.select(F.col("y_true").alias("y"), F.flatten("ps").alias("features")), "members")
    search = WeightSearch(members, k, step, decimals=None)
    at, thresholds, value = search.best(RowSums(rows))
    wid = -1
    if at:
        wid = 0
        for x in search.weights[at][:-1]:
            wid = wid * (units + 1) + round(x * units)
    return preds.sparkSession.createDataFrame([(wid, value, thresholds)], "wid int, valid_score double, th array<double>")


def temperature_fit(preds: DataFrame, keys: list[str], lo: float = 0.05, hi: float = 20.0, points: int = 64,
                    rounds: int = 4) -> DataFrame:
    """Temperature per key that minimises the mean negative log likelihood of softmax(log p / T).

    Equal posteriors are counted and written once. Each round scores ``points`` log-spaced temperatures in
    one aggregation pass over them and narrows the bracket to the neighbours of the best; the driver sees
    keys x points means.
    """
    preds = write_and_read(distinct_posteriors(preds, [*keys, "y_true"]), "posteriors")
    k = preds.select(F.max(F.size("p"))).first()[0]
    logp = [F.ln(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), x))) for x in po.slots(F.col("p"), k)]
    d = preds.select(*keys, *[x.alias(f"l{i}") for i, x in enumerate(logp)], "y_true", "n")
    ls = [F.col(f"l{i}") for i in range(k)]
    d = d.withColumn("top", po.largest(ls)).withColumn("ly", F.get(F.array(*ls), F.col("y_true")))
    spark = preds.sparkSession
    found = {tuple(r): (math.log(lo), math.log(hi)) for r in d.select(*keys).distinct().collect()}
    schema = d.select(*keys).schema.simpleString()[7:-1].replace(":", " ")
    best: dict = {}
    for _ in range(rounds):
        cand = [(*key, [math.exp(a + (b - a) * i / (points - 1)) for i in range(points)]) for key, (a, b) in found.items()]
        grid = spark.createDataFrame(cand, f"{schema}, ts array<double>")
        at = d.join(F.broadcast(grid), keys).select(*keys, *ls, "top", "ly", "n", F.posexplode("ts").alias("i", "t"))
        e = [F.exp((x - F.col("top")) / F.col("t")) for x in ls]
        ll = (F.col("ly") - F.col("top")) / F.col("t") - F.log(sum(e[1:], e[0]))
        scored = at.select(*keys, "i", "n", (-F.greatest(F.lit(math.log(1e-12)), ll)).alias("v"))
        means = scored.groupBy(*keys, "i").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("_nll")).groupBy(*keys).agg(
            F.min_by("i", F.struct("_nll", "i")).alias("_best"), F.min("_nll").alias("_nll")).collect()
        for r in means:
            key = tuple(r[x] for x in keys)
            a, b = found[key]
            step = (b - a) / (points - 1)
            mid = a + step * r["_best"]
            best[key] = (math.exp(mid), r["_nll"])
            found[key] = (max(math.log(lo), mid - step), min(math.log(hi), mid + step))
    return spark.createDataFrame([(*k, *v) for k, v in best.items()], f"{schema}, temperature double, nll double")
