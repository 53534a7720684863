"""Near-duplicate vectors under the eight orientations of a square grid.

The all-pairs comparison becomes an exact blocked join:

1. Identical vectors (after removing mean and scale) collapse to one *item* with a count, so a
   group of copies, however large, is one row. Counts of pairs are products of counts.
2. Correlation >= t means distance <= r = sqrt(2(1-t)). A tree of splits (``metric_tree``) sends a
   left item to one cell and a right item to every cell within r of it, so every pair meets in
   one cell.
3. Cells with many items are cut into block pairs; a task compares one block pair by a matrix
   product of the ordered grids, tries the eight orientations on what is left and returns the
   survivors only. Blocks grow with the cell, so that a row travels to few of them, and an unsplit
   self-join sends a row to one half of the pairs.
4. The task decides the survivors exactly and hands them to a collector: all pairs, a spanning
   forest (components), or sums by category (audits), so that a cluster of m near copies
   costs an audit or a component O(m) rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from assay.functions.vectors import SCAN_NAMES, VERIFY_NAMES, scan_orders, verify_orders
from assay.operators.metric_tree import metric_cells, ordered, reach_of
from assay.session import cut_lineage, write_and_read

CELL_ROWS = 4096       # items per cell, and at least so many per block of a cell that no split helps
CELL_BLOCKS = 8        # blocks of such a cell, for as long as they hold no more than
BLOCK_ROWS = 65536     # so many items
PRODUCT = 1 << 22      # distances taken at once
CHECK_PAIRS = 16384    # pairs turned at once
SLACK = 1e-9

# Fixed values of the duplicate rule.
SCREEN_CORR = 0.995
VERIFY_CORR = 0.9995
MAX_RESIDUAL = 3.0
IDENTICAL_CORR = 0.9999
SWEEP = (0.999, 0.99, 0.98, 0.95, 0.90)


def describe(vectors: DataFrame, side: int, keep_scale: bool = False) -> DataFrame:
    """(id, key, unit, norm) per vector; constant vectors have no direction and drop out.

    ``key`` equals for vectors with the same direction, and with ``keep_scale`` the same
    contrast too.
    """
    cols = [c for c in vectors.columns if c != "v"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            x -= x.mean(axis=1, keepdims=True)
            norm = np.sqrt((x * x).sum(axis=1))
            keep = norm / side > 1e-6  # SD above 1e-6
            x, norm, head = x[keep], norm[keep], pdf.loc[keep, cols].reset_index(drop=True)
            if not len(x):
                continue
            unit = x / norm[:, None]
            digits = np.round((x if keep_scale else unit) * 1e6).astype(np.int64) + 0
            key = [hashlib.md5(row.tobytes()).hexdigest() for row in digits]
            yield head.assign(key=key, unit=list(unit), norm=norm)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*cols).schema.fields)
    return vectors.mapInPandas(run, f"{fields}, key string, unit array<double>, norm double")


def collapse(described: DataFrame) -> DataFrame:
    """(item, n, unit, norm): one row per distinct vector, named by its smallest id."""
    return described.groupBy("key").agg(
        F.min("id").alias("item"), F.count(F.lit(1)).alias("n"),
        F.min_by("unit", "id").alias("unit"), F.min_by("norm", "id").alias("norm"))


def _scores(orders: np.ndarray, turn_right: bool, side: int, names: tuple[str, ...]):
    """Batch function of unit vectors and right norms: best correlation over the orientations,
    its name, the residual in units of the right vector's norm, and the correlation of 2x2
    block means."""
    half = side // 2

    def coarse(u: np.ndarray) -> np.ndarray:
        g = u.reshape(len(u), half, 2, half, 2).mean(axis=(2, 4)).reshape(len(u), half * half)
        g = g - g.mean(axis=1, keepdims=True)
        n = np.sqrt((g * g).sum(axis=1, keepdims=True))
        return np.divide(g, n, out=np.zeros_like(g), where=n > 0)

    def run(a: np.ndarray, b: np.ndarray, norm: np.ndarray) -> dict:
        moved, still = (b, a) if turn_right else (a, b)
        scores = np.stack([(moved[:, o] * still).sum(axis=1) for o in orders], axis=1)
        # equal scores up to rounding noise: the first orientation
        which = (scores >= scores.max(axis=1, keepdims=True) - 1e-12).argmax(axis=1)
        rows = np.arange(len(a))
        corr = scores[rows, which]
        turned = moved[rows[:, None], orders[which]]
        x, y = (a, turned) if turn_right else (turned, b)
        resid = np.abs(corr[:, None] * x - y).mean(axis=1) * norm
        # the coarse grid is screened over its own eight orientations
        ca, cb = coarse(a), coarse(b)
        screen = np.max([(ca[:, o] * cb).sum(axis=1) for o in scan_orders(half)], axis=0)
        return {"corr": corr, "transform": np.array(names)[which], "residual": resid, "screen": screen}

    return run


class PairList:
    """Collects every pair of a block pair."""

    def __init__(self, left: pd.DataFrame, right: pd.DataFrame):
        self.a, self.b = left["item"].to_numpy(), right["item"].to_numpy()
        self.found: list[pd.DataFrame] = []

    def wanted(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.ones(len(x), dtype=bool)

    def add(self, x: np.ndarray, y: np.ndarray, scores: dict) -> None:
        self.found.append(pd.DataFrame({"a": self.a[x], "b": self.b[y], **scores}))

    def result(self) -> pd.DataFrame | None:
        return pd.concat(self.found) if self.found else None


class Forest:
    """Collects a spanning forest of a block pair: at most one edge a row, whatever the pairs.
    Pairs already connected aren't verified."""

    def __init__(self, left: pd.DataFrame, right: pd.DataFrame):
        self.a, self.b = left["item"].to_numpy(), right["item"].to_numpy()
        names, at = np.unique(np.concatenate([self.a, self.b]), return_inverse=True)  # an item may be on both sides
        self.x, self.y = at[:len(self.a)], at[len(self.a):]
        self.root = np.arange(len(names))
        self.edges: list[tuple] = []

    def wanted(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return self.root[self.x[x]] != self.root[self.y[y]]

    def add(self, x: np.ndarray, y: np.ndarray, scores: dict) -> None:
        for i, j in zip(x.tolist(), y.tolist()):
            one, two = self.root[self.x[i]], self.root[self.y[j]]
            if one != two:
                self.root[self.root == two] = one
                self.edges.append((self.a[i], self.b[j]))

    def result(self) -> pd.DataFrame | None:
        return pd.DataFrame(self.edges, columns=["a", "b"]) if self.edges else None


class CategoryCounts:
    """Adds up the member pairs of a block pair by the categories of both ends. ``cats`` and
    ``ms`` of an item are its categories and their numbers of members."""

    def __init__(self, left: pd.DataFrame, right: pd.DataFrame):
        def flat(d: pd.DataFrame, name: str) -> pd.DataFrame:
            at = np.repeat(np.arange(len(d)), d["cats"].map(len))
            return pd.DataFrame({name: at, f"cat_{name}": np.concatenate(d["cats"].to_list()), f"m_{name}": np.concatenate(d["ms"].to_list())})

        self.a, self.b = flat(left, "a"), flat(right, "b")
        self.sums: list[pd.DataFrame] = []

    def wanted(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.ones(len(x), dtype=bool)

    def add(self, x: np.ndarray, y: np.ndarray, scores: dict) -> None:
        j = pd.DataFrame({"a": x, "b": y}).merge(self.a, on="a").merge(self.b, on="b")
        j["k"] = j["m_a"] * j["m_b"]
        self.sums.append(j.groupby(["cat_a", "cat_b"], as_index=False)["k"].sum())

    def result(self) -> pd.DataFrame | None:
        return pd.concat(self.sums).groupby(["cat_a", "cat_b"], as_index=False)["k"].sum() if self.sums else None


def joined_blocks(left: DataFrame, right: DataFrame, side: int, t: float, same: bool, strict: bool,
                  keep, collector: type, schema: str) -> DataFrame:
    """What ``collector`` makes of the item pairs with correlation >= ``t`` that ``keep`` (a
    function of their scores, or None) takes. ``same`` marks a self-join: only a < b counts.

    ``left`` and ``right`` are (item, unit, norm, ...); the further columns reach the collector.
    """
    home, guest = metric_cells(left, right, side, t, CELL_ROWS)
    # a cell is cut into blocks on both sides; each left block meets each right block once. In a cell that is the whole of a self-join
    # the sides are the same, and the blocks i <= j meet. The inner join with the other side's counts drops cells only one side uses.
    def blocks(d: DataFrame, name: str) -> DataFrame:
        least = lambda rows: F.ceil(F.count(F.lit(1)) / rows).cast("int")
        return d.groupBy("cell").agg(F.greatest(least(BLOCK_ROWS), F.least(F.lit(CELL_BLOCKS), least(CELL_ROWS))).alias(name))

    half = F.lit(same) & (F.col("cell") == "")
    both = blocks(home, "na").join(blocks(guest, "nb"), "cell")
    own = lambda n: F.pmod(F.xxhash64("item"), F.col(n)).cast("int")
    p = home.join(both, "cell").withColumn("i", own("na")).withColumn(
        "j", F.explode(F.sequence(F.when(half, F.col("i")).otherwise(0), F.col("nb") - 1))).drop("na", "nb")
    q = guest.join(both, "cell").withColumn("j", own("nb")).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.when(half, F.col("j")).otherwise(F.col("na") - 1)))).drop("na", "nb")
    floor = 1 - reach_of(t) ** 2 / 2 - SLACK
    scores = _scores(verify_orders(side), False, side, VERIFY_NAMES) if strict else _scores(
        scan_orders(side), True, side, SCAN_NAMES)
    empty = pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")}, dtype=object)

    def meet(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return empty
        ends = [(d["item"].to_numpy(), np.stack(d["unit"].to_numpy()), d["norm"].to_numpy()) for d in (left, right)]
        (a, ua, _), (b, ub, _) = ends
        fa, fb = ordered(ua, side), ordered(ub, side)
        # (first end, second end, collector); two blocks of a half hold each pair once, whichever item is the smaller
        ways = [(0, 1, collector(left, right))]
        if same and key[0] == "" and key[1] < key[2]:
            ways.append((1, 0, collector(right, left)))
        step = max(1, PRODUCT // len(b))
        for s in range(0, len(a), step):
            # ordering keeps the length 1, so the distance is a matrix product
            u, w = np.nonzero(fa[s:s + step] @ fb.T >= floor)
            u += s
            for one, two, out in ways:
                rows = (u, w)
                if same:
                    rising = ends[one][0][rows[one]] < ends[two][0][rows[two]]
                    rows = (u[rising], w[rising])
                for k in range(0, len(rows[0]), CHECK_PAIRS):
                    x, y = rows[one][k:k + CHECK_PAIRS], rows[two][k:k + CHECK_PAIRS]
                    ask = out.wanted(x, y)
                    x, y = x[ask], y[ask]
                    if not len(x):
                        continue
                    got = scores(ends[one][1][x], ends[two][1][y], ends[two][2][y])
                    ok = got["corr"] >= t - 1e-12
                    if keep is not None:
                        ok &= keep(got)
                    if ok.any():
                        out.add(x[ok], y[ok], {c: v[ok] for c, v in got.items()})
        made = [m for m in (out.result() for _, _, out in ways) if m is not None]
        return pd.concat(made) if made else empty

    keys = ["cell", "i", "j"]
    return p.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(meet, schema)


def scored_pairs(left: DataFrame, right: DataFrame, side: int, t: float, same: bool, strict: bool, keep=None) -> DataFrame:
    """(a, b, corr, transform, residual, screen) of the item pairs with correlation >= t."""
    x, y = (d.select("item", "unit", "norm") for d in (left, right))
    idt = dict(left.dtypes)["item"]
    return joined_blocks(x, y, side, t, same, strict, keep, PairList,
                         f"a {idt}, b {idt}, corr double, transform string, residual double, screen double")


def _strict_rule(screen: bool):
    """The residual limit, and with ``screen`` the coarse one, where the pairs meet."""
    def keep(scores: dict) -> np.ndarray:
        ok = scores["residual"] <= MAX_RESIDUAL
        return ok & (scores["screen"] >= SCREEN_CORR) if screen else ok

    return keep


def near_duplicate_pairs(vectors: DataFrame, side: int, t: float = 0.98) -> dict[str, DataFrame]:
    """``items`` (item, n, ...), ``members`` (id, item, ...), ``pairs`` (a, b, corr, transform, pairs).

    A pair row stands for all pairs of members of the two items; a = b lists an item whose
    copies are duplicates of each other.
    """
    return _pairs(vectors, side, t, False)


def _items(vectors: DataFrame, side: int, strict: bool) -> dict[str, DataFrame]:
    d = write_and_read(describe(vectors, side, keep_scale=strict), "described")
    items = write_and_read(collapse(d), "items")
    return {"items": items, "members": d.join(items.select("key", "item"), "key").drop("unit", "norm", "key")}


def _pairs(vectors: DataFrame, side: int, t: float, strict: bool, keep=None) -> dict[str, DataFrame]:
    out = _items(vectors, side, strict)
    items = out["items"]
    across = scored_pairs(items, items, side, t, True, strict, keep)
    within = items.where("n > 1").select(
        F.col("item").alias("a"), F.col("item").alias("b"), F.lit(1.0).alias("corr"),
        F.lit((VERIFY_NAMES if strict else SCAN_NAMES)[0]).alias("transform"), F.lit(0.0).alias("residual"), F.lit(1.0).alias("screen"))
    n = items.select("item", "n")
    sizes = (across.unionByName(within)
             .join(n.select(F.col("item").alias("a"), F.col("n").alias("na")), "a")
             .join(n.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b"))
    count = F.when(F.col("a") == F.col("b"), (F.col("na") * (F.col("na") - 1) / 2).cast("bigint")).otherwise(F.col("na") * F.col("nb"))
    return {**out, "pairs": sizes.withColumn("pairs", count).drop("na", "nb")}


def strict_pairs(vectors: DataFrame, side: int, screen: bool = False) -> dict[str, DataFrame]:
    """The duplicate relation: correlation >= 0.9995 and brightness-matched residual <= 3.

    ``screen`` also demands 0.995 on the 2x2 block means, the two-stage form of the rule; it can
    miss pairs whose coarse grid carries little of the picture. The verdict on two items is
    that of their first members.
    """
    return _pairs(vectors, side, VERIFY_CORR, True, _strict_rule(screen))


def strict_items(vectors: DataFrame, side: int) -> dict:
    """The same relation with its pairs left unlisted, for ``leakage_audit`` and
    ``duplicate_components``: (items, members, side)."""
    return {**_items(vectors, side, True), "side": side}


def _unlisted(relation: dict, items: DataFrame, collector: type, schema: str) -> DataFrame:
    return joined_blocks(items, items, relation["side"], VERIFY_CORR, True, True, _strict_rule(False), collector, schema)


def leaked_rows_best_partner(train: DataFrame, test: DataFrame, side: int) -> DataFrame:
    """Every train row that is the same picture as a test row, with its best partner:
    (path_id, partner, corr, transform, residual).

    All candidates are examined. The best is the highest coarse-grid score, then the smallest
    id of a test row.
    """
    dt, de = describe(train, side, keep_scale=True), describe(test, side, keep_scale=True)
    dt, de = write_and_read(dt, "train-described"), write_and_read(de, "test-described")
    a, b = write_and_read(collapse(dt), "train-items"), write_and_read(collapse(de), "test-items")
    ok = scored_pairs(a, b, side, VERIFY_CORR, False, True, _strict_rule(False))
    best = ok.groupBy("a").agg(F.max_by(
        F.struct(F.col("b").alias("partner"), "corr", "transform", "residual"),
        F.struct(F.round("screen", 9).alias("s"), (-F.col("b")).alias("m"))).alias("x")).select(F.col("a").alias("item"), "x.*")
    return dt.select("id", "key").join(a.select("key", "item"), "key").join(best, "item").drop("key", "item")


def member_counts(members: DataFrame, cols: list[str]) -> DataFrame:
    return members.groupBy("item", *cols).agg(F.count(F.lit(1)).alias("m"))


def pair_category_counts(pairs: DataFrame, members: DataFrame, cols: list[str], keep: list[str]) -> DataFrame:
    """Member pairs behind each item pair, by the categories of both ends:
    (keep, <col>_a, <col>_b, k) where k counts pairs.

    Categories are few, so an item is a handful of rows whatever its number of copies.
    """
    mc = member_counts(members, cols)
    def side(s: str) -> DataFrame:
        return mc.select(F.col("item").alias(s), F.col("m").alias(f"m{s}"), *[F.col(c).alias(f"{c}_{s}") for c in cols])
    j = pairs.select("a", "b", *keep).join(side("a"), "a").join(side("b"), "b")
    ca, cb = F.struct(*[F.col(f"{c}_a") for c in cols]), F.struct(*[F.col(f"{c}_b") for c in cols])
    inside = F.col("a") == F.col("b")
    k = F.when(~inside, F.col("ma") * F.col("mb")).when(ca < cb, F.col("ma") * F.col("mb")).when(
        ca == cb, (F.col("ma") * (F.col("ma") - 1) / 2).cast("bigint")).otherwise(0)
    return j.withColumn("k", k).where("k > 0").groupBy(
        *keep, *[f"{c}_{s}" for c in cols for s in ("a", "b")]).agg(F.sum("k").alias("k"))


def near_duplicate_report(vectors: DataFrame, side: int, t: float = 0.98) -> DataFrame:
    """One row of totals. ``vectors`` is (id, v, folder, label, role)."""
    r = near_duplicate_pairs(vectors, side, t)
    p = r["pairs"].withColumn("ident", F.col("corr") >= IDENTICAL_CORR).withColumn("turned", F.col("transform") != SCAN_NAMES[0])
    c = pair_category_counts(p, r["members"], ["folder", "label", "role"], ["ident", "turned"])
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("k"))), F.lit(0)).alias
    return c.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n_pairs"), s(F.col("ident"))("n_identical"), s(F.col("turned"))("n_reoriented"),
        s(F.col("folder_a") != F.col("folder_b"))("n_cross_folder"), s(F.col("folder_a") == F.col("folder_b"))("n_within_folder"),
        s(F.col("label_a") != F.col("label_b"))("n_cross_class"), s(F.col("role_a") != F.col("role_b"))("n_cross_role"))


def threshold_sweep(vectors: DataFrame, side: int, thresholds: tuple[float, ...] = SWEEP) -> DataFrame:
    """The same counts at several thresholds from one scan at the loosest."""
    r = near_duplicate_pairs(vectors, side, min(thresholds))
    lits = F.array(*[F.lit(t) for t in sorted(thresholds, reverse=True)])
    p = (r["pairs"].withColumn("threshold", F.explode(lits)).where(F.col("corr") >= F.col("threshold") - F.lit(1e-12))
         .withColumn("turned", F.col("transform") != SCAN_NAMES[0]))
    c = pair_category_counts(p, r["members"], ["folder", "label", "role"], ["threshold", "turned"])
    s = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("k"))), F.lit(0)).alias
    return c.groupBy("threshold").agg(
        F.sum("k").alias("n_pairs"), s(F.col("folder_a") != F.col("folder_b"))("n_cross_folder"),
        s(F.col("role_a") != F.col("role_b"))("n_cross_role"), s(F.col("label_a") != F.col("label_b"))("n_cross_class"),
        s(F.col("turned"))("n_reoriented"))


def leakage_audit(relation: dict[str, DataFrame], claimed: DataFrame) -> DataFrame:
    """(role_pair, same_class, cross_class) pair counts under the strict relation.

    ``claimed`` is (id, role, label): members no manifest claims count for nothing.
    """
    m = relation["members"].select("id", "item").join(claimed.select("id", "role", "label"), "id")
    if "pairs" in relation:
        c = pair_category_counts(relation["pairs"], m, ["role", "label"], [])
    else:
        own = F.struct("role", "label")
        cats = m.groupBy("item", "role", "label").agg(F.count(F.lit(1)).alias("m")).groupBy("item").agg(
            F.sort_array(F.collect_list(F.struct(F.to_json(own).alias("cat"), "m"))).alias("c"))
        items = relation["items"].join(cats, "item").select(
            "item", "unit", "norm", F.col("c.cat").alias("cats"), F.col("c.m").alias("ms"))
        across = _unlisted(relation, items, CategoryCounts, "cat_a string, cat_b string, k bigint")
        kind = m.select(own.alias("s")).schema["s"].dataType.simpleString()
        part = lambda x: F.from_json(f"cat_{x}", kind)
        across = across.select(*[part(x)[f].alias(f"{f}_{x}") for f in ("role", "label") for x in ("a", "b")], "k")
        same_item = relation["items"].where("n > 1").select(F.col("item").alias("a"), F.col("item").alias("b"))
        c = across.unionByName(pair_category_counts(same_item, m, ["role", "label"], []))
    pair = F.concat_ws("_", F.array_sort(F.array("role_a", "role_b")))
    same = F.col("label_a") == F.col("label_b")
    return c.withColumn("role_pair", pair).groupBy("role_pair").agg(
        F.coalesce(F.sum(F.when(same, F.col("k"))), F.lit(0)).alias("same_class"),
        F.coalesce(F.sum(F.when(~same, F.col("k"))), F.lit(0)).alias("cross_class"))


def leakage_gate(audit: DataFrame, limit: int = 0, exempt_reason: str = "") -> DataFrame:
    """One row: test-facing pairs, the cross-class ones, and pass, fail or exempt."""
    facing = F.col("role_pair").isin("test_train", "test_valid")
    tot = audit.agg(
        F.coalesce(F.sum(F.when(facing, F.col("same_class"))), F.lit(0)).alias("n_test_facing"),
        F.coalesce(F.sum(F.when(facing, F.col("cross_class"))), F.lit(0)).alias("n_test_facing_cross_class"),
        F.coalesce(F.sum(F.when(F.col("role_pair") == "train_valid", F.col("same_class"))), F.lit(0)).alias("n_train_valid"))
    gate = F.lit("exempt") if exempt_reason else F.when(F.col("n_test_facing") > limit, "fail").otherwise("pass")
    return tot.withColumn("gate", gate).withColumn("exempt_reason", F.lit(exempt_reason))


def rows_touched(relation: dict[str, DataFrame], claimed: DataFrame) -> DataFrame:
    """(role_pair, n): distinct rows a fix would have to move, never the test side.

    A row counts once per role pair when any member of a partner item sits in the other role.
    """
    m = relation["members"].select("id", "item").join(claimed.select("id", "role"), "id")
    roles = m.select("item", "role").distinct()
    p = relation["pairs"].select("a", "b")
    both = p.unionByName(p.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both.join(roles.select(F.col("item").alias("b"), F.col("role").alias("other")), "b").select(
        F.col("a").alias("item"), "other").distinct()
    rank = lambda c: F.when(c == "train", 0).when(c == "valid", 1).otherwise(2)
    hit = m.join(seen, "item").where((F.col("role") != F.col("other")) & (rank(F.col("role")) < rank(F.col("other"))))
    return hit.select("id", F.concat_ws("_", F.array_sort(F.array("role", "other"))).alias("role_pair")).distinct().groupBy(
        "role_pair").agg(F.count(F.lit(1)).alias("n"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node. ``edges`` is (a, b).

    Alternates two star steps, each an aggregate and a join; a round halves path lengths. Every
    round is checkpointed into the shared folder and compared with the one before by a checksum.
    """
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:  # the least neighbours only fall, so the rounds end
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        mins = large.groupBy("u").agg(F.min("v").alias("m"))
        j = large.join(mins, "u")
        small = j.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(mins.select("u", F.col("m").alias("v")))
        e = cut_lineage(small.where("u <> v").distinct())
        mark = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == last:
            break
        last = mark
    leaders = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(leaders)


def duplicate_components(relation: dict[str, DataFrame], pool: DataFrame) -> DataFrame:
    """(id, component) of the duplicate relation induced on ``pool`` (id): edges that leave the
    pool are ignored; the key is the smallest member in the pool."""
    m = relation["members"].select("id", "item").join(pool.select("id"), "id")
    inside = m.groupBy("item").agg(F.min("id").alias("low"))
    if "pairs" in relation:
        p = relation["pairs"].where("a <> b").select("a", "b")
    else:
        idt = dict(relation["items"].dtypes)["item"]
        items = relation["items"].join(inside.select("item"), "item").select("item", "unit", "norm")
        p = _unlisted(relation, items, Forest, f"a {idt}, b {idt}")
    e = (p.join(inside.select(F.col("item").alias("a"), F.col("low").alias("la")), "a")
         .join(inside.select(F.col("item").alias("b"), F.col("low").alias("lb")), "b")
         .select(F.col("la").alias("a"), F.col("lb").alias("b")))
    comp = connected_components(e).withColumnRenamed("node", "low")
    keyed = m.join(inside, "item").join(comp, "low", "left")
    rest = pool.select("id").join(m.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return keyed.select("id", F.coalesce("component", "low").alias("component")).unionByName(rest)


def content_group_key(rows: DataFrame, mode: str, side: int = 8, relation: dict[str, DataFrame] | None = None) -> DataFrame:
    """Rows (id, v, ...) with their content group ``grp``: none, md5 (same values), canonical
    (same grid up to orientation) or strict (components of the duplicate relation)."""
    from assay.functions.vectors import canonical_grid_key

    if (relation is not None) != (mode == "strict"):
        raise ValueError("a relation is needed for mode strict and for no other")
    if mode == "none":
        return rows.withColumn("grp", F.col("id").cast("string"))
    if mode == "md5":
        return rows.withColumn("grp", F.md5(F.array_join(F.col("v").cast("array<string>"), ",").cast("binary")))
    if mode == "canonical":
        return rows.withColumn("grp", canonical_grid_key(F.col("v"), side))
    if mode == "strict":
        comp = duplicate_components(relation, rows)
        return rows.join(comp.select("id", F.col("component").cast("string").alias("grp")), "id")
    raise ValueError(f"unknown content group mode {mode!r}")


def cross_corpus_match(a: DataFrame, b: DataFrame, side: int) -> DataFrame:
    """Every row of corpus A with the row of corpus B it is the same picture as (null if none).

    ``a`` and ``b`` are (id, v, folder, label, role).
    """
    best = leaked_rows_best_partner(a.select("id", "v"), b.select("id", "v"), side)
    info = b.select(F.col("id").alias("partner"), F.col("label").alias("partner_label"), F.col("role").alias("partner_role"))
    return a.drop("v").join(best, "id", "left").join(info, "partner", "left")


def cross_corpus_exposure(matches: DataFrame) -> DataFrame:
    """Per folder and in total: rows, matched, matched into train and test of the other corpus,
    label contradictions, distinct targets, and own test rows in the other's development pool."""
    hit = F.col("partner").isNotNull()
    c = lambda cond: F.coalesce(F.sum(cond.cast("int")), F.lit(0)).cast("bigint")
    return matches.rollup("folder").agg(
        F.count(F.lit(1)).alias("n"), c(hit).alias("matched"),
        c(hit & (F.col("partner_role") == "train")).alias("into_train"), c(hit & (F.col("partner_role") == "test")).alias("into_test"),
        c(hit & (F.col("partner_label") != F.col("label"))).alias("contradictions"),
        F.count_distinct("partner").alias("distinct_targets"),
        c(hit & (F.col("role") == "test") & F.col("partner_role").isin("train", "valid")).alias("test_in_other_dev"),
    ).withColumn("folder", F.coalesce("folder", F.lit("ALL"))).withColumn(
        "collisions", F.col("matched") - F.col("distinct_targets")).withColumn(
        "coverage", F.round(F.col("matched") / F.col("n"), 6))


def independence_verdict(cohorts: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: does a table quoting these cohorts span both corpora, hence not independent.

    ``rules`` is a hand-kept table (family, side).
    """
    from assay.functions.text import cohort_family

    sides = cohorts.withColumn("family", cohort_family(F.col("cohort"))).join(F.broadcast(rules), "family")
    return sides.agg(F.coalesce(F.count_distinct("side"), F.lit(0)).alias("sides")).select(
        (F.col("sides") > 1).alias("spans_both"), (F.col("sides") <= 1).alias("independent"))
