"""Columns over posterior vectors (``ARRAY<DOUBLE>``, one slot per class)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

TIE = 1e-12


def asum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def slots(p: Column, k: int) -> list[Column]:
    """The k values of a posterior as scalar columns.

    Sums and comparisons over scalars stay inside generated code.
    """
    return [F.get(p, F.lit(i)) for i in range(k)]


def largest(v: list[Column]) -> Column:
    return F.greatest(*v) if len(v) > 1 else v[0]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with its argument evaluated once per row; written inline, an expression inside
    a lambda or a chain of conditions would be evaluated again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def argmax_of(v: list[Column]) -> Column:
    """Index of the largest value; the lowest class wins a tie up to rounding noise.

    Up to four classes it is a chain of comparisons in generated code; the chain repeats the
    maximum per class, so more classes go through an array.
    """
    if len(v) <= 4:
        bound = largest(v) - F.lit(TIE)
        out = F.lit(len(v) - 1)
        for i in reversed(range(len(v) - 1)):
            out = F.when(v[i] >= bound, F.lit(i)).otherwise(out)
        return out.cast("int")

    def first(s: Column) -> Column:
        near = F.transform(s["v"], lambda x: x >= s["top"])
        return (F.array_position(near, F.lit(True)) - 1).cast("int")
    bound = let(F.array(*v), lambda a: F.struct(a.alias("v"), (F.array_max(a) - F.lit(TIE)).alias("top")))
    return let(bound, first)


def argmin_of(v: list[Column]) -> Column:
    return argmax_of([-x for x in v])


def argmax_lowest(p: Column, k: int) -> Column:
    return argmax_of(slots(p, k))


def has_tie(p: Column, k: int) -> Column:
    v = slots(p, k)
    bound = largest(v) - F.lit(TIE)
    return sum(((x >= bound).cast("int") for x in v[1:]), (v[0] >= bound).cast("int")) > 1


def round9(x: Column) -> Column:
    """Half-up to 9 decimals in plain arithmetic; the built-in goes through decimals."""
    return F.floor(x * F.lit(1e9) + F.lit(0.5)) / F.lit(1e9)


def p_at(p: Column, y: Column) -> Column:
    return F.get(p, y.cast("int"))


def weighted_average(parts: list[Column], weights: list[float]) -> Column:
    """Sum of w*p over the members, the weights scaled to sum 1."""
    total = sum(weights)
    out = F.transform(parts[0], lambda x: x * F.lit(weights[0] / total))
    for part, w in zip(parts[1:], weights[1:]):
        out = F.zip_with(out, part, lambda a, b, w=w: a + b * F.lit(w / total))
    return out


# Default ensemble weights by member name, 1.0 for other names.
DEFAULT_MEMBER_WEIGHTS = {"xgboost": 0.40, "svm": 0.30, "lightgbm": 0.15, "catboost": 0.15}


def default_weights(names: list[str]) -> list[float]:
    raw = []
    for n in names:
        hits = [w for k, w in DEFAULT_MEMBER_WEIGHTS.items() if k in n.lower()]
        raw.append(hits[-1] if hits else 1.0)
    return [w / sum(raw) for w in raw]


def clip_threshold(t: Column) -> Column:
    return F.greatest(F.lit(1e-6), F.least(F.lit(0.999999), t))


def threshold_rule(p: Column, thresholds: Column | list[float], k: int, normal_idx: int | None = None) -> Column:
    """Largest p/t among the classes with p >= t, the plain argmax where none qualifies.

    With two classes only the positive one is compared with its threshold.
    """
    v = slots(p, k)
    raw = [F.lit(float(x)) for x in thresholds] if isinstance(thresholds, list) else slots(thresholds, k)
    t = [clip_threshold(x) for x in raw]
    if k == 2:
        pos = 1 - normal_idx if normal_idx in (0, 1) else 1
        return F.when(v[pos] >= t[pos], F.lit(pos)).otherwise(F.lit(1 - pos))
    score = [F.when(a >= b, a / b).otherwise(F.lit(-1.0)) for a, b in zip(v, t)]
    none = sum(((a >= b).cast("int") for a, b in zip(v[1:], t[1:])), (v[0] >= t[0]).cast("int")) == 0
    return F.when(none, argmax_of(v)).otherwise(argmax_of(score))


def bayes_rule(p: Column, cost: list[list[float]]) -> Column:
    """Class with the smallest expected cost sum_i p_i C[i][j]."""
    v = slots(p, len(cost))
    risks = []
    for j in range(len(cost)):
        terms = [x * F.lit(float(row[j])) for x, row in zip(v, cost)]
        risks.append(sum(terms[1:], terms[0]))
    return argmin_of(risks)


def temperature_apply(p: Column, t: Column | float, k: int) -> Column:
    """softmax(log(p) / T)."""
    t = F.lit(float(t)) if isinstance(t, (int, float)) else t
    z = F.array(*[F.ln(F.greatest(F.lit(1e-12), F.least(F.lit(1.0), x))) / t for x in slots(p, k)])
    top = let(z, lambda a: F.struct(a.alias("z"), F.array_max(a).alias("m")))
    e = let(top, lambda s: F.transform(s["z"], lambda x: F.exp(x - s["m"])))
    total = let(e, lambda a: F.struct(a.alias("e"), asum(a).alias("s")))
    return let(total, lambda q: F.transform(q["e"], lambda x: x / q["s"]))


def cost_matrix(k: int, normal_idx: int | None, miss: float = 10.0, wrong_type: float = 4.0,
                false_alarm: float = 1.0) -> list[list[float]]:
    """Cost of predicting column j when row i is true; missing a finding costs most."""
    def cell(i: int, j: int) -> float:
        if i == j:
            return 0.0
        if normal_idx is None or (i != normal_idx and j != normal_idx):
            return wrong_type
        return miss if j == normal_idx else false_alarm
    return [[cell(i, j) for j in range(k)] for i in range(k)]


def valid_posterior(p: Column, y_pred: Column, k: int) -> dict[str, Column]:
    """Boolean violation columns of the posterior contract."""
    ok_size = F.size(p) == k
    finite = F.forall(p, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return {
        "wrong_length": ~ok_size,
        "not_finite": ~finite,
        "negative": F.exists(p, lambda x: x < 0),
        "sum_not_one": F.abs(asum(p) - 1.0) > F.lit(1e-5 + 1e-5),
        "label_not_argmax": F.coalesce(
            F.abs(p_at(p, y_pred) - F.array_max(p)) > F.lit(1e-6) + F.lit(1e-5) * F.array_max(p), F.lit(True)),
    }


def nanos(col: Column) -> Column:
    """Value as whole billionths: a float that prints and hashes the same everywhere."""
    return F.round(col * 1e9).cast("bigint")
