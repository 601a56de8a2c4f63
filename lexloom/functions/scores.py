"""Score arithmetic on arrays that are parallel to a document's sentences; no shuffle, no windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY = "CAST(array() AS array<double>)"


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(value), lambda v: then(v)), F.lit(0))


def _ranged(values: Column, then) -> Column:
    """``then(x, low, high)`` for each value, with the extremes computed once."""

    def inner(v):
        return let(F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high")), lambda r: F.transform(v, lambda x: then(x, r["low"], r["high"])))

    return let(values, inner)


def over_max(values: Column) -> Column:
    """Divide by the largest value; 0 counts as 1 and a negative maximum stays."""
    return _ranged(values, lambda x, low, high: x / F.when(high == 0, F.lit(1.0)).otherwise(high))


def minmax(values: Column, constant: float = 0.5, eps: float = 1e-9) -> Column:
    """Rescale to [0, 1]; ``constant`` where the range is below ``eps``."""
    return _ranged(values, lambda x, low, high: F.when(high - low < eps, F.lit(constant)).otherwise((x - low) / (high - low)))


def minmax_zero(values: Column) -> Column:
    """Rescale to [0, 1]; 0 where the range is within 1e-12."""
    return _ranged(values, lambda x, low, high: F.when(high - low <= 1e-12, F.lit(0.0)).otherwise((x - low) / (high - low)))


def minmax_unit(values: Column) -> Column:
    """Rescale with the range, or with 1 where there is none."""
    return _ranged(values, lambda x, low, high: (x - low) / F.when(high <= low, F.lit(1.0)).otherwise(high - low))


def zscore(values: Column) -> Column:
    """Centre and divide by the sample deviation; a deviation of 0 counts as 1."""

    def spread(v, mean):
        square = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        return F.when(F.size(v) > 1, F.sqrt(square / F.greatest(F.size(v) - 1, F.lit(1)))).otherwise(F.lit(0.0))

    def inner(v):
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(v), F.lit(1))
        return let(mean, lambda m: let(spread(v, m), lambda d: F.transform(v, lambda x: (x - m) / F.when(d == 0, F.lit(1.0)).otherwise(d))))

    return let(values, inner)


def weighted(features: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of the features with a non-zero weight; a feature without weight is not computed at all."""
    used = [(f, float(weights[name])) for name, f in features.items() if weights.get(name)]
    if not used:
        return F.transform(next(iter(features.values())), lambda x: F.lit(0.0))
    total = scaled(*used[0])
    for f, w in used[1:]:
        total = F.zip_with(total, scaled(f, w), lambda a, x: a + x)
    return total


def scaled(values: Column, by: float) -> Column:
    return F.transform(values, lambda x: x * by)


def combine_v1(features: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum over its maximum."""
    return over_max(weighted(features, weights))


def combine_v2(features: dict[str, Column], weights: dict[str, float], interactions=(), normalize: str = "minmax") -> Column:
    """Weighted sum of rescaled features and weighted products of two, rescaled again."""
    ready = {n: (minmax(f) if normalize == "minmax" else f) if weights.get(n) else F.transform(f, lambda x: F.lit(0.0)) for n, f in features.items()}
    total = weighted(ready, weights)
    for a, b, w in interactions:
        if a in ready and b in ready:
            product = scaled(F.zip_with(ready[a], ready[b], lambda x, y: x * y), float(w))
            total = F.zip_with(total, product, lambda x, y: x + y)
    return minmax(total)


def length_scores(n_tokens: Column, cap: int = 40) -> Column:
    return over_max(F.transform(n_tokens, lambda n: F.least(n, F.lit(cap)).cast("double")))


def position_scores(n: Column, method: str = "linear", decay: float = 0.1) -> Column:
    """Scores of ``n`` places: linear from 1 to 0, inverse, or exponential; one place scores 1."""
    places = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.expr("CAST(array() AS array<int>)"))
    if method == "inverse":
        return F.transform(places, lambda i: 1.0 / (1.0 + i))
    if method == "exponential":
        return F.transform(places, lambda i: F.exp(-decay * i))
    return F.transform(places, lambda i: F.when(n == 1, F.lit(1.0)).otherwise(1.0 - i / (n - 1)))


def ranked(values: Column) -> Column:
    """Places by falling value, ties by place."""
    marked = F.transform(values, lambda x, i: F.struct((-x).alias("s"), i.alias("i")))
    return F.transform(F.array_sort(marked), lambda x: x["i"])


def top_k(values: Column, k: int) -> Column:
    """The ``k`` best places in document order."""
    return F.array_sort(F.slice(ranked(values), 1, k))


def boosted(values: Column, pool: Column, factor: float = 1.05) -> Column:
    return let(pool, lambda p: F.transform(values, lambda x, i: F.when(F.array_contains(p, i), x * factor).otherwise(x)))


def fill_budget(order: Column, cost: Column, budget: int) -> Column:
    """Take places in ``order`` while they fit, skipping those that don't; in document order."""
    start = F.struct(F.lit(0).alias("used"), F.expr("CAST(array() AS array<int>)").alias("picked"))

    def step(a, i):
        c = F.get(cost, i)
        fits = a["used"] + c <= budget
        return F.struct(F.when(fits, a["used"] + c).otherwise(a["used"]).alias("used"), F.when(fits, F.array_append(a["picked"], i)).otherwise(a["picked"]).alias("picked"))

    return F.array_sort(F.aggregate(order, start, step, lambda a: a["picked"]))


def trim_budget(cost: Column, budget: int) -> Column:
    """Leading places up to, not including, the first that would pass the budget."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(a, c):
        goes = a["open"] & (a["used"] + c <= budget)
        return F.struct(F.when(goes, a["used"] + c).otherwise(a["used"]).alias("used"), F.when(goes, a["n"] + 1).otherwise(a["n"]).alias("n"), goes.alias("open"))

    n = F.aggregate(cost, start, step, lambda a: a["n"])
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.expr("CAST(array() AS array<int>)"))
