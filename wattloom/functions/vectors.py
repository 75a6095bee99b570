"""Array expressions: statistics, element-wise arithmetic and distributions. All are built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    """Sum of the elements, from the first on."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """Arithmetic mean; null for an empty array."""
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def first_argmax(a: Column) -> Column:
    """1-based position of the first maximum."""
    return F.array_position(a, F.array_max(a))


def differences(a: Column) -> Column:
    """Each element less the one before it."""
    return F.zip_with(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, y: x - y)


def load_factor(a: Column) -> Column:
    """Mean over maximum; null where the maximum isn't positive."""
    return F.when(F.array_max(a) > 0, mean(a) / F.array_max(a))


def trend(a: Column) -> Column:
    """Mean of the first differences, that is (last - first) / (n - 1)."""
    return F.when(F.size(a) > 1, (F.element_at(a, -1) - F.element_at(a, 1)) / (F.size(a) - 1))


def scale(a: Column, k: Column) -> Column:
    """Every element times ``k``."""
    return F.transform(a, lambda x: x * k)


def subtract(a: Column, *others: Column) -> Column:
    """``a`` less the other vectors, element by element."""
    for b in others:
        a = F.zip_with(a, b, lambda x, y: x - y)
    return a


def max_abs(a: Column) -> Column:
    """Largest absolute element."""
    return F.array_max(F.transform(a, lambda x: F.abs(x)))


def softmax(a: Column) -> Column:
    """exp(x - max) normalised."""
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / total(e))


def entropy(p: Column) -> Column:
    """Shannon entropy in nats; zero probabilities count nothing."""
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def effective_support(p: Column) -> Column:
    """exp of the entropy."""
    return F.exp(entropy(p))


def top_p(p: Column, mass: float) -> Column:
    """Probabilities of the smallest set of the likeliest elements that reaches ``mass``, renormalised; the rest is 0. Ties keep the earlier element."""
    ranked = F.array_sort(F.transform(p, lambda x, i: F.struct((-x).alias("n"), i.alias("i"))))
    kept = F.aggregate(
        ranked,
        F.struct(F.lit(0.0).alias("m"), F.array().cast("array<int>").alias("k")),
        lambda s, r: F.when(s["m"] < mass, F.struct((s["m"] - r["n"]).alias("m"), F.concat(s["k"], F.array(r["i"])).alias("k"))).otherwise(s),
    )
    return F.transform(p, lambda x, i: F.when(F.array_contains(kept["k"], i), x / kept["m"]).otherwise(0.0))


def total_variation(p: Column, q: Column) -> Column:
    """Half the sum of absolute differences."""
    return total(F.zip_with(p, q, lambda x, y: F.abs(x - y))) / 2


def brier(p: Column, hit: Column) -> Column:
    """Sum of squared differences to the one-hot vector of the 0-based class ``hit``."""
    return total(F.transform(p, lambda x, i: F.pow(x - F.when(i == hit, 1.0).otherwise(0.0), F.lit(2.0))))


def log_loss(p: Column, hit: Column, least: float = 1e-12) -> Column:
    """Negative log of the probability of the 0-based class ``hit``, at least ``least``; null where there is no such class."""
    x = F.try_element_at(p, hit.cast("int") + 1)
    return F.when(x.isNotNull(), -F.ln(F.greatest(x, F.lit(least))))


def percent_change(a: Column) -> Column:
    """Change from the first to the last element in percent of the first; null where that is 0."""
    first = F.try_element_at(a, F.lit(1))
    return F.when(first != 0, (F.try_element_at(a, F.lit(-1)) - first) / first * 100)


def chance_all_vary(p: Column, draws: int) -> Column:
    """Probability that ``draws`` independent draws aren't all alike."""
    return 1 - total(F.transform(p, lambda x: F.pow(x, F.lit(float(draws)))))


def at_hour_ending(a: Column, he: Column) -> Column:
    """The element of an hour ending in 1..n; null outside."""
    return F.when((he >= 1) & (he <= F.size(a)), F.element_at(a, F.when((he >= 1) & (he <= F.size(a)), he).otherwise(1)))


def first_difference(a: Column, b: Column, tolerance: float = 1e-7) -> Column:
    """1-based position of the first elements that differ (a missing one does); 0 where the vectors are alike, null where one is null."""
    apart = F.zip_with(a, b, lambda x, y: x.isNull() | y.isNull() | (F.abs(x - y) > tolerance * (1 + F.abs(y))))
    return F.array_position(apart, F.lit(True))


def draw(p: Column, u: Column) -> Column:
    """0-based class drawn from probabilities ``p`` by a uniform number in [0, 1): the first whose cumulated probability exceeds it, else the last."""
    state = F.struct(F.lit(0.0).alias("c"), F.lit(-1).alias("at"), F.lit(0).alias("k"))

    def step(s, x):
        c = s["c"] + x
        return F.struct(c.alias("c"), F.when((s["at"] < 0) & (c > u), s["k"]).otherwise(s["at"]).alias("at"), (s["k"] + 1).alias("k"))

    return F.aggregate(p, state, step, lambda s: F.when(s["at"] >= 0, s["at"]).otherwise(s["k"] - 1))


def uniform(*keys: Column) -> Column:
    """A reproducible number in [0, 1) from a hash of the keys, whatever the partitioning."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 52)) / F.lit(float(1 << 52))
