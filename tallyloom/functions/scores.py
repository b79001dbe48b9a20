"""Probabilities, answers and losses from arrays of option scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Probabilities of scores divided by a temperature, shifted by the largest."""
    t = F.lit(temperature) if isinstance(temperature, float | int) else temperature
    exps = F.transform(logits, lambda z: F.exp((z - F.array_max(logits)) / t))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    return F.transform(exps, lambda e: e / total)


def argmax(xs: Column) -> Column:
    """The index of the first largest element."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def temperature_of(kind: Column, temperatures: dict[str, float] | float | None) -> Column:
    """None: 1; a number; or by question type, with `default`."""
    if not isinstance(temperatures, dict):
        return F.lit(float(temperatures or 1.0))
    out = F.lit(float(temperatures.get("default", 1.0)))
    for k, t in temperatures.items():
        out = F.when(kind == k, float(t)).otherwise(out)
    return out


def confidence(probs: Column) -> Column:
    """0 for an even distribution, 1 for a certain one."""
    k = F.size(probs)
    return (F.array_max(probs) - 1 / k) / (1 - 1 / k)


def expected_level(probs: Column) -> Column:
    return F.aggregate(F.transform(probs, lambda p, i: p * i), F.lit(0.0), lambda a, x: a + x)


def one_hot(target: Column, k: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(i == target, 1.0).otherwise(0.0))


def soft_target(labels: Column, probs: Column) -> Column:
    """Probabilities in the order of labels, 0 where missing, scaled to sum 1; null if the sum is 0."""
    raw = F.transform(labels, lambda k: F.coalesce(F.try_element_at(probs, k), F.lit(0.0)))
    total = F.aggregate(raw, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(raw, lambda x: x / total))


def _dot(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)


def brier(probs: Column, target: Column) -> Column:
    return _dot(probs, target, lambda p, q: (p - q) * (p - q))


def nll(probs: Column, at: Column) -> Column:
    return -F.log(F.greatest(F.try_element_at(probs, at + 1), F.lit(1e-12)))


def cross_entropy(probs: Column, target: Column, smoothing: float = 0.0) -> Column:
    k = F.size(probs)
    return _dot(probs, target, lambda p, q: -(q * (1 - smoothing) + smoothing / k) * F.log(F.greatest(p, F.lit(1e-12))))


def total_variation(a: Column, b: Column) -> Column:
    return _dot(a, b, lambda p, q: F.abs(p - q)) / 2


def ranked_probability(probs: Column, target: Column) -> Column:
    """Squared differences of the running sums, over the number of steps."""
    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("s"))
    step = lambda a, x: F.struct((a["d"] + x).alias("d"), (a["s"] + (a["d"] + x) * (a["d"] + x)).alias("s"))
    diffs = F.zip_with(probs, target, lambda p, q: p - q)
    return F.aggregate(F.slice(diffs, 1, F.greatest(F.size(probs) - 1, F.lit(1))), start, step, lambda a: a["s"]) / F.greatest(F.size(probs) - 1, F.lit(1))


#: Losses by name: (probabilities, one-hot or soft target) -> column.
LOSSES = {
    "ce": cross_entropy,
    "ce_smooth": lambda p, q: cross_entropy(p, q, 0.1),
    "brier": brier,
    "ce_brier": lambda p, q: cross_entropy(p, q) + brier(p, q),
    "rps": ranked_probability,
}


def confidence_bin(conf: Column, bins: int = 10) -> Column:
    """The right-closed bin of equal width; 0 is in the first."""
    out = F.lit(0)
    for b in range(1, bins):
        out = F.when(conf > b / bins, b).otherwise(out)
    return out
