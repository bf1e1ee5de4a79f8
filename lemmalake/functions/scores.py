"""Column functions on rewards, reviews and token probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length_penalty(n: Column, most: int) -> Column:
    """0 up to 0.8 of the most tokens, then linear to -1 at the most, -1 beyond; -1 where nothing is allowed."""
    if most <= 0:
        return F.lit(-1.0)
    free = 0.8 * most
    return F.when(n <= free, F.lit(0.0)).otherwise(F.greatest(F.lit(-1.0), -(n - free) / (most - free)))


def shortness(n: Column, weight: Column) -> Column:
    """exp(-n / 1000) for a weight of 1; other weights stay."""
    return F.when(weight == 1.0, F.exp(-0.001 * n)).otherwise(weight)


def rubric(complexity: Column, relevance: Column, redundancy: Column) -> Column:
    """The review of three scores: 0 for a complexity of 3 or 4, else their sum against the ideal, not below 0; null if one is missing."""
    total = relevance + (2 - complexity) + (1 - redundancy)
    known = complexity.isNotNull() & relevance.isNotNull() & redundancy.isNotNull()
    return F.when(known, F.when(complexity.isin(3, 4), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), total)))


def entropy(logprobs: Column) -> Column:
    """The entropy of probabilities given as logarithms, after they are scaled to sum to 1; null for an empty array."""
    total = F.aggregate(logprobs, F.lit(0.0), lambda s, x: s + F.exp(x))
    return F.when(F.size(logprobs) > 0, F.aggregate(logprobs, F.lit(0.0), lambda s, x: s - (F.exp(x) / total) * F.log(F.exp(x) / total + 1e-10)))


def importance_ratios(new: Column, old: Column, low: float, high: float) -> Column:
    """exp(new - old), clamped, by token. Clamping the ratio rather than its logarithm lets low be 0."""
    return F.zip_with(new, old, lambda a, b: F.greatest(F.lit(low), F.least(F.lit(high), F.exp(a - b))))


def padded(tokens: Column, size: Column, pad: int) -> Column:
    """Padded on the left to a size; longer arrays stay."""
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(size - F.size(tokens), F.lit(0))), tokens)
