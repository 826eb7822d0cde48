"""Column functions over arrays of numbers: similarity, windows of sequences, training arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Null if either is a zero vector."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v))


def last(x: Column, n: int) -> Column:
    """The last ``n`` items, all if fewer."""
    return F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)), F.lit(n))


def pad_right(x: Column, n: Column, fill: Column) -> Column:
    return F.concat(x, F.array_repeat(fill, F.greatest(n - F.size(x), F.lit(0))))


def pad_left(x: Column, n: Column, fill: Column) -> Column:
    return F.concat(F.array_repeat(fill, F.greatest(n - F.size(x), F.lit(0))), x)


def masked_mean(x: Column, mask: Column) -> Column:
    """sum(x * mask) / sum(mask); null without any mask."""
    return F.try_divide(total(F.zip_with(x, mask, lambda v, m: v * m)), total(F.transform(mask, lambda m: m.cast("double"))))


def log_softmax(x: Column) -> Column:
    top = F.array_max(x)
    norm = F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top))) + top
    return F.transform(x, lambda v: v - norm)


def gather(rows: Column, ids: Column) -> Column:
    """From an array of log-probability arrays the one of each id (from 0)."""
    return F.zip_with(rows, ids, lambda r, i: F.element_at(r, i + 1))


def mean_probability(logprobs: Column) -> Column:
    """Confidence as the mean probability of an answer's tokens."""
    return F.try_divide(F.aggregate(logprobs, F.lit(0.0), lambda s, v: s + F.exp(v)), F.size(logprobs))


def surprise(logprobs: Column) -> Column:
    """Confidence as the negated sum of log-probabilities."""
    return -total(logprobs)
