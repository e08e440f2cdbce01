"""Vector columns: ``array<double>`` (or float) expressions, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside a lambda over elements it would be computed for each of them."""
    return F.transform(F.array(value), body)[0]


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    """Cosine; 0 where a vector is zero."""
    length = norm(x) * norm(y)
    return F.when(length == 0, 0.0).otherwise(dot(x, y) / length)


def unit(x: Column) -> Column:
    """L2-normalised; a zero vector stays zero."""
    return bound(norm(x), lambda length: F.transform(x, lambda v: F.when(length == 0, 0.0).otherwise(v.cast("double") / length)))


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: F.pow(a.cast("double") - b.cast("double"), 2)), F.lit(0.0), lambda s, v: s + v))


def layer_norm(x: Column, epsilon: float = 1e-5) -> Column:
    """(x - mean) / sqrt(population variance + epsilon)."""
    n = F.nullif(F.size(x), F.lit(0))
    total = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double"))

    def spread(mean: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(v.cast("double") - mean, 2)) / n

    return bound(total / n, lambda mean: bound(F.sqrt(spread(mean) + epsilon), lambda scale: F.transform(x, lambda v: (v.cast("double") - mean) / scale)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def softmax(x: Column) -> Column:
    def shares(top: Column) -> Column:
        total = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v.cast("double") - top))
        return bound(total, lambda t: F.transform(x, lambda v: F.exp(v.cast("double") - top) / t))

    return bound(F.array_max(x), shares)


def argmax(x: Column) -> Column:
    """Place of the largest value, from 0; the first of equals."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("double"))


def pair_mean(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: (a.cast("double") + b.cast("double")) / 2)


def mean_pairwise_cosine(total: Column, squares: Column, n: Column) -> Column:
    """Mean cosine over all pairs of n unit vectors, mapped to [0, 1], from their sum vector and the sum of their squared lengths.

    No pair is formed: twice the sum over pairs is the squared length of the sum less the squared lengths.
    Null for fewer than two vectors.
    """
    mean = (dot(total, total) - squares) / (n * (n - 1))
    return F.when(n >= 2, (mean + 1) / 2)
