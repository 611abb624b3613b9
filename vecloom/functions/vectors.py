"""Element-wise functions over array<double> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a, b) -> Column:
    """Null where a vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def sigmoid(x) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def mean_vector(vectors) -> Column:
    """Element-wise mean of an array of vectors."""
    v = _c(vectors)
    return F.transform(F.aggregate(F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0))), F.get(v, F.lit(0)), lambda s, x: F.zip_with(s, x, lambda p, q: p + q)), lambda x: x / F.size(v))


def capped(a, max_norm: float | None) -> Column:
    """A vector scaled down to max_norm."""
    v = _c(a)
    return v if max_norm is None else F.when(norm(v) > max_norm, F.transform(v, lambda x: x * max_norm / norm(v))).otherwise(v)


def average(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: (x + y) / 2)


def hadamard(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x * y)


def weighted_l1(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x - y))


def weighted_l2(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))


EDGE_OPERATORS: dict[str, Callable] = {f.__name__: f for f in (average, hadamard, weighted_l1, weighted_l2)}


def edge_operator(name: str) -> Callable:
    """By name, in any case."""
    try:
        return EDGE_OPERATORS[name.lower()]
    except KeyError:
        raise ValueError(f"edge operator {name!r}: one of {sorted(EDGE_OPERATORS)}") from None
