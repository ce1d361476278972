"""Vector expressions over ``array<double>`` columns.

With ``dim`` given, a sum over positions is written out term by term, which Spark compiles into the
stage's generated code, and a vector of another length is an error; without it the array functions handle any length.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

BINS = 10
EPSILON = 1e-5


def _total(a: Column, b: Column, term: Callable[[Column, Column], Column], dim: int | None) -> Column:
    if dim is not None:
        return _of_length(dim, reduce(add, [term(a.getItem(i), b.getItem(i)) for i in range(dim)]), a, b)
    return F.aggregate(F.zip_with(a, b, term), F.lit(0.0), lambda acc, x: acc + x)


def _of_length(dim: int, value: Column, *vectors: Column) -> Column:
    """``value``, if all vectors have ``dim`` numbers; null if one is null; else an error."""
    missing, fits = reduce(or_, [v.isNull() for v in vectors]), reduce(and_, [F.size(v) == dim for v in vectors])
    return F.when(fits, value).when(missing, None).otherwise(F.raise_error(F.lit(f"a vector without exactly {dim} numbers")).cast("double"))


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    return _total(a, b, lambda x, y: x * y, dim)


def norm(a: Column, dim: int | None = None) -> Column:
    return F.sqrt(dot(a, a, dim))


def cosine_from(dot_product: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine when the norms are already known; null when one of them is zero."""
    return F.try_divide(dot_product, norm_a * norm_b)


def cosine_similarity(a: Column, b: Column, dim: int | None = None) -> Column:
    return cosine_from(dot(a, b, dim), norm(a, dim), norm(b, dim))


def euclidean_distance(a: Column, b: Column, dim: int | None = None) -> Column:
    return F.sqrt(_total(a, b, lambda x, y: (x - y) * (x - y), dim))


def manhattan_distance(a: Column, b: Column, dim: int | None = None) -> Column:
    return _total(a, b, lambda x, y: F.abs(x - y), dim)


def chebyshev_distance(a: Column, b: Column, dim: int | None = None) -> Column:
    if dim is not None and dim > 1:
        return _of_length(dim, F.greatest(*[F.abs(a.getItem(i) - b.getItem(i)) for i in range(dim)]), a, b)
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def histogram(vec: Column, bins: int = BINS, epsilon: float = EPSILON) -> Column:
    """Smoothed share of the vector's values in equal bins between its own minimum and maximum.

    Each bin is closed on the left, the last on both sides; a constant vector uses value ± 0.5.
    """
    low, high = F.array_min(vec), F.array_max(vec)
    flat = low == high
    start = F.when(flat, low - 0.5).otherwise(low)
    step = (F.when(flat, high + 0.5).otherwise(high) - start) / bins

    def shares(row: Column) -> Column:
        def share(i: Column) -> Column:
            left, right = row["start"] + row["step"] * i, row["start"] + row["step"] * (i + 1)
            inside = F.filter(row["vec"], lambda v: (v >= left) & ((v < right) | (i == bins - 1)))
            return (F.size(inside) + epsilon) / F.size(row["vec"])

        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), share)

    # A one-element array holds start and step, so that they are worked out once per vector.
    bound = F.array(F.struct(vec.alias("vec"), start.alias("start"), step.alias("step")))
    return F.get(F.transform(bound, shares), F.lit(0))


def kl_from_histograms(a: Column, b: Column, bins: int | None = BINS) -> Column:
    """Divergence of two histogram columns; with ``bins`` None they may be costly expressions, each
    of which is evaluated once."""
    return _total(a, b, lambda x, y: x * F.ln(x / y), bins)


def histogram_kl(a: Column, b: Column, bins: int = BINS, epsilon: float = EPSILON) -> Column:
    """Kullback-Leibler divergence of the two value histograms; positions play no part."""
    return kl_from_histograms(histogram(a, bins, epsilon), histogram(b, bins, epsilon), None)
