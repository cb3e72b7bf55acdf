"""Vector arithmetic as Column expressions over ``array<double>``.

All stay inside the JVM.  Cast a stored ``array<float>`` with ``wide`` first, so
that sums accumulate in double precision.  Sparse vectors are ``map<int,double>``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def wide(x: Column | str) -> Column:
    return _col(x).cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def checked(x: Column, y: Column, value: Column) -> Column:
    """``value``, or an error where the two vectors' lengths differ."""
    return F.when(F.size(x) == F.size(y), value).otherwise(F.raise_error(F.lit("vectors of different length")).cast("array<double>"))


def add(x: Column, y: Column) -> Column:
    return checked(x, y, F.zip_with(x, y, lambda a, b: a + b))


def subtract(x: Column, y: Column) -> Column:
    return checked(x, y, F.zip_with(x, y, lambda a, b: a - b))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it occurs there."""
    return F.transform(F.array(value), body)[0]


def divide(x: Column, n: Column) -> Column:
    return F.transform(x, lambda a: a / n)


def ratio(x: Column, y: Column) -> Column:
    """Elementwise quotient."""
    return checked(x, y, F.zip_with(x, y, lambda a, b: a / b))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    """0 where either vector has no length."""
    lengths = norm(x) * norm(y)
    return F.when(lengths > 0, dot(x, y) / lengths).otherwise(F.lit(0.0))


def squared_distance(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def negative_squared_distance(x: Column, y: Column) -> Column:
    return -squared_distance(x, y)


def l1_distance(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: F.abs(a - b)))


def similarity_l2(x: Column, y: Column) -> Column:
    return 1 / (1 + F.sqrt(squared_distance(x, y)))


def similarity_squared_l2(x: Column, y: Column) -> Column:
    return 1 / (1 + squared_distance(x, y))


#: Similarities by name, larger is nearer.
SIMILARITIES: dict[str, Callable[[Column, Column], Column]] = {
    "cosine": cosine, "dot": dot, "l2": similarity_l2, "sql2": similarity_squared_l2, "negative_sql2": negative_squared_distance,
}


def centroid(sums: Column, n: Column, kind: str = "none") -> Column:
    """Mean of ``n`` vectors with the given sum.

    ``none``: as it is; ``l2``: of unit length (0 stays 0); ``l_inf``: divided by
    its largest absolute entry (0 stays 0); ``binary``: 1 where positive.
    """
    mean = divide(sums, n)
    if kind == "none":
        return mean
    if kind == "binary":
        return F.transform(mean, lambda a: (a > 0).cast("double"))
    size = {"l2": norm, "l_inf": lambda m: F.array_max(F.transform(m, F.abs))}[kind]
    return let(mean, lambda m: let(size(m), lambda z: F.when(z > 0, divide(m, z)).otherwise(m)))


def sparse_dot(x: Column, y: Column) -> Column:
    shared = F.map_filter(x, lambda k, _: F.map_contains_key(y, k))
    return F.aggregate(F.map_entries(shared), F.lit(0.0), lambda s, e: s + e["value"] * F.element_at(y, e["key"]))


def sparse_norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(F.map_values(x), F.lit(0.0), lambda s, v: s + v * v))


def sparse_squared_distance(x: Column, y: Column) -> Column:
    return sparse_norm(x) * sparse_norm(x) + sparse_norm(y) * sparse_norm(y) - 2 * sparse_dot(x, y)


def sparse_centroid(sums: Column, n: Column, kind: str = "none") -> Column:
    mean = F.transform_values(sums, lambda _, v: v / n)
    if kind == "none":
        return mean
    if kind == "binary":
        return F.transform_values(F.map_filter(mean, lambda _, v: v > 0), lambda _, v: F.lit(1.0))
    size = sparse_norm(mean)
    return F.when(size > 0, F.transform_values(mean, lambda _, v: v / size)).otherwise(mean)


def average_link(n_a: Column, sum_a: Column, sq_a: Column, n_b: Column, sum_b: Column, sq_b: Column) -> Column:
    """Mean of -|x - y|^2 over all pairs across two clusters, from counts, sums and sums of squares."""
    return -(sq_a / n_a + sq_b / n_b - 2 * dot(divide(sum_a, n_a), divide(sum_b, n_b)))


def centroid_link(n_a: Column, sum_a: Column, n_b: Column, sum_b: Column, kind: str = "l2", similarity: str = "dot") -> Column:
    """Similarity of two clusters' centroids of the given kind."""
    return SIMILARITIES[similarity](centroid(sum_a, n_a, kind), centroid(sum_b, n_b, kind))


def cosine_link(sum_a: Column, sum_b: Column) -> Column:
    """Cosine of the clusters' sums."""
    return cosine(sum_a, sum_b)
