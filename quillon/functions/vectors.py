"""Scalar functions over sparse vectors in row form, MAP<STRING, DOUBLE>; an absent key reads as 0.

All are column expressions. A vector of norm 0 normalises to zeros, and every similarity
with a denominator of 0 is 0. Ordered results sort by value descending, then key descending.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0)


def empty() -> Column:
    return F.from_json(F.lit("{}"), "map<string,double>")


def get(vec: Column, key: Column) -> Column:
    """Value of a key, or 0."""
    return F.coalesce(F.try_element_at(vec, key), _zero())


def put(vec: Column, key: Column, value: Column) -> Column:
    """The vector with a key set (a value of 0 is stored)."""
    return F.map_concat(F.map_filter(vec, lambda k, _: k != key), F.create_map(key, value.cast("double")))


def size(vec: Column) -> Column:
    return F.cardinality(vec)


def clear(vec: Column) -> Column:
    return F.map_filter(vec, lambda k, v: F.lit(False))


def entries(vec: Column) -> Column:
    return F.map_entries(vec)


def _sorted(vec: Column, rank) -> Column:  # noqa: ANN001
    def order(a: Column, b: Column) -> Column:
        x, y = rank(a["value"]), rank(b["value"])
        return F.when(x > y, -1).when(x < y, 1).when(a["key"] > b["key"], -1).when(a["key"] < b["key"], 1).otherwise(0)

    return F.array_sort(F.map_entries(vec), order)


def sorted_items(vec: Column) -> Column:
    """Entries by value descending, then key descending."""
    return _sorted(vec, lambda v: v)


def sorted_items_abs(vec: Column) -> Column:
    """Entries by absolute value descending, then key descending."""
    return _sorted(vec, F.abs)


def resize(vec: Column, n: int) -> Column:
    """The n entries of largest absolute value; unchanged if there are no more."""
    return F.when(size(vec) <= n, vec).otherwise(F.map_from_entries(F.slice(sorted_items_abs(vec), 1, n)))


def norm_squared(vec: Column) -> Column:
    return F.aggregate(F.map_values(vec), _zero(), lambda t, v: t + v * v)


def norm(vec: Column) -> Column:
    return F.sqrt(norm_squared(vec))


def multiply_constant(vec: Column, x: Column) -> Column:
    return F.transform_values(vec, lambda _, v: v * x)


def normalize(vec: Column) -> Column:
    """Divided by the norm; a norm of 0 gives zeros."""
    scale = F.coalesce(F.try_divide(F.lit(1.0), norm(vec)), _zero())
    return F.get(F.transform(F.array(scale), lambda s: F.transform_values(vec, lambda _, v: v * s)), F.lit(0))


def add_vector(a: Column, b: Column) -> Column:
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, _zero()) + F.coalesce(y, _zero()))


def delete_vector(a: Column, b: Column) -> Column:
    """a - b over the union of keys; cancelled keys stay, with value 0."""
    return F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, _zero()) - F.coalesce(y, _zero()))


def euclid_distance_squared(a: Column, b: Column) -> Column:
    return norm_squared(delete_vector(a, b))


def euclid_distance(a: Column, b: Column) -> Column:
    return F.sqrt(euclid_distance_squared(a, b))


def inner_product(a: Column, b: Column) -> Column:
    products = F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x * y, _zero()))
    return F.aggregate(F.map_values(products), _zero(), lambda t, v: t + v)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.nanvl(F.try_divide(inner_product(a, b), norm(a) * norm(b)), _zero()), _zero())


def jaccard(a: Column, b: Column) -> Column:
    """prod / (|a| + |b| - prod) with plain, not squared, norms; it can exceed 1."""
    prod = inner_product(a, b)
    return F.coalesce(F.nanvl(F.try_divide(prod, norm(a) + norm(b) - prod), _zero()), _zero())
