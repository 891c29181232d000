"""Multisets as map columns from item to a positive count (J17): no explode, no shuffle beyond the one that counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _positive(counts: Column) -> Column:
    return F.map_filter(counts, lambda _, n: n > 0)


def _zipped(a: Column, b: Column, f) -> Column:  # noqa: ANN001
    """f of both counts of every item that either has; an absent item or map counts as none."""
    zero = F.lit(0).cast("bigint")
    empty = lambda m: F.coalesce(m, F.map_filter(F.coalesce(a, b), lambda _, n: n < 0))
    return _positive(F.map_zip_with(empty(a), empty(b), lambda _, x, y: f(F.coalesce(x, zero), F.coalesce(y, zero))))


def of_pairs(item: str, n: str) -> Column:
    """An aggregate: the counter of rows that have each item once with its count; null items are left out."""
    return F.map_from_entries(F.filter(F.collect_list(F.struct(item, F.col(n).cast("bigint").alias("n"))), lambda e: e[item].isNotNull()))


def of_array(items: Column) -> Column:
    """The counter of an array's items; null items are left out."""
    own = F.array_compact(items)
    return F.map_from_entries(F.transform(F.array_distinct(own), lambda x: F.struct(x, F.size(F.filter(own, lambda y: y == x)).cast("bigint"))))


def intersection(a: Column, b: Column) -> Column:
    return _zipped(a, b, F.least)


def union(a: Column, b: Column) -> Column:
    return _zipped(a, b, F.greatest)


def added(a: Column, b: Column) -> Column:
    return _zipped(a, b, lambda x, y: x + y)


def excess(a: Column, b: Column) -> Column:
    """What a has beyond b."""
    return _zipped(a, b, lambda x, y: x - y)


def total(a: Column) -> Column:
    return F.aggregate(F.map_values(a), F.lit(0).cast("bigint"), lambda t, n: t + n)


def keys(a: Column) -> Column:
    """The items in order."""
    return F.array_sort(F.map_keys(a))


def rendered(a: Column) -> Column:
    """item:count in the order of the items, comma-joined."""
    return F.array_join(F.transform(F.array_sort(F.transform(F.map_entries(a), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("n")))), lambda e: F.concat_ws(":", e["k"].cast("string"), e["n"].cast("string"))), ",")
