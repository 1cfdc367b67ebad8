"""Array helpers that stay inside one row, so they never shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``.

    The optimizer inlines a projected column that a lambda mentions once, which
    would evaluate it per element; a lambda argument is evaluated only once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def runs_of_equal(sorted_array: Column, differs: Callable[[Column, Column], Column]) -> Column:
    """Split a sorted array into sub-arrays of neighbours that do not differ."""

    def cut(arr: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(arr)),
            lambda i: (i == 1) | differs(F.get(arr, i - 1), F.get(arr, i - 2)),
        )
        return let(starts, lambda st: F.transform(
            st, lambda a, j: F.slice(arr, a, F.coalesce(F.get(st, j + 1), F.size(arr) + 1) - a)))

    return let(sorted_array, lambda arr: F.when(F.size(arr) > 0, cut(arr)).otherwise(F.array()))


def distinct_sorted(items: Column) -> Column:
    """Sorted distinct elements. ``array_distinct`` compares structs pairwise,
    which is quadratic; this is one sort."""
    return let(F.sort_array(items), lambda arr: F.filter(
        arr, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(arr, i - 1))))


def tally(items: Column) -> Column:
    """Multiset of an array: ``array<struct<item, n, first>>`` sorted by item.

    ``first`` is the 0-based position of the first occurrence. Cost is one sort.
    """
    placed = F.transform(items, lambda x, i: F.struct(x.alias("item"), i.alias("at")))

    def count(arr: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(arr)),
            lambda i: (i == 1) | (F.get(arr, i - 1)["item"] != F.get(arr, i - 2)["item"]),
        )
        return let(starts, lambda st: F.transform(st, lambda a, j: F.struct(
            F.get(arr, a - 1)["item"].alias("item"),
            (F.coalesce(F.get(st, j + 1), F.size(arr) + 1) - a).alias("n"),
            F.get(arr, a - 1)["at"].alias("first"),
        )))

    empty = F.array().cast("array<struct<item:string,n:int,first:int>>")
    return let(F.sort_array(placed),
               lambda arr: F.when(F.size(arr) > 0, count(arr)).otherwise(empty))


def explode_rows(df: DataFrame, keys: list[str], array: Column, item: str,
                 pos: str | None = None) -> DataFrame:
    """One row per element: keys, the position if named, the element.

    A plain ``explode`` makes the optimizer add a ``size(array) > 0`` filter
    below it, which evaluates a computed array twice; the outer form does not.
    """
    if pos is None:
        return df.select(*keys, F.explode_outer(array).alias(item)).filter(F.col(item).isNotNull())
    return df.select(*keys, F.posexplode_outer(array).alias(pos, item)).filter(F.col(pos).isNotNull())
