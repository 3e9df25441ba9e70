"""Row-local array helpers: grouping inside one row needs no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`; works inside lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sorted_runs(items: Column, key: str, shape: Callable[[Column, Column], Column]) -> Column:
    """Group an array of structs by its first field `key` and map every group with `shape(key, group)`.

    One sort and one pass over the run starts, so the cost is k log k in the length of the array: items of a run are read
    by their place, since every slice would copy the whole array. The groups keep the order given by the remaining struct
    fields. No item is null; sort_array compares without the lambda of array_sort.
    """

    def group(s: Column) -> Column:
        indexes = F.transform(s, lambda x, i: i)
        starts = F.filter(
            indexes, lambda i: (i == 0) | (F.get(s, i)[key] != F.get(s, i - 1)[key])
        )
        return let(
            starts,
            lambda b: F.transform(
                b,
                lambda start, j: let(
                    F.transform(
                        F.sequence(start, F.coalesce(F.get(b, j + 1), F.size(s)) - 1), lambda at: F.get(s, at)
                    ),
                    lambda run: shape(F.get(s, start)[key], run),
                ),
            ),
        )

    return let(F.sort_array(items), group)
