"""Steps of a plan that the optimiser keeps apart, and maps from pairs whose keys may repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, *keep: str, **columns: Column) -> DataFrame:
    """The columns ``keep`` of ``df`` and the given ones, which are computed once a row.

    They come out of a generator over one element.  A filter on them stays above it, where
    the optimiser would else write their expressions out again at the scan.
    """
    one = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*keep, F.inline(F.array(one)))


def last_of_each(keys: Column, values: Column) -> Column:
    """A map from two arrays; of equal keys the last one counts."""
    later = lambda k, i: F.array_contains(F.slice(keys, i + 2, F.size(keys)), k)
    numbers = F.filter(F.sequence(F.lit(0), F.size(keys) - 1), lambda i: ~later(F.get(keys, i), i))
    own = F.map_from_arrays(F.transform(numbers, lambda i: F.get(keys, i)), F.transform(numbers, lambda i: F.get(values, i)))
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_arrays(keys, values)).otherwise(own)


def sides(pairs: Column, sign: str = "=") -> tuple[Column, Column]:
    """What stands before and after the first ``sign`` of each text of an array."""
    before = F.transform(pairs, lambda p: F.substring_index(p, sign, 1))
    return before, F.transform(pairs, lambda p: p.substr(F.locate(sign, p) + 1, F.length(p)))
