"""Percentiles of rank q * (n + 1), with interpolation between neighbours and clamping.

Spark's own percentile uses another rank.  Values are ranked by a window, which sorts on
disk if it must, so no group is ever gathered into an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: list[str], q: float, value: str = "value", others: dict[str, Column] | None = None) -> DataFrame:
    """``keys, value`` with the percentile of each group's non-null values; NaN for a group without any."""
    group = Window.partitionBy(*keys)
    x = df.withColumn("_rank", F.row_number().over(group.orderBy(F.col(value).asc_nulls_last()))).withColumn("_n", F.count(value).over(group))
    at = F.lit(q) * (F.col("_n") + 1)
    clamped = F.least(F.greatest(F.floor(at), F.lit(1)), F.greatest(F.col("_n"), F.lit(1)))
    inside = (at >= 1) & (at < F.col("_n"))
    low, high = F.max(F.when(F.col("_rank") == clamped, F.col(value))), F.max(F.when(inside & (F.col("_rank") == clamped + 1), F.col(value)))
    share = F.max(F.when(inside, at - F.floor(at)).otherwise(0.0))
    x = x.groupBy(*keys).agg(low.alias("_low"), high.alias("_high"), share.alias("_share"), *[c.alias(n) for n, c in (others or {}).items()])
    out = F.coalesce(F.when(F.col("_high").isNull(), F.col("_low")).otherwise(F.col("_low") + F.col("_share") * (F.col("_high") - F.col("_low"))), F.lit(float("nan")))
    return x.select(*keys, out.alias(value), *(others or {}))


def of_list(values: list[float], q: float) -> float:
    """The same percentile of a Python list."""
    a = sorted(values, key=lambda x: (x != x, x))  # NaN last
    n, at = len(a), q * (len(a) + 1)
    if n == 0:
        return float("nan")
    if n == 1 or at < 1:
        return a[0]
    if at >= n:
        return a[-1]
    k = int(at)
    return a[k - 1] + (at - k) * (a[k] - a[k - 1])
