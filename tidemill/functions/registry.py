"""Aggregate functions by name, for downsampling (within a series) and aggregation (across series).

Each entry makes a Spark aggregate from a value column and an order column.  Users may
``register`` their own.  Percentiles need ranks and are computed by ``percentiles.ranked``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F



def finite(v: Column) -> Column:
    """The value, or null for NaN and infinities."""
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def _no_nan(f: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    """min or max that passes over NaN, and is NaN only if nothing else is there."""
    return lambda v, ts: F.coalesce(f(F.when(~F.isnan(v), v)), F.when(F.count(v) > 0, F.lit(float("nan"))))


_COMMON = {
    "avg": lambda v, ts: F.avg(v),
    "sum": lambda v, ts: F.sum(v),
    "count": lambda v, ts: F.count(v).cast("double"),
    "min": _no_nan(F.min),
    "max": _no_nan(F.max),
}
DOWNSAMPLERS: dict[str, Callable[[Column, Column], Column]] = {
    **_COMMON,
    "dev": lambda v, ts: F.stddev_pop(v),
    "first": lambda v, ts: F.min_by(v, ts),
    "last": lambda v, ts: F.max_by(v, ts),
}
#: ``dev`` across series leaves NaN and infinities out; of none it is NaN.
AGGREGATORS: dict[str, Callable[[Column, Column], Column]] = {
    **_COMMON,
    "dev": lambda v, ts: F.coalesce(F.stddev_pop(finite(v)), F.lit(float("nan"))),
}
# The names that an aggregator listing shows.
LISTED = ["avg", "bottom1", "bottom3", "bottom5", "bottom9", "count", "dev", "first", "last", "max", "min", "none", "p50", "p90", "p95", "p98", "p99", "p999", "sum", "top1", "top3", "top5", "top9"]
#: Listed, but without an implementation across series.
UNSUPPORTED = {"first", "last"}


def register(name: str, make: Callable[[Column, Column], Column], across: bool = True, within: bool = True) -> None:
    """Add a function: ``make(value, ts)`` returns a Spark aggregate."""
    if across:
        AGGREGATORS[name] = make
    if within:
        DOWNSAMPLERS[name] = make


def quantile(name: str) -> float | None:
    """0.5 for ``p50``, 0.999 for ``p999``, 0.9999 for ``p9999``; None for other names."""
    m = re.fullmatch(r"p(\d+)", name)
    if not m:
        return None
    n, scale = int(m[1]), 100
    while n > scale:
        scale *= 10
    return n / scale


def extreme(name: str) -> tuple[str, int] | None:
    """("top" or "bottom", N) for names like ``top3``."""
    m = re.fullmatch(r"(top|bottom)(\d+)", name)
    return (m[1], int(m[2])) if m else None
