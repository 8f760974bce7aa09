"""Hourly and daily rollups, and queries over them.

A rollup row is ``metric, series, tags, ts, cnt, min, max, sum``.  Hourly rows come from
deduplicated points, daily rows from hourly ones.  A query may read a rollup if its
function can be answered from one and its interval is a whole number of rollup periods.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import Downsample
from ..schema import ROLLUP_COLUMNS, SECONDS, arrival, named, tag_pairs
from .points import Bounds

HOUR, DAY = 3600, 86400
EPOCH = dt.date(1970, 1, 1)
FUNCTIONS = {"avg", "count", "min", "max", "sum"}


def _fold(frame: DataFrame, keys: list[str], bucket: Column, parts: dict) -> DataFrame:
    return frame.groupBy(*keys, bucket.alias("bucket")).agg(*[c.alias(n) for n, c in parts.items()]).withColumnRenamed("bucket", "ts")


def _coarser() -> dict[str, Column]:
    return {"cnt": F.sum("cnt"), "min": F.min("min"), "max": F.max("max"), "sum": F.sum("sum")}


def hourly(points: DataFrame, resolution: str = SECONDS) -> DataFrame:
    """Rollup rows of each series and hour; one shuffle of the points, then one sort that all aggregates share.

    A hash aggregate would hold a task's rows once for each of the four steps.  Values in
    structs have Spark sort instead; the hash, being first in the order, spares most
    comparisons of pairs.
    """
    period = HOUR * (1 if resolution == SECONDS else 1000)
    # Metric and pairs are one key: a constant metric, being a literal, would have each aggregate sort anew.
    who = F.struct("metric", tag_pairs(F.col("tags")).alias("pairs"))
    x = points.select(who.alias("who"), "ts", "value", arrival(points).alias("seq"), (F.col("ts") - F.col("ts") % period).alias("bucket"))
    x = x.repartition("who", "bucket").withColumn("dealt", F.xxhash64("who", "bucket"))
    x = x.groupBy("dealt", "who", "bucket", "ts").agg(F.max_by(F.struct("value"), "seq")["value"].alias("value"))
    no_nan = F.when(~F.isnan("value"), F.struct("value"))
    x = _fold(x, ["dealt", "who"], F.col("bucket"), {"cnt": F.count("value"), "min": F.min(no_nan)["value"], "max": F.max(no_nan)["value"], "sum": F.sum("value")})
    return x.select("who.metric", *named(F.col("who.pairs")), *ROLLUP_COLUMNS[3:])


def coarser(rollup: DataFrame, period: int) -> DataFrame:
    """Rollup rows of a longer period, a multiple of the present one."""
    x = rollup.withColumn("pairs", tag_pairs(F.col("tags")))
    return _fold(x, ["metric", "pairs"], F.col("ts") - F.col("ts") % period, _coarser()).select("metric", *named(F.col("pairs")), *ROLLUP_COLUMNS[3:])


def daily(rollup: DataFrame, resolution: str = SECONDS) -> DataFrame:
    return coarser(rollup, DAY * (1 if resolution == SECONDS else 1000))


def usable(spec: Downsample | None, usage: str = "ROLLUP_FALLBACK_RAW") -> str | None:
    """The table to read for a downsampler: "daily", "hourly" or None for raw points."""
    if usage == "ROLLUP_RAW" or spec is None or spec.all or spec.function not in FUNCTIONS:
        return None
    if spec.interval % (DAY * 1000) == 0:
        return "daily"
    return "hourly" if spec.interval % (HOUR * 1000) == 0 else None


def from_rollup(rollup: DataFrame, function: str, b: Bounds) -> DataFrame:
    """``series, result, ts, value`` of each bucket from rollup rows with ``result``."""
    x = rollup.where(F.col("ts").between(b.scan_from, b.scan_to))
    x = _fold(x, ["series", "result"], F.col("ts") - F.col("ts") % b.interval, _coarser())
    value = {"avg": F.col("sum") / F.col("cnt"), "count": F.col("cnt").cast("double"), "min": F.col("min"), "max": F.col("max"), "sum": F.col("sum")}[function]
    return x.where("cnt > 0").select("series", "result", "ts", value.alias("value"))


def with_fallback(rollup: DataFrame, raw: DataFrame, invalid: DataFrame | None, stale: frozenset[int] = frozenset(), resolution: str = SECONDS) -> DataFrame:
    """Rollup rows, but what they do not tell rightly made anew from raw points, by the hour.

    ``invalid(metric, series, day_number)``: a series' days with late points.  ``stale``:
    days since the epoch that are not rolled up whole; being literals, they prune the
    days of a stored table.
    """
    unit = DAY * (1 if resolution == SECONDS else 1000)
    day = F.floor(F.col("ts") / unit)
    keys = ["metric", "series", "day_number"]
    old = F.lit(False)
    if stale:
        old = day.isin(sorted(stale))
        if "day" in raw.columns:
            old = old & F.col("day").isin([EPOCH + dt.timedelta(days=d) for d in sorted(stale)])
    good, again = rollup.where(~day.isin(sorted(stale))) if stale else rollup, raw.where(old)
    if invalid is not None:
        raw = raw.withColumn("day_number", day).where(~day.isin(sorted(stale))) if stale else raw.withColumn("day_number", day)
        good = good.withColumn("day_number", day).join(invalid, keys, "left_anti")
        again = again.unionByName(raw.join(invalid, keys, "left_semi").drop("day_number"))
    return good.select(*ROLLUP_COLUMNS).unionByName(hourly(again, resolution).select(*ROLLUP_COLUMNS))
