"""Selection of points: bounds, matching series and last-write-wins."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registry import extreme
from ..plans.spec import SubQuery
from ..schema import SECONDS, arrival, named, tag_pairs, with_series
from .filters import matching


@dataclass(frozen=True)
class Bounds:
    """In units of the table: what to scan, the first and last bucket's range, and the interval (0: one bucket)."""

    scan_from: int
    scan_to: int
    first: int
    last: int
    interval: int
    start: int

    @property
    def buckets(self) -> int:
        return 1 if not self.interval else max(0, (self.last - self.first) // self.interval + 1)


def bounds(start_ms: int, end_ms: int, sub: SubQuery, resolution: str = SECONDS) -> Bounds:
    """Bounds of a query, both inclusive; with an interval, whole buckets from the first that starts in range."""
    unit = 1000 if resolution == SECONDS else 1
    start, end = start_ms // unit, end_ms // unit
    if sub.downsample is None or sub.downsample.all:
        return Bounds(start, end, start, end, 0, start)
    step = max(1, sub.downsample.interval // unit)
    first = -(-start // step) * step
    last = end if end % step == 0 else end // step * step + step - 1
    return Bounds(first, last + step - 1 if last % step == 0 else last, first, last, step, start)


def matching_series(frame: DataFrame, sub: SubQuery) -> DataFrame:
    """Rows of the metric whose tags match all filters."""
    x = frame.where(F.col("metric") == sub.metric).where(matching(sub.tags + sub.filters))
    return x.where(F.size("tags") == len({f.key for f in sub.tags + sub.filters})) if sub.explicit_tags else x


def in_range(points: DataFrame, b: Bounds, resolution: str = SECONDS) -> DataFrame:
    """Points in the scanned range; a stored table is pruned by day as well.

    A raw ``time`` column (TIMESTAMP_NTZ), if there, gets the same bounds, which reach the
    Parquet scan; bounds on a computed ``ts`` do not.
    """
    x = points.where(F.col("ts").between(b.scan_from, b.scan_to))
    unit = 1 if resolution == SECONDS else 1000
    if "day" in points.columns:
        x = x.where(F.col("day").between(F.date_from_unix_date(F.lit(b.scan_from // (86400 * unit))), F.date_from_unix_date(F.lit(b.scan_to // (86400 * unit)))))
    if "time" in points.columns:
        at = lambda t: F.lit(dt.datetime.fromtimestamp(t / unit, dt.timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")
        x = x.where((F.col("time") >= at(b.scan_from)) & (F.col("time") < at(b.scan_to + 1)))
    return x


def last_write_wins(points: DataFrame, b: Bounds | None = None) -> DataFrame:
    """``metric, series, tags, ts, value`` (and ``bucket``): of equal timestamps in a series the latest written.

    With buckets, rows are dealt by (tags, bucket) once; grouping by bucket then needs no
    shuffle of its own.  A single bucket would put a whole series in one task, so there
    the timestamps deal the rows.  The metric deals nothing: a constant one would be
    folded out of the groups, and the shuffle would no longer serve them.
    """
    x = points.select("metric", tag_pairs(F.col("tags")).alias("pairs"), "ts", "value", arrival(points).alias("seq"))
    keys = ["metric", "pairs", "ts"]
    if b is not None and b.interval:
        x = x.withColumn("bucket", F.col("ts") - F.col("ts") % b.interval).repartition("pairs", "bucket")
        keys.append("bucket")
    x = x.groupBy(*keys).agg(F.max_by("value", "seq").alias("value"))
    return x.select("metric", *named(F.col("pairs")), *keys[2:], "value")


def select(points: DataFrame, sub: SubQuery, b: Bounds, resolution: str = SECONDS) -> DataFrame:
    """``series, result, ts, value`` (and ``bucket``) of the matching points in range, each timestamp of a series once.

    Tags have served by then: the result that a series belongs to is known, so they are
    not shuffled.  The exchange is the same as in ``last_write_wins``.
    """
    x = with_result(with_series(in_range(matching_series(points, sub), b, resolution)), sub)
    x = x.select("series", "result", "ts", "value", arrival(points).alias("seq"))
    keys = ["series", "result", "ts"]
    if b.interval:
        x = x.withColumn("bucket", F.col("ts") - F.col("ts") % b.interval).repartition("series", "bucket")
        keys.append("bucket")
    return x.groupBy(*keys).agg(F.max_by("value", "seq").alias("value"))


def grouping_keys(sub: SubQuery) -> list[str]:
    return sorted({f.key for f in sub.tags})


def per_series(sub: SubQuery) -> bool:
    """Whether results are single series rather than groups."""
    return sub.aggregator == "none" or extreme(sub.aggregator) is not None


def with_result(rows: DataFrame, sub: SubQuery) -> DataFrame:
    """Adds ``result``: the name of the result that a series belongs to."""
    if per_series(sub):
        return rows.withColumn("result", F.col("series"))
    keys = grouping_keys(sub)
    return rows.withColumn("result", F.concat_ws(",", *[F.concat(F.lit(f"{k}="), F.col("tags")[k]) for k in keys]) if keys else F.lit(""))
