"""The data model: points, series and rollup tables.

A point is ``(metric, ts, value, tags, seq)``: ``ts`` in units of the table's resolution
(seconds unless said otherwise), ``seq`` a number that grows with arrival.  A series is a
metric with an exact set of tags; its name is the canonical text ``k1=v1,k2=v2`` with keys
in order.  Points may carry that text as the column ``series``; operators add it if not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS_SCHEMA = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("seq", T.LongType()),
    ]
)
ROLLUP_COLUMNS = ["metric", "series", "tags", "ts", "cnt", "min", "max", "sum"]
#: The reserved tag that holds a field's name, and its value for points without fields.
FIELD_TAG, NO_FIELD = "_field", "_"
SECONDS, MILLISECONDS = "second", "millisecond"
#: Timestamps from this one on are rejected by the writer.
REJECT_FROM = 10**13


def canonical_tags(tags: Column) -> Column:
    """``k1=v1,k2=v2`` with keys in order; empty for no tags."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


def tag_pairs(tags: Column) -> Column:
    """Tags as an array of pairs in the order of their keys: unlike a map, it can be a key of groups."""
    return F.array_sort(F.map_entries(tags))


def named(pairs: Column) -> list[Column]:
    """``series, tags`` from the pairs."""
    series = F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return [series.alias("series"), F.map_from_entries(pairs).alias("tags")]


def arrival(points: DataFrame) -> Column:
    """What orders writes: ``seq``, and within a text of many points their ``place``."""
    return F.struct("seq", "place") if "place" in points.columns else F.col("seq")


def with_series(points: DataFrame) -> DataFrame:
    return points if "series" in points.columns else points.withColumn("series", canonical_tags(F.col("tags")))


def with_day(points: DataFrame, resolution: str = SECONDS) -> DataFrame:
    """Adds the UTC day that partitions a stored table."""
    unit = 1 if resolution == SECONDS else 1000
    return points.withColumn("day", F.date_from_unix_date((F.col("ts") / F.lit(86400 * unit)).cast("int")))


def series_table(points: DataFrame) -> DataFrame:
    """The catalogue: every series once."""
    return with_series(points).groupBy("metric", "series").agg(F.first("tags").alias("tags"))


def normalise_ts(ts: Column, resolution: str = SECONDS) -> Column:
    """Detects the unit of an integer timestamp by its size and converts it to the resolution."""
    # Below 10^10 seconds, below 10^13 milliseconds, below 10^16 microseconds, else nanoseconds.
    ms = F.when(ts < 10**10, ts * 1000).when(ts < 10**13, ts).when(ts < 10**16, F.floor(ts / 1000)).otherwise(F.floor(ts / 1000000)).cast("long")
    return ms if resolution == MILLISECONDS else F.when(ts < 10**10, ts).otherwise(F.floor(ms / 1000)).cast("long")
