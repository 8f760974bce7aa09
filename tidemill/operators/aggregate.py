"""Aggregation across series at equal timestamps, grouping by tags, and extreme series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.percentiles import ranked
from ..functions.registry import AGGREGATORS, LISTED, extreme, finite, quantile
from ..plans.spec import SubQuery

#: How many of a series' last values decide its rank among extreme series.
LAST = 3


def aggregate(values: DataFrame, sub: SubQuery) -> DataFrame:
    """``result, ts, value`` from ``series, result, ts, value``."""
    if sub.aggregator == "none":
        return values.select("result", "ts", "value")
    if extreme(sub.aggregator):
        return extremes(values, *extreme(sub.aggregator)).select("result", "ts", "value")
    keys = ["result", "ts"]
    q = quantile(sub.aggregator)
    if q is not None:
        return ranked(values.withColumn("value", finite(F.col("value"))), keys, q)
    return values.groupBy(*keys).agg(AGGREGATORS[sub.aggregator](F.col("value"), F.col("ts")).alias("value"))


def extremes(values: DataFrame, side: str, n: int) -> DataFrame:
    """Whole series with the n largest maxima (or least minima) of their last values; ties by series name."""
    latest = Window.partitionBy("series").orderBy(F.col("ts").desc())
    x = values.select("series", "ts", "value").withColumn("k", F.row_number().over(latest)).where(F.col("k") <= LAST)
    best = F.max("value") if side == "top" else F.min("value")
    x = x.groupBy("series").agg(best.alias("best"))
    chosen = x.orderBy(F.col("best").desc() if side == "top" else F.col("best"), "series").limit(n).select("series")
    # n rows, a number that the query states.
    return values.join(F.broadcast(chosen), "series", "left_semi")


def group_tags(members: DataFrame) -> DataFrame:
    """``result, tags, aggregate_tags`` of each result, from its ``series, result, tags``.

    ``tags``: those with one value in all member series.  ``aggregate_tags``: keys that
    all members have, with two or more values.
    """
    n = members.groupBy("result").agg(F.count("*").alias("n"))
    pairs = members.select("result", F.explode("tags").alias("k", "v"))
    keys = pairs.groupBy("result", "k").agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
    told = keys.join(n, "result").where("m = n").groupBy("result").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("low") == F.col("high"), F.struct("k", "low"))))).alias("tags"),
        F.sort_array(F.collect_list(F.when(F.col("low") != F.col("high"), F.col("k")))).alias("aggregate_tags"),
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return n.join(told, "result", "left").select("result", F.coalesce("tags", empty).alias("tags"), F.coalesce("aggregate_tags", F.array().cast("array<string>")).alias("aggregate_tags"))


def listing(spark) -> DataFrame:
    """The names that clients may ask for."""
    return spark.createDataFrame([(n,) for n in LISTED], "name string")
