"""Downsampling within a series, and the fill of empty buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.percentiles import ranked
from ..functions.registry import DOWNSAMPLERS, quantile
from ..plans.spec import Downsample, QueryError
from .points import Bounds

#: Rows that a fill grid may have for each series.
MAX_BUCKETS = 10_000_000
COLUMNS = ["series", "result", "ts", "value"]


def downsample(points: DataFrame, spec: Downsample | None, b: Bounds) -> DataFrame:
    """``series, result, ts, value`` with one row per series and bucket."""
    if spec is None:
        return points.select(*COLUMNS)
    x = points if "bucket" in points.columns else points.withColumn("bucket", F.lit(b.start).cast("long"))
    keys = ["series", "result", "bucket"]
    q = quantile(spec.function)
    out = ranked(x, keys, q) if q is not None else x.groupBy(*keys).agg(DOWNSAMPLERS[spec.function](F.col("value"), F.col("ts")).alias("value"))
    return out.withColumnRenamed("bucket", "ts").select(*COLUMNS)


def fill(values: DataFrame, series: DataFrame, spec: Downsample | None, b: Bounds) -> DataFrame:
    """Every bucket of every series of ``series(series, result)``, empty ones as 0 or NaN.

    ``series`` is the matching catalogue: a series without points in range is filled too.
    """
    if spec is None or spec.fill == "none":
        return values
    if b.buckets > MAX_BUCKETS:
        raise QueryError("the range has too many buckets to fill", 413)
    if not b.interval:
        grid = series.select("series", "result", F.lit(b.start).cast("long").alias("ts"))
    elif b.first > b.last:
        return values.limit(0)
    else:
        step = F.sequence(F.lit(b.first).cast("long"), F.lit(b.last).cast("long"), F.lit(b.interval).cast("long"))
        grid = series.select("series", "result", F.explode(step).alias("ts"))
    empty = F.lit(0.0) if spec.fill == "zero" else F.lit(float("nan"))
    return grid.join(values.select("series", "ts", "value"), ["series", "ts"], "left").select("series", "result", "ts", F.coalesce("value", empty).alias("value"))
