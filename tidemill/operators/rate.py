"""Rates of change per second of each result, with counter options."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.spec import Rate
from ..schema import SECONDS


def rate(values: DataFrame, spec: Rate | None, resolution: str = SECONDS) -> DataFrame:
    """``result, ts, value``; the first point of a result has no rate and goes.

    A counter that falls has wrapped at ``counter_max``, unless resets are dropped: then
    the point goes, yet the next one is measured from it.  A rate over ``reset_value``
    after a wrap counts as 0.
    """
    if spec is None:
        return values
    w = Window.partitionBy("result").orderBy("ts")
    x = values.withColumn("v0", F.lag("value").over(w)).withColumn("t0", F.lag("ts").over(w)).where(F.col("t0").isNotNull())
    seconds = (F.col("ts") - F.col("t0")) / (1.0 if resolution == SECONDS else 1000.0)
    plain = (F.col("value") - F.col("v0")) / seconds
    out = plain
    if spec.counter:
        fell = F.col("value") < F.col("v0")
        if spec.drop_resets:
            x = x.where(~fell)
        else:
            wrapped = (F.lit(spec.counter_max) - F.col("v0") + F.col("value")) / seconds
            if spec.reset_value:
                wrapped = F.when(wrapped > spec.reset_value, 0.0).otherwise(wrapped)
            out = F.when(fell, wrapped).otherwise(plain)
    return x.select("result", "ts", out.alias("value"))
