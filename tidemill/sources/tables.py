"""The driver's tables as points."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _points(df: DataFrame, metric: str, time: str, value: str, tags: dict[str, str], seq: Column) -> DataFrame:
    """Tags keep their order by key in the series name."""
    parts: list[Column] = []
    pairs: list[Column] = []
    for k in sorted(tags):
        v = F.col(tags[k]).cast("string")
        parts.append(F.concat(F.lit(f"{k}="), v))
        pairs += [F.lit(k), v]
    return df.select(
        F.lit(metric).alias("metric"),
        F.unix_seconds(F.col(time).cast("timestamp")).alias("ts"),
        F.col(value).cast("double").alias("value"),
        F.create_map(*pairs).alias("tags"),
        seq.alias("seq"),
        F.concat_ws(",", *parts).alias("series"),
        F.col(time).alias("time"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/events.parquet")
    return _points(x, "events.value", "ts", "value", {"event_type": "event_type", "user_id": "user_id"}, F.col("event_id"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return _points(x, "orders.totalprice", "o_orderdate", "o_totalprice", {"status": "o_orderstatus", "priority": "o_orderpriority"}, F.col("o_orderkey"))


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local master without the setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemill-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/tidemill-{uuid.uuid4().hex}"
