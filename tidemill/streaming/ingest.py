"""Continuous ingest: any line source into a store.

Late points are never dropped.  Each micro-batch is appended, which makes the days that it
touched stale; their rollups are made anew every so often, and queries read stale days
from points, so answers are right whatever the order of arrival.  ``hourly_stream`` is the append-only alternative: windows close behind a
watermark, and what comes later reaches the points table only.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store, batch_name
from ..schema import with_series
from ..sources.text import parse, parse_line_protocol, parse_put


def file_lines(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """New text files of a folder as lines."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path).select(F.col("value").alias("text"))


def socket_lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    return spark.readStream.format("socket").option("host", host).option("port", port).load().select(F.col("value").alias("text"))


def kafka_lines(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load().select(F.col("value").cast("string").alias("text"))


def ingest(lines: DataFrame, store: Store, checkpoint: str, kind: str = "put", renew: int = 0, once: bool = False) -> StreamingQuery:
    """Start the stream.  Later batches, and later lines of one, win over earlier ones.

    Within a batch the order of arrival decides, so its points then only carry the batch's
    number, which never overflows.  A batch that is run again replaces its first run.
    Lines without a timestamp get the time at which their batch began; what no parser
    takes goes to the store's rejects.  Every ``renew`` batches stale rollups are made
    anew (0: never; ``store.write_rollups`` does it when called); until then queries read
    stale days from points.
    """

    def batch(frame: DataFrame, number: int) -> None:
        numbered = frame.withColumn("seq", F.monotonically_increasing_id()).persist()
        name = batch_name(checkpoint, number)
        try:
            if kind == "line":
                points, rejects = parse_line_protocol(numbered, now=int(time.time()), resolution=store.resolution)
            else:
                points, rejects = parse(numbered, None if kind == "put" else kind, store.resolution)
            store.append(points, name, number)
            store.reject(rejects, name)
        finally:
            numbered.unpersist()
        if renew and (number + 1) % renew == 0:
            store.write_rollups()

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def hourly_stream(lines: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """``metric, series, ts, cnt, min, max, sum`` of each closed hour, from put lines as they come."""
    points, _ = parse_put(lines.withColumn("seq", F.lit(0).cast("long")))
    x = with_series(points).withColumn("time", F.timestamp_seconds("ts")).withWatermark("time", lateness)
    out = x.groupBy(F.window("time", "1 hour"), "metric", "series").agg(F.count("value").alias("cnt"), F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"))
    return out.select("metric", "series", F.unix_seconds("window.start").alias("ts"), "cnt", "min", "max", "sum")
