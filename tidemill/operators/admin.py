"""Administration of a store: what it holds, its own metrics as points, and the administrative verbs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.spec import QueryError
from ..schema import POINTS_SCHEMA
from .store import Store

VERSION = "0.2.0"
#: Metrics of the store itself begin with this.
OWN = "tidemill."


def version(spark: SparkSession) -> DataFrame:
    """``name, value``: versions of the library and of Spark."""
    return spark.createDataFrame([("tidemill", VERSION), ("spark", spark.version)], "name string, value string")


def config(spark: SparkSession, store: Store | None = None) -> DataFrame:
    """``name, value`` of the settings that queries and stores depend on."""
    names = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.checkpoint.dir")
    rows = [(n, spark.conf.get(n, None)) for n in names]
    if store is not None:
        rows += [("store.path", store.path), ("store.resolution", store.resolution)]
    return spark.createDataFrame(rows, "name string, value string")


def stats(store: Store) -> DataFrame:
    """``name, value``: points, series, days, batches, and days whose rollups do not hold."""
    batches = store.batches()
    counts = store.points().agg(F.count("*").alias("points")).crossJoin(store.series().agg(F.count("*").alias("series")))
    known = {"days": len(batches), "batches": sum(map(len, batches.values())), "stale_days": len(store.stale_days())}
    pairs = [F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in {"points": F.col("points"), "series": F.col("series"), **{n: F.lit(v) for n, v in known.items()}}.items()]
    return counts.select(F.inline(F.array(*pairs)))


def own_metrics(store: Store, now: int | None = None, host: str = "local") -> DataFrame:
    """``stats`` as points, to be appended to this store or another one."""
    ts = int(time.time()) if now is None else now
    x = stats(store).select(F.concat(F.lit(OWN), "name").alias("metric"), F.lit(ts).cast("long").alias("ts"), "value", F.create_map(F.lit("host"), F.lit(host)).alias("tags"), F.lit(ts).cast("long").alias("seq"))
    return x.select(*POINTS_SCHEMA.names)


def stream_metrics(spark: SparkSession, now: int | None = None) -> DataFrame:
    """The last progress of each running stream as points."""
    ts = int(time.time()) if now is None else now
    rows = []
    for q in spark.streams.active:
        p = q.lastProgress or {}
        for name in ("numInputRows", "inputRowsPerSecond", "processedRowsPerSecond"):
            if p.get(name) is not None:
                rows.append((f"{OWN}stream.{name}", ts, float(p[name]), {"stream": q.name or str(q.id)}, ts))
    return spark.createDataFrame(rows, POINTS_SCHEMA)


def _stop(store: Store, _: str) -> None:
    for q in store.spark.streams.active:
        q.stop()


#: Verbs by name: each takes the store and one text, and may return a frame.  Appends are never buffered, so ``append`` has nothing to flush.
VERBS: dict[str, Callable[[Store, str], DataFrame | None]] = {
    "append": lambda store, _: None,
    "cfg": lambda store, _: config(store.spark, store),
    "compact": lambda store, days: store.compact(*days.split(",") if days else ()),
    "cp": lambda store, text: store.add_checkpoint(text) if text else store.checkpoints(),
    "gc": lambda store, days: store.spark.createDataFrame([(d,) for d in store.retain(int(days))], "day string"),
    "log": lambda store, level: store.spark.sparkContext.setLogLevel((level or "WARN").upper()),
    "ping": lambda store, _: store.spark.createDataFrame([("pong",)], "answer string"),
    "rollup": lambda store, days: store.write_rollups(days.split(",") if days else None),
    "stat": lambda store, _: stats(store),
    "stop": _stop,
}


def admin(store: Store, verb: str, argument: str = "") -> DataFrame | None:
    """Carry out an administrative verb."""
    if verb not in VERBS:
        raise QueryError(f"unrecognized cmd: {verb}")
    return VERBS[verb](store, argument)
