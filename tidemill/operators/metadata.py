"""Suggestions and series lookups over the catalogue."""

from __future__ import annotations

from urllib.parse import parse_qs

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.spec import QueryError, TagFilter, parse_filter, parse_loose_map
from .filters import matching


def suggest(series: DataFrame, kind: str, prefix: str = "", limit: int = 1000) -> DataFrame:
    """``name``: metrics, tag keys or tag values that start with a prefix, in order, at most ``limit``."""
    if kind == "metrics":
        names = series.select(F.col("metric").alias("name"))
        prefix = "" if prefix == "*" else prefix
    elif kind == "tagk":
        names = series.select(F.explode(F.map_keys("tags")).alias("name"))
    elif kind == "tagv":
        names = series.select(F.explode(F.map_values("tags")).alias("name"))
    else:
        raise QueryError(f"cannot suggest {kind!r}")
    return names.where(F.col("name").startswith(prefix)).distinct().orderBy("name").limit(limit)


def lookup(series: DataFrame, metric: str, filters: tuple[TagFilter, ...] = (), limit: int = 25, start: int = 0, strict: bool = False) -> DataFrame:
    """``metric, series, tags, tsuid`` of matching series, a page of them in order; ``*`` stands for any metric.

    ``strict``: an error if no series matches, which takes a job to find out.
    """
    x = series if metric == "*" else series.where(F.col("metric") == metric)
    x = x.where(matching(filters)).withColumn("tsuid", F.hex(F.xxhash64("metric", "series")))
    if strict and x.isEmpty():
        raise QueryError(f"no series of metric {metric!r} match", 400)
    return x.orderBy("metric", "series").offset(start).limit(limit)


def lookup_text(series: DataFrame, query: str) -> DataFrame:
    """``lookup`` for the query string of a GET: ``m=metric{k=v,...}``, ``limit`` and ``startIndex``; no match is an error."""
    p = parse_qs(query.lstrip("?"))
    if "m" not in p:
        raise QueryError("m is missing")
    metric, brace, tags = p["m"][-1].partition("{")
    filters = tuple(parse_filter(k, v) for k, v in parse_loose_map(brace + tags).items()) if brace else ()
    return lookup(series, metric, filters, int(p.get("limit", ["25"])[-1]), int(p.get("startIndex", ["0"])[-1]), strict=True)


def checkpoints(lines: DataFrame) -> DataFrame:
    """``leader, channel, checkpoint``: the last of each, from rows ``text leader:channel:cp, seq``."""
    parts = F.split("text", ":", 3)
    x = lines.select(F.get(parts, F.lit(0)).alias("leader"), F.get(parts, F.lit(1)).alias("channel"), F.get(parts, F.lit(2)).alias("checkpoint"), "seq").where("checkpoint is not null")
    return x.groupBy("leader", "channel").agg(F.max_by("checkpoint", "seq").alias("checkpoint"))
