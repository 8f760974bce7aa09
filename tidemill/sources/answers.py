"""Answers as JSON text, made by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import tag_pairs


def number(v: Column) -> Column:
    """16 decimals without trailing zeros; NaN and infinities as texts in quotes."""
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.16f", v), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(F.isnan(v), '"NaN"').when(F.abs(v) == F.lit(float("inf")), '"Inf"').otherwise(plain)


def to_json(results: DataFrame, to_seconds: bool = False) -> DataFrame:
    """``query_index, result, json``: one object ``{metric, tags, aggregateTags, dps}`` per result, in order.

    A result's points are gathered into its row, as its answer needs them.
    """
    ts = F.floor(F.col("ts") / 1000) if to_seconds else F.col("ts")
    dps = F.sort_array(F.collect_list(F.struct(ts.alias("t"), number(F.col("value")).alias("v"))))
    x = results.groupBy("query_index", "metric", "result").agg(F.first("tags").alias("tags"), F.first("aggregate_tags").alias("aggregate_tags"), dps.alias("dps"))
    body = F.array_join(F.transform("dps", lambda d: F.concat(F.lit('"'), d["t"].cast("string"), F.lit('":'), d["v"])), ",")
    head = F.to_json(F.struct("metric", "tags", F.col("aggregate_tags").alias("aggregateTags")))
    whole = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"dps":{'), F.col("body"), F.lit("}}"))
    return x.withColumn("head", head).withColumn("body", body).select("query_index", "result", whole.alias("json"), "tags").orderBy("query_index", tag_pairs(F.col("tags")), "result").drop("tags")


def ordered(results: DataFrame) -> DataFrame:
    """Results by sub-query and by their tags (pairs in order, fewer first), points by time."""
    return results.orderBy("query_index", tag_pairs(F.col("tags")), "result", "ts")


def document(results: DataFrame, limit: str = "64mb") -> str:
    """The whole answer; too large a one is refused."""
    from ..functions.timeparse import size as parse_size
    from ..plans.spec import QueryError

    parts, size, most = [], 0, parse_size(limit)
    for row in to_json(results).toLocalIterator():
        size += len(row.json)
        if size > most:
            raise QueryError("the answer is too large", 413)
        parts.append(row.json)
    return "[" + ",".join(parts) + "]"
