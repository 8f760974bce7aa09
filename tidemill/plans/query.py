"""From a query to a lazy DataFrame.

``run`` never starts a job: every bound comes from the query.  The order of steps is
select, last write wins, downsample, fill, aggregate, rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rollup as R
from ..operators.aggregate import aggregate, group_tags
from ..operators.downsample import downsample, fill
from ..operators.points import Bounds, bounds, in_range, matching_series, select, with_result
from ..operators.rate import rate
from ..schema import SECONDS, named, series_table, tag_pairs, with_series
from .spec import Query, QueryError, SubQuery, parse_body, parse_get


class Tables:
    """What queries read: points, and optionally the catalogue and rollups.

    Rollups answer for all points but those of ``invalid(metric, series, day_number)`` and
    of the days ``stale`` (numbers since the epoch), which are read raw; whoever gives
    rollups without them vouches that the rollups are complete.  ``Store.tables`` gives both.
    """

    def __init__(self, points: DataFrame, series: DataFrame | None = None, hourly: DataFrame | None = None, daily: DataFrame | None = None, invalid: DataFrame | None = None, resolution: str = SECONDS, stale: frozenset[int] = frozenset()):
        self.points, self.hourly, self.daily, self.invalid, self.resolution, self.stale = points, hourly, daily, invalid, resolution, stale
        self._series = series

    @property
    def series(self) -> DataFrame:
        return series_table(self.points) if self._series is None else self._series


def _rollup(tables: Tables, sub: SubQuery) -> DataFrame | None:
    """The coarsest rollup that can answer: daily, else hourly, else none."""
    use = R.usable(sub.downsample, sub.rollup)
    return tables.daily if use == "daily" and tables.daily is not None else tables.hourly if use else None


def _rows(tables: Tables, rollup: DataFrame, sub: SubQuery) -> DataFrame:
    """Matching rollup rows, those that do not hold made anew from points."""
    rows = matching_series(rollup, sub)
    if tables.invalid is not None or tables.stale:
        rows = R.with_fallback(rows, with_series(matching_series(tables.points, sub)), tables.invalid, tables.stale, tables.resolution)
    return with_result(rows, sub)


def _downsampled(tables: Tables, sub: SubQuery, b: Bounds) -> DataFrame:
    """``series, result, ts, value`` of each series and bucket."""
    rollup = _rollup(tables, sub)
    if rollup is not None:
        return R.from_rollup(_rows(tables, rollup, sub), sub.downsample.function, b)
    return downsample(select(tables.points, sub, b, tables.resolution), sub.downsample, b)


def _members(tables: Tables, sub: SubQuery, b: Bounds) -> DataFrame:
    """``series, result, tags`` of the series with values in range, or of all that match where gaps are filled.

    Taken from the table that answers by a partial aggregation, before any other step.
    """
    rollup = _rollup(tables, sub)
    if sub.downsample is not None and sub.downsample.fill != "none":
        rows = matching_series(tables.series, sub)
    elif rollup is not None:
        rows = _rows(tables, rollup, sub).where(F.col("ts").between(b.scan_from, b.scan_to)).where("cnt > 0")
    else:
        rows = with_series(in_range(matching_series(tables.points, sub), b, tables.resolution))
    rows = rows.groupBy(tag_pairs(F.col("tags")).alias("pairs")).agg(F.lit(1)).select(*named(F.col("pairs")))
    return with_result(rows, sub)


def run_one(tables: Tables, query: Query, sub: SubQuery, with_tags: bool = True) -> DataFrame:
    """``metric, result, ts, value`` and, with tags, ``tags, aggregate_tags`` of one sub-query."""
    if query.end < query.start:
        raise QueryError("end is before start")
    b = bounds(query.start, query.end, sub, tables.resolution)
    values = _downsampled(tables, sub, b)
    if sub.downsample is not None and sub.downsample.fill != "none":
        values = fill(values, with_result(matching_series(tables.series, sub), sub), sub.downsample, b)
    out = rate(aggregate(values, sub), sub.rate, tables.resolution)
    out = out.select(F.lit(sub.metric).alias("metric"), "result", "ts", "value")
    return out.join(group_tags(_members(tables, sub, b)), "result").select("metric", "result", "ts", "value", "tags", "aggregate_tags") if with_tags else out


def run(tables: Tables, query: Query, with_tags: bool = True) -> DataFrame:
    """All sub-queries, one after the other, with their number in ``query_index``."""
    if not query.queries:
        raise QueryError("queries are missing")
    parts = [run_one(tables, query, sub, with_tags).withColumn("query_index", F.lit(i)) for i, sub in enumerate(query.queries)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def get(tables: Tables, text: str, now_ms: int | None = None, with_tags: bool = True) -> DataFrame:
    return run(tables, parse_get(text, now_ms), with_tags)


def post(tables: Tables, body: str | dict, now_ms: int | None = None, with_tags: bool = True) -> DataFrame:
    return run(tables, parse_body(body, now_ms), with_tags)
