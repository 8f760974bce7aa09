"""The registered queries over the driver's tables, each with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeparse
from ..operators import admin, aggregate, filters, metadata, rollup
from ..operators.points import last_write_wins
from ..operators.store import Store
from ..schema import canonical_tags, series_table
from ..sources import tables as T
from ..sources import text
from ..sources.answers import ordered, to_json
from ..streaming.ingest import file_lines, hourly_stream, ingest
from .query import Tables, get, post
from .spec import parse_filter

#: 2024-01-01 and 2024-01-31, UTC: all events.
START, END = 1704067200, 1706659200
RANGE = "start=2024/01/01&end=2024/01/31"
HOUR = 3600

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
ORACLE: dict[str, str] = {}

#: Events as points, last write of a second wins.
BASE = "x as (select event_type, cast(user_id as varchar) as user_id, cast(floor(epoch(ts)) as bigint) as t, arg_max(value, event_id) as value from events group by 1, 2, 3)"
SERIES = "'event_type=' || event_type || ',user_id=' || user_id"


def flat(df: DataFrame, digits: int = 6) -> DataFrame:
    """``result, ts, value`` with values rounded, NaN as -1."""
    return df.select("result", "ts", F.when(F.isnan("value"), -1.0).otherwise(F.round("value", digits)).alias("value"))


def _m(text_: str, source: Callable = T.events, when: str = RANGE, digits: int = 6) -> Run:
    return lambda spark, d: flat(get(Tables(source(spark, d)), f"{when}&m={text_}", with_tags=False), digits)


def add(name: str, run: Run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql is not None:
        ORACLE[name] = sql


def legacy(values: str, q: float) -> str:
    """The percentile of rank q * (n + 1) over a list expression."""
    a, n = f"list_sort(list({values}))", f"count({values})"
    at = f"({q!r} * ({n} + 1))"
    k = f"cast(floor({at}) as bigint)"
    return f"case when {n} = 1 or {at} < 1 then ({a})[1] when {at} >= {n} then ({a})[{n}] else ({a})[{k}] + ({at} - floor({at})) * (({a})[{k} + 1] - ({a})[{k}]) end"


def down(function: str, interval: int = HOUR, lo: int = START, hi: int = END + HOUR - 1, where: str = "true") -> str:
    """The downsampling step as a CTE ``d(event_type, user_id, b, v)``."""
    return f"with {BASE}, d as (select event_type, user_id, t - t % {interval} as b, {function} as v from x where t between {lo} and {hi} and {where} group by 1, 2, 3) "


def outer(select: str, group: str, order: str = "") -> str:
    return f"select {group} as result, b as ts, round({select}, 6) as value from d group by 1, 2{order}"


# Raw points and filters.
raw = f"with {BASE} select {SERIES} as result, t as ts, round(value, 6) as value from x where t between {START} and {END} and "
add("raw_none", _m("none:events.value"), raw + "true")
_FILTERS = {
    "filter_literal": ("event_type=click", "event_type = 'click'"),
    "filter_star": ("event_type=*", "event_type is not null"),
    "filter_prefix": ("event_type=p*", "event_type like 'p%'"),
    "filter_pipe": ("event_type=click|view", "event_type in ('click', 'view')"),
    "filter_literal_or": ("user_id=literal_or(1|2|77)", "user_id in ('1', '2', '77')"),
    "filter_iliteral_or": ("event_type=iliteral_or(CLICK|Purchase)", "lower(event_type) in ('click', 'purchase')"),
    "filter_not_literal_or": ("event_type=not_literal_or(click|view)", "event_type not in ('click', 'view')"),
    "filter_not_iliteral_or": ("event_type=not_iliteral_or(CLICK)", "lower(event_type) not in ('click')"),
    "filter_wildcard": ("event_type=wildcard(*i*)", "event_type like '%i%'"),
    "filter_iwildcard": ("event_type=iwildcard(*IC*)", "event_type ilike '%ic%'"),
    "filter_regexp": ("user_id=regexp(1[0-4]%2B)", "regexp_full_match(user_id, '1[0-4]+')"),
    "filter_conjunction": ("event_type=click,user_id=1*", "event_type = 'click' and user_id like '1%'"),
}
for _name, (_tag, _sql) in _FILTERS.items():
    add(_name, _m(f"none:events.value{{{_tag}}}"), raw + _sql)
add("filter_non_grouping", _m("sum:1h-sum:events.value{event_type=*}{user_id=1*}"), down("sum(value)", where="user_id like '1%'") + outer("sum(v)", "'event_type=' || event_type"))
add("filter_explicit_tags", _m("count:1d-count:explicit_tags:events.value{event_type=*,user_id=*}"), down("count(value)", 86400, hi=END + 86399) + outer("cast(count(v) as double)", SERIES))
add("filter_unknown_metric", _m("none:no.such.metric"), raw + "false")

# Downsampling: each function, per series.
_DOWN = {"avg": "avg(value)", "sum": "sum(value)", "count": "cast(count(value) as double)", "min": "min(value)", "max": "max(value)", "dev": "stddev_pop(value)", "first": "arg_min(value, t)", "last": "arg_max(value, t)", "p50": legacy("value", 0.5), "p95": legacy("value", 0.95), "p999": legacy("value", 0.999)}
for _f, _sql in _DOWN.items():
    add(f"ds_{_f}", _m(f"none:6h-{_f}:events.value{{event_type=click}}"), down(_sql, 6 * HOUR, hi=END + 6 * HOUR - 1, where="event_type = 'click'") + f"select {SERIES} as result, b as ts, round(v, 6) as value from d")
add("ds_all_avg", _m("none:0all-avg:events.value"), f"with {BASE} select {SERIES} as result, cast({START} as bigint) as ts, round(avg(value), 6) as value from x where t between {START} and {END} group by 1")
_WEEK = 604800
_w0, _w1 = -(-START // _WEEK) * _WEEK, END // _WEEK * _WEEK + _WEEK - 1
add("ds_week_sum", _m("sum:1w-sum:events.value{event_type=*}"), down("sum(value)", _WEEK, _w0, _w1) + outer("sum(v)", "'event_type=' || event_type"))
_S, _E = START + 4 * 86400 + 1234, START + 11 * 86400 + 777
_u0, _u1 = (_S - 1) // HOUR * HOUR + HOUR, (_E - 1) // HOUR * HOUR + HOUR - 1
add("ds_unaligned_range", _m("sum:1h-avg:events.value{event_type=*}", when=f"start={_S}&end={_E}"), down("avg(value)", lo=_u0, hi=_u1) + outer("sum(v)", "'event_type=' || event_type"))
_grid = f", s as (select distinct event_type, user_id from x where event_type = 'click'), g as (select event_type, user_id, b from s, (select unnest(range({START}, {END} + 1, 86400)) as b)) "
_fill = down("avg(value)", 86400, hi=END + 86399, where="event_type = 'click'").rstrip() + _grid
add("ds_fill_zero", _m("none:1d-avg-zero:events.value{event_type=click}"), _fill + f"select {SERIES} as result, b as ts, round(coalesce(v, 0), 6) as value from g left join d using (event_type, user_id, b)")
add("ds_fill_nan", _m("none:1d-avg-nan:events.value{event_type=click}"), _fill + f"select {SERIES} as result, b as ts, round(coalesce(v, -1), 6) as value from g left join d using (event_type, user_id, b)")
add("ds_fill_then_avg", _m("avg:1d-sum-zero:events.value{event_type=click}"), _fill.replace("avg(value)", "sum(value)") + "select 'event_type=click' as result, b as ts, round(avg(coalesce(v, 0)), 6) as value from g left join d using (event_type, user_id, b) group by b")

# Aggregation across series.
_ACROSS = {"avg": "avg(v)", "sum": "sum(v)", "count": "cast(count(v) as double)", "min": "min(v)", "max": "max(v)", "dev": "stddev_pop(v)", "p50": legacy("v", 0.5), "p99": legacy("v", 0.99), "p999": legacy("v", 0.999)}
for _f, _sql in _ACROSS.items():
    add(f"agg_{_f}", _m(f"{_f}:1h-avg:events.value{{event_type=*}}"), down("avg(value)") + outer(_sql, "'event_type=' || event_type"))
for _side, _best, _order in (("top", "max", "desc"), ("bottom", "min", "asc")):
    _rank = f", r as (select event_type, user_id, {_best}(v) as best from (select *, row_number() over (partition by event_type, user_id order by b desc) as k from d) where k <= 3 group by 1, 2), c as (select event_type, user_id from r order by best {_order}, {SERIES} limit 3) "
    add(f"agg_{_side}3", _m(f"{_side}3:1h-avg:events.value"), down("avg(value)").rstrip() + _rank + f"select {SERIES} as result, b as ts, round(v, 6) as value from d semi join c using (event_type, user_id)")
add("group_by_tag", _m("sum:1h-avg:events.value{event_type=*}"), down("avg(value)") + outer("sum(v)", "'event_type=' || event_type"))
add("group_global", _m("sum:1h-avg:events.value"), down("avg(value)") + outer("sum(v)", "''"))
add("group_two_tags", _m("max:1d-max:events.value{user_id=*,event_type=click|view}"), down("max(value)", 86400, hi=END + 86399, where="event_type in ('click', 'view')") + outer("max(v)", SERIES))


def _group_meta(spark: SparkSession, d: str) -> DataFrame:
    x = get(Tables(T.events(spark, d)), f"{RANGE}&m=sum:1h-avg:events.value{{event_type=*}}")
    return x.select("result", canonical_tags(F.col("tags")).alias("tags"), F.array_join("aggregate_tags", ",").alias("aggregate_tags")).distinct()


add("group_meta", _group_meta, down("avg(value)") + "select 'event_type=' || event_type as result, 'event_type=' || event_type || case when count(distinct user_id) = 1 then ',user_id=' || min(user_id) else '' end as tags, case when count(distinct user_id) > 1 then 'user_id' else '' end as aggregate_tags from d group by event_type")

# Rates, after aggregation.
_sum = down("sum(value)").rstrip() + ", g as (select event_type, b, sum(v) as v from d group by 1, 2), r as (select *, lag(v) over (partition by event_type order by b) as v0, lag(b) over (partition by event_type order by b) as b0 from g) "
_rate = _sum + "select 'event_type=' || event_type as result, b as ts, round({}, 9) as value from r where b0 is not null{}"
_plain = "(v - v0) / (b - b0)"
_wrap = "(1000.0 - v0 + v) / (b - b0)"
add("rate_plain", _m("sum:rate:1h-sum:events.value{event_type=*}", digits=9), _rate.format(_plain, ""))
add("rate_counter", _m("sum:rate{counter,1000}:1h-sum:events.value{event_type=*}", digits=9), _rate.format(f"case when v < v0 then {_wrap} else {_plain} end", ""))
add("rate_drop_resets", _m("sum:rate{counter,1000,0,dropResets}:1h-sum:events.value{event_type=*}", digits=9), _rate.format(_plain, " and v >= v0"))
add("rate_reset_value", _m("sum:rate{counter,1000,0.1}:1h-sum:events.value{event_type=*}", digits=9), _rate.format(f"case when v < v0 then case when {_wrap} > 0.1 then 0 else {_wrap} end else {_plain} end", ""))



def _post_rate(spark: SparkSession, d: str) -> DataFrame:
    q = {"metric": "events.value", "aggregator": "sum", "downsample": "1h-sum", "rate": True, "rateOptions": {"counter": True, "counterMax": 1000, "resetValue": 0.1}, "filters": [{"type": "literal_or", "tagk": "event_type", "filter": "click|view|purchase", "groupBy": True}]}
    return flat(post(Tables(T.events(spark, d)), {"start": "2024/01/01", "end": "2024/01/31", "queries": [q]}, with_tags=False), 9)


add("post_rate_options", _post_rate, ORACLE["rate_reset_value"] + " and event_type in ('click', 'view', 'purchase')")

# Last write wins, and several sub-queries.
add(
    "dedup_last_write",
    _m("none:orders.totalprice", T.orders, "start=1990/01/01&end=2030/01/01"),
    "select 'priority=' || o_orderpriority || ',status=' || o_orderstatus as result, cast(floor(epoch(o_orderdate)) as bigint) as ts, round(arg_max(o_totalprice, o_orderkey), 6) as value from orders group by 1, 2",
)


def _multi(spark: SparkSession, d: str) -> DataFrame:
    q = {"metric": "events.value", "downsample": "1d-sum", "tags": {"event_type": "*"}}
    x = post(Tables(T.events(spark, d)), {"start": START, "end": END, "queries": [q | {"aggregator": "sum"}, q | {"aggregator": "max"}, q | {"aggregator": "sum"}]}, with_tags=False)
    return x.select("query_index", "result", "ts", F.round("value", 6).alias("value"))


_one = "select {} as query_index, 'event_type=' || event_type as result, b as ts, round({}(v), 6) as value from d group by event_type, b"
add("multi_query_union", _multi, down("sum(value)", 86400, hi=END + 86399) + " union all ".join(_one.format(i, f) for i, f in enumerate(("sum", "max", "sum"))))


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    """Results by their tags and points by time, with their places in that order."""
    x = get(Tables(T.events(spark, d)), f"{RANGE}&m=max:7d-max:events.value{{event_type=*,user_id=1*}}")
    rows = [(i, r.result, r.ts, round(r.value, 6)) for i, r in enumerate(ordered(x).toLocalIterator())]
    return spark.createDataFrame(rows, "place long, result string, ts long, value double")


add("ordered_results", _ordered, down("max(value)", _WEEK, _w0, _w1, "user_id like '1%'") + f"select row_number() over (order by event_type, user_id, b) - 1 as place, {SERIES} as result, b as ts, round(v, 6) as value from d")


# Rollups.
def _hourly(spark: SparkSession, d: str) -> DataFrame:
    x = rollup.hourly(T.events(spark, d))
    return x.select("series", "ts", "cnt", "min", "max", F.round("sum", 6).alias("sum"))


def _daily(spark: SparkSession, d: str) -> DataFrame:
    x = rollup.daily(rollup.hourly(T.events(spark, d)))
    return x.select("series", "ts", "cnt", "min", "max", F.round("sum", 6).alias("sum"))


_roll = f"with {BASE} select {SERIES} as series, t - t % {{}} as ts, count(value) as cnt, min(value) as min, max(value) as max, round(sum(value), 6) as sum from x group by 1, 2"
add("rollup_hourly", _hourly, _roll.format(HOUR))
add("rollup_daily", _daily, _roll.format(86400))


def _over_rollup(spark: SparkSession, d: str) -> DataFrame:
    points = T.events(spark, d)
    return flat(get(Tables(points, hourly=rollup.hourly(points)), f"{RANGE}&m=sum:2h-avg:events.value{{event_type=*}}", with_tags=False))


def _fallback(spark: SparkSession, d: str) -> DataFrame:
    """The rollup lacks what came late on two days; those are read from raw points."""
    points = T.events(spark, d)
    late = F.floor(F.col("ts") / 86400).isin(START // 86400 + 1, START // 86400 + 3)
    stale = rollup.hourly(points.where(~(late & (F.col("seq") % 2 == 0))))
    invalid = points.where(late).select("metric", "series", F.floor(F.col("ts") / 86400).alias("day_number")).distinct()
    return flat(get(Tables(points, hourly=stale, invalid=invalid), f"{RANGE}&m=sum:2h-avg:events.value{{event_type=*}}", with_tags=False))


_two = down("avg(value)", 2 * HOUR, hi=END + 2 * HOUR - 1) + outer("sum(v)", "'event_type=' || event_type")
add("rollup_query_avg_2h", _over_rollup, _two)
add("rollup_fallback_raw", _fallback, _two)

# Metadata.
_series = lambda spark, d: series_table(T.events(spark, d))
add("suggest_metrics", lambda s, d: metadata.suggest(_series(s, d).unionByName(series_table(T.orders(s, d))), "metrics", "*"), "select unnest(['events.value', 'orders.totalprice']) as name")
add("suggest_tagk", lambda s, d: metadata.suggest(_series(s, d), "tagk", "e"), "select 'event_type' as name")
add("suggest_tagv", lambda s, d: metadata.suggest(_series(s, d), "tagv", "1", 20), f"with {BASE} select distinct v as name from (select event_type as v from x union all select user_id from x) where v like '1%' order by 1 limit 20")
add(
    "lookup_series",
    lambda s, d: metadata.lookup(_series(s, d), "events.value", (parse_filter("event_type", "click"),), 25, 10).select("metric", "series"),
    f"with {BASE} select distinct 'events.value' as metric, {SERIES} as series from x where event_type = 'click' order by 2 limit 25 offset 10",
)


def _checkpoints(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/events.parquet")
    return metadata.checkpoints(x.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("text"), F.col("event_id").alias("seq")))


add("latest_checkpoint", _checkpoints, "select event_type as leader, cast(user_id as varchar) as channel, cast(max(event_id) as varchar) as checkpoint from events group by 1, 2")



def _lookup_text(spark: SparkSession, d: str) -> DataFrame:
    return metadata.lookup_text(_series(spark, d), "m=events.value{event_type=view,user_id=1*}&limit=30&startIndex=5").select("metric", "series")


add("lookup_text", _lookup_text, f"with {BASE} select distinct 'events.value' as metric, {SERIES} as series from x where event_type = 'view' and user_id like '1%' order by 2 limit 30 offset 5")


def _times(spark: SparkSession, d: str) -> DataFrame:
    now = 61_000
    rows = [
        ("relative", timeparse.instant("1m-ago", now)),
        ("absolute", timeparse.instant("2024/10/07 08:48:26")),
        ("east", timeparse.instant("2024/10/07", tz="UTC+1")),
        ("west", timeparse.instant("2024/10/07", tz="UTC-1")),
        ("numeric", timeparse.instant(1728290906)),
        ("converted", timeparse.convert(7200, "s", "h")),
        ("month from", timeparse.month_bounds(1728290906000)[0]),
        ("month to", timeparse.month_bounds(1728290906000)[1]),
        ("size", timeparse.size("4kb")),
    ]
    return spark.createDataFrame(rows, "name string, value long")


add(
    "time_functions",
    _times,
    "select * from (values ('relative', 1000), ('absolute', epoch_ms(timestamp '2024-10-07 08:48:26')), ('east', epoch_ms(timestamp '2024-10-06 23:00:00')), ('west', epoch_ms(timestamp '2024-10-07 01:00:00')), ('numeric', 1728290906000), ('converted', 2), ('month from', epoch_ms(timestamp '2024-10-01 00:00:00')), ('month to', epoch_ms(timestamp '2024-11-01 00:00:00')), ('size', 4096)) as t(name, value)",
)

# Wire formats: events written as text and parsed back.
_back = lambda p: p.select("metric", "ts", "value", canonical_tags(F.col("tags")).alias("series"), "seq")
_parsed = f"select 'events.value' as metric, cast(floor(epoch(ts)) as bigint) as ts, value, 'event_type=' || event_type || ',user_id=' || user_id as series, {{}} as seq from events"
add("parse_put_plain", lambda s, d: _back(text.parse_put(text.to_put(T.events(s, d)))[0]), _parsed.format("event_id"))


def _json_lines(points: DataFrame) -> DataFrame:
    return points.select(F.to_json(F.struct("metric", F.col("ts").alias("timestamp"), "value", "tags")).alias("text"), "seq")


add("parse_put_json", lambda s, d: _back(text.parse_json(_json_lines(T.events(s, d)))[0]), _parsed.format("event_id"))


def _line_lines(points: DataFrame) -> DataFrame:
    head = F.concat(F.col("metric"), F.lit(","), F.col("series"))
    return points.select(F.concat(head, F.lit(" v="), F.col("value").cast("string"), F.lit(","), F.lit("w=1 "), F.col("ts").cast("string")).alias("text"), "seq")


add("parse_line_protocol", lambda s, d: _back(text.parse_line_protocol(_line_lines(T.events(s, d)))[0]), f"select metric, ts, case f when 'v' then value else 1 end as value, '_field=' || f || ',' || series as series, seq from ({_parsed.format('event_id')}), (select unnest(['v', 'w']) as f)")


# All forms in one input: a JSON body, a plain line and a datagram's line each third event; copies that came earlier lose.
def _auto(spark: SparkSession, d: str) -> DataFrame:
    points = T.events(spark, d)
    plain = text.to_put(points.where("seq % 2 = 0"))
    early = text.to_put(points.where("seq % 2 = 1").withColumn("value", F.lit(-1.0)).withColumn("seq", F.col("seq") - 1))
    got, _ = text.parse(plain.unionByName(early).unionByName(_json_lines(points.where("seq % 2 = 1"))))
    x = last_write_wins(got)
    return x.select("series", "ts", F.round("value", 6).alias("value"))


add("parse_auto", _auto, f"with {BASE} select {SERIES} as series, t as ts, round(value, 6) as value from x")


def _escapes(spark: SparkSession, d: str) -> DataFrame:
    """Measurements, tags and fields with escaped signs, repeated tags and fields, and no timestamp."""
    x = spark.read.parquet(f"{d}/events.parquet")
    line = F.concat(F.lit(r"m\,e\ v,k\=1=a\,b,type=x,type="), "event_type", F.lit(r",_field=t f\=1=0,f\=1="), F.col("value").cast("string"))
    points, _ = text.parse_line_protocol(x.select(line.alias("text"), F.col("event_id").alias("seq")), now=START)
    return _back(points)


add("parse_escapes", _escapes, f"select 'm_Ce_Sv' as metric, cast({START} as bigint) as ts, value, '_field=f_E1,k_E1=a_Cb,type=' || event_type as series, event_id as seq from events")


def _raw_tags(spark: SparkSession, d: str) -> DataFrame:
    x = spark.read.parquet(f"{d}/events.parquet")
    form = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("a=1,type="), "event_type", F.lit(",a="), F.col("user_id").cast("string"))).when(F.col("event_id") % 3 == 1, ";").otherwise(F.concat(F.lit("bad key="), "event_type"))
    return x.select("event_id", F.coalesce(canonical_tags(text.parse_raw_tags(form)), F.lit("none")).alias("tags"))


add("parse_raw_tags", _raw_tags, "select event_id, case event_id % 3 when 0 then 'a=' || user_id || ',type=' || event_type when 1 then '' else 'none' end as tags from events")


def _exposition(spark: SparkSession, d: str) -> DataFrame:
    """Each event as a gauge, and each user as a summary of two lines; a label ``host`` gives way."""
    x = spark.read.parquet(f"{d}/events.parquet")
    at = F.lit(f" {START}")
    gauge = x.select(F.concat(F.lit('load{host="old",id="'), F.col("event_id").cast("string"), F.lit('"} '), F.col("value").cast("string"), at).alias("text"), F.col("event_id").alias("seq"))
    users = x.groupBy("user_id").agg(F.count("*").alias("n"))
    of = lambda kind, v: users.select(F.concat(F.lit(f'took_{kind}{{user="'), F.col("user_id").cast("string"), F.lit('"} '), v.cast("string"), at).alias("text"), (-F.col("user_id")).alias("seq"))
    head = spark.createDataFrame([("# TYPE took summary", -1), ("# TYPE load gauge", -1)], "text string, seq long")
    lines = head.unionByName(gauge).unionByName(of("sum", F.col("n") * 3)).unionByName(of("count", F.col("n")))
    return text.parse_exposition(lines, now=0, host="h").select("metric", "ts", "value", canonical_tags(F.col("tags")).alias("series"))


add("parse_exposition", _exposition, f"select 'load' as metric, cast({START} as bigint) as ts, value, 'host=h,id=' || event_id as series from events union all select distinct 'took', {START}, 3.0, 'host=h,user=' || user_id from events")


def _gzip(spark: SparkSession, d: str) -> DataFrame:
    """Put lines in compressed files, read back in the order of each file."""
    base = T.scratch(spark)
    text.to_put(T.events(spark, d)).select("text").write.option("compression", "gzip").text(base)
    points, _ = text.parse(text.read_lines(spark, base))
    return points.select("metric", "ts", "value", canonical_tags(F.col("tags")).alias("series"))


def _datagrams(spark: SparkSession, d: str) -> DataFrame:
    """Lines without ``put``, of metrics whose names begin like control lines."""
    points = T.events(spark, d).withColumn("metric", F.concat(F.element_at(F.array(F.lit("stats."), F.lit("help."), F.lit("version.")), (F.col("seq") % 3 + 1).cast("int")), F.lit("x")))
    lines = text.to_put(points).withColumn("text", F.substring("text", 5, 10000))
    return _back(text.parse_put(lines, prefix=False)[0])


add("parse_datagrams", _datagrams, _parsed.format("event_id").replace("'events.value' as metric", "case event_id % 3 when 0 then 'stats.x' when 1 then 'help.x' else 'version.x' end as metric"))


def _field(spark: SparkSession, d: str) -> DataFrame:
    points, _ = text.parse_line_protocol(_line_lines(T.events(spark, d)))
    return flat(get(Tables(points), f"{RANGE}&m=sum:1h-sum:events.value{{_field=v,event_type=*}}", with_tags=False))


add("filter_field", _field, down("sum(value)") + outer("sum(v)", "'_field=v,event_type=' || event_type").replace("'_field=v,event_type='", "'_field=v,event_type='"))
add("parse_gzip", _gzip, f"select metric, ts, value, series from ({_parsed.format('event_id')})")
add("aggregator_list", lambda s, d: aggregate.listing(s), "select unnest(['avg', 'bottom1', 'bottom3', 'bottom5', 'bottom9', 'count', 'dev', 'first', 'last', 'max', 'min', 'none', 'p50', 'p90', 'p95', 'p98', 'p99', 'p999', 'sum', 'top1', 'top3', 'top5', 'top9']) as name")
add("filter_list", lambda s, d: filters.listing(s).select("name"), "select unnest(['literal_or', 'iliteral_or', 'not_literal_or', 'not_iliteral_or', 'wildcard', 'iwildcard', 'regexp']) as name")


# The stored table: all events, written in two batches of which the second has what was written later.
def _stored(spark: SparkSession, d: str) -> Store:
    store = Store(spark, T.scratch(spark))
    points = T.events(spark, d).drop("time", "series")
    store.append(points.where("seq % 2 = 1"))
    store.append(points.where("seq % 2 = 0"))
    return store


def _compact(spark: SparkSession, d: str) -> DataFrame:
    store = _stored(spark, d)
    store.compact()
    return store.points().select("series", "ts", F.round("value", 6).alias("value"))


add("compact_day", _compact, f"with {BASE} select {SERIES} as series, t as ts, round(value, 6) as value from x")


def _retention(spark: SparkSession, d: str) -> DataFrame:
    store = _stored(spark, d)
    store.retain(20)
    return store.inspect().select(F.unix_date("day").cast("long").alias("day"), "series", "first", "last")


add("retention", _retention, f"with {BASE}, y as (select distinct t // 86400 as day from x order by 1 desc limit 20) select t // 86400 as day, count(distinct {SERIES}) as series, min(t) as first, max(t) as last from x where t // 86400 in (select day from y) group by 1")


def _tail(text_: str) -> Run:
    """Rollups are made after the first batch; the second one makes days stale, which are read from points."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        store = Store(spark, T.scratch(spark))
        points = T.events(spark, d).drop("time", "series")
        cut = START + 20 * 86400
        store.append(points.where(F.col("ts") < cut))
        store.write_rollups()
        # What comes later: the tail, and writes into three days that are rolled up already.
        late = F.floor((F.col("ts") - START) / 86400).isin(2, 3, 11)
        store.append(points.where((F.col("ts") >= cut) | late).withColumn("value", F.when(late, F.col("value") + 1).otherwise(F.col("value"))).withColumn("seq", F.col("seq") + 1_000_000_000))
        return flat(get(store.tables(), f"{RANGE}&m={text_}", with_tags=False))

    return run


_late = f"with {BASE}, z as (select event_type, user_id, t, case when (t - {START}) // 86400 in (2, 3, 11) then value + 1 else value end as value from x), d as (select event_type, user_id, t - t % {{0}} as b, {{1}} as v from z where t >= {{2}} group by 1, 2, 3) "
add("rollup_tail", _tail("sum:2h-avg:events.value{event_type=*}"), _late.format(2 * HOUR, "avg(value)", START) + outer("sum(v)", "'event_type=' || event_type"))
add("rollup_daily_fallback", _tail("max:2d-sum:events.value{event_type=*}"), _late.format(2 * 86400, "sum(value)", -(-START // (2 * 86400)) * 2 * 86400) + outer("max(v)", "'event_type=' || event_type"))
add(
    "json_render",
    lambda s, d: to_json(get(Tables(T.events(s, d)), f"{RANGE}&m=count:1d-count:events.value{{event_type=*}}")),
    down("count(value)", 86400, hi=END + 86399).rstrip()
    + """, n as (select event_type, b, count(v) as v from d group by 1, 2), u as (select event_type, count(distinct user_id) as users, min(user_id) as one from d group by 1)
select 0 as query_index, 'event_type=' || event_type as result, '{"metric":"events.value","tags":{"event_type":"' || event_type || '"' || case when users = 1 then ',"user_id":"' || one || '"' else '' end || '},"aggregateTags":[' || case when users > 1 then '"user_id"' else '' end || '],"dps":{' || string_agg('"' || b || '":' || v, ',' order by b) || '}}' as json
from n join u using (event_type) group by event_type, users, one""",
)


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """Events as put lines in files, streamed into a store; the rollups that the stream keeps."""
    base = T.scratch(spark)
    text.to_put(T.events(spark, d)).select("text").write.text(f"{base}/lines")
    store = Store(spark, f"{base}/store")
    ingest(file_lines(spark, f"{base}/lines"), store, f"{base}/offsets", once=True).awaitTermination()
    store.write_rollups()
    return store.hourly().select("series", "ts", "cnt", "min", "max", F.round("sum", 6).alias("sum"))


add("stream_rollup", _streamed, _roll.format(HOUR))


def _closed_hours(spark: SparkSession, d: str) -> DataFrame:
    """The append-only stream: hours that a watermark of one hour has closed, every line counted."""
    base = T.scratch(spark)
    text.to_put(T.events(spark, d)).select("text").write.text(f"{base}/lines")
    hours = hourly_stream(file_lines(spark, f"{base}/lines"))
    hours.writeStream.option("checkpointLocation", f"{base}/offsets").option("path", f"{base}/hours").format("parquet").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/hours").select("series", "ts", "cnt", "min", "max", F.round("sum", 6).alias("sum"))


add("stream_hours", _closed_hours, f"with y as (select {SERIES} as series, cast(floor(epoch(ts)) as bigint) as t, value from events) select series, t - t % 3600 as ts, count(value) as cnt, min(value) as min, max(value) as max, round(sum(value), 6) as sum from y where t - t % 3600 + 3600 <= (select max(t) from y) - 3600 group by 1, 2")


def _stats(spark: SparkSession, d: str) -> DataFrame:
    store = _stored(spark, d)
    store.write_rollups()
    store.append(T.events(spark, d).where("seq < 100").drop("time", "series"))
    return admin.own_metrics(store, START).select("metric", "ts", "value", canonical_tags(F.col("tags")).alias("series"))


add(
    "store_stats",
    _stats,
    f"""with {BASE}, e as (select *, cast(floor(epoch(ts)) as bigint) // 86400 as day from events), s as (select distinct day from e where event_id < 100),
n as (select 'points' as name, (select count(*) from e) + (select count(*) from e where event_id < 100) as value
union all select 'series', (select count(distinct {SERIES}) from x) union all select 'days', (select count(distinct day) from e)
union all select 'batches', (select count(*) from (select distinct day, event_id % 2 from e)) + (select count(*) from s) union all select 'stale_days', (select count(*) from s))
select 'tidemill.' || name as metric, cast({START} as bigint) as ts, cast(value as double) as value, 'host=local' as series from n""",
)


def _replica(spark: SparkSession, d: str) -> DataFrame:
    """A store copied twice, then kept by its timer: each point once, whatever was copied again."""
    store, other = _stored(spark, d), Store(spark, T.scratch(spark))
    store.replicate(other)
    store.replicate(other)
    other.maintain()
    return flat(get(other.tables(), f"{RANGE}&m=sum:1d-sum:events.value{{event_type=*}}", with_tags=False))


add("replicate_and_maintain", _replica, down("sum(value)", 86400, hi=END + 86399) + outer("sum(v)", "'event_type=' || event_type"))
