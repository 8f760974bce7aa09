import pytest

from tidemill.functions import timeparse as T
from tidemill.functions.percentiles import of_list
from tidemill.functions.registry import extreme, quantile
from tidemill.plans import spec as S
from tidemill.plans.spec import QueryError


def test_instants():
    assert T.instant("1m-ago", now_ms=61_000) == 1000
    assert T.instant("2024/10/07 08:48:26") == 1728290906000
    assert T.instant("2024/10/07-08:48") == 1728290880000
    assert [T.instant("2024/10/07", tz=z) // 1000 - 1728259200 for z in ("UTC", "UTC+1", "UTC-1", "Europe/Paris")] == [0, -3600, 3600, -7200]
    assert [T.instant(x) for x in (1700000000, "1700000000", 1700000000123, "1700000000123456", 1700000000123456789)] == [1700000000000] * 2 + [1700000000123] * 3
    assert T.instant("now", now_ms=5) == 5
    for bad in ("yesterday", "5q-ago", "2024-10-07"):
        with pytest.raises(T.TimeError):
            T.instant(bad)


def test_units():
    assert [T.duration(x) for x in ("500ms", "90s", "2h", "1d", "1w", "1n", "1y", "3min")] == [500, 90_000, 7_200_000, 86_400_000, 604_800_000, 2_592_000_000, 31_536_000_000, 180_000]
    assert (T.size("10"), T.size("4kb"), T.size("1 gb")) == (10, 4096, 1 << 30)
    assert (T.convert(90, "s", "min"), T.convert(1, "h", "ms"), T.convert(1500, "us", "ms")) == (1, 3_600_000, 1)
    assert T.month_bounds(T.instant("2024/12/15")) == (T.instant("2024/12/01"), T.instant("2025/01/01"))
    with pytest.raises(T.TimeError):
        T.convert(1, "s", "fortnight")


def test_names():
    assert [quantile(x) for x in ("p50", "p999", "p100", "p9999", "avg")] == [0.5, 0.999, 1.0, pytest.approx(0.9999), None]
    assert extreme("top3") == ("top", 3) and extreme("bottom12") == ("bottom", 12) and extreme("topN") is None


def test_percentile_golden_values():
    at = {q: (of_list([26.878908, 0.0], q), of_list([0.0, 0.0], q)) for q in (0.5, 0.75, 0.9, 0.95, 0.99, 0.999)}
    assert at[0.5] == (13.439454, 0) and all(at[q] == (26.878908, 0) for q in (0.75, 0.9, 0.95, 0.99, 0.999))


def test_m_expressions():
    q = S.parse_m('avg:rate{counter,100,5,dropResets}:10s-p95-zero:my.metric{"host"="*",dc=a|b}{os=wildcard(l*)}')
    assert q.metric == "my.metric" and q.aggregator == "avg"
    assert q.downsample == S.Downsample(10_000, "p95", "zero")
    assert q.rate == S.Rate(True, 100.0, 5.0, True)
    assert q.tags == (S.TagFilter("host", "wildcard", "*"), S.TagFilter("dc", "literal_or", "a|b")) and q.filters == (S.TagFilter("os", "wildcard", "l*"),)
    assert S.parse_m("sum:explicit_tags:m{a=b}").explicit_tags and not S.parse_m("sum:explicit_tags:m").explicit_tags
    assert S.parse_m("none:0all-last:m").downsample.all
    assert S.parse_m("sum:1h:m").downsample is None and S.parse_m("sum:1h-none:m").downsample is None
    assert S.parse_m("sum:0s-sum:m").downsample.interval == 1000
    assert S.parse_m("sum:percentiles[1,2]:m") == S.parse_m("sum:m")
    assert S.parse_m("sum:rate:m").rate == S.Rate()
    for bad in ("m", "first:m", "last:m", "median:m", "sum:1y-sum:m", "sum:1h-median:m", "sum:1h-sum-prev:m", "sum:m{a}"):
        with pytest.raises(QueryError):
            S.parse_m(bad)


def test_requests():
    g = S.parse_get("start=1h-ago&m=avg%3A1m-avg%3Am%7Bhost%3D*%7D&m=sum:n", now_ms=10_000_000)
    assert (g.start, g.end, [q.metric for q in g.queries]) == (6_400_000, 10_000_000, ["m", "n"])
    p = S.parse_body('{"start": 1, "end": 2, "msResolution": true, "queries": [{"metric": "m", "aggregator": "sum", "downsample": "1m-avg", "tags": {"a": "*"}, "rate": true, "rateOptions": {"counter": true, "counterMax": 9}, "filters": [{"type": "iwildcard", "tagk": "b", "filter": "x*", "groupBy": false}]}]}')
    q = p.queries[0]
    assert p.ms and q.rate == S.Rate(True, 9.0) and q.filters == (S.TagFilter("b", "iwildcard", "x*"),)
    for bad in ("", "{}", '{"start": 1}', '{"start": 1, "queries": []}', '{"start": 1, "queries": [{}]}', "[", '{"start": "x", "queries": [{"metric": "m"}]}'):
        with pytest.raises(QueryError):
            S.parse_body(bad)
    with pytest.raises(QueryError):
        S.parse_get("m=sum:m")
    assert S.parse_loose_map("{a=b,c=*}") == {"a": "b", "c": "*"} == S.parse_loose_map('{"a": "b", "c": "*"}')
