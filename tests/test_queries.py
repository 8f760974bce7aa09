import math
import random

import pytest

from tidemill.operators import rollup as R
from tidemill.operators.aggregate import listing
from tidemill.operators.metadata import lookup, suggest
from tidemill.plans import query as Q
from tidemill.plans import spec as S
from tidemill.schema import POINTS_SCHEMA, series_table
from tidemill.sources.answers import document

from . import model

T0 = 1_700_000_000


def sample(seed=1234567890, n=1500):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        tags = {"tag1": f"val{rng.randint(1, 3)}", "tag2": rng.choice(["A", "a", "b.c", "bxc"])}
        if rng.random() < 0.2:
            tags["tag3"] = "only"
        value = rng.choice([math.nan, math.inf]) if rng.random() < 0.01 else round(rng.uniform(0, 100), 3)
        rows.append((f"m{rng.randint(1, 2)}", T0 + rng.randint(0, 900), value, tags, seq))
    return rows


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(sample(), POINTS_SCHEMA).cache()


CASES = [
    *[f"none:60s-{f}:m1{{tag1=val1}}" for f in ("avg", "sum", "count", "min", "max", "dev", "first", "last", "p50", "p95")],
    *[f"{a}:60s-avg:m1{{tag1=*}}" for a in ("avg", "sum", "count", "min", "max", "dev", "p50", "p99", "top2", "bottom1")],
    "none:m2{tag2=literal_or(a|b.c)}",
    "none:m2{tag2=iliteral_or(A)}",
    "none:m2{tag2=not_literal_or(A|a)}",
    "none:m2{tag2=not_iliteral_or(a)}",
    "none:m2{tag2=wildcard(b.*)}",
    "none:m2{tag2=iwildcard(*X*)}",
    "none:m2{tag2=regexp(b.c)}",
    "none:m2{tag3=*}",
    "sum:0all-sum:m1{tag1=*}",
    "sum:100s-avg-zero:m1{tag1=*,tag2=a}",
    "count:100s-avg-nan:m1{tag1=*}{tag3=*}",
    "sum:rate:60s-sum:m1{tag1=*}",
    "sum:rate{counter,500}:60s-max:m1",
    "sum:rate{counter,500,0,drop}:60s-max:m1",
    "sum:rate{counter,500,3}:60s-max:m1{tag2=*}",
]


@pytest.mark.parametrize("m", CASES)
def test_against_model(points, m):
    query = S.Query((T0 + 37) * 1000, (T0 + 811) * 1000, (S.parse_m(m),))
    got = {(r.result, r.ts): r.value for r in Q.run(Q.Tables(points), query, with_tags=False).collect()}
    want = model.run(sample(), query, query.queries[0])
    assert got.keys() == want.keys() and want
    for k, v in want.items():
        assert math.isclose(got[k], v, rel_tol=1e-9, abs_tol=1e-9) or (math.isnan(v) and math.isnan(got[k])), (k, got[k], v)


def test_group_tags_fixture(spark):
    rows = [("g", T0, 1.0, dict(zip(("tag1", "tag2", "tag3"), v)), i) for i, v in enumerate([("val1", "val2", "val3"), ("val1", "val3", "val2"), ("val1", "val2", "val24")])]
    tables = Q.Tables(spark.createDataFrame(rows, POINTS_SCHEMA))
    run = lambda m: {r.result: (r.tags, r.aggregate_tags, r.value) for r in Q.get(tables, f"start={T0 - 3600}&end={T0 + 3600}&m={m}").collect()}
    assert run("sum:1h-avg:g{tag1=val1,tag2=*}") == {"tag1=val1,tag2=val2": ({"tag1": "val1", "tag2": "val2"}, ["tag3"], 2.0), "tag1=val1,tag2=val3": ({"tag1": "val1", "tag2": "val3", "tag3": "val2"}, [], 1.0)}
    assert set(run("sum:1h-avg:g{tag1=val1,tag3=val2|val24}")) == {"tag1=val1,tag3=val2", "tag1=val1,tag3=val24"}
    assert set(run("sum:1h-avg:g{tag1=val1,tag3=val2*}")) == {"tag1=val1,tag3=val2", "tag1=val1,tag3=val24"}
    assert run("sum:1h-avg:g")[""] == ({"tag1": "val1"}, ["tag2", "tag3"], 3.0)


def test_duplicates_and_all(spark):
    rows = [("d", T0 + i, float(k * 100 + i), {}, k * 20 + i) for k in range(10) for i in range(20)]
    tables = Q.Tables(spark.createDataFrame(rows, POINTS_SCHEMA))
    run = lambda m: [(r.ts, r.value) for r in Q.get(tables, f"start={T0}&end={T0 + 100}&m={m}", with_tags=False).orderBy("ts").collect()]
    assert run("none:d") == [(T0 + i, 900.0 + i) for i in range(20)]
    assert run("none:0all-last:d") == [(T0, 919.0)] and run("none:0all-avg:d") == [(T0, 909.5)]
    assert run("sum:rate:0all-sum:d") == []


def test_rollups_answer_alike(points):
    query = lambda m: S.Query(T0 * 1000, (T0 + 900) * 1000 + 7_200_000, (S.parse_m(m),))
    clean = points.where("not isnan(value) and value < 1000").cache()
    hourly = R.hourly(clean)
    for f in ("avg", "sum", "count", "min", "max"):
        q = query(f"sum:1h-{f}:m1{{tag1=*}}")
        rows = lambda t: sorted((r.result, r.ts, round(r.value, 6)) for r in Q.run(t, q, with_tags=False).collect())  # noqa: B023, E731
        assert rows(Q.Tables(clean)) == rows(Q.Tables(clean, hourly=hourly)) == rows(Q.Tables(clean, hourly=hourly.limit(0), invalid=clean.selectExpr("metric", "array_join(transform(array_sort(map_entries(tags)), e -> concat(e.key, '=', e.value)), ',') as series", "floor(ts / 86400) as day_number").distinct()))
    assert R.usable(S.parse_downsample("1d-avg")) == "daily" and R.usable(S.parse_downsample("90m-avg")) is None
    assert R.usable(S.parse_downsample("2h-p95")) is None and R.usable(S.parse_downsample("2h-sum"), "ROLLUP_RAW") is None


def test_errors_and_metadata(spark, points):
    tables = Q.Tables(points)
    with pytest.raises(S.QueryError):
        Q.get(tables, f"start={T0}&end={T0 - 1}&m=sum:m1")
    with pytest.raises(S.QueryError) as e:
        Q.get(tables, f"start=0&end={T0}&m=sum:1s-avg-zero:m1")
    assert e.value.status == 413
    names = lambda *a: [r.name for r in suggest(series_table(points), *a).collect()]
    assert names("metrics", "*") == ["m1", "m2"] and names("tagk", "tag") == ["tag1", "tag2", "tag3"] and names("tagv", "val", 2) == ["val1", "val2"]
    assert lookup(series_table(points), "*", S.parse_tags("tag3=only"), 5, 1).count() == 5
    assert listing(spark).count() == 23


def test_json_answer(spark):
    rows = [("j", T0, 1.5, {"h": 'a"b'}, 0), ("j", T0 + 1, float("nan"), {"h": 'a"b'}, 1), ("j", T0 + 2, float("inf"), {"h": 'a"b'}, 2), ("j", T0 + 3, 3.0, {"h": 'a"b'}, 3)]
    out = document(Q.get(Q.Tables(spark.createDataFrame(rows, POINTS_SCHEMA)), f"start={T0}&end={T0 + 9}&m=none:j"))
    assert out == '[{"metric":"j","tags":{"h":"a\\"b"},"aggregateTags":[],"dps":{"%d":1.5,"%d":"NaN","%d":"Inf","%d":3}}]' % (T0, T0 + 1, T0 + 2, T0 + 3)


def test_time_bound_reaches_the_scan(spark, tmp_path):
    from tidemill.sources import tables as D

    spark.sql("select 1L as event_id, timestamp_ntz'2024-01-06 00:00:00' as ts, 2L as user_id, 'click' as event_type, 1.0D as value, '{}' as props").write.parquet(f"{tmp_path}/events.parquet")
    df = Q.get(Q.Tables(D.events(spark, str(tmp_path))), "start=2024/01/05&end=2024/01/12&m=sum:1h-avg:events.value{event_type=click}", with_tags=False)
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-05" in plan and "EqualTo(event_type,click)" in plan and "props" not in plan
    # Points are dealt once, by series and bucket; the other exchange carries partial sums of groups.
    assert plan.count("Exchange ") == 2
    assert df.count() == 1
