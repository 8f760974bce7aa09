import gzip

from tidemill.operators.metadata import checkpoints
from tidemill.operators.store import Store
from tidemill.plans import query as Q
from tidemill.schema import POINTS_SCHEMA
from tidemill.sources import text as X
from tidemill.streaming.ingest import file_lines, hourly_stream, ingest

T0 = 1_700_000_000


def lines(spark, *texts):
    return spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "text string, seq long")


def rows(points):
    return sorted((r.metric, r.ts, r.value, tuple(sorted(r.tags.items()))) for r in points.collect())


def test_put_lines(spark):
    good, bad = X.parse_put(lines(spark, f"put a.b {T0} 1.5 h=x c=1\r", f'put "my metric" {T0}123 2', "version", "", f"put a {T0} NaN h=y", "put a x 1 h=y", f"put a {T0} z h=y", f"put a {T0} 1 h", "put a 99999999999999 1 h=y"))
    got = rows(good)
    assert got[1:] == [("a.b", T0, 1.5, (("c", "1"), ("h", "x"))), ("my_metric", T0, 2.0, ())]
    assert got[0][0] == "a" and got[0][2] != got[0][2]
    assert sorted(r.seq for r in bad.collect()) == [5, 6, 7, 8]
    assert rows(X.parse_put(lines(spark, f"a {T0} 1 h=x"), prefix=False)[0]) == [("a", T0, 1.0, (("h", "x"),))]


def test_json_puts(spark):
    one = f'{{"metric":"m","timestamp":{T0},"value":"1.5","tags":{{"a":1,"b":true}}}}'
    bodies = lines(spark, one, f'[{one},{{"metric":"n","timestamp":"{T0}","value":2,"tags":{{}}}},{{"metric":"n","timestamp":1,"value":2,"tags":{{}},"extra":1}}]', "[{")
    good, counts = X.parse_json(bodies)
    assert rows(good) == [("m", T0, 1.5, (("a", "1"), ("b", "true")))] * 2 + [("n", T0, 2.0, ())]
    assert {r.seq: (r.success, r.failed) for r in counts.collect()} == {0: (1, 0), 1: (2, 1), 2: (0, 1)}
    points, bad = X.parse(bodies.unionByName(lines(spark, f"put p {T0} 1 a=b")))
    assert len(rows(points)) == 4 and len(bad.collect()) == 2


def test_line_protocol(spark):
    texts = [r"measure\,ment4,tag4=val4,tag\ 5=val5 f4=4,f5=5.1 1234567890", r"measurement\ 5,tag\=5=val\ 5,tag\,6=val\,5 f\=4=4,f\,5=5.1 1234567890", "# comment", "measurement3 f3=3", "bad line here now", "x,y f=1 1", "m f=z 1", "late f=1 1234567890"]
    good, bad = X.parse_line_protocol(lines(spark, *texts), now=77)
    got = rows(good)
    assert ("measure_Cment4", 1234567890, 4.0, (("_field", "f4"), ("tag4", "val4"), ("tag_S5", "val5"))) in got
    assert ("measurement_S5", 1234567890, 5.1, (("_field", "f_C5"), ("tag_C6", "val_C5"), ("tag_E5", "val_S5"))) in got
    assert ("measurement3", 77, 3.0, (("_field", "f3"),)) in got and len(got) == 6
    assert sorted(r.seq for r in bad.collect()) == [4, 5, 6]
    assert len(rows(X.parse_line_protocol(lines(spark, *texts), now=77, stop=True)[0])) == 5


def test_raw_tags_exposition_and_gzip(spark, tmp_path):
    df = lines(spark, "city=seattle,state=wa", "host name=host1,cpu=2", ";", "novalue").select("seq", X.parse_raw_tags(X.F.col("text")).alias("t"))
    assert {r.seq: r.t for r in df.collect()} == {0: {"city": "seattle", "state": "wa"}, 1: None, 2: {}, 3: None}
    exposition = ["# TYPE lat histogram", 'lat_bucket{le="1"} 3', 'lat_sum{p="a"} 10', 'lat_count{p="a"} 4', "# TYPE up gauge", f"up 1 {T0}000", 'go_info{v="1"} 1']
    got = rows(X.parse_exposition(lines(spark, *exposition), now=T0, host="h1"))
    assert got == [("lat", T0, 2.5, (("host", "h1"), ("p", "a"))), ("up", T0, 1.0, (("host", "h1"),))]
    (tmp_path / "a.txt.gz").write_bytes(gzip.compress(f"put z {T0} 1 a=b\n".encode()))
    assert rows(X.parse(X.read_lines(spark, str(tmp_path)))[0]) == [("z", T0, 1.0, (("a", "b"),))]
    assert X.generate(spark, 3, 4).count() == 12
    saved = checkpoints(lines(spark, "l:c:1", "l:c:2", "l:d:x:y", "odd"))
    assert {(r.leader, r.channel): r.checkpoint for r in saved.collect()} == {("l", "c"): "2", ("l", "d"): "x:y"}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.points().count() == 0 and store.days() == []
    day = 86400
    make = lambda k, v, seq: spark.createDataFrame([("m", T0 // day * day + d * day + i, v, {"h": "a"}, seq) for d in range(k) for i in range(5)], POINTS_SCHEMA)
    store.append(make(4, 1.0, 1))
    store.append(make(2, 2.0, 2))
    assert store.points().count() == 30
    store.compact(store.days()[0])
    assert store.points().count() == 25
    store.write_series()
    store.write_rollups()
    q = f"start={T0 // day * day}&end={T0 // day * day + 4 * day - 1}&m=none:1d-sum:m"
    by_rollup = Q.Tables(store.points(), store.series(), store.hourly(), store.daily())
    got = lambda t: [(r.ts, r.value) for r in Q.get(t, q, with_tags=False).orderBy("ts").collect()]
    assert got(by_rollup) == got(Q.Tables(store.points())) and [v for _, v in got(by_rollup)] == [10.0, 10.0, 5.0, 5.0]
    assert len(store.retain(3)) == 1 and len(store.days()) == 3
    assert store.inspect().count() == 3
    store.backfill(lines(spark, f"put b {T0} 1 h=a", f"put b {T0 + 10} 1 h=a"), T0 + 5, T0 + 20)
    assert store.points().where("metric = 'b'").count() == 1


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    store = Store(spark, str(tmp_path / "s"))
    go = lambda: ingest(file_lines(spark, str(source)), store, str(tmp_path / "c"), once=True).awaitTermination()
    (source / "1.txt").write_text("".join(f"put s {T0 + 60 * i} {i} h=a\n" for i in range(120)))
    go()
    (source / "2.txt").write_text(f"put s {T0} 100 h=a\nput s {T0 + 1} 5 h=a\nbroken\n")
    go()
    assert store.rejects().count() == 1 and len(store.stale_days()) == len(store.days())
    store.write_rollups()
    assert store.stale_days() == []
    first = store.hourly().orderBy("ts").first()
    assert store.hourly().agg({"cnt": "sum"}).first()[0] == 121 and first.max == 100.0
    stream = hourly_stream(file_lines(spark, str(source)))
    query = stream.writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("hours").count() >= 1


def test_repeats_are_settled_not_errors(spark):
    good, bad = X.parse_put(lines(spark, f"put m {T0} 1 a=1 b=2 a=3", f"put m {T0} 1 a=1 b", "put m"))
    assert rows(good) == [("m", T0, 1.0, (("a", "3"), ("b", "2")))] and len(bad.collect()) == 2
    good, bad = X.parse_line_protocol(lines(spark, f"m,a=1,a=2 f=1,f=2 {T0}", f"m,_field=x,b=1 f=3 {T0}", f"m,a f=1 {T0}", f"m f {T0}"))
    assert rows(good) == [("m", T0, 2.0, (("_field", "f"), ("a", "2"))), ("m", T0, 3.0, (("_field", "f"), ("b", "1")))] and len(bad.collect()) == 2
    got = rows(X.parse_exposition(lines(spark, 'up{host="old",a="1",a="2"} 1'), now=T0, host="new"))
    assert got == [("up", T0, 1.0, (("a", "2"), ("host", "new")))]
    tags = lines(spark, "a=1,b=2,a=3").select(X.parse_raw_tags(X.F.col("text")).alias("t")).first().t
    assert tags == {"a": "3", "b": "2"}
    good, counts = X.parse_json(lines(spark, f'{{"metric":"m","timestamp":{T0},"value":1,"tags":{{"a":"1","a":"2"}}}}'))
    assert len(good.collect()) + counts.first().failed == 1


def test_control_lines_are_whole_lines(spark):
    texts = ["version", "stats", "help\r", "_cp l:c:1", "don't forward", "help me", "statsx", f"put stats.cpu {T0} 1 a=b"]
    good, bad = X.parse_put(lines(spark, *texts))
    assert [r[0] for r in rows(good)] == ["stats.cpu"] and sorted(r.text for r in bad.collect()) == ["help me", "statsx"]
    good, bad = X.parse_put(lines(spark, f"stats.cpu {T0} 1 a=b", f"help {T0} 2", "version"), prefix=False)
    assert [r[0] for r in rows(good)] == ["help", "stats.cpu"] and [r.text for r in bad.collect()] == ["version"]


def test_arrival_is_one_order_for_all_forms(spark):
    from tidemill.operators.points import last_write_wins

    point = lambda v: f'{{"metric":"m","timestamp":{T0},"value":{v},"tags":{{"a":"b"}}}}'
    got = lambda *texts: [r.value for r in last_write_wins(X.parse(lines(spark, *texts))[0]).collect()]
    assert got(f"put m {T0} 1 a=b", f"[{point(2)},{point(3)}]", f"put m {T0} 4 a=b") == [4.0]
    assert got(f"put m {T0} 1 a=b", f"[{point(2)},{point(3)}]") == [3.0]


def test_many_batches_keep_their_order(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    store = Store(spark, str(tmp_path / "s"))
    for k in range(10):
        (source / f"{k}.txt").write_text(f'[{{"metric":"m","timestamp":{T0},"value":{k},"tags":{{"a":"b"}}}},{{"metric":"m","timestamp":{T0 + 1},"value":{k},"tags":{{"a":"b"}}}}]\n')
        ingest(file_lines(spark, str(source), 1), store, str(tmp_path / "c"), renew=4, once=True).awaitTermination()
    assert store.points().count() == 20 and store.stale_days() == store.days()
    q = f"start={T0}&end={T0 + 9}&m=none:m"
    assert [r.value for r in Q.get(store.tables(), q, with_tags=False).collect()] == [9.0, 9.0]
    q = f"start={T0 // 3600 * 3600}&end={T0 + 3600}&m=sum:1h-sum:m"
    assert [r.value for r in Q.get(store.tables(), q, with_tags=False).collect()] == [18.0]
    plain = Store(spark, str(tmp_path / "p"))
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "x.txt").write_text("m,a=b f=1\n")
    ingest(file_lines(spark, str(tmp_path / "lines")), plain, str(tmp_path / "d"), kind="line", once=True).awaitTermination()
    assert plain.points().first().ts > T0


def test_writes_and_compaction_can_be_repeated(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    make = lambda v, seq: spark.createDataFrame([("m", T0 + i, v, {"h": "a"}, seq) for i in range(5)], POINTS_SCHEMA)
    for _ in range(2):
        store.append(make(1.0, 1), "one")
        store.append(make(2.0, 2), "two")
    assert store.points().count() == 10 and store.series().count() == 1
    store.write_rollups()
    q = f"start={T0 - 100}&end={T0 + 100}&m=none:m"
    values = lambda: [r.value for r in Q.get(store.tables(), q, with_tags=False).collect()]
    delete = Store._delete

    def stops(self, path):
        raise OSError("stopped")

    monkeypatch.setattr(Store, "_delete", stops)
    try:
        store.compact()
    except OSError:
        pass
    assert store.points().count() == 15 and values() == [2.0] * 5
    monkeypatch.setattr(Store, "_delete", delete)
    store.compact()
    assert store.points().count() == 5 and values() == [2.0] * 5
    assert store.maintain() == [] and store.stale_days() == []
    other = Store(spark, str(tmp_path / "o"))
    assert store.replicate(other) == 1 and store.replicate(other) == 0 and other.points().count() == 5


def test_administration(spark, tmp_path):
    import pytest

    from tidemill.operators.admin import admin, own_metrics, stream_metrics, version
    from tidemill.operators.metadata import lookup_text
    from tidemill.plans.spec import QueryError

    store = Store(spark, str(tmp_path / "s"))
    store.append(spark.createDataFrame([("m", T0, 1.0, {"h": "a"}, 1)], POINTS_SCHEMA))
    admin(store, "rollup")
    admin(store, "compact")
    assert {r.name: r.value for r in admin(store, "stat").collect()} == {"points": 1, "series": 1, "days": 1, "batches": 1, "stale_days": 0}
    admin(store, "cp", "l:c:1")
    admin(store, "cp", "l:c:2")
    assert [r.checkpoint for r in admin(store, "cp").collect()] == ["2"]
    assert admin(store, "ping").first().answer == "pong" and version(spark).count() == 2 and admin(store, "cfg").count() >= 6
    store.append(own_metrics(store, T0))
    assert stream_metrics(spark).count() == 0 and store.points().count() == 6
    assert lookup_text(store.series(), "m=m{h=a}").count() == 1
    for wrong in ("m=nothing", "limit=3"):
        with pytest.raises(QueryError):
            lookup_text(store.series(), wrong)
    with pytest.raises(QueryError):
        admin(store, "fly")
    assert len(admin(store, "gc", "0").collect()) == 1 and store.days() == []


def test_a_batch_writes_its_series_in_many_tasks(spark, tmp_path):
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    was = spark.conf.get(coalesce)
    store = Store(spark, str(tmp_path / "s"))
    spark.conf.set(coalesce, "false")
    try:
        for batch in ("one", "one", "two"):
            store.append(spark.createDataFrame([("m", T0 + d * 86400, 1.0, {"h": str(i)}, 1) for i in range(50) for d in range(2)], POINTS_SCHEMA), batch)
    finally:
        spark.conf.set(coalesce, was)
    assert len(list((tmp_path / "s" / "series" / "batch=one").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "s" / "series")).count() == 100 and store.series().count() == 50


def test_hourly_rollups_hold_rows_once(spark):
    from pyspark.sql import functions as F

    from tidemill.operators.rollup import hourly

    nan, t = float("nan"), T0 // 3600 * 3600
    points = [("m", t, 1.0, {"h": "a"}, 1), ("m", t, -0.5, {"h": "a"}, 2), ("m", t + 1, nan, {"h": "a"}, 3), ("m", t + 2, 4.0, {"h": "a"}, 4), ("m", t + 3600, nan, {"h": "a"}, 5), ("m", t, 7.0, {"h": "b"}, 6), ("n", t, 8.0, {"h": "b"}, 7), ("m", t, 9.0, {}, 8)]
    got = hourly(spark.createDataFrame(points, POINTS_SCHEMA))
    one = hourly(spark.createDataFrame(points, POINTS_SCHEMA).withColumn("metric", F.lit("m")))
    for frame in (got, one):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Sort [") == 1 and "HashAggregate" not in plan and plan.count("Exchange") == 1
    rows_ = {(r.metric, r.series, r.ts - t): (r.tags, r.cnt, r.min, r.max, str(r.sum)) for r in got.collect()}
    assert rows_ == {
        ("m", "h=a", 0): ({"h": "a"}, 3, -0.5, 4.0, "nan"),
        ("m", "h=a", 3600): ({"h": "a"}, 1, None, None, "nan"),
        ("m", "h=b", 0): ({"h": "b"}, 1, 7.0, 7.0, "7.0"),
        ("n", "h=b", 0): ({"h": "b"}, 1, 8.0, 8.0, "8.0"),
        ("m", "", 0): ({}, 1, 9.0, 9.0, "9.0"),
    }
    assert {(r.series, r.ts - t): r.cnt for r in one.collect()} == {("h=a", 0): 3, ("h=a", 3600): 1, ("h=b", 0): 1, ("", 0): 1}
