"""Parsers of the wire formats: text lines in, points and rejects out, all in Spark expressions.

Input frames have ``text`` and ``seq`` (arrival order).  Files, sockets and topics differ
only in the reader that supplies them; Spark's text reader also opens gzip and deflate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.staging import last_of_each, sides, staged
from ..schema import FIELD_TAG, REJECT_FROM, SECONDS, normalise_ts

# Control lines, which carry no points, and the word that begins a check-point.
CONTROL = ("version", "stats", "help", "diediedie", "_cp", "don't forward", "exit")
CHECKPOINT = "_cp"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``text, seq`` of text files, compressed or not; ``seq`` grows along each file."""
    return spark.read.text(path).select(F.col("value").alias("text"), F.monotonically_increasing_id().alias("seq"))


def _good(value: Column, ts: Column) -> Column:
    return F.coalesce(value.isNotNull() & ts.between(0, REJECT_FROM - 1), F.lit(False))


def _trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\r\n\f\v"))


def parse_raw_tags(text: Column) -> Column:
    """A map from ``k=v,k=v``; null if a pair lacks its sign or has white space before it; ``;`` alone means no tags.

    Of equal keys the last one counts.
    """
    ok = text.rlike(r"^[^=,\s]+=[^=,]+(,[^=,\s]+=[^=,]+)*$")
    pairs = F.when(_trimmed(text) == ";", F.array().cast("array<string>")).when(ok, F.split(text, ","))
    return last_of_each(*sides(pairs))


def _control(line: Column) -> Column:
    """Whole lines, but for check-points, which go on after their word."""
    return line.isin([w for w in CONTROL if w != CHECKPOINT]) | line.startswith(f"{CHECKPOINT} ")


def parse_put(lines: DataFrame, prefix: bool = True, resolution: str = SECONDS) -> tuple[DataFrame, DataFrame]:
    """``put metric ts value k=v ...`` lines as (points, rejects); control and empty lines are neither.

    A quoted metric's blanks become ``_``; of equal tag keys the last one counts.
    Datagrams have neither ``put`` nor control lines: ``prefix=False``.
    """
    line = F.rtrim("text", F.lit(" \t\r\n\f\v"))
    x = lines.select("text", "seq", line.alias("line")).where(F.col("line") != "")
    if prefix:
        x = x.where(~_control(F.col("line")))
    # A quoted metric stands between the first two quotation marks.
    q = F.split("line", '"', 3)
    quoted = (F.size(q) == 3) & (F.rtrim(q[0]) == ("put" if prefix else ""))
    whole = F.when(F.contains("line", F.lit('"')), F.when(quoted, F.concat(q[0], F.replace(q[1], F.lit(" "), F.lit("_")), F.get(q, F.lit(2))))).otherwise(F.col("line"))
    first = 1 if prefix else 0
    x = x.select("text", "seq", F.split(whole, " +", first + 4).alias("p"))
    part = lambda k: F.get("p", F.lit(first + k))
    shaped = F.lit(True) if not prefix else F.get("p", F.lit(0)) == "put"
    ts = F.when(part(1).rlike(r"^\d+$"), part(1).try_cast("long"))
    pairs = F.when(part(3).isNull(), F.array().cast("array<string>")).when(part(3).rlike(r"^(?:[^\s=]+=[^\s=]+(?: +|$))+$"), F.split(part(3), " +"))
    x = staged(x, "text", "seq", metric=part(0), given=ts, value=part(2).try_cast("double"), pairs=pairs, shaped=shaped)
    good = F.coalesce(F.col("shaped") & (F.col("metric") != "") & F.col("pairs").isNotNull(), F.lit(False)) & _good(F.col("value"), F.col("given"))
    points = x.where(good).select("metric", normalise_ts(F.col("given"), resolution).alias("ts"), "value", last_of_each(*sides(F.col("pairs"))).alias("tags"), "seq")
    return points, x.where(~good).select("text", "seq")


def parse_json(bodies: DataFrame, resolution: str = SECONDS) -> tuple[DataFrame, DataFrame]:
    """JSON puts, an object or an array per body, as (points, failures per body).

    Points keep their body's ``seq`` and have their ``place`` in it.  An unknown key fails
    its point; numbers may be quoted.  Failures: ``seq, success, failed``.
    """
    t = _trimmed(F.col("text"))
    many = F.from_json(F.when(t.startswith("{"), F.concat(F.lit("["), t, F.lit("]"))).otherwise(t), "array<map<string,string>>")
    x = bodies.select("seq", F.posexplode_outer(many).alias("place", "p"))
    known = F.size(F.array_except(F.map_keys("p"), F.array(*map(F.lit, ["metric", "timestamp", "value", "tags"])))) == 0
    field = lambda k: F.col("p")[k]
    x = staged(x, "seq", "place", metric=field("metric"), given=field("timestamp").try_cast("long"), value=field("value").try_cast("double"), tags=F.from_json(field("tags"), "map<string,string>"), known=known)
    good = F.coalesce(F.col("known") & F.col("metric").isNotNull() & F.col("tags").isNotNull(), F.lit(False)) & _good(F.col("value"), F.col("given"))
    counts = x.groupBy("seq").agg(F.count_if(good).alias("success"), F.count_if(~good).alias("failed"))
    return x.where(good).select("metric", normalise_ts(F.col("given"), resolution).alias("ts"), "value", "tags", "seq", "place"), counts


def unescape(text: Column) -> Column:
    """Line-protocol escapes: ``\\,`` to ``_C``, ``\\=`` to ``_E``, ``\\ `` to ``_S``, others to ``__``."""
    out = text
    for pattern, to in ((r"\\,", "_C"), (r"\\=", "_E"), (r"\\ ", "_S"), (r"\\.", "__")):
        out = F.regexp_replace(out, pattern, to)
    return F.when(F.contains(text, F.lit("\\")), out).otherwise(text)


def parse_line_protocol(lines: DataFrame, now: int | None = None, resolution: str = SECONDS, stop: bool = False) -> tuple[DataFrame, DataFrame]:
    """``measurement[,k=v...] f=v[,f=v...] [ts]`` as (points, rejects): one point per field, its name in ``_field``.

    A missing timestamp is ``now``, by default the time of the query.  Of equal tags or
    fields the last one counts, and a tag ``_field`` gives way to the field's name.
    ``stop``: nothing after the first bad line counts.
    """
    x = lines.select("text", "seq", _trimmed(F.col("text")).alias("line")).where(~F.col("line").startswith("#") & (F.col("line") != ""))
    x = x.select("text", "seq", F.split(unescape(F.col("line")), " +").alias("p"))
    at = lambda k: F.get("p", F.lit(k))
    moment = F.unix_seconds(F.current_timestamp()) if now is None else F.lit(now).cast("long")
    x = x.select("text", "seq", F.split(at(0), ",").alias("head"), F.split(at(1), ",").alias("fields"), F.when(at(2).isNull(), moment).otherwise(at(2).try_cast("long")).alias("given"), F.size("p").between(2, 3).alias("shaped"))
    x = x.withColumn("pairs", F.slice("head", 2, F.size("head")))
    tags, fields = sides(F.col("pairs")), sides(F.col("fields"))
    named = lambda pairs: F.forall(pairs, lambda p: F.locate("=", p) > 1)
    numbers = F.transform(fields[1], lambda v: v.try_cast("double"))
    x = staged(x, "text", "seq", metric=F.get("head", F.lit(0)), given=F.col("given"), shaped=F.col("shaped") & named("pairs") & named("fields"), tag_keys=tags[0], tag_values=tags[1], names=fields[0], numbers=numbers)
    good = F.coalesce(F.col("shaped") & F.col("metric").rlike("^[A-Za-z0-9]") & F.forall("numbers", lambda v: v.isNotNull()) & F.col("given").isNotNull(), F.lit(False))
    rejects = x.where(~good).select("text", "seq")
    if stop:
        first = x.where(~good).agg(F.min("seq").alias("bad"))
        # One row, so each task can hold it.
        x = x.join(F.broadcast(first), F.col("bad").isNull() | (F.col("seq") < F.col("bad")))
    own = last_of_each(F.col("tag_keys"), F.col("tag_values"))
    own = F.when(F.array_contains("tag_keys", FIELD_TAG), F.map_filter(own, lambda k, _: k != FIELD_TAG)).otherwise(own)
    x = x.where(good).select("metric", normalise_ts(F.col("given"), resolution).alias("ts"), own.alias("own"), "seq", F.explode(last_of_each(F.col("names"), F.col("numbers"))).alias("f", "value"))
    return x.select("metric", "ts", "value", F.map_concat("own", F.create_map(F.lit(FIELD_TAG), F.col("f"))).alias("tags"), "seq"), rejects


def parse(lines: DataFrame, kind: str | None = None, resolution: str = SECONDS) -> tuple[DataFrame, DataFrame]:
    """Put bodies, JSON or plain, as (points, rejects): by ``kind``, or by each text's first character.

    Points have ``seq`` and ``place``, so all forms are in one order of arrival.  A JSON
    body is a reject if any of its points failed.
    """
    is_json = F.coalesce(F.ltrim("text").rlike(r"^[\[{]"), F.lit(False))
    none = lines.where(F.lit(False))
    plain, bad = parse_put(none if kind == "json" else lines if kind == "plain" else lines.where(~is_json), resolution=resolution)
    bodies = none if kind == "plain" else lines if kind == "json" else lines.where(is_json)
    many, counts = parse_json(bodies, resolution)
    failed = bodies.join(counts.where("failed > 0").select("seq"), "seq", "left_semi").select("text", "seq")
    return plain.withColumn("place", F.lit(0)).unionByName(many), bad.unionByName(failed)


def parse_exposition(lines: DataFrame, now: int, host: str) -> DataFrame:
    """Prometheus text as points.

    Histograms and summaries give their mean, sum over count, under the base name; buckets
    and info metrics are left out; the tag ``host`` is added and replaces a label of that name.
    """
    x = lines.select("seq", _trimmed(F.col("text")).alias("line"))
    t = F.col("line")
    kinds = x.where(t.startswith("# TYPE ")).select(F.get(F.split(t, " +"), F.lit(2)).alias("base"), F.get(F.split(t, " +"), F.lit(3)).alias("kind")).distinct()
    form = r"^([a-zA-Z_:][\w:]*)(?:\{(.*)\})? +(\S+)(?: +(\d+))?$"
    part = lambda k: F.regexp_extract(t, form, k)
    x = staged(x.where(~t.startswith("#")), "seq", name=part(1), labels=F.regexp_extract_all(part(2), F.lit(r'(\w+="[^"]*")'), 1), value=part(3).try_cast("double"), given=F.coalesce(part(4).try_cast("long"), F.lit(now)))
    keys, values = sides(F.col("labels"))
    values = F.transform(values, lambda v: v.substr(F.lit(2), F.length(v) - 2))
    tags = last_of_each(F.concat(keys, F.array(F.lit("host"))), F.concat(values, F.array(F.lit(host))))
    x = x.where("name <> '' and value is not null").select("seq", "name", "value", "given", tags.alias("tags"), F.regexp_replace("name", "_(sum|count|bucket)$", "").alias("base"))
    x = x.join(kinds, "base", "left")
    composed = F.col("kind").isin("histogram", "summary") & (F.col("name") != F.col("base"))
    means = x.where(composed & F.col("name").rlike("_(sum|count)$")).groupBy("base", "given", F.array_sort(F.map_entries(F.col("tags"))).alias("pairs"))
    means = means.agg(F.max(F.when(F.col("name").endswith("_sum"), F.col("value"))).alias("s"), F.max(F.when(F.col("name").endswith("_count"), F.col("value"))).alias("c"), F.max("seq").alias("seq"))
    means = means.where("s is not null and c > 0").select(F.col("base").alias("metric"), normalise_ts(F.col("given")).alias("ts"), (F.col("s") / F.col("c")).alias("value"), F.map_from_entries("pairs").alias("tags"), "seq")
    plain = x.where(~F.coalesce(composed, F.lit(False)) & ~F.col("name").endswith("_info")).select(F.col("name").alias("metric"), normalise_ts(F.col("given")).alias("ts"), "value", "tags", "seq")
    return plain.unionByName(means)


def to_put(points: DataFrame) -> DataFrame:
    """Points as ``put`` lines, ``text, seq``."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ")
    return points.select(F.concat_ws(" ", F.lit("put"), "metric", F.col("ts").cast("string"), F.col("value").cast("string"), pairs).alias("text"), "seq")


def generate(spark: SparkSession, hosts: int = 10, steps: int = 360, step: int = 10, start: int = 1_700_000_000, metric: str = "load.cpu") -> DataFrame:
    """A load of points for tests and benchmarks, made by Spark."""
    n = F.col("id")
    host = F.concat(F.lit("host"), (n % hosts).cast("string"))
    return spark.range(hosts * steps).select(
        F.lit(metric).alias("metric"),
        (F.lit(start) + F.floor(n / hosts) * step).cast("long").alias("ts"),
        ((F.xxhash64("id") % 10000) / 100.0).alias("value"),
        F.create_map(F.lit("host"), host).alias("tags"),
        n.alias("seq"),
    )
