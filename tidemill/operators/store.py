"""A points table on disk: Parquet partitioned by UTC day and batch, sorted for row-group pruning.

Every append writes batches of its own, so repeating one (a stream's batch after a
failure) replaces what it wrote before.  A later write of the same point wins when the
table is read, and ``compact`` makes that final for a day.  Days are the unit of
rewriting, of rollups and of retention.

A day's rollups hold while the day has the batches that they were made from; the table
``rolled`` says which.  Days with other batches are stale, and ``tables`` has queries read
them from points.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.query import Tables
from ..schema import POINTS_SCHEMA, SECONDS, arrival, named, series_table, tag_pairs, with_day, with_series
from . import rollup as R
from .metadata import checkpoints

ROLLED_SCHEMA = "batch string, day date"


def _date(day: str) -> dt.date:
    return dt.date.fromisoformat(day)


class Store:
    """Tables below ``path``: points, series, hourly and daily rollups, which days they hold for, and rejects."""

    def __init__(self, spark: SparkSession, path: str, resolution: str = SECONDS):
        self.spark, self.path, self.resolution = spark, path.rstrip("/"), resolution

    def _at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def _fs(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf), p

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _folders(self, path: str, key: str) -> list[str]:
        """Values of the partition folders ``key=...`` in a folder."""
        fs, p = self._fs(path)
        if not fs.exists(p):
            return []
        return sorted(n.removeprefix(f"{key}=") for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith(f"{key}="))

    def _replace(self, frame: DataFrame, name: str, *by: str) -> None:
        """Write ``frame`` in place of the partitions that it has rows of."""
        frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(self._at(name))

    def exists(self, name: str) -> bool:
        fs, p = self._fs(self._at(name))
        return fs.exists(p)

    def append(self, points: DataFrame, batch: str | None = None, seq: int | None = None) -> None:
        """Add points and their series.  ``batch`` names the write: the same name again replaces it.

        ``seq``: the number that all its points get; of equal ones the last by arrival is kept then.
        Rows of a day and series lie together, so scans skip row groups; files are cut by
        ranges, so a series with a third of all points is several tasks' work.
        """
        if seq is not None or "place" in points.columns:
            x = points.groupBy("metric", tag_pairs(F.col("tags")).alias("pairs"), "ts").agg(F.max_by("value", arrival(points)).alias("value"), F.max("seq").alias("seq"))
            points = x.select("metric", "ts", "value", *named(F.col("pairs")), (F.col("seq") if seq is None else F.lit(seq)).cast("long").alias("seq"))
        name = batch or f"a{uuid.uuid4().hex}"
        x = with_day(with_series(points), self.resolution).select("metric", "ts", "value", "tags", "seq", "series", "day", F.lit(name).alias("batch"))
        self._replace(x.repartitionByRange("day", "metric", "series", "ts").sortWithinPartitions("day", "batch", "metric", "series", "ts"), "points", "day", "batch")
        if self.exists("points"):
            # In as many tasks as the shuffle has: one for all would sort the whole catalogue.
            self._replace(series_table(self._all().where(F.col("batch") == name)).withColumn("batch", F.lit(name)), "series", "batch")

    def _all(self) -> DataFrame:
        return self.spark.read.schema("metric string, ts long, value double, tags map<string,string>, seq long, series string, day date, batch string").parquet(self._at("points"))

    def points(self) -> DataFrame:
        if not self.days():
            return with_day(with_series(self.spark.createDataFrame([], POINTS_SCHEMA)), self.resolution)
        return self._all().drop("batch")

    def days(self) -> list[str]:
        """Days with points, the oldest first."""
        return self._folders(self._at("points"), "day")

    def batches(self) -> dict[str, set[str]]:
        """The batches of each day, from one listing."""
        fs, p = self._fs(f"{self._at('points')}/day=*/batch=*")
        out: dict[str, set[str]] = {}
        for s in fs.globStatus(p) or []:
            place = s.getPath()
            out.setdefault(place.getParent().getName().removeprefix("day="), set()).add(place.getName().removeprefix("batch="))
        return out

    def compact(self, *days: str) -> None:
        """Rewrite days (all by default) with each point once, the last written; other days stay as they are.

        The new batches are written aside in one job, then day by day moved into place and
        the old ones deleted.  Wherever this stops, each day tells the same points: what is
        there twice is the same write.
        """
        there, stale = self.batches(), set(self.stale_days())
        old = {d: there[d] for d in days or there if d in there}
        if not old:
            return
        x = self._all().where(F.col("day").isin([_date(d) for d in old]))
        # Batches that come in meanwhile are not read, as they are not deleted either.
        x = x.where(F.col("batch").isin(sorted(set().union(*old.values()))))
        once = x.groupBy("day", "metric", tag_pairs(F.col("tags")).alias("pairs"), "ts").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
        once = once.select("metric", "ts", "value", *named(F.col("pairs")), "seq", "day").select("metric", "ts", "value", "tags", "seq", "series", "day")
        new = f"c{uuid.uuid4().hex}"
        aside = self._at(f"compacting/{new}")
        once.repartitionByRange("day", "metric", "series", "ts").sortWithinPartitions("day", "metric", "series", "ts").write.partitionBy("day").parquet(aside)
        for day, batches in old.items():
            self._move(f"{aside}/day={day}", f"{self._at('points')}/day={day}/batch={new}")
            for batch in batches:
                self._delete(f"{self._at('points')}/day={day}/batch={batch}")
        self._delete(aside)
        self._note({d: {new} for d in old if d not in stale})

    def _move(self, path: str, to: str) -> None:
        fs, old = self._fs(path)
        if not fs.rename(old, self._fs(to)[1]):
            raise OSError(f"could not move {path} to {to}")

    def retain(self, days: int) -> list[str]:
        """Keep the newest days; returns those deleted, whose rollups go as well."""
        gone = self.days()[:-days] if days else self.days()
        for day in gone:
            for name in ("hourly", "daily", "rolled", "points"):
                self._delete(f"{self._at(name)}/day={day}")
        return gone

    def write_series(self) -> None:
        """Rewrite the catalogue from the points."""
        x = series_table(self.points()).withColumn("batch", F.lit("all"))
        x.write.mode("overwrite").partitionBy("batch").parquet(self._at("series"))

    def series(self) -> DataFrame:
        if not self.exists("series"):
            return series_table(self.points())
        return series_table(self.spark.read.parquet(self._at("series")).drop("batch"))

    def stale_days(self) -> list[str]:
        """Days whose rollups are missing or older than their points."""
        rolled: dict[str, set[str]] = {}
        if self.exists("rolled"):
            for row in self.spark.read.schema(ROLLED_SCHEMA).parquet(self._at("rolled")).collect():
                rolled.setdefault(str(row.day), set()).add(row.batch)
        return [d for d, batches in sorted(self.batches().items()) if batches != rolled.get(d)]

    def _note(self, batches: dict[str, set[str]]) -> None:
        """Remember what the rollups of days were made from."""
        rows = [(b, _date(d)) for d in batches for b in batches[d]]
        if rows:
            self._replace(self.spark.createDataFrame(rows, ROLLED_SCHEMA).coalesce(1), "rolled", "day")

    def write_rollups(self, days: list[str] | None = None) -> None:
        """Make the rollups of stale days, or of the given ones, anew from all their points."""
        # Listed before the points are read: what comes in meanwhile leaves its day stale.
        batches = {d: b for d, b in self.batches().items() if days is None or d in days}
        days = [d for d in (self.stale_days() if days is None else days) if d in batches]
        if not days:
            return
        wanted = F.col("day").isin([_date(d) for d in days])
        self._replace(with_day(R.hourly(self.points().where(wanted), self.resolution), self.resolution), "hourly", "day")
        self._replace(with_day(R.daily(self.hourly().where(wanted), self.resolution), self.resolution), "daily", "day")
        self._note({d: batches[d] for d in days})

    def hourly(self) -> DataFrame:
        return self.spark.read.parquet(self._at("hourly"))

    def daily(self) -> DataFrame:
        return self.spark.read.parquet(self._at("daily"))

    def tables(self) -> Tables:
        """What queries need: rollups answer for the days that they hold for, points for the others."""
        rollups = {"hourly": self.hourly(), "daily": self.daily()} if self.exists("daily") else {}
        stale = frozenset((_date(d) - R.EPOCH).days for d in self.stale_days()) if rollups else frozenset()
        return Tables(self.points(), self.series(), resolution=self.resolution, stale=stale, **rollups)

    def backfill(self, lines: DataFrame, start: int, end: int) -> None:
        """Append the put lines whose points lie in [start, end]."""
        from ..sources.text import parse

        points, _ = parse(lines, resolution=self.resolution)
        self.append(points.where(F.col("ts").between(start, end)))

    def maintain(self, compact_after: int = 1, retain: int | None = None) -> list[str]:
        """What a timer is to do now and then; returns the days compacted.

        Retention first; then days that are ``compact_after`` or more behind the newest one
        and lie in several batches are compacted; last, stale rollups are made anew.
        """
        if retain is not None:
            self.retain(retain)
        there = self.batches()
        old = sorted(there)[: -compact_after or None]
        ripe = [d for d in old if len(there[d]) > 1]
        if ripe:
            self.compact(*ripe)
        self.write_rollups()
        return ripe

    def replicate(self, to: Store) -> int:
        """Copy the batches that another store lacks, under their names, so copying again changes nothing; returns how many."""
        theirs = to.batches()
        lacking = {b for d, batches in self.batches().items() for b in batches - theirs.get(d, set())}
        for batch in sorted(lacking):
            to.append(self._all().where(F.col("batch") == batch).select("metric", "ts", "value", "tags", "seq", "series"), batch)
        return len(lacking)

    def add_checkpoint(self, text: str) -> None:
        """Remember ``leader:channel:checkpoint``."""
        row = self.spark.createDataFrame([(text, time.time_ns())], "text string, seq long")
        row.coalesce(1).write.mode("append").parquet(self._at("checkpoints"))

    def checkpoints(self) -> DataFrame:
        """The last check-point of each leader and channel."""
        kinds = "text string, seq long"
        lines = self.spark.read.schema(kinds).parquet(self._at("checkpoints")) if self.exists("checkpoints") else self.spark.createDataFrame([], kinds)
        return checkpoints(lines)

    def reject(self, rejects: DataFrame, batch: str) -> None:
        """Keep the lines that no parser took, ``text, seq``, by batch."""
        self._replace(rejects.withColumn("batch", F.lit(batch)), "rejects", "batch")

    def rejects(self) -> DataFrame:
        return self.spark.read.schema("text string, seq long, batch string").parquet(self._at("rejects"))

    def inspect(self) -> DataFrame:
        """Points, series and range of each day."""
        return self.points().groupBy("day").agg(F.count("*").alias("points"), F.count_distinct("metric", "series").alias("series"), F.min("ts").alias("first"), F.max("ts").alias("last")).orderBy("day")


def batch_name(source: str, number: int) -> str:
    """The name of a stream's batch, from its check-point folder and number."""
    return f"s{hashlib.sha256(source.encode()).hexdigest()[:12]}-{number:012d}"
