"""Sharding by extendible hashing.

A row's 60-bit hash is read from the top.  A bucket is a hash prefix; a bucket that is
over the byte limit splits on its next bit, all others stay, until every shard fits.
The directory is never built on the driver: byte counts of prefix cells are aggregated
by Spark, and only rows of cells that are still too large go on to the next bits.

Defined results: null ids hash like the text "null"; a null or empty text has 0 bytes;
rows that agree in id share a hash and therefore a shard; when no bits are left (rows
with one id over the limit, or one row over it) the shard is given out with
``oversized`` true rather than cut; an empty table has no shards; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, release

BITS = 60
#: Bits by which cells are finer than shards on average, and bits added in each further pass.
SLACK = 4
LIMIT = 64 << 20


def hash_bits(key: Column) -> Column:
    """The first 60 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, BITS // 4), 16, 10).cast("long")


def shard(df: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, depth, shard, shard_bytes, oversized``.

    ``shard`` is the number of the prefix of ``depth`` bits.
    """
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long")
    rows = materialize(df.select(F.col(f"`{id_col}`").alias("doc_id"), size.alias("n_bytes"), hash_bits(F.col(f"`{id_col}`")).alias("h")), "shard-rows")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    done, low, high = None, 0, min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + SLACK)
    left = rows
    while True:
        cells, left_now = _split(left, low, high, limit)
        done = cells if done is None else done.unionByName(cells)
        if left_now.isEmpty():
            return done
        low, high, left = high + 1, min(BITS, high + SLACK), left_now


def _split(rows: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose bucket fits at a depth from low to high, and those that need more bits."""
    cell = F.shiftright("h", BITS - high)
    cells = materialize(rows.groupBy(cell.alias("shard")).agg(F.sum("n_bytes").alias("bytes")), "shard-cells")
    # Sums of each depth come from the next deeper one; where none fits, none does further up.
    level, depth, fits, held = cells, high, None, []
    while True:
        now = level if depth == BITS else level.where(F.col("bytes") <= limit)
        now = now.select(F.lit(depth).alias("depth"), "shard", F.col("bytes").alias("shard_bytes"))
        if depth < high and now.isEmpty():
            break
        fits, top = now if fits is None else fits.union(now), depth
        if depth == low:
            break
        level, depth = materialize(level.groupBy(F.shiftright("shard", 1).alias("shard")).agg(F.sum("bytes").alias("bytes")), "shard-level"), depth - 1
        held.append(level)
    # The shallowest prefix of each cell that fits.
    prefixes = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.shiftright("shard", high - d).alias("shard")) for d in range(top, high + 1)])).alias("at")
    asked = cells.select(F.col("shard").alias("cell"), prefixes).select("cell", "at.depth", "at.shard")
    directory = asked.join(fits, ["depth", "shard"]).groupBy("cell").agg(F.min(F.struct("depth", "shard", "shard_bytes")).alias("found"))
    directory = materialize(directory, "shard-directory")
    release(*held)
    tagged = rows.withColumn("cell", cell).join(directory, "cell", "left")
    out = tagged.where("found is not null").select("doc_id", "n_bytes", "found.depth", "found.shard", "found.shard_bytes", (F.col("found.shard_bytes") > limit).alias("oversized"))
    left = materialize(tagged.where("found is null").select("doc_id", "n_bytes", "h"), "shard-left")
    release(cells)
    return out, left


def write_shards(df: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write ``df`` as Parquet partitioned by ``shard`` (``shard_`` where ``df`` has that column); a shard's rows share one task, which its limit bounds."""
    name, key = free_name(df, "shard"), free_name(df, "_id")
    taken = shard(df, limit, id_col, text_col).select(F.col("doc_id").alias(key), F.concat_ws("-", "depth", "shard").alias(name)).distinct()
    rows = df.join(taken, F.col(f"`{id_col}`").eqNullSafe(F.col(key))).drop(key)
    rows.repartition(name).write.partitionBy(name).parquet(path)


def query(docs: DataFrame) -> DataFrame:
    return shard(docs)


def oracle(limit: int = LIMIT, depth: int = 24) -> str:
    """Valid while every shard fits within ``depth`` bits."""
    return f"""
with r as (select doc_id, cast(coalesce(strlen(text), 0) as bigint) as n_bytes, cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 15) as bigint) as h from documents),
d as (select unnest(range(0, {depth + 1})) as depth),
s as (select depth, h >> ({BITS} - depth) as shard, sum(n_bytes) as shard_bytes from r, d group by 1, 2),
f as (select doc_id, n_bytes, s.depth, s.shard, s.shard_bytes, row_number() over (partition by doc_id order by s.depth) as k
      from r cross join d join s on s.depth = d.depth and s.shard = h >> ({BITS} - d.depth) where s.shard_bytes <= {limit})
select doc_id, n_bytes, cast(depth as integer) as depth, cast(shard as bigint) as shard, cast(shard_bytes as bigint) as shard_bytes, false as oversized from f where k = 1"""
