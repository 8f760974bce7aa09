"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the white space of every text contract, as a Java and RE2 class.
SPACE = r"[\x20\x09-\x0D]+"


#: Whether a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where the setting is absent, a local master gets a temporary folder of its own;
    a cluster without the setting is an error, since no other folder is shared.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="tidemill-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, never a recomputation.  The
    shuffle files that the write made go with its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(schema).parquet(path)


def release(*frames: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and that nothing will read again."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = sc._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE, _INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(_BASE)
    return x ^ (x >> np.uint64(32))


_BYTES = mix(mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _STEP))
#: Bytes that ``word_hashes`` looks at together, and powers of its base and of the inverse for so many.
BUFFER = 1 << 18
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(n, BUFFER)
    if size > BUFFER or not _powers:
        made = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, dtype=np.uint64)])) for b in (_BASE, _INVERSE))
        if size > BUFFER:
            return made
        _powers[0] = made
    return _powers[0]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in a buffer of bytes, and where they start.

    A word's hash is a polynomial over a random number for each of its bytes, which comes
    from one running sum over the buffer; the length is mixed in.  The buffer is cut where
    words end, so memory is bounded but for a word that is longer than a buffer.
    """
    hashes, starts, at = [], [], 0
    while at < len(data):
        stop = min(len(data), at + BUFFER)
        if stop < len(data):
            blank = np.flatnonzero(_BLANK[data[at:stop]])
            if len(blank):
                stop = at + int(blank[-1]) + 1
            else:
                after = next((k for k in range(stop, len(data), BUFFER) if _BLANK[data[k : k + BUFFER]].any()), None)
                stop = len(data) if after is None else after + int(np.argmax(_BLANK[data[after : after + BUFFER]])) + 1
        h, s = _hashes(data[at:stop])
        hashes.append(h)
        starts.append(s + at)
        at = stop
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    blank = np.ones(n + 2, dtype=bool)
    blank[1:-1] = _BLANK[data]
    starts, ends = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    power, inverse = _powers_of(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * power[:n], out=sums[1:])
    return mix(mix((sums[ends] - sums[starts]) * inverse[starts]) + (ends - starts).astype(np.uint64) * _STEP), starts


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as make it differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """Words of a text as an array; no words for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that ``column`` holds about ``limit`` bytes in each piece (a longer row stands alone)."""
    held, start = 0, 0
    for i, x in enumerate(batch.column(column)):
        size = 0 if not x.is_valid else x.as_buffer().size
        if held and held + size > limit:
            yield batch.slice(start, i - start)
            held, start = 0, i
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
