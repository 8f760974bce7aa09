"""Line dedup by content-defined chunks and windows of lines.

A rolling hash over a text's line hashes chooses chunk boundaries, so equal stretches of
lines are cut alike wherever they stand and whatever precedes them.  A chunk of at least
``MIN_LINES`` lines that occurs more than once in the corpus stays at its first place
(smallest document id, then position); later ones are removed once their bytes have been
compared with the first one's.  Chunks alone miss short repeats amid other lines, so every
window of ``MIN_LINES`` neighbouring lines that are not blank is looked up in the same way.
A window that overlaps its own first place stays, so the first copy of a line always does.

Hashes are grouped with partial aggregation, and every join has plain shuffled sides, so
a chunk found in a third of all documents does not land in one task.

Defined results: a null text stays null, an empty one empty; a text that loses all its
lines becomes empty (``dedup_lines``) or goes (``keep_unseen``, unless it had no lines to
lose); texts of fewer than MIN_LINES lines are never touched; rows with one id are one
document, so their equal chunks are first together; null ids sort last; an empty table
gives an empty result; extra columns are carried through, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, release, slices
from .spans import KEY, cut, marked, restored, with_words

MIN_LINES = 2
#: One in so many line positions is a boundary, on average, beyond the least length.
DIVISOR = 2
#: Lines that the rolling hash looks back on.
WINDOW = 2

_MULT = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1


def chunks(data: bytes, min_lines: int = MIN_LINES, divisor: int = DIVISOR, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(first byte, byte after the last line, lines) of each chunk; the last byte excludes the line feed.

    The rolling hash is a polynomial over the last ``window`` line hashes.
    """
    lines = data.split(b"\n")
    out, start, at, first, rolling = [], 0, 0, 0, 0
    hashes: list[int] = []
    drop = pow(_MULT, window, 1 << 64)
    for i, line in enumerate(lines):
        h = xxhash.xxh3_64_intdigest(line)
        hashes.append(h)
        rolling = (rolling * _MULT + h) & _ALL
        if i >= window:
            rolling = (rolling - hashes[i - window] * drop) & _ALL
        at += len(line) + 1
        long_enough = i + 1 - first >= min_lines and len(lines) - i - 1 >= min_lines
        if (long_enough and (rolling >> 32) % divisor == 0) or i + 1 == len(lines):
            out.append((start, at - 1, i + 1 - first))
            start, first = at, i + 1
    return out


def windows(data: bytes, min_lines: int = MIN_LINES) -> Iterator[tuple[int, int]]:
    """(first byte, byte after the last line) of each ``min_lines`` neighbouring lines that are not blank."""
    at, run = 0, []
    for line in data.split(b"\n"):
        run = [*run[-min_lines + 1 :], at] if min_lines > 1 and line.strip() else [at] if line.strip() else []
        at += len(line) + 1
        if len(run) == min_lines:
            yield run[0], at - 1


def _chunks(min_lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, prints, starts, stops = [], [], [], []
                for i, t in enumerate(part.column("text").to_pylist()):
                    if not t:
                        continue
                    data = t.encode("utf-8", "surrogatepass")
                    whole = [(a, b) for a, b, n in chunks(data, min_lines) if n >= min_lines and not data[a:b].isspace() and b > a]
                    for a, b in dict.fromkeys([*whole, *windows(data, min_lines)]):
                        rows.append(i)
                        prints.append(hashlib.blake2b(data[a:b], digest_size=16).digest())
                        starts.append(a)
                        stops.append(b)
                both = np.frombuffer(b"".join(prints), dtype=np.int64).reshape(-1, 2)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(at), part.column("mark").take(at), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())],
                    names=[*KEY, "h1", "h2", "start", "stop"],
                )

    return run


def repeated_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """``doc_id, mark, start, stop`` of each chunk or window to remove: byte for byte equal to an earlier one."""
    docs = marked(df, id_col, text_col)
    kind = dict(docs.dtypes)["doc_id"]
    found = materialize(docs.mapInArrow(_chunks(min_lines), f"doc_id {kind}, mark long, h1 long, h2 long, start long, stop long"), "line-chunks")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start", "mark")
    first = materialize(found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(order).alias("first")).where("n > 1").drop("n"), "line-first")
    members = found.join(first, ["h1", "h2"]).withColumn("is_first", F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("start") == F.col("first.start")) & (F.col("mark") == F.col("first.mark")))
    # Neither the first place nor what overlaps it goes.
    members = members.where(~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("mark") != F.col("first.mark")) | F.col("is_first") | (F.col("start") >= F.col("first.start") + F.col("stop") - F.col("start")))
    # The same text under the same id is one document: its other rows' chunks are first as well.
    asked = members.groupBy(*KEY).agg(F.collect_set(F.struct("h1", "h2", "start", "stop", "is_first")).alias("asked")).select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "asked")
    held = docs.join(asked.hint("merge"), docs.doc_id.eqNullSafe(F.col("_id")) & (docs.mark == F.col("_mark"))).select(*KEY, F.encode("text", "UTF-8").alias("bytes"), F.explode("asked").alias("x"))
    piece = F.expr("substring(bytes, cast(x.start as int) + 1, cast(x.stop - x.start as int))").alias("piece")
    pieces = materialize(held.select(*KEY, "x.*", piece), "line-pieces")
    release(found, first)
    kept = pieces.where("is_first").select("h1", "h2", F.col("piece").alias("against")).dropDuplicates(["h1", "h2"])
    kept = materialize(kept, "line-kept")
    return pieces.where("not is_first").join(kept, ["h1", "h2"]).where("piece = against").select(*KEY, "start", "stop")


def _with_line_end(spans: DataFrame) -> DataFrame:
    """A removed chunk takes one line feed along: the one before it, or at a text's start the one after it."""
    first = F.col("start") == 0
    return spans.select(*KEY, F.when(first, F.col("start")).otherwise(F.col("start") - 1).alias("start"), F.when(first, F.col("stop") + 1).otherwise(F.col("stop")).alias("stop"))


def _cut_lines(df: DataFrame, id_col: str, text_col: str, min_lines: int) -> DataFrame:
    spans = materialize(_with_line_end(repeated_chunks(df, id_col, text_col, min_lines)), "line-spans")
    return cut(df, spans, id_col, text_col, as_text=True)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """``df`` with repeated chunks gone from ``text_col``, and ``cut`` as last column: the numbers of bytes, of those removed, and of spans."""
    said = F.struct("cut.n_bytes", "cut.n_removed", "cut.n_spans").alias(free_name(df, "cut"))
    return _cut_lines(df, id_col, text_col, min_lines).select(*restored(df, text_col), said)


def keep_unseen(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES) -> DataFrame:
    """``df`` with repeated chunks gone, without the texts of which nothing but white space is left."""
    return _cut_lines(df, id_col, text_col, min_lines).where(with_words()).select(*restored(df, text_col))


def query(docs: DataFrame) -> DataFrame:
    x = dedup_lines(docs.select("doc_id", "text"))
    return x.select("doc_id", "cut.n_bytes", "cut.n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))
