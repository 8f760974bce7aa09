"""Exact dedup by composable polynomial fingerprints and a chunkwise comparison.

The fingerprint of a byte string is its value as a polynomial at four points, each
modulo a prime below 2**31.  Chunks are hashed independently (one exact matrix product
for a whole batch) and combined by length-shifted arithmetic, so a huge document costs
no more memory than its chunks.  Rows with equal length and fingerprint are then
compared chunk by chunk with the row that stays; a group in which any chunk differs is
split by the texts' SHA-256 instead.

Fingerprints are grouped with partial aggregation, and both joins have plain shuffled
sides, so adaptive execution can split the key of a very large group.

Defined results: a null text counts as empty; equal texts with equal ids are told apart
by row, and exactly one row of a group stays; null ids sort after all others, and rows
without an id are compared by SHA-256 instead of chunk by chunk; ids may be of any type; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize, slices

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
POINTS = (1000003, 1299709, 15485863, 32452843)
CHUNK = 4096
COMPARED = 1 << 16

_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_RUN = re.compile(rb" {2,}")


def normalise(text: str | None) -> bytes:
    """UTF-8 of the text with every run of white space as one space."""
    return _RUN.sub(b" ", (text or "").encode("utf-8", "surrogatepass").translate(_BLANK))


def _powers() -> np.ndarray:
    out = np.ones((CHUNK, len(PRIMES)))
    for k, (p, b) in enumerate(zip(PRIMES, POINTS, strict=True)):
        x = 1
        for i in range(CHUNK - 1, -1, -1):
            out[i, k] = x
            x = x * b % p
    return out


def combine(left: tuple[int, ...], right: tuple[int, ...], right_length: int) -> tuple[int, ...]:
    """The fingerprint of a concatenation: shift the left one by the right one's length and add."""
    return tuple((a * pow(b, right_length, p) + c) % p for a, c, b, p in zip(left, right, POINTS, PRIMES, strict=True))


def chunk_hashes(chunks: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Fingerprints of rows of CHUNK bytes; sums stay below 2**53, so doubles hold them exactly."""
    return (chunks.astype(np.float64) @ powers).astype(np.int64) % np.array(PRIMES, dtype=np.int64)


def fingerprints(texts: list[bytes], powers: np.ndarray | None = None) -> list[tuple[int, ...]]:
    """One fingerprint for each text; leading zero bytes leave it alone, so only the first chunk is padded."""
    powers = _powers() if powers is None else powers
    counts = [-(-len(t) // CHUNK) for t in texts]
    total = sum(counts)
    found = np.zeros((total, len(PRIMES)), dtype=np.int64)
    block = 1024
    padded = b"".join(bytes(n * CHUNK - len(t)) + t for t, n in zip(texts, counts, strict=True))
    grid = np.frombuffer(padded, dtype=np.uint8).reshape(total, CHUNK)
    for i in range(0, total, block):
        found[i : i + block] = chunk_hashes(grid[i : i + block], powers)
    rows, at, out = found.tolist(), 0, []
    shift = [pow(b, CHUNK, p) for b, p in zip(POINTS, PRIMES, strict=True)]
    for n in counts:
        h = [0] * len(PRIMES)
        for row in rows[at : at + n]:
            h = [(x * s + c) % p for x, s, c, p in zip(h, shift, row, PRIMES, strict=True)]
        at += n
        out.append(tuple(h))
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = _powers()
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [normalise(t) for t in part.column("text").to_pylist()]
            prints = fingerprints(texts, powers)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([a << 31 | b for a, b, _, _ in prints], pa.int64()),
                    pa.array([c << 31 | d for _, _, c, d in prints], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ],
                names=["id", "size", "fp1", "fp2", "sha"],
            )


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    prints = rows.mapInArrow(_fingerprint_batches, f"id {dict(rows.dtypes)['id']}, size long, fp1 long, fp2 long, sha string")
    prints = materialize(prints.withColumn("row", F.monotonically_increasing_id()), "exact-prints")
    key = ["size", "fp1", "fp2"]
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "sha")).alias("first")
    groups = materialize(prints.groupBy(*key).agg(first, F.count("*").alias("n")), "exact-groups")
    differ = materialize(_differences(rows, prints, groups, key), "exact-differences")
    if differ.isEmpty():
        prints, groups = prints.withColumn("part", F.lit("")), groups.withColumn("part", F.lit(""))
    else:
        prints = prints.join(differ.distinct().withColumn("differs", F.lit(True)), key, "left").withColumn("part", F.when(F.col("differs"), F.col("sha")).otherwise("")).drop("differs")
        groups = prints.groupBy(*key, "part").agg(first, F.count("*").alias("n"))
    return prints.join(groups, [*key, "part"]).select(
        F.col("id").alias("doc_id"), F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("first.row")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def _differences(rows: DataFrame, prints: DataFrame, groups: DataFrame, key: list[str]) -> DataFrame:
    """Keys of groups in which some member's chunk is not the chunk of the row that stays."""
    several = groups.where("n > 1 and size > 0 and first.id is not null").select(*key, F.col("first.id").alias("keep"))
    members = prints.join(several, key).select(*key, "keep", "id").where("id is not null")
    text = F.encode(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "), "UTF-8").alias("bytes")
    held = rows.select("id", text).where("id is not null").join(members, "id")
    last = f"greatest((length(bytes) - 1) div {COMPARED}, 0)"
    pieces = F.posexplode(F.expr(f"transform(sequence(0L, {last}), i -> substring(bytes, cast(i * {COMPARED} + 1 as int), {COMPARED}))")).alias("chunk", "piece")
    chunks = held.select(*key, "keep", "id", pieces)
    kept = chunks.where("id = keep").select("keep", "chunk", F.col("piece").alias("against"))
    # Rows without an id cannot be found again by it: their SHA-256 tells them apart.
    nameless = prints.where("id is null").join(groups.where("n > 1"), key).where("sha <> first.sha").select(*key)
    return chunks.where("id <> keep").join(kept, ["keep", "chunk"], "left").where("against is null or piece <> against").select(*key).union(nameless)


def query(docs: DataFrame) -> DataFrame:
    return exact_dedup(docs)


ORACLE = """
with x as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as t from documents),
g as (select t, min(doc_id) as keep_id, count(*) as group_size from x group by t)
select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from x join g using (t)"""
