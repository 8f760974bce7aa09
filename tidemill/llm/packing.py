"""Packing into length buckets that a dynamic programme makes optimal.

Texts are cut into sequences of at most ``max_tokens`` tokens (words here; any length
column will do).  The histogram of sequence lengths has at most ``max_tokens`` entries,
so it fits on the driver at every input size.  A dynamic programme over it finds the
bucket boundaries with the least padding; inside each bucket, sequences fill batches
whose padded size stays within a token budget.

Batches need a running number inside each bucket, by id and piece, so it does not depend
on how the table is stored.  Sequences are sorted in ranges, which rows of one id share
if need be, and written; each partition counts its rows by bucket, the counts become offsets, and a
row's number is its partition's offset plus its place there.  So one bucket may hold any
share of the rows.

Defined results: texts without words give one sequence of 0 tokens, in the first
bucket; an empty table gives an empty result; repeated rows are packed one by one; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, words

MAX_TOKENS = 4096
BUCKETS = 16
BUDGET = 1 << 16


def boundaries(histogram: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    cost(i, j) pads lengths i..j up to the j-th length.  It satisfies the quadrangle
    inequality, so the best split points are monotone and each layer is solved by
    divide and conquer: O(buckets * n * log n).
    """
    lengths = sorted(histogram)
    n = len(lengths)
    if n == 0:
        return []
    counts = np.cumsum([0] + [histogram[x] for x in lengths])
    tokens = np.cumsum([0] + [histogram[x] * x for x in lengths])
    buckets = min(buckets, n)
    size = np.array(lengths, dtype=np.int64)

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        """Padding of lengths[i:j] as one bucket."""
        return size[j - 1] * (counts[j] - counts[i]) - (tokens[j] - tokens[i])

    best = np.array([0] + [int(cost(np.array(0), j)) for j in range(1, n + 1)], dtype=np.int64)
    cuts = []
    for _ in range(1, buckets):
        now, cut = best.copy(), np.full(n + 1, -1, dtype=np.int64)
        todo = [(1, n, 0, n - 1)]
        while todo:
            a, b, low, high = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(low, min(high, j - 1) + 1)
            total = best[i] + cost(i, j)
            k = int(np.argmin(total))
            if total[k] < now[j]:
                now[j], cut[j] = total[k], i[k]
            todo += [(a, j - 1, low, int(i[k])), (j + 1, b, int(i[k]), high)]
        best = now
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if cut[j] >= 0:
            out.append(lengths[j - 1])
            j = int(cut[j])
            if j == 0:
                break
    if j:
        out.append(lengths[j - 1])
    return sorted(out)


def sequences(df: DataFrame, n_tokens: Column, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, piece, start, n_tokens``: each text cut at multiples of ``max_tokens``."""
    x = df.select(F.col(f"`{id_col}`").alias("doc_id"), n_tokens.cast("long").alias("total"))
    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.floor((F.col("total") - 1) / max_tokens), F.lit(0)).cast("long"))).alias("piece")
    x = x.select("doc_id", "total", pieces)
    start = F.col("piece") * max_tokens
    return x.select("doc_id", "piece", start.alias("start"), F.least(F.col("total") - start, F.lit(max_tokens)).alias("n_tokens"))


def pack(df: DataFrame, n_tokens: Column, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id") -> DataFrame:
    """One row per sequence: ``doc_id, piece, start, n_tokens, bucket_tokens, batch, slot, padding``.

    ``batch`` counts from 0 inside its bucket, ``slot`` inside its batch; a batch has at
    most ``budget // bucket_tokens`` rows (one at least).
    """
    cut = materialize(sequences(df, n_tokens, max_tokens, id_col).withColumn("tie", F.monotonically_increasing_id()), "pack-cut")
    order = ["doc_id", "piece", "n_tokens", "tie"]
    ranged = cut.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    seqs = materialize(ranged.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "pack-sequences")
    release(cut)
    bounds = boundaries({r[0]: r[1] for r in seqs.groupBy("n_tokens").count().collect()}, buckets)
    bucket = F.lit(bounds[-1] if bounds else 0)
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("n_tokens") <= b, b).otherwise(bucket)
    seqs = seqs.withColumn("bucket_tokens", bucket.cast("long"))
    # Offsets of each partition in each bucket: (partitions x buckets) rows.
    counts = seqs.groupBy("bucket_tokens", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("bucket_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("bucket_tokens", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("bucket_tokens", "part").orderBy("row")) - 1
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("bucket_tokens", F.lit(1)))).cast("long")
    x = seqs.withColumn("place", place).join(offsets, ["bucket_tokens", "part"]).withColumn("number", F.col("offset") + F.col("place")).withColumn("rows", rows)
    return x.select("doc_id", "piece", "start", "n_tokens", "bucket_tokens", F.expr("number div rows").alias("batch"), (F.col("number") % F.col("rows")).alias("slot"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"))


def pack_texts(df: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``pack`` with words as tokens."""
    return pack(df, F.size(words(F.col(f"`{text_col}`"))), **options)


def query(docs: DataFrame) -> DataFrame:
    return pack_texts(docs)
