"""Removal of byte spans from texts.

Documents are named by id and a hash of their text, so rows that share an id but not a
text are never confused.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = ["doc_id", "mark"]


def marked(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mark, text`` of every row."""
    text = F.col(f"`{text_col}`")
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order, touching ones joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _cut(place: int, as_text: bool):
    """``place``: where the text stands in the caller's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, size, gone, runs = [], [], [], []
            for text, spans in zip(batch.column("row").field(place), batch.column("spans"), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                merged = union_of([(s["start"], min(s["stop"], len(data))) for s in spans.as_py()]) if spans.is_valid else []
                at, rest = 0, []
                for a, b in merged:
                    rest.append(data[at:a])
                    at = b
                rest.append(data[at:])
                left = b"".join(rest) if merged else data
                kept.append((left.decode("utf-8", "ignore") if merged else None) if as_text else left)
                size.append(len(data))
                gone.append(sum(b - a for a, b in merged))
                runs.append(len(merged))
            columns = [pa.array(kept, pa.string() if as_text else pa.binary()), *[pa.array(x, pa.int64()) for x in (size, gone, runs)]]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.StructArray.from_arrays(columns, names=["kept", "n_bytes", "n_removed", "n_spans"])], names=["row", "cut"])

    return run


def cut(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", as_text: bool = False) -> DataFrame:
    """``row``, the caller's row as one struct, and the struct ``cut``: ``kept`` (bytes left), ``n_bytes``, ``n_removed``, ``n_spans``.

    ``as_text``: ``kept`` is text instead, without characters that a cut halved, and null
    where nothing was removed.

    ``spans(doc_id, mark, start, stop)``: bytes to remove; they may overlap.  A document's
    spans are gathered in its row, which its length bounds.
    """
    lists = spans.groupBy(*KEY).agg(F.collect_set(F.struct("start", "stop")).alias("spans")).select(F.col("doc_id").alias("id_s"), F.col("mark").alias("mark_s"), "spans")
    x = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("mark"))
    # Always by shuffle: a list that is small enough to broadcast today grows with the corpus.
    x = x.join(lists.hint("merge"), F.col("id").eqNullSafe(F.col("id_s")) & (F.col("mark") == F.col("mark_s")), "left").select("row", "spans")
    told = T.StructType([T.StructField("kept", T.StringType() if as_text else T.BinaryType()), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]])
    return x.mapInArrow(_cut(df.columns.index(text_col), as_text), T.StructType([T.StructField("row", df.schema), T.StructField("cut", told)]))


def restored(df: DataFrame, text_col: str = "text") -> list[Column]:
    """The columns of ``df`` from what ``cut`` gives as text, with what is left of the text."""
    own = lambda c: F.col("row").getField(c)
    left = F.when(F.col("cut.n_removed") > 0, F.col("cut.kept")).otherwise(own(text_col))
    return [(left if c == text_col else own(c)).alias(c) for c in df.columns]


def with_words() -> Column:
    """Whether a text lost nothing, or has more than white space left."""
    return (F.col("cut.n_removed") == 0) | F.col("cut.kept").rlike(r"[^\x20\x09-\x0D]")
