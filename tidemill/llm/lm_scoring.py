"""Language-model scores by prediction by partial matching (PPM) over bytes.

The model is a byte-context trie of orders ORDER to 0 with escape method D: after a
context with total T and d distinct symbols, a symbol seen c times has (2c - 1) / 2T and
the escape d / 2T.  After an escape, symbols of the longer context are excluded from the
shorter one; below order 0, the bytes not yet excluded are alike.  A text is its words,
A-Z in lower case, one space between them, and a line feed at its end.

Pretrained: every training document counts, and the trie lives in tables keyed by packed
context, so it grows with the corpus and is nowhere broadcast or cut.  Since counts are
fixed while scoring, a position's probability depends on its last ORDER + 1 bytes alone;
it is worked out once for each such string.  Documents are then scored in blocks, each
block receiving just the strings that it holds.

Adaptive: ``adaptive_log10`` learns from the document itself as it goes.

Defined results: null and empty texts are the end token alone; a null id belongs to the
training rows in the query; without training rows every byte costs log10(256); equal
rows count and score as often as they are there, though they are worked on once; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, word_hashes

ORDER = 5
#: Bytes of text in a block of documents that is scored together.
BLOCK_BYTES = 12 << 20
PIECE = 4 << 20
#: Values worked on together, so that they stay in the processor's cache.
CACHED = 1 << 15
END = b"\n"


def tokens(text: str | None) -> list[bytes]:
    """Words in lower case, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def normal(text: str | None) -> bytes:
    """Words in lower case with one space between them, and the end."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()) + END


#: The end's key; keys of words are negative too, and strings are packed into positive numbers.
END_KEY = -1


def words(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the words of normal texts, and how many each text has."""
    h, starts = word_hashes(np.frombuffer(b"".join(docs), dtype=np.uint8))
    return np.minimum(~(h >> np.uint64(1)).astype(np.int64), END_KEY - 1), np.diff(np.searchsorted(starts, np.cumsum([0, *map(len, docs)])))


def _pieces(texts: pa.ChunkedArray):
    """Normal texts of consecutive documents, about PIECE bytes of them at a time."""
    held, size, first = [], 0, 0
    for i, t in enumerate(texts):
        held.append(normal(t.as_py()))
        size += len(held[-1])
        if size >= PIECE:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The last ``order`` + 1 bytes at each position of each normal text, packed; and the lengths of texts."""
    pad = END * order
    joined = np.frombuffer(b"".join(pad + t for t in texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.zeros(max(0, len(joined) - order), dtype=np.int64)
    for at in range(0, len(out), CACHED):
        part = out[at : at + CACHED]
        for j in range(order + 1):
            part <<= 8
            part |= joined[at + j : at + j + len(part)]
    # A document's positions are followed by those of the next one's padding.
    keep = np.ones(len(out), dtype=bool)
    ends = np.cumsum(sizes + order)[:-1] - order
    for j in range(order):
        keep[ends + j] = False
    return out[keep], sizes


def _distinct(keys: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, with the sums of ``counted``."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counted[order], first) if len(first) else np.zeros(0, np.int64)


def _tally(keys: np.ndarray, each: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct keys and the sums of ``each``, in parts that may share keys."""
    if len(each) and each.max() > 1:
        return [_distinct(keys, each)]
    others = np.unique(keys[each == 0])
    return [np.unique(keys[each == 1], return_counts=True), (others, np.zeros(len(others), dtype=np.int64))]


def _count(order: int):
    """Distinct strings and words of a block, with their numbers in training documents."""

    def run(table: pa.Table) -> pa.Table:
        # How often each document counts: never outside training, else as often as its row is there.
        weight = table.column("times").to_numpy() * table.column("train").to_numpy(zero_copy_only=False)
        block = table.column("block")[0].as_py()
        parts = []
        for first, docs in _pieces(table.column("text")):
            mine = weight[first : first + len(docs)]
            g, sizes = grams(docs, order)
            parts += _tally(g, np.repeat(mine, sizes))
            w, sizes = words(docs)
            parts += _tally(w, np.repeat(mine, sizes))
        parts.append((np.array([END_KEY]), np.array([weight.sum()])))
        key, n = _distinct(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]))
        return pa.table({"block": pa.array(np.full(len(key), block, dtype=np.int32)), "key": pa.array(key), "n": pa.array(n)})

    return run


class _Table:
    """Values by 64-bit key: rows sorted by a hash, and where each hash begins."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = np.uint64(64 - max(4, int(len(keys) * 2).bit_length() + 1))
        h = self._hash(keys)
        at = np.argsort(h, kind="stable")
        self.keys, self.values = keys[at], values[at]
        self.starts = np.searchsorted(h[at], np.arange(1 << (64 - int(self.bits)))).astype(np.int32)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, all of which are there."""
        return np.concatenate([self._find(keys[i : i + CACHED]) for i in range(0, len(keys), CACHED)]) if len(keys) else self.values[:0]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = self.starts[self._hash(keys).astype(np.int64)]
        left = np.flatnonzero(self.keys[at] != keys)
        while len(left):
            at[left] += 1
            left = left[self.keys[at[left]] != keys[left]]
        return self.values[at]


def _score(order: int, total: int, distinct: int):
    """Scores of a block's documents, from the values of its strings and words."""

    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        key, value = (values.column(c).to_numpy() for c in ("key", "value"))
        word = key < 0
        logs, counts = _Table(key[~word], value[~word]), _Table(key[word], value[word])
        bottom = total + distinct + 1
        end = counts.find(np.array([END_KEY]))[0]
        n, known, base, score = [], [], [], []
        for _, parts in _pieces(docs.column("text")):
            g, sizes = grams(parts, order)
            score += np.add.reduceat(logs.find(g), np.concatenate([[0], np.cumsum(sizes)[:-1]])).tolist()
            w, sizes = words(parts)
            c = counts.find(w)
            some, at = np.flatnonzero(sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            sums, seen = np.zeros(len(parts)), np.zeros(len(parts), dtype=np.int64)
            if len(some):
                sums[some] = np.add.reduceat(np.log10((c + 1) / bottom), at[some])
                seen[some] = np.add.reduceat((c > 0).astype(np.int64), at[some])
            n += (sizes + 1).tolist()
            known += (seen + int(end > 0)).tolist()
            base += (sums + math.log10((end + 1) / bottom)).tolist()
        return pa.table({"doc_id": docs.column("doc_id"), "train": docs.column("train"), "times": docs.column("times"), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(known, pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64())})

    return run


def _probabilities(strings: DataFrame, order: int) -> tuple[DataFrame, list[DataFrame]]:
    """``key, value``: log10 of the last byte's probability after the others, for every string of the corpus.

    ``strings``: key and its number n in training.  Works down from the longest context;
    only strings that must escape go on to the next shorter one, with what they exclude.
    Also returns the tables that the result is read from.
    """
    seen = materialize(strings.where("n > 0").select("key", "n"), "ppm-seen")
    ask = strings.select("key", F.lit(0.0).alias("log"), F.lit(0).cast("long").alias("out_n"), F.lit(0).cast("long").alias("out_d"))
    done, held = [], []
    for k in range(order, -1, -1):
        mask = (1 << 8 * k) - 1
        shorter = materialize(seen.groupBy(F.col("key").bitwiseAND(F.lit(mask)).alias("key")).agg(F.sum("n").alias("n")), "ppm-seen") if k else None
        nodes = seen.withColumn("context", F.shiftright("key", 8))
        if k:
            nodes = nodes.join(shorter.select(F.col("key").alias("below"), F.col("n").alias("below_n")), F.col("key").bitwiseAND(F.lit(mask)) == F.col("below"))
        else:
            nodes = nodes.withColumn("below_n", F.lit(0).cast("long"))
        nodes = nodes.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("d"), F.sum("below_n").alias("covers"))
        full = (1 << 8 * (k + 1)) - 1
        x = ask.withColumn("string", F.col("key").bitwiseAND(F.lit(full))).withColumn("of", F.shiftright("string", 8))
        x = x.join(nodes, F.col("of") == F.col("context"), "left").join(seen.select(F.col("key").alias("known"), F.col("n").alias("c")), F.col("string") == F.col("known"), "left")
        # What is left of the context after exclusion; a context with nothing left is passed over.
        x = x.withColumn("t", F.coalesce(F.col("total") - F.col("out_n"), F.lit(0))).withColumn("e", F.coalesce(F.col("d") - F.col("out_d"), F.lit(0)))
        hit = (F.col("t") > 0) & F.col("c").isNotNull()
        step = F.when(hit, F.log10((2 * F.col("c") - 1) / (2 * F.col("t")))).when(F.col("t") > 0, F.log10(F.col("e") / (2 * F.col("t")))).otherwise(0.0)
        x = x.select("key", (F.col("log") + step).alias("log"), hit.alias("hit"), F.coalesce("covers", F.lit(0)).alias("out_n"), F.coalesce("d", F.lit(0)).alias("out_d"))
        x = materialize(x, "ppm-level")
        done.append(x.where("hit").select("key", F.col("log").alias("value")))
        ask = x.where("not hit").drop("hit")
        held.append(x)
        release(seen)
        seen = shorter
    done.append(ask.select("key", (F.col("log") - F.log10(F.greatest(F.lit(256) - F.col("out_d"), F.lit(1)).cast("double"))).alias("value")))
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out, held


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per input row: ``doc_id, train, n_tokens, n_known, train_tokens, base_score, score``.

    ``train`` marks the rows to learn from.  ``score`` is the pretrained model's log10
    probability of the text, ``base_score`` that of an add-one unigram model of words.
    """
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0))
    total = df.agg(F.sum(size.cast("long") + 1)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(f"`{text_col}`").alias("text"))
    docs = _folded(rows).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))
    # A task for each block, whatever its number hashes to.
    docs = docs.repartitionById(blocks, F.col("block"))
    counts = materialize(docs.groupBy("block").applyInArrow(_count(order), "block int, key long, n long"), "ppm-counts")
    sums = materialize(counts.groupBy("key").agg(F.sum("n").alias("n")), "ppm-sums")
    n, v = sums.where("key < 0 and n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    strings, held = _probabilities(sums.where("key >= 0"), order)
    values = materialize(strings.select("key", "value").union(sums.where("key < 0").select("key", F.col("n").cast("double"))), "ppm-values")
    release(*held, sums)
    asked = materialize(counts.select("block", "key").join(values, "key").select("block", "key", "value"), "ppm-asked")
    release(counts, values)
    kinds = f"doc_id {dict(rows.dtypes)['doc_id']}, train boolean, times long, n_tokens long, n_known long, base_score double, score double"
    scored = docs.groupBy("block").cogroup(asked.repartitionById(blocks, F.col("block")).groupBy("block")).applyInArrow(_score(order, n, v), kinds)
    scored = scored.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return scored.select("doc_id", "train", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def _folded(rows: DataFrame) -> DataFrame:
    """``rows`` with ``times``: rows that are equal in all become one, so that no block holds many of them."""
    again = materialize(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"), "ppm-again")
    if again.isEmpty():
        release(again)
        return rows.withColumn("times", F.lit(1).cast("long"))
    key = rows["doc_id"].eqNullSafe(again["doc_id"])
    folded = rows.join(again, key, "left_semi").groupBy("doc_id", "train", "text").agg(F.count("*").alias("times"))
    return rows.join(again, key, "left_anti").withColumn("times", F.lit(1).cast("long")).unionByName(folded)


def adaptive_log10(text: str | None, order: int = ORDER) -> float:
    """log10 probability of one text under a model that starts empty and learns each byte after coding it."""
    data = b" ".join(tokens(text)[:-1]) + END
    trie: dict[bytes, dict[int, int]] = {}
    past, log = END * order, 0.0
    for s in data:
        out: set[int] = set()
        for k in range(order, -1, -1):
            node = trie.get(past[len(past) - k :], {})
            left = {x: c for x, c in node.items() if x not in out}
            t = sum(left.values())
            if t and s in left:
                log += math.log10((2 * left[s] - 1) / (2 * t))
                break
            if t:
                log += math.log10(len(left) / (2 * t))
            out |= node.keys()
        else:
            log -= math.log10(max(1, 256 - len(out)))
        for k in range(order + 1):
            node = trie.setdefault(past[len(past) - k :], {})
            node[s] = node.get(s, 0) + 1
        past = (past + bytes([s]))[-order:] if order else b""
    return log


def adaptive_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``doc_id, score`` with each document's adaptive log10 probability."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([adaptive_log10(t.as_py(), order) for t in b.column("text")], pa.float64())], names=["doc_id", "score"])

    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def query(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score(docs, ~held_out).select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
