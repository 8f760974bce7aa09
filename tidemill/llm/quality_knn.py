"""Quality classifier: similarity-weighted nearest-neighbour voting in a latent space.

Terms of a text are its words in lower case, and their forms: letters, capitals and digits
as one sign a run, other characters as they are, and repetitions as terms of their own (a
word after itself, a word seen before, a line seen before).  Words and forms are hashed
into one space, weighted by rarity, normalised as two families of equal weight, and
projected on the leading singular vectors of the labelled sample (latent semantic
analysis).  The labelled vectors are broadcast, each block of documents
is multiplied with all of them, so cosines are exact, and the nearest vote with their
similarities.

Bounds: the sample has at most ``PER_CLASS`` rows of each label, those with the least
hash of their id; so the broadcast is at most 2 * PER_CLASS * DIMENSIONS floats, plus the
projection, whatever the corpus.  Votes are weighted by how many training rows a sampled
row stands for.

Defined results: a null text counts as empty; where no neighbour is similar, and where
one label or none is known, the score is the share of label 1 among training labels (0.5
without any); labels that are null or without a document are passed over; of several
labels of one id the largest counts, and of its several texts the least; repeated rows
are scored one by one; an empty table gives an empty result; other columns, language and
source among them, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

PER_CLASS = 2048
DIMENSIONS = 64
NEIGHBOURS = 15
#: A neighbour votes with its cosine to this power.
SHARPNESS = 8
THRESHOLD = 0.3
#: Slots for words and for forms.
WORDS, FORMS = 3072, 1024
WIDTH = WORDS + FORMS

_RUN = re.compile(rb"[a-z\x80-\xff]+|[A-Z]+|[0-9]+")
#: Terms that no word has.
_AGAIN, _SEEN, _LINE = b"\n1", b"\n2", b"\n3"


def form(word: bytes) -> bytes:
    """Runs of letters as ``a``, of capitals as ``A``, of digits as ``0``, all else as it is."""
    return _RUN.sub(lambda m: b"a" if m[0][0] >= 97 else b"A" if m[0][0] >= 65 else b"0", word)


def _form_slot(term: bytes) -> int:
    return WORDS + xxhash.xxh3_64_intdigest(term) % FORMS


class _Slots(dict):
    """The slots of a word and of its form, kept while there are not too many."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) >= 1 << 18:
            self.clear()
        out = self[word] = (xxhash.xxh3_64_intdigest(word.lower()) % WORDS, _form_slot(form(word)))
        return out


def features(text: str | None, slots: _Slots | None = None) -> np.ndarray:
    """Logarithms of rates per hundred words; all zero for a text without words."""
    out = np.zeros(WIDTH, dtype=np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return out
    slots = _Slots() if slots is None else slots
    counts = Counter(words)
    at = np.array([slots[w] for w in counts], dtype=np.int64)
    n = np.fromiter(counts.values(), dtype=np.float32, count=len(counts))
    np.add.at(out, at[:, 0], n)
    np.add.at(out, at[:, 1], n)
    lines = raw.split(b"\n")
    out[_form_slot(_AGAIN)] += sum(map(bytes.__eq__, words, words[1:]))
    out[_form_slot(_SEEN)] += len(words) - len(counts)
    out[_form_slot(_LINE)] += len(lines) - len(set(lines))
    return np.log1p(out * (100 / len(words)))


class Model:
    """Projection, labelled vectors and votes; ``fit`` makes one from the labelled sample."""

    def __init__(self, weights: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, votes: np.ndarray, prior: float):
        self.weights, self.axes, self.vectors, self.labels, self.votes, self.prior = weights, axes, vectors, labels, votes, prior

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    @classmethod
    def _scaled(cls, x: np.ndarray, rarity: np.ndarray) -> np.ndarray:
        """Rows weighted by rarity, both families of terms with the same length."""
        out = x * rarity
        out[:, :WORDS] = cls._unit(out[:, :WORDS])
        out[:, WORDS:] = cls._unit(out[:, WORDS:])
        return out

    @classmethod
    def fit(cls, x: np.ndarray, labels: np.ndarray, totals: dict[int, int], dimensions: int = DIMENSIONS) -> Model:
        """``totals``: training rows of each label, which the sampled ones stand for."""
        known = sum(totals.values())
        prior = totals.get(1, 0) / known if known else 0.5
        rarity = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 1 if len(x) else np.ones(WIDTH, dtype=np.float32)
        scaled = cls._scaled(x, rarity)
        k = min(dimensions, *scaled.shape) if len(x) else 0
        axes = np.zeros((WIDTH, max(k, 1)), dtype=np.float32)
        if k:
            # Subspace iteration for the leading right singular vectors.
            guess = np.random.default_rng(0).standard_normal((WIDTH, min(k + 16, WIDTH))).astype(np.float32)
            for _ in range(6):
                guess, _r = np.linalg.qr(scaled.T @ (scaled @ guess))
            small = scaled @ guess
            _, _, right = np.linalg.svd(small, full_matrices=False)
            axes = (guess @ right.T)[:, :k].astype(np.float32)
        vectors = cls._unit(scaled @ axes).astype(np.float32) if len(x) else np.zeros((0, 1), dtype=np.float32)
        sampled = {c: max(1, int((labels == c).sum())) for c in (0, 1)}
        votes = np.array([totals.get(int(c), 0) / sampled[int(c)] for c in labels], dtype=np.float32)
        return cls(rarity, axes, vectors, labels.astype(np.float32), votes, prior)

    def score(self, x: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 in the neighbours' votes, for a block of feature rows."""
        out = np.full(len(x), self.prior)
        if len(set(self.labels.tolist())) < 2 or not len(x):
            return out
        cosine = self._unit(self._scaled(x, self.weights) @ self.axes) @ self.vectors.T
        k = min(neighbours, cosine.shape[1])
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        votes = np.maximum(np.take_along_axis(cosine, near, 1), 0).astype(np.float64) ** SHARPNESS * self.votes[near]
        total = votes.sum(axis=1)
        some = total > 0
        out[some] = (votes * self.labels[near]).sum(axis=1)[some] / total[some]
        return np.clip(out, 0, 1)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    slots = _Slots()
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [features(t.as_py(), slots) for t in part.column("text")]
            at = [np.flatnonzero(x) for x in rows]
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), pa.array([a.astype("<i4").tobytes() for a in at], pa.binary()), pa.array([x[a].astype("<f4").tobytes() for x, a in zip(rows, at, strict=True)], pa.binary())],
                names=["label", "at", "x"],
            )


def train(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> Model:
    """A model from ``labels(id_col, label_col)`` with values 0 and 1, the bounded sample of each."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("id is not null and label in (0, 1)")
    # Each id once, and only those with a document: they are counted and sampled alike.
    known = known.groupBy("id").agg(F.max("label").alias("label")).join(texts.select("id"), "id", "left_semi")
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    sample = None
    for c in (0, 1):
        some = known.where(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(per_class)
        sample = some if sample is None else sample.union(some)
    # The sample has a proven bound, so it may be broadcast, and its features come to the driver.
    held = texts.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text")).select("label", "text")
    rows = held.mapInArrow(_extract, "label int, at binary, x binary").collect()
    x = np.zeros((len(rows), WIDTH), dtype=np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(bytes(r[1]), dtype="<i4")] = np.frombuffer(bytes(r[2]), dtype="<f4")
    return Model.fit(x, np.array([r[0] for r in rows], dtype=np.int64), totals)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, slots = shared.value, _Slots()
        for batch in batches:
            for part in slices(batch, "text"):
                at = range(0, part.num_rows, 512)
                texts = part.column("text")
                found = [m.score(np.array([features(t.as_py(), slots) for t in texts.slice(i, 512)]).reshape(-1, WIDTH)) for i in at]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.concatenate(found), pa.float64())], names=["doc_id", "score"])

    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def held_out(key: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels.where(~held_out(F.col("doc_id"))), "quality")
    x = score(docs, model)
    return x.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
