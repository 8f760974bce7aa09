import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import packing as P
from tidemill.llm import quality_knn as K
from tidemill.llm import quality_rules as Q
from tidemill.llm import sharding as H

from .fixtures import SCHEMA, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(t):
    t = t or ""
    w = WORD.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    covered = {i + j for i, g in enumerate(windows) if n[g] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force(spark):
    rows = texts()
    got = Q.query(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted((str(i), *counts(t)) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_reject_and_keep(spark):
    good = "The house is of the old kind and we like it. " + " ".join(f"word{i}" for i in range(60)) + " and that was the end of it."
    rows = [(1, good, "x"), (2, " ".join(f"w{i}###" for i in range(80)) + " the and of", "x"), (3, good.upper(), "x"), (4, None, "x"), (5, "short", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality_metrics string")
    kept = Q.keep_good(df)
    assert kept.columns == df.columns
    assert [r.doc_id for r in kept.collect()] == [1]
    assert kept.collect()[0].quality_metrics == "x"
    judged = Q.judge(df)
    assert judged.columns == [*df.columns, "quality_metrics_", "quality_verdict"]
    assert judged.where("quality_verdict.kept").count() == 1


def test_filter_stays_above_the_measuring(spark):
    plan = Q.keep_good(spark.createDataFrame([], SCHEMA).withColumn("x", F.rand()))._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert len(filters) == 1 and "Generate" in plan[plan.index(filters[0]) :]
    assert not re.search(r"xxhash64|lambda|split", filters[0]) and "Python" not in plan


def brute_buckets(histogram, k):
    lengths = sorted(histogram)
    best = {(0, 0): 0}
    for j in range(1, len(lengths) + 1):
        for b in range(1, k + 1):
            best[j, b] = min((best[i, b - 1] + sum(histogram[x] * (lengths[j - 1] - x) for x in lengths[i:j]) for i in range(j) if (i, b - 1) in best), default=10**18)
    return min(best[len(lengths), b] for b in range(0, k + 1) if (len(lengths), b) in best)


def test_boundaries_are_optimal():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lengths = rng.choice(200, size=rng.integers(1, 25), replace=False)
        histogram = {int(x): int(rng.integers(1, 30)) for x in lengths}
        for k in (1, 2, 3, 5, 40):
            bounds = P.boundaries(histogram, k)
            assert len(bounds) <= k and bounds[-1] == max(histogram)
            padding = sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())
            assert padding == brute_buckets(histogram, k)
    assert P.boundaries({}) == []


def test_packing(spark):
    rows = texts()
    got = P.pack_texts(spark.createDataFrame(rows, SCHEMA), max_tokens=500, buckets=4, budget=2000).collect()
    total = Counter()
    for r in got:
        total[r.doc_id] += r.n_tokens
        assert r.n_tokens <= r.bucket_tokens and r.padding == r.bucket_tokens - r.n_tokens and r.start == 500 * r.piece
    want = Counter()
    for i, t, *_ in rows:
        want[i] += len(WORD.findall(t or ""))
    assert total == want
    # Bounds of least padding, and places by id and piece, whatever the partitions.
    histogram = Counter(r.n_tokens for r in got)
    assert sum(r.padding for r in got) == brute_buckets(histogram, 4)
    number = {}
    for r in sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.piece, r.n_tokens)):
        number.setdefault(r.bucket_tokens, []).append((r.doc_id, r.piece, r.n_tokens))
    for r in got:
        assert number[r.bucket_tokens][r.batch * max(1, 2000 // max(r.bucket_tokens, 1)) + r.slot] == (r.doc_id, r.piece, r.n_tokens)
    slots = Counter((r.bucket_tokens, r.batch, r.slot) for r in got)
    assert set(slots.values()) == {1} and len({r.bucket_tokens for r in got}) <= 4
    sizes = Counter((b, k) for b, k, _ in slots)
    for (b, k), n in sizes.items():
        most = max(1, 2000 // max(b, 1))
        last = max(x for y, x in sizes if y == b)
        assert n <= most and (n == most or k == last)
    assert P.query(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sharding(spark):
    rows = [(i, "x" * (i % 97) * 10, "en", "s", 0) for i in range(3000)] + [(None, "n", None, None, None), (5000, "y" * 30000, "en", "s", 0), (7, "again", "en", "s", 0)]
    limit = 20000
    got = H.shard(spark.createDataFrame(rows, SCHEMA), limit).collect()
    assert len(got) == len(rows)
    sums = Counter()
    for r in got:
        sums[r.depth, r.shard] += r.n_bytes
    for r in got:
        assert sums[r.depth, r.shard] == r.shard_bytes
        assert r.oversized == (r.shard_bytes > limit) == (r.doc_id == 5000 and r.depth == H.BITS)
    # Prefixes do not contain one another, and a parent of a shard would not fit.
    shards = set(sums)
    for d, s in shards:
        assert not any((k, s >> (d - k)) in shards for k in range(d))
        if d:
            assert sum(n for (k, x), n in sums.items() if k >= d and x >> (k - d + 1) == s >> 1) > limit
    assert H.query(spark.createDataFrame([], SCHEMA)).count() == 0


def test_classifier_separates_and_holds_out(spark):
    rows = texts(n=150)
    rows = [(i, (t or "") + ("" if i % 3 else " ***" * 40 + "|#|" * 20), "en", "s", 0) for i, (_, t, *_) in enumerate(rows)]
    labels = [(i, 1 if i % 3 else 0, 0) for i in range(len(rows))] + [(None, 1, 0), (99999, 0, 0), (3, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = K.query(docs, marks).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    out = [r for r in got if r.held_out]
    assert sum(r.predicted == bool(r.doc_id % 3) for r in out) >= 0.9 * len(out)
    # The same from end to end, one document at a time.
    known = {i: q for i, q, _ in labels if i is not None and q is not None and i < len(rows) and zlib.crc32(str(i).encode()) % 5}
    model = K.Model.fit(np.array([K.features(rows[i][1]) for i in known]), np.array(list(known.values())), Counter(known.values()))
    want = {i: model.score(K.features(t)[None, :])[0] for i, t, *_ in rows}
    assert all(abs(r.score - want[r.doc_id]) < 0.02 for r in got)
    # Held-out labels change nothing.
    flipped = [(i, 1 - q if q is not None and i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    again = K.query(docs, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int")).collect()
    assert {(r.doc_id, r.score) for r in got} == {(r.doc_id, r.score) for r in again}


def test_votes_equal_brute_force():
    rng = np.random.default_rng(1)
    x = np.abs(rng.standard_normal((40, K.WIDTH))).astype(np.float32)
    labels = np.arange(40) % 2
    m = K.Model.fit(x, labels, {0: 30, 1: 90}, dimensions=10)
    y = np.abs(rng.standard_normal((9, K.WIDTH))).astype(np.float32)
    got = m.score(y, neighbours=7)
    for k, row in enumerate(y):
        v = row * m.weights
        v[: K.WORDS] /= np.linalg.norm(v[: K.WORDS])
        v[K.WORDS :] /= np.linalg.norm(v[K.WORDS :])
        v = v @ m.axes
        cosine = m.vectors @ (v / np.linalg.norm(v))
        near = np.argsort(-cosine)[:7]
        w = np.maximum(cosine[near], 0) ** K.SHARPNESS * np.where(labels[near] == 1, 90 / 20, 30 / 20)
        assert abs(got[k] - (w * labels[near]).sum() / w.sum()) < 1e-4
    none = K.Model.fit(x[:0], labels[:0], {})
    assert none.score(y).tolist() == [0.5] * 9
