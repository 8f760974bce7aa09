import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemill.llm import lm_scoring as M

from .fixtures import SCHEMA, texts


def brute(rows, trains, order):
    trie = defaultdict(Counter)
    words = Counter()
    for (_, t, *_), train in zip(rows, trains):
        if train:
            words.update(M.tokens(t))
            data = M.END * order + b" ".join(M.tokens(t)[:-1]) + M.END
            for i in range(order, len(data)):
                for k in range(order + 1):
                    trie[data[i - k : i]][data[i]] += 1
    n, v = sum(words.values()), len(words)
    out = []
    for _, t, *_ in rows:
        data = M.END * order + b" ".join(M.tokens(t)[:-1]) + M.END
        log = 0.0
        for i in range(order, len(data)):
            gone = set()
            for k in range(order, -1, -1):
                node = {s: c for s, c in trie.get(data[i - k : i], {}).items() if s not in gone}
                total = sum(node.values())
                if data[i] in node:
                    log += math.log10((2 * node[data[i]] - 1) / (2 * total))
                    break
                if total:
                    log += math.log10(len(node) / (2 * total))
                gone |= node.keys()
            else:
                log -= math.log10(max(1, 256 - len(gone)))
        got = M.tokens(t)
        out.append((len(got), sum(words[w] > 0 for w in got), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in got), log))
    return out


@pytest.mark.parametrize("block", [M.BLOCK_BYTES, 4000])
def test_query_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK_BYTES", block)
    monkeypatch.setattr(M, "PIECE", 3000)
    rows = texts(n=20)
    rows += [rows[5]] * 6 + [(None, None, None, None, None)] * 3 + [(None, "no id here", "fr", None, None)] * 2
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows]
    want = brute(rows, [not h for h in held], M.ORDER)
    expected = sorted((str(r[0]), h, *[round(x, 6) for x in w]) for r, h, w in zip(rows, held, want))
    got = M.query(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == expected


def test_no_training_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_known, r.train_tokens, r.base_score, round(r.score, 9)) for r in M.score(df, F.lit(False)).collect()}
    assert got == {1: (2, 0, 0, 0.0, round(-3 * math.log10(256), 9)), 2: (1, 0, 0, 0.0, round(-math.log10(256), 9))}
    assert M.score(df.limit(0), F.lit(True)).count() == 0


def test_adaptive_learns(spark):
    once, again = M.adaptive_log10("abcdefgh"), M.adaptive_log10("abcdefgh " * 20)
    assert again > 20 * once
    assert M.adaptive_log10(None) == -math.log10(256)
    df = spark.createDataFrame([(1, "abab abab"), (None, None)], "doc_id long, text string")
    assert {r.doc_id: r.score for r in M.adaptive_score(df).collect()} == {1: M.adaptive_log10("abab abab"), None: -math.log10(256)}
