"""The pipeline against a brute-force composition of its stages on a small table."""

import re
from collections import Counter

import pytest
import xxhash

import corpus_pipeline as C
from tidemill.llm import line_dedup as L
from tidemill.llm import quality_rules as Q
from tidemill.llm import suffix_dedup as S
from tidemill.llm.spans import union_of

from .fixtures import SCHEMA, texts
from .test_dedup import jaccard_brute

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def good(i, t):
    return (i, f"{t}\nThe end of it, and the rest is in the house with you, as it was.", "en", "src", 0)


def units(data):
    """First and last byte of every chunk and window of a text, straight from their definitions."""
    lines = data.split(b"\n")
    starts = [0]
    for x in lines:
        starts.append(starts[-1] + len(x) + 1)
    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    out, first, n = set(), 0, len(lines)
    for i in range(n):
        rolling = sum(hashes[i - j] * pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(L.WINDOW) if i >= j) % (1 << 64)
        if i + 1 == n or (i + 1 - first >= L.MIN_LINES and n - i - 1 >= L.MIN_LINES and (rolling >> 32) % L.DIVISOR == 0):
            part = b"\n".join(lines[first : i + 1])
            if i + 1 - first >= L.MIN_LINES and part.strip():
                out.add((starts[first], starts[first] + len(part)))
            first = i + 1
    for i in range(n - L.MIN_LINES + 1):
        if all(x.strip() for x in lines[i : i + L.MIN_LINES]):
            out.add((starts[i], starts[i + L.MIN_LINES] - 1))
    return out


def line_brute(rows):
    first, out = {}, {}
    for i in sorted(rows):
        data = rows[i].encode()
        for a, b in sorted(units(data)):
            first.setdefault(data[a:b], (i, a))
    for i, t in rows.items():
        data = t.encode()
        gone = []
        for a, b in units(data):
            doc, at = first[data[a:b]]
            if doc != i or a >= at + b - a:
                gone.append((a - 1, b) if a else (0, b + 1))
        left = data
        for a, b in reversed(union_of(gone)):
            left = left[:a] + left[b:]
        if not gone or WORD.search(left.decode()):
            out[i] = left.decode()
    return out


def repeat_brute(rows, length, keep_first):
    data = {i: t.encode() for i, t in rows.items()}
    first, starts = {}, Counter()
    for i in sorted(data):
        for k in range(len(data[i]) - length + 1):
            first.setdefault(data[i][k : k + length], (i, k))
            starts[data[i][k : k + length]] += 1
    out = {}
    for i, d in data.items():
        gone = []
        for k in range(len(d) - length + 1):
            doc, at = first[d[k : k + length]]
            if (doc != i or k >= at + length) if keep_first else starts[d[k : k + length]] > 1:
                gone.append((k, k + length))
        left = d
        for a, b in reversed(union_of(gone)):
            left = left[:a] + left[b:]
        left = left.decode("utf-8", "ignore")
        if not gone or WORD.search(left):
            out[i] = left
    return out


@pytest.mark.parametrize("group", [S.GROUP, 3])
def test_repeats_keep_their_first_place(spark, monkeypatch, group):
    monkeypatch.setattr(S.repeated_spans, "__defaults__", (*S.repeated_spans.__defaults__[:-1], group))
    rows = {i: t for i, t, *_ in texts() if i is not None and t and i != 3}
    long = max(rows.values(), key=len)
    rows |= {1000 + k: f"{k} begins " * 9 + long[5000 + 40 * (k % 5) : 5700 - 30 * (k % 7)] + f" ends {k}" * 9 for k in range(30)}
    rows |= {2000: long[100:900] * 3, 2001: "ab" * 400, 2002: long[300:700]}
    got = rows_of(S.keep_unrepeated(spark.createDataFrame(sorted(rows.items()), "doc_id long, text string"), length=C.PASSAGE, keep_first=True))
    assert got == repeat_brute(rows, C.PASSAGE, True) and len(got) < len(rows)


def test_line_dedup_equals_brute_force(spark):
    rows = {i: t for i, t, *_ in texts(n=30) if i is not None and t and i != 3}
    body = rows[5].split("\n") + rows[9].split("\n")
    rows |= {500 + k: "\n".join([*body[k : k + 3 + k % 5], f"own {k}", *body[2 * k : 2 * k + 2], "", *body[:2]]) for k in range(len(body))}
    got = rows_of(L.keep_unseen(spark.createDataFrame(sorted(rows.items()), "doc_id long, text string")))
    assert got == line_brute(rows) and got != rows


def test_stages_equal_brute_force(spark, tmp_path):
    rows = [good(i, t) for i, t, *_ in texts(n=40) if i is not None and t]
    rows += [(900, None, None, None, None), (901, "short", "en", "s", 5), (902, rows[0][1] + " ***" * 300, "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept = rows_of(C.quality(spark, docs, ""))
    assert kept == {r.doc_id: r.text for r in Q.judge(docs).where("quality_verdict.kept").collect()} and 0 < len(kept) < len(rows)
    lines = line_brute(kept)
    table = lambda x: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in sorted(x.items())], SCHEMA)
    assert rows_of(C.lines(spark, table(kept), "")) == lines
    comps = jaccard_brute([(i, t) for i, t in lines.items()])
    alone = {i: t for i, t in lines.items() if comps[i] == i}
    assert rows_of(C.near_duplicates(spark, table(lines), "")) == alone
    rest = repeat_brute(alone, C.PASSAGE, False)
    found = C.repeats(spark, table(alone), "")
    assert found.columns == docs.columns
    assert rows_of(found) == rest
    total = Counter()
    for r in C.run(spark, str(tmp_path)).collect():
        total[r.doc_id] += r.n_tokens
    assert total == {i: len(WORD.findall(t)) for i, t in rest.items()}
    assert [n for n, _ in C.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "suffix_dedup", "packing"] and C.ORACLE_SQL is None
