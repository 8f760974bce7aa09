import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemill.llm import exact_dedup as E
from tidemill.llm import jaccard_join as J
from tidemill.llm import line_dedup as L
from tidemill.llm import suffix_dedup as S
from tidemill.llm.spans import union_of

from .fixtures import SCHEMA, texts


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


@given(st.binary(max_size=9000), st.binary(max_size=9000))
@settings(max_examples=30, deadline=None)
def test_fingerprints_compose(a, b):
    whole, left, right = E.fingerprints([a + b, a, b])
    assert whole == E.combine(left, right, len(b))


def test_exact_dedup_equals_brute_force(spark):
    rows = texts()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[E.normalise(t)].append(i)
    want = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(str(i), str(keep), len(ids), sha(t)) for i in ids]
    got = E.exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == sorted(want)
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_splits_colliding_fingerprints(spark, monkeypatch):
    rows = [(1, "same size a"), (2, "same size b"), (3, "same size b"), (4, "same  size a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fake = df.selectExpr("doc_id as id", "cast(0 as long) as size")
    assert fake.count() == 4
    original = E.materialize

    def weak(frame, tag):
        return original(frame.selectExpr("id", "size", "0L as fp1", "0L as fp2", "sha", "row") if tag == "exact-prints" else frame, tag)

    monkeypatch.setattr(E, "materialize", weak)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in E.exact_dedup(df).collect()}
    assert got == {1: (1, 2, True), 2: (2, 2, True), 3: (2, 2, False), 4: (1, 2, False)}


def jaccard_brute(rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append({b" ".join(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({b" ".join(w)} if w else set()))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if i is not None]
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in ids} | {None: None}


def test_jaccard_join_equals_brute_force(spark):
    rows = texts(n=40)
    want = jaccard_brute(rows)
    got = J.query(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == want[r.doc_id] for r in got)
    assert len({r.component_id for r in got}) < len(got)


def test_jaccard_join_chains_and_borders(spark):
    """A chain of slow change: only neighbours link, and the component spans several size blocks."""
    words = [f"w{i}" for i in range(600)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 100 + 4 * k]), "en", "s", 0) for k in range(40)]
    rows += [(100 + k, " ".join(words[:200] + [f"y{k}_{j}" for j in range(10 + 5 * k)]), "en", "s", 0) for k in range(20)]
    rows += [(200 + k, " ".join(w if (i * 7 + k) % 45 else f"z{k}" for i, w in enumerate(words[:300])), "en", "s", 0) for k in range(45)]
    want = jaccard_brute(rows)
    got = {r.doc_id: r.component_id for r in J.query(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: want[i] for i in got}
    assert J.query(spark.createDataFrame([], SCHEMA)).count() == 0


def test_blocks_count_common_tokens_and_join_parts(monkeypatch):
    monkeypatch.setattr(J, "SLICE", 3)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 40, size=k)) for k in (0, 1, 5, 20, 30, 3, 0, 12)]
    want = [[len(set(x) & set(y)) for y in sets[2:]] for x in sets]
    assert J._common(sets, sets[2:]).tolist() == want
    linked = np.zeros((6, 6), dtype=bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        linked[a, b] = linked[b, a] = True
    assert sorted(J._forest(linked)) == [(2, 1), (3, 0), (5, 0)]


@pytest.mark.parametrize("chunk", [J.CHUNK, 3])
def test_jaccard_join_counts_all_links(spark, monkeypatch, chunk):
    """Links inside components too, of sets that are similar to a hub and not to each other, equal sets and repeated ids."""
    monkeypatch.setattr(J, "CHUNK", chunk)
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 100 + 4 * k])) for k in range(20)]
    rows += [(100 + k, " ".join(f"z{k}" if j in (7 * k % 290, (7 * k + 150) % 290) else f"v{j}" for j in range(300))) for k in range(1, 25)]
    rows += [(200 + k, " ".join([f"v{j}" for j in range(300)] + [f"y{k}_{j}" for j in range(10 + 5 * k)])) for k in range(12)]
    rows += [(300, rows[30][1]), (300, rows[5][1]), (301, rows[30][1].upper()), (5, rows[5][1]), (None, rows[5][1]), (302, None), (303, "")]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    similar = lambda x, y: x and y and 100 * len(x & y) >= 80 * len(x | y)
    want = [(str(i), len(sets[m]), 0 if i is None else sum(1 for k, (j, _) in enumerate(rows) if k != m and j is not None and similar(sets[m], sets[k]))) for m, (i, _) in enumerate(rows)]
    got = J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.n_links) for r in got) == sorted(want)
    comps = jaccard_brute(rows)
    assert all(r.component_id == comps[r.doc_id] for r in got)


def suffix_brute(data: list[bytes], length: int) -> list[bytes]:
    starts = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = union_of([(i, i + length) for i in range(len(d) - length + 1) if starts[d[i : i + length]] > 1])
        at, left = 0, b""
        for a, b in gone:
            left += d[at:a]
            at = b
        out.append((len(d), sum(b - a for a, b in gone), len(gone), sha(left + d[at:])))
    return out


@pytest.mark.parametrize("group", [S.GROUP, 3])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(S.repeated_spans, "__defaults__", (*S.repeated_spans.__defaults__[:-1], group))
    monkeypatch.setattr(S, "BUFFER", 5000)
    rows = texts()
    long = rows[-3][1]
    rows += [(1000 + k, "q" * k + long[2000 : 3000 + 37 * k] + "r" * (3 * k), None, None, None) for k in range(8)]
    # One passage amid other text on both sides, from different places on: one anchor with many classes.
    rows += [(2000 + k, f"{k} begins " * 9 + long[5000 + 40 * (k % 5) : 5700 - 30 * (k % 7)] + f" ends {k}" * 9, None, None, None) for k in range(30)]
    want = suffix_brute([(t or "").encode() for _, t, *_ in rows], S.LENGTH)
    expected = sorted((str(r[0]), *w) for r, w in zip(rows, want))
    got = S.query(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == expected
    assert sum(w[1] for w in want) > 5000


def test_suffix_dedup_deals_a_hot_anchor_to_many_tasks(spark, monkeypatch):
    """Where rows are joined by their anchor, no aggregate by it keeps a hot anchor's rows in one task, and no row with bytes is dealt by it."""
    plans, original = {}, S.materialize

    def seen(frame, tag):
        plans.setdefault(tag, []).append(frame._jdf.queryExecution().executedPlan().toString())
        return original(frame, tag)

    monkeypatch.setattr(S, "materialize", seen)
    long = texts()[-3][1]
    rows = [(k, f"{k} begins " * 9 + long[5000 + 40 * (k % 5) : 5700 - 30 * (k % 7)] + f" ends {k}" * 9) for k in range(30)]
    # The counts are small here; as large ones they are not broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spans = S.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), group=3).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spans and plans["suffix-level"]
    for plan in plans["suffix-level"] + plans["suffix-known"]:
        assert "SortMergeJoin" in plan and "Aggregate" not in plan
    for plan in plans["suffix-level"]:
        assert sum("hashpartitioning(anchor#" in x and "kind#" not in x for x in plan.split("\n")) == 2


@given(st.sets(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=20))
@settings(max_examples=50, deadline=None)
def test_widest_leaves_out_what_is_inside(found):
    assert set(S.widest(found)) == {(b, a) for b, a in found if not any((x, y) != (b, a) and x >= b and y >= a for x, y in found)}


def test_maximal_repeats_lists_all_members():
    parts = [(b"xxAB", b"CDyy"), (b"zzAB", b"CDyy"), (b"zzAB", b"CDzz"), (b"..QB", b"CD..")]
    found = {(back, ahead, tuple(sorted(m))) for back, ahead, m in S.maximal_repeats([left[::-1] for left, _ in parts], [r for _, r in parts], 3)}
    assert {(1, 2, (0, 1, 2, 3)), (2, 2, (0, 1, 2)), (4, 2, (1, 2)), (2, 4, (0, 1))} <= found


def test_line_dedup(spark):
    block = "\n".join(f"line number {i} of a shared block" for i in range(12))
    rows = [(1, "head one\n" + block + "\ntail one", "x"), (2, block, "y"), (3, "other\n" + block, "z"), (4, None, "n"), (5, "", "e"), (6, "single", None), (7, "single", None), (None, block, "q"), (2, block, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, cut string")
    got = {(r.doc_id, r.cut): r.text for r in L.dedup_lines(df).collect()}
    assert got[1, "x"] == rows[0][1] and got[4, "n"] is None and got[5, "e"] == "" and got[6, None] == "single"
    assert len(got[2, "y"]) < len(block) / 2 and len(got[3, "z"]) < len(rows[2][1]) / 2 and "other" in got[3, "z"]
    assert all(x in block.split("\n") for x in got[2, "y"].split("\n") if x)
    kept = L.keep_unseen(df)
    assert kept.columns == df.columns
    assert L.query(df.limit(0)).count() == 0


def test_line_dedup_catches_short_blocks_amid_other_lines(spark):
    blocks = [[f"block {n} {k} line {j}" for j in range(n)] for n in (2, 3, 4, 5) for k in range(10)]
    rows, want = [], {}
    for doc in range(4):
        own = [[f"own {doc} {k} {j}" for j in range(1 + (k + doc) % 4)] for k in range(len(blocks))]
        order = blocks[doc:] + blocks[:doc]
        rows.append((doc, "\n".join(x for pair in zip(own, order) for part in pair for x in part)))
        want[doc] = rows[0][1] if not doc else "\n".join(x for part in own for x in part)
    # Repeats inside one document: the first two lines stay.
    rows += [(10, "same\nsame\nsame\nsame"), (11, "same\nsame\nother"), (12, "\n\nx\n\ny"), (13, "z\n\ny")]
    want |= {10: "same\nsame", 11: "other", 12: rows[6][1], 13: rows[7][1]}
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in got} == want


@given(st.lists(st.sampled_from(["", "a", "bb", "a line", "é"]), min_size=1, max_size=40))
@settings(max_examples=60, deadline=None)
def test_chunks_tile_the_text(lines):
    data = "\n".join(lines).encode()
    found = L.chunks(data)
    assert b"\n".join(data[a:b] for a, b, _ in found) == data
    assert sum(n for *_, n in found) == len(lines)
    assert all(n >= L.MIN_LINES for *_, n in found) or len(lines) < L.MIN_LINES
