"""Suffix-array dedup: every byte of a long repeat goes, wherever its other occurrences are.

A window of ``LENGTH`` bytes repeats if it starts at two places of the corpus.  Suffixes
are compared in groups that can share a window:

1. Anchors.  A window's anchor is the GRAM-byte string in it with the least hash, the
   leftmost of equals: a function of the window's bytes alone.  So equal windows have
   equal anchors at equal offsets, and only places with one anchor need comparing.  A
   run of neighbouring windows with one anchor place makes one row.
2. Classes.  Rows with equal anchors and equal bytes around them are one class.  In a
   class with two or more rows, all windows of all rows repeat.  Counting classes is a
   partial aggregation, so an anchor or class held by a third of all rows is no burden.
3. Common-prefix interval tree.  Where one anchor has several classes, one row of each
   enters an enhanced suffix array over the suffixes at the anchor: they are sorted,
   neighbouring common prefixes computed, and a stack scan lists the prefix intervals.
   Inside an interval the left contexts are sorted and scanned in the same way; an
   interval of theirs whose members differ in the byte further left is left-diverse, and
   so, with its prefix interval, a maximal repeat: it is put out with all its members.
4. An anchor with more than ``GROUP`` classes is split, by what else its windows hold.
   Windows that begin ``low`` to ``high`` bytes before the anchor all hold ``low`` bytes
   before it and so many after it; halving that range makes more bytes common to its
   windows, and rows go on in groups that agree in those bytes.  Rows that agree in all
   windows of the half are one class again, and one of them goes on.  Groups that fit
   have their trees, and where the range is one offset, a group is one class.  So no task
   has more than ``GROUP`` classes of a group.

``keep_first``: the first of the places of a window (by id, then place) keeps its bytes, and
so does a window that overlaps its own first place.  Any repeat shows this by its least
member, since a window's places are the members of one of the tree's repeats.

Defined results: null and empty texts, and texts shorter than LENGTH, lose nothing;
repeated rows are separate texts, so a repeated row of LENGTH bytes or more loses all its
bytes; an empty table gives an empty result; ids may be of any type; extra columns are
carried through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialize, release, slices
from .spans import KEY, cut, marked, restored, with_words

LENGTH = 400
GRAM = 64
GROUP = 256
#: Bytes looked at together; places fit into 24 bits.
BUFFER = 2 << 20

_PLACE = np.uint64((1 << 24) - 1)
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes (a power of two, 8 or more) from each place, by doubling."""
    n = len(data) - 7
    h = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(8):
        h |= data[j : j + n].astype(np.uint64) << np.uint64(8 * j)
    size = 8
    while True:
        h *= _ODD[0]
        h ^= h >> np.uint64(29)
        if size == gram:
            return h
        h = (h[:-size] * _ODD[1]) ^ (h[size:] + (h[:-size] >> np.uint64(32)))
        size *= 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchor_runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, its place, and the first and last window start, of each run of windows in joined texts.

    ``ends``: where each text ends in ``data``; windows do not cross texts.
    """
    none = (np.zeros(0, np.int64),) * 4
    if len(data) < length:
        return none
    h = _grams(data, gram)
    place = np.arange(len(h), dtype=np.uint64)
    at = (_least((h & ~_PLACE) | place, length - gram + 1) & _PLACE).astype(np.int64)
    inside = np.ones(len(at), dtype=bool)
    for end in ends[:-1]:
        inside[max(0, end - length + 1) : end] = False
    p = np.flatnonzero(inside)
    if not len(p):
        return none
    a = at[p]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)]))
    last = np.concatenate([first[1:], [len(p)]]) - 1
    return h[a[first]].astype(np.int64), a[first], p[first], p[last]


def _runs(length: int, gram: int):
    """Rows (anchor, class digest, document, anchor place, first and last window start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "c1", "c2", *KEY, "place", "first", "last"]
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t.as_buffer() if t.is_valid else b"" for t in part.column("text")]
                for group in _buffers([memoryview(t) for t in texts], length):
                    joined = b"".join(x[2] for x in group)
                    sizes = np.array([len(x[2]) for x in group])
                    ends = np.cumsum(sizes)
                    h, q, a, b = anchor_runs(np.frombuffer(joined, dtype=np.uint8), ends, length, gram)
                    doc = np.searchsorted(ends, a, side="right")
                    digests = b"".join(xxhash.xxh3_128_digest(joined[x : y + length], seed=z - x) for x, y, z in zip(a.tolist(), b.tolist(), q.tolist(), strict=True))
                    two = np.frombuffer(digests, dtype=np.int64).reshape(-1, 2)
                    shift = np.array([x[1] for x in group], dtype=np.int64)[doc] - (ends - sizes)[doc]
                    at = pa.array(np.array([x[0] for x in group], dtype=np.int64)[doc])
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(two[:, 0]), pa.array(two[:, 1]), part.column("doc_id").take(at), part.column("mark").take(at), *[pa.array(v + shift) for v in (q, a, b)]], names=names)

    return run


def _buffers(texts: list[memoryview], length: int) -> Iterator[list[tuple[int, int, memoryview]]]:
    """Lists of (text number, offset, bytes) of about BUFFER bytes; longer texts go in overlapping parts."""
    held, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), BUFFER):
            piece = t[at : at + BUFFER + length - 1]
            if len(piece) < length:
                continue
            if held and size + len(piece) > BUFFER:
                yield held
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield held


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common length, first, last) of every interval of the tree over suffixes, by a stack scan.

    ``lcp[i]``: what suffix i has in common with suffix i - 1; lcp[0] is not used.
    """
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        now, left = (lcp[i] if i < len(lcp) else 0), i - 1
        while now < stack[-1][0]:
            common, left = stack.pop()
            yield common, left, i - 1
        if now > stack[-1][0]:
            stack.append((now, left))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes before the anchor, bytes from it on, all members) of every maximal repeat of ``length`` or more.

    ``lefts`` are read away from the anchor.  Each right interval's members are sorted by
    left context; a left interval among them is as long as its members agree, so they
    differ in the byte before, which is the test of left diversity.
    """
    order = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [0] + [_common(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)]
    by_left = sorted(range(len(lefts)), key=lefts.__getitem__)
    rank = [0] * len(lefts)
    for r, i in enumerate(by_left):
        rank[i] = r
    reach = max(map(len, lefts), default=0)
    for common, first, last in intervals(lcp):
        if common + reach < length:
            continue
        members = sorted(order[first : last + 1], key=rank.__getitem__)
        before = [0] + [_common(lefts[a], lefts[b]) for a, b in zip(members, members[1:], strict=False)]
        if common >= length:
            yield 0, common, members
        for agreed, a, b in intervals(before):
            if agreed and agreed + common >= length:
                yield agreed, common, members[a : b + 1]


def widest(found: set[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Those (back, ahead) that no other one reaches as far as on both sides."""
    most = -1
    for back, ahead in sorted(found, reverse=True):
        if ahead > most:
            most = ahead
            yield back, ahead


def _trees(length: int, keep_first: bool):
    """Spans of repeated bytes in the single rows of each anchor's classes; the rows arrive sorted by anchor.

    ``keep_first``: in all rows but the least of each repeat.
    """

    def goes(r: tuple, least: tuple) -> bool:
        """Whether a member's bytes go, which the least member has too."""
        return r[1:3] != least[1:3] or r[3] >= least[3] + length

    def rows(batches: Iterator[pa.RecordBatch], kinds: list[pa.DataType]):
        for batch in batches:
            kinds[:] = [batch.schema.field(c).type for c in KEY]
            yield from zip(*[batch.column(c).to_pylist() for c in ("anchor", *KEY, "place", "first", "n", "piece")], strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kinds: list[pa.DataType] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, pa.int64(), pa.int64()], strict=True)], names=[*KEY, "start", "stop"])

        for _, group in groupby(rows(batches, kinds), key=lambda r: r[0]):
            group = list(group)
            if len(group) < 2 or (not keep_first and all(r[5] > 1 for r in group)):
                continue
            before = [r[3] - r[4] for r in group]
            lefts = [r[6][:k][::-1] for r, k in zip(group, before, strict=True)]
            rights = [r[6][k:] for r, k in zip(group, before, strict=True)]
            best: dict[int, set[tuple[int, int]]] = {}
            for back, ahead, members in maximal_repeats(lefts, rights, length):
                least = min((group[m] for m in members), key=lambda r: ((1,) if r[1] is None else (0, r[1]), r[2], r[3])) if keep_first else None
                for m in members:
                    if goes(group[m], least) if keep_first else group[m][5] == 1:
                        best.setdefault(m, set()).add((back, ahead))
            for m, found in best.items():
                r = group[m]
                out += [(r[1], r[2], r[3] - back, r[3] + ahead) for back, ahead in widest(found)]
            if len(out) > 20000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return run


def _pieces(length: int):
    """The bytes around each asked-for anchor of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", *KEY, "place", "first", "n", "classes", "piece"]
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("text")[i].as_buffer()
                asked = batch.column("asked")[i].as_py()
                view = memoryview(data)
                at = pa.array([i] * len(asked), pa.int64())
                columns = [pa.array([x[c] for x in asked], pa.int64()) for c in ("anchor", "place", "first", "n", "classes")]
                pieces = pa.array([bytes(view[x["first"] : x["last"] + length]) for x in asked], pa.binary())
                yield pa.RecordBatch.from_arrays([columns[0], batch.column("doc_id").take(at), batch.column("mark").take(at), *columns[1:], pieces], names=names)

    return run


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, group: int = GROUP) -> DataFrame:
    """``doc_id, mark, start, stop``: spans that together cover the bytes of repeated windows, or of all but their first places."""
    docs = marked(df, id_col, text_col)
    kind = dict(docs.dtypes)["doc_id"]
    runs = docs.mapInArrow(_runs(length, gram), f"anchor long, c1 long, c2 long, doc_id {kind}, mark long, place long, first long, last long")
    runs = materialize(runs, "suffix-runs")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "place")
    key = ["anchor", "c1", "c2"]
    classes = materialize(runs.groupBy(*key).agg(F.count("*").alias("n"), F.min(order).alias("least")), "suffix-classes")
    several = classes.groupBy("anchor").agg(F.count("*").alias("classes")).where("classes > 1")
    several = materialize(several, "suffix-anchors")
    known = classes.join(several, "anchor", "left").where("n > 1 or classes > 1").select(*key, "n", "least", F.coalesce("classes", F.lit(1)).alias("classes"))
    known = materialize(known, "suffix-known")
    release(classes, several)
    later = ~(F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("mark") == F.col("least.mark"))) | (F.col("place") >= F.col("least.place") + length)
    chosen = ~later if keep_first else F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("mark") == F.col("least.mark")) & (F.col("place") == F.col("least.place"))
    # One row stands for its class in a tree; the few others that overlap it have first places of their own to find.
    told = runs.join(known, key).withColumn("chosen", chosen).where("n > 1 or chosen")
    told = materialize(told.select("anchor", *KEY, "place", "first", "last", "n", "classes", "chosen", "least"), "suffix-told")
    release(runs, known)
    whole = told.where("n > 1").where(later if keep_first else F.lit(True)).select(*KEY, F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    asked = told.where("chosen and classes > 1").groupBy(*KEY).agg(F.collect_set(F.struct("anchor", "place", "first", "last", "n", "classes")).alias("asked"))
    held = docs.join(asked.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "asked"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    # One of several equal rows is enough: a class's chosen row stands for its text.
    held = held.select(*KEY, "text", "asked")
    pieces = materialize(held.mapInArrow(_pieces(length), f"anchor long, doc_id {kind}, mark long, place long, first long, n long, classes long, piece binary"), "suffix-pieces")
    spans = f"doc_id {kind}, mark long, start long, stop long"
    trees = lambda x: x.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_trees(length, keep_first), spans)
    columns = ["anchor", *KEY, "place", "first", "n", "piece"]
    out = whole.union(trees(pieces.where(f"classes <= {group}").select(*columns)))
    left = pieces.where(f"classes > {group}").dropDuplicates(["anchor", *KEY, "first"]).select(*columns, F.lit(0).alias("low"), F.lit(length - gram).alias("high"))
    while not left.isEmpty():
        halves = materialize(_halves(left, length), "suffix-halves")
        # Classes of the narrower range: rows that agree in all its windows repeat in all of them.
        kinds = materialize(halves.groupBy("anchor", "kind").agg(F.count("*").alias("m"), F.min(order).alias("least")), "suffix-kinds")
        # Counts are written before they are joined, and joined to the short rows: Spark cuts a hot anchor's rows up only where no aggregate stands beside the join.
        sizes = materialize(kinds.groupBy("anchor").agg(F.count("*").alias("classes")), "suffix-sizes")
        level = halves.join(kinds.join(sizes.hint("merge"), "anchor").where("m > 1 or classes > 1").hint("merge"), ["anchor", "kind"])
        level = materialize(level.withColumn("chosen", chosen).withColumn("later", later), "suffix-level")
        release(halves, kinds, sizes)
        out = out.union(level.where("m > 1").where(F.col("later") if keep_first else F.lit(True)).select(*KEY, "start", "stop"))
        left = level.where("chosen and classes > 1").withColumn("n", F.greatest("n", "m"))
        out = out.union(trees(left.where(f"classes <= {group}").select(*columns)))
        left = left.where(f"classes > {group}").select(*columns, "low", "high")
    return out


def _halves(rows: DataFrame, length: int) -> DataFrame:
    """Rows of both halves of their offsets' range, under the digest of the bytes that all its windows hold.

    ``kind``: the digest of all bytes of the row's windows in the half; ``start``, ``stop``: where those bytes are.
    """
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))).alias("half")
    x = rows.select("anchor", *KEY, "place", "first", "n", "piece", halves).where("half.low <= half.high")
    # Offsets that a row's windows have: from its last window to its first.
    x = x.where(f"half.low <= place - first and half.high >= place - first + {length} - length(piece)")
    x = x.withColumn("start", F.expr("greatest(first, place - half.high)")).withColumn("stop", F.expr(f"least(first + length(piece), place - half.low + {length})"))
    part = lambda start, size: F.expr(f"md5(substring(piece, cast({start} - first as int) + 1, cast({size} as int)))")
    common = part("place - half.low", f"half.low + {length} - half.high")
    key = F.md5(F.concat_ws("-", common, F.col("anchor").cast("string"), F.col("half.low").cast("string"), F.col("half.high").cast("string")))
    kind = F.concat_ws("-", part("start", "stop - start"), F.expr("cast(place - start as string)"), F.expr("cast(stop - place as string)"))
    return x.select(key.alias("anchor"), *KEY, "place", "first", "n", "piece", "half.low", "half.high", "start", "stop", kind.alias("kind"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with ``cut`` as last column: the bytes ``kept``, and ``n_bytes``, ``n_removed`` and ``n_spans``."""
    spans = materialize(repeated_spans(df, id_col, text_col, length), "suffix-spans")
    return cut(df, spans, id_col, text_col).select("row.*", F.col("cut").alias(free_name(df, "cut")))


def keep_unrepeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """``df`` with its texts less their repeats, without the texts of which nothing but white space is left.

    No copy of a repeat stays, unless ``keep_first``: then its first place keeps it, and no
    text is lost to all documents.
    """
    spans = materialize(repeated_spans(df, id_col, text_col, length, keep_first=keep_first), "suffix-spans")
    return cut(df, spans, id_col, text_col, as_text=True).where(with_words()).select(*restored(df, text_col))


def query(docs: DataFrame) -> DataFrame:
    x = remove_repeats(docs.select("doc_id", "text"))
    return x.select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", F.sha2("cut.kept", 256).alias("kept_sha256"))


ORACLE = f"""
with h as (select doc_id, coalesce(hex(encode(text)), '') as x from documents),
k as (select doc_id, i, md5(substr(x, 2 * i + 1, {2 * LENGTH})) as w from (select doc_id, x, unnest(range(0, len(x) // 2 - {LENGTH} + 1)) as i from h)),
again as (select w from k group by w having count(*) > 1),
d as (select doc_id, i from k semi join again using (w)),
m as (select *, case when i - lag(i) over (partition by doc_id order by i) <= {LENGTH} then 0 else 1 end as opens from d),
g as (select *, sum(opens) over (partition by doc_id order by i) as span from m),
s as (select doc_id, span, min(i) as a, max(i) + {LENGTH} as b from g group by 1, 2),
f as (select *, lag(b, 1, 0) over (partition by doc_id order by a) as before from s),
o as (select doc_id, sum(b - a) as gone, count(*) as spans, max(b) as stop, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' order by a) as head from f join h using (doc_id) group by doc_id)
select doc_id, cast(len(x) // 2 as bigint) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, cast(coalesce(spans, 0) as bigint) as n_spans,
  sha256(unhex(case when gone is null then x else head || substr(x, 2 * stop + 1) end)) as kept_sha256
from h left join o using (doc_id)"""
