"""N-gram Jaccard join with set-relation skipping.

Texts become sets of word shingles.  The join is exact and skips work on two levels:

* Index level.  Inverted lists hold only the tokens of a set's prefix, rare ones first, and
  are cut into blocks by set size.  A probe opens only the blocks whose sizes can reach
  the threshold, and the positions of the shared token in both sets bound the overlap,
  so whole stretches of a list are never visited.
* Answer level.  Equal sets collapse into one class.  In each block, every set is first
  compared with one of its sets, the leader, and then with the hub that most sets of its
  lists were compared with.  A set's answers follow from its hub's: sets with one hub H
  differ from it by x ^ H and y ^ H, and ``|x & y|`` follows from the sizes and from
  ``|(x ^ H) & (y ^ H)|``.  So sets with one hub never meet in a list; their differences
  are compared in blocks, and what leaves a block are link counts and a spanning forest,
  not pairs.

Only pairs of different hubs that neither level can skip are compared one by one, and a
pair's prefixes bound its overlap before that.  The whole sets of what is compared are made
from whole texts, once each.

Cost: a group of G sets around one hub takes about G * G / CHUNK rows of differences and
vector products over G * G pairs; it is the one step that is not near-linear, as the
links that it counts are not.

Token order: a set first shows the least hashes of its tokens, half as many again as its
prefix needs.  Tokens shown by more than ``FREQUENT`` sets come last in the order, so
they leave the prefix of every set that has rarer ones; sets that lack rarer ones among
those shown (large groups of near copies) show all their tokens.  The counts are exact
and cover all sets; they decide cost, never results.

Defined results: null and empty texts have empty sets and link with nothing; rows with
one id are in one component, linked by any of their texts; links are counted by row, to
all other rows with an id, one's own included, whose sets are similar; a null id links with nothing and has
a null component; an empty table gives an empty result; other columns are ignored; ids
that are not whole numbers are refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, mix, release, slices, word_hashes
from .components import components

WIDTH = 5
#: The threshold as hundredths: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: A token that more sets than this show is frequent, and comes last in the order of tokens.
FREQUENT = 16
#: Sets are measured against leaders and hubs if a bound leaves this similarity open, in hundredths,
#: and can have a hub that is as similar as this; both decide cost, never results.
MEASURED, NEAR = 60, 30
#: So many ids may be broadcast; more are shuffled.
FEW = 1 << 12
#: Sets, and tokens of their differences, in a chunk of those around one hub.
CHUNK, CHUNK_TOKENS = 512, 1 << 18
#: Columns of a product of blocks.
SLICE = 2048

_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Words are runs of other than ASCII white space, A-Z in lower case.
    """
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() + b" " for t in texts]
    ids, starts = word_hashes(np.frombuffer(b"".join(parts), dtype=np.uint8))
    sizes = np.diff(np.searchsorted(starts, np.cumsum([0, *map(len, parts)]))).tolist()
    n = max(0, len(ids) - width + 1)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        h = mix(h * _STEP + ids[j : j + n])
    out, at = [], 0
    for size in sizes:
        if size >= width:
            x = np.sort(h[at : at + size - width + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif size:
            short = np.array([size], dtype=np.uint64)
            for x in ids[at : at + size]:
                short = mix(short * _STEP + x)
            out.append(short)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += size
    return out


def prefix_length(n, percent: int = PERCENT):
    """Tokens that a set of n must show so that a similar set of any size shares one of them."""
    return n - -(-percent * n // 100) + 1


def shown_length(n: int, percent: int = PERCENT) -> int:
    """Tokens of a set of n that are shown at first."""
    p = prefix_length(n, percent)
    return min(n, p + p // 2 + 8)


def _scan(width: int, percent: int, whole: bool):
    """Per document its set's size and fingerprint, and its least hashes (or all) in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                sets = shingle_sets(part.column("text").to_pylist(), width)
                prints = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), dtype=np.int64).reshape(-1, 2)
                keys = [(s if whole else s[: shown_length(len(s), percent) if len(s) else 0]) >> np.uint64(1) for s in sets]
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys).astype(np.int64) if keys else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists], names=["doc_id", "n", "f1", "f2", "keys"])

    return run


def _rows(column: pa.Array) -> list[np.ndarray]:
    """The rows of an array of lists, without copies."""
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
    return [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _measure(percent: int):
    """Sizes of both sets of a pair and of their intersection; from a similarity of ``percent`` on also the tokens that just one of them has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _rows(batch.column("keys_a")), _rows(batch.column("keys_b"))
            unlike = [np.setxor1d(x, y, assume_unique=True) for x, y in zip(left, right, strict=True)]
            na, nb, d = (np.array([len(x) for x in side], dtype=np.int64) for side in (left, right, unlike))
            both = (na + nb - d) // 2
            near = (100 + percent) * both >= percent * (na + nb)
            parts = [u if ok else u[:0] for u, ok in zip(unlike, near, strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(u) for u in parts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)), mask=pa.array(~near))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(na), pa.array(nb), pa.array(both), lists], names=["a", "b", "na", "nb", "both", "unlike"])

    return run


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each of the left sets shares with each of the right ones, by products of 0-1 blocks."""
    flat = [np.concatenate(side) for side in (left, right)]
    owner = [np.repeat(np.arange(len(side)), [len(x) for x in side]) for side in (left, right)]
    tokens = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    if not len(tokens):
        return out
    at = [np.searchsorted(tokens, f) for f in flat]
    keep = [tokens[np.minimum(k, len(tokens) - 1)] == f for k, f in zip(at, flat, strict=True)]
    at, owner = [k[x] for k, x in zip(at, keep, strict=True)], [o[x] for o, x in zip(owner, keep, strict=True)]
    for start in range(0, len(tokens), SLICE):
        block = []
        for side, k, o in zip((left, right), at, owner, strict=True):
            now = (k >= start) & (k < start + SLICE)
            m = np.zeros((len(side), min(SLICE, len(tokens) - start)), dtype=np.float32)
            m[o[now], k[now] - start] = 1
            block.append(m)
        out += block[0] @ block[1].T
    return out


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, row of its part with the least number) that join what a symmetric matrix links."""
    left, edges = np.ones(len(linked), dtype=bool), []
    for root in range(len(linked)):
        if not left[root]:
            continue
        part, front = np.zeros(len(linked), dtype=bool), np.array([root])
        part[root] = True
        while len(front):
            new = linked[front].any(axis=0) & ~part
            part |= new
            front = np.flatnonzero(new)
        left &= ~part
        edges += [(int(k), root) for k in np.flatnonzero(part) if k != root]
    return edges


def _blocks(percent: int):
    """Of the sets in two chunks around one hub (or one chunk): how many rows each links with, and a forest of the links."""

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_numpy()
        ids, n, w = (table.column(c).to_numpy() for c in ("doc_id", "n", "w"))
        sets = _rows(table.column("unlike").combine_chunks())
        d = np.array([len(x) for x in sets], dtype=np.int64)
        same = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        a = np.flatnonzero(chunk == table.column("low")[0].as_py())
        b = a if same else np.flatnonzero(chunk == table.column("high")[0].as_py())
        if not len(a) or not len(b):
            return pa.table({"doc_id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
        shared = np.rint(_common([sets[i] for i in a], [sets[i] for i in b])).astype(np.int64)
        sizes = n[a][:, None] + n[b][None, :]
        # |x & y| = (|x| + |y| - |x ^ y|) / 2, and x ^ y is what just one of both differences has.
        both = (sizes - (d[a][:, None] + d[b][None, :] - 2 * shared)) // 2
        linked = (100 + percent) * both >= percent * sizes
        if same:
            np.fill_diagonal(linked, False)
            rows, whole = a, linked
        else:
            rows = np.concatenate([a, b])
            whole = np.zeros((len(rows), len(rows)), dtype=bool)
            whole[: len(a), len(a) :] = linked
            whole[len(a) :, : len(a)] = linked.T
        counts = whole.astype(np.float64) @ w[rows].astype(np.float64)
        other = ids[rows].copy()
        for k, root in _forest(whole):
            other[k] = ids[rows][root]
        return pa.table({"doc_id": pa.array(ids[rows]), "links": pa.array(np.rint(counts).astype(np.int64)), "other": pa.array(other)})

    return run


def _ordered(hits: DataFrame) -> DataFrame:
    """``key, doc_id, n, pos`` with places in the final order, from places by hash.

    ``hits``: key, doc_id, n, given (tokens shown), pos, and m, the number of sets that show
    the token.  A token that is not frequent moves up by the frequent ones before it;
    frequent ones follow all others.  Rows of tokens that no other set shows may be absent.
    """
    x = hits.withColumn("often", (F.col("m") > FREQUENT).cast("int"))
    doc = Window.partitionBy("doc_id", "n")
    before = F.sum("often").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("often")
    x = x.withColumn("before", before).withColumn("rare", F.col("given") - F.sum("often").over(doc))
    pos = F.when(F.col("often") == 1, F.col("rare") + F.col("before")).otherwise(F.col("pos") - F.col("before"))
    return x.select("key", "doc_id", "n", pos.cast("int").alias("pos"), "m")


def linked_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, repeated: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The join: ``(members, counts, comps)``.  An id may stand for one text only, in several rows if ``repeated``.

    ``members``: doc_id, n, rep (the smallest id with an equal set).  ``counts``: rep,
    n_links, the rows that link with a row of rep's class.  ``comps``: node, component over
    representatives.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kinds = "doc_id long, n long, f1 long, f2 long, keys array<long>"
    parts = materialize(docs.mapInArrow(_scan(width, percent, False), kinds), "join-scan")
    rows = materialize(parts.select("doc_id", "n", "f1", "f2"), "join-rows")
    classes = materialize(rows.where("n > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")), "join-classes")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    once = lambda x: x.dropDuplicates(["doc_id"]) if repeated else x
    known = docs.where("doc_id is not null")
    pairs = _Pairs(percent)
    first = materialize(once(parts.where("n > 0").select("doc_id", "n", "keys").join(reps.hint("merge"), "doc_id", "left_semi")), "join-first")
    release(parts)
    sets = _Sets(lambda ids: once(known.join(ids, "doc_id", "left_semi").mapInArrow(_scan(width, percent, True), kinds).select("doc_id", "n", "keys")))
    lists = _lists(first, sets, pairs)
    release(first)
    members = materialize(rows.join(classes, ["f1", "f2"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).alias("rep")), "join-members")
    release(rows, classes)
    # Each set's listed tokens, which tell how many of its prefix it shares with another one.
    shown = materialize(lists.groupBy("doc_id", "n").agg(F.collect_list("key").alias("keys")), "join-shown")
    answers, held = _answers(sets, _star(lists, pairs), shown, pairs, MEASURED)
    hubs = _hubs(answers, shown)
    more, again = _answers(sets, _nearer(lists, hubs, answers, sets), shown, pairs, MEASURED)
    answers = answers.unionByName(more)
    release(hubs)
    hubs = _hubs(answers, shown)
    more, last = _answers(sets, _rest(lists, hubs, answers, pairs), shown, pairs, percent)
    answers = answers.unionByName(more)
    release(lists, *sets.tables)
    weights = materialize(members.where("rep is not null and doc_id is not null").groupBy(F.col("rep").alias("doc_id")).agg(F.count("*").alias("w")), "join-weights")
    around, groups = _around(answers, hubs, shown, weights, percent)
    # Links of sets with one hub are told by the blocks, all others by single answers.
    told = answers.where("linked").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    hub = lambda c: hubs.select(F.col("doc_id").alias(c), F.col("hub").alias(f"hub_{c}"))
    told = told.join(hub("a"), "a").join(hub("b"), "b").join(groups.select(F.col("hub").alias("hub_a"), F.lit(True).alias("done")), "hub_a", "left")
    single = materialize(told.where("done is null or hub_a <> hub_b").select("a", "b"), "join-single")
    comps = components(single.union(around.where("doc_id <> other").select(F.col("doc_id").alias("a"), F.col("other").alias("b"))))
    both = single.union(single.select("b", "a"))
    compared = both.join(weights.withColumnRenamed("doc_id", "b"), "b").select(F.col("a").alias("doc_id"), F.col("w").alias("links"))
    all_ = weights.select("doc_id", (F.col("w") - 1).alias("links")).union(around.select("doc_id", "links")).union(compared)
    counts = materialize(all_.groupBy(F.col("doc_id").alias("rep")).agg(F.sum("links").alias("n_links")), "join-counts")
    release(around, groups, hubs, single, weights, shown, *held, *again, *last)
    return members, counts, comps


class _Sets:
    """Whole sets, made from whole texts when first asked for, once each."""

    def __init__(self, make):
        self.make, self.tables = make, []

    def of(self, ids: DataFrame) -> DataFrame:
        """``doc_id, n, keys`` of all sets made so far, those of ``ids(doc_id)`` among them."""
        for t in self.tables:
            ids = ids.join(t.select("doc_id"), "doc_id", "left_anti")
        new = materialize(ids, "join-new")
        n = new.count()
        if n or not self.tables:
            self.tables.append(materialize(self.make(F.broadcast(new) if n <= FEW else new.hint("merge")), "join-sets"))
        release(new)
        return self.all()

    def all(self) -> DataFrame:
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.union(t)
        return out


def _lists(first: DataFrame, sets: _Sets, p: _Pairs) -> DataFrame:
    """``key, doc_id, n, pos, block``: the prefixes of all sets, less tokens that no other set has there.

    ``first``: the tokens that each set shows at first.
    """
    explode = lambda x: x.select("doc_id", F.col("n").cast("int").alias("n"), F.size("keys").alias("given"), F.posexplode("keys").alias("pos", "key"))
    index = explode(first)
    shared = materialize(index.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "join-keys")
    hits = materialize(index.join(shared.hint("merge"), "key").select("key", "doc_id", "n", "given", "pos", "m"), "join-hits")
    # Sets with too few rare tokens among those shown: they show all.
    often = F.count_if(F.col("m") > FREQUENT)
    short = hits.groupBy("doc_id", "n", "given").agg(often.alias("often")).where(f"given < n and given - often < {p.prefix('n')}")
    short = materialize(short.select("doc_id").distinct(), "join-short")
    tokens = explode(sets.of(short))
    heavy = _ordered(tokens.join(shared, "key", "left").withColumn("m", F.coalesce("m", F.lit(0)))).where(f"pos < {p.prefix('n')}")
    heavy = materialize(heavy, "join-heavy")
    # Tokens that thereby came in, where other sets show them.
    late = index.join(heavy.where("m < 2").select("key").distinct().hint("merge"), "key", "left_semi").withColumn("m", F.lit(1).cast("long"))
    light = hits.union(late.select(*hits.columns)).join(short, "doc_id", "left_anti")
    listed = _ordered(light).where(f"pos < {p.prefix('n')}").union(heavy)
    # Blocks of a factor 100 / percent: similar sets lie in one block or in neighbouring ones.
    block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / p.percent))).cast("int")
    lists = materialize(listed.select("key", "doc_id", "n", "pos", block.alias("block")), "join-lists")
    release(hits, short, shared, heavy)
    return lists


class _Pairs:
    """Conditions on a pair of sets x, y with |x| <= |y|, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent
        # Overlap of a pair: 100 * both >= percent * (|x| + |y| - both).
        self.linked = f"{100 + percent}L * both >= {percent}L * (na + nb)"
        # The smaller set need only show the prefix that a partner of its own size or more asks for.
        self.leading = F.expr(f"pos <= n - cast(ceil({2 * percent}L * n / {100.0 + percent}D - 1e-9) as int)")

    def least(self, n: str) -> str:
        """What a set must share with any similar one."""
        return f"cast(ceil({self.percent}L * {n} / 100.0D - 1e-9) as int)"

    def prefix(self, n: str) -> str:
        return f"({n} - {self.least(n)} + 1)"

    def possible(self, xn: str, xpos: str, yn: str, ypos: str):
        """Sizes fit, and what follows the shared token is enough if it is the first one shared."""
        return F.expr(f"{xn} <= {yn} and 100L * {xn} >= {self.percent}L * {yn} and {100 + self.percent}L * least({xn} - {xpos}, {yn} - {ypos}) >= {self.percent}L * ({xn} + {yn})")

    def either(self, xn: str, xpos: str, yn: str, ypos: str):
        return self.possible(xn, xpos, yn, ypos) | self.possible(yn, ypos, xn, xpos)

    def bounded(self, pairs: DataFrame, shown: DataFrame, percent: int) -> DataFrame:
        """``a, b, ok``: whether a bound of the overlap from the prefixes reaches ``percent``.

        Of two prefixes, let one end first in the global order.  What both sets share up to
        there is in both prefixes; beyond it, its own set has only ``least - 1`` tokens left.
        """
        side = lambda c: shown.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("keys").alias(f"keys{c}"))
        left = lambda n: F.expr(f"{self.least(n)} - 1")
        x = pairs.join(side("b"), "b").join(side("a"), "a")
        x = x.withColumn("most", (F.size(F.array_intersect("keysa", "keysb")) + F.greatest(left("na"), left("nb"))).cast("long"))
        ok = F.expr(f"{100 + percent}L * least(most, na, nb) >= {percent}L * (na + nb)")
        return x.groupBy("a", "b").agg(F.max(ok).alias("ok"))


def _answers(sets: _Sets, pairs: DataFrame, shown: DataFrame, p: _Pairs, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """``a, b, na, nb, both, unlike, linked`` of each pair, and the tables that hold it.

    ``both`` and ``unlike`` are null where a bound was enough to tell that the similarity
    is less than ``percent``, ``unlike`` also where the overlap tells that it is less than NEAR.
    """
    asked = materialize(p.bounded(pairs, shown, percent), "join-asked")
    wanted = asked.where("ok").select("a", "b")
    there = sets.of(wanted.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    side = lambda c: there.select(F.col("doc_id").alias(c), F.col("keys").alias(f"keys_{c}"))
    x = wanted.hint("merge").join(side("b"), "b").hint("merge").join(side("a"), "a").select("a", "b", "keys_a", "keys_b")
    tested = materialize(x.mapInArrow(_measure(NEAR), "a long, b long, na long, nb long, both long, unlike array<long>"), "join-tested")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("na", "long"), ("nb", "long"), ("both", "long"), ("unlike", "array<long>"))]
    told = tested.withColumn("linked", F.expr(p.linked)).union(asked.where("not ok").select("a", "b", *none, F.lit(False)))
    return told, [asked, tested]


def _star(lists: DataFrame, p: _Pairs) -> DataFrame:
    """Pairs (leader, set): in each list every set with the leaders of its block and of the next smaller one."""
    leaders = lists.groupBy("key", F.col("block").alias("open")).agg(F.min(F.struct("doc_id", "n", "pos")).alias("lead"))
    probes = lists.withColumn("open", F.explode(F.array("block", F.col("block") - 1)))
    star = probes.join(leaders, ["key", "open"]).where(F.col("doc_id") != F.col("lead.doc_id")).where(p.either("lead.n", "lead.pos", "n", "pos"))
    return star.select(F.col("lead.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()


def _hubs(answers: DataFrame, shown: DataFrame) -> DataFrame:
    """``doc_id, hub, fame``: of the sets that a set was compared with, itself included, the one compared with most sets."""
    exact = answers.where("unlike is not null")
    ends = exact.select(F.col("a").alias("hub"), F.col("b").alias("doc_id")).union(exact.select("b", "a")).union(shown.select(F.col("doc_id").alias("hub"), "doc_id")).distinct()
    fame = ends.groupBy("hub").agg(F.count("*").alias("fame"))
    best = ends.join(fame, "hub").groupBy("doc_id").agg(F.max(F.struct("fame", (-F.col("hub")).alias("less"))).alias("top"))
    return materialize(best.select("doc_id", (-F.col("top.less")).alias("hub"), F.col("top.fame").alias("fame")), "join-hubs")


def _nearer(lists: DataFrame, hubs: DataFrame, answers: DataFrame, sets: _Sets) -> DataFrame:
    """New pairs (hub, set): each set with the most compared hub of its lists, where that is not its own.

    Only of sets that are there already: one that no leader asked for is near none of them.
    """
    rows = lists.select("key", "block", "doc_id").join(hubs, "doc_id")
    tops = rows.groupBy("key", "block").agg(F.max(F.struct("fame", "hub")).alias("top"))
    opened = rows.withColumn("block", F.explode(F.array("block", F.col("block") - 1, F.col("block") + 1)))
    best = opened.join(tops, ["key", "block"]).groupBy("doc_id").agg(F.max("top").alias("top"), F.first("fame").alias("fame"))
    asked = best.where("top.fame > fame and top.hub <> doc_id").select(F.col("top.hub").alias("a"), F.col("doc_id").alias("b"))
    asked = asked.join(sets.all().select(F.col("doc_id").alias("b")), "b", "left_semi").select("a", "b")
    return asked.join(_either_way(answers), ["a", "b"], "left_anti")


def _either_way(answers: DataFrame) -> DataFrame:
    return answers.select("a", "b").union(answers.select(F.col("b"), F.col("a"))).toDF("a", "b").distinct()


def _rest(lists: DataFrame, hubs: DataFrame, answers: DataFrame, p: _Pairs) -> DataFrame:
    """Pairs of sets of different hubs that meet in a list and can link."""
    rows = lists.join(hubs.select("doc_id", "hub"), "doc_id")
    left = rows.where(p.leading).select("key", *[F.col(c).alias(f"x_{c}") for c in ("doc_id", "n", "pos", "hub", "block")])
    opened = rows.withColumn("x_block", F.explode(F.array("block", F.col("block") - 1)))
    pairs = left.join(opened, ["key", "x_block"]).where("x_doc_id <> doc_id and x_hub <> hub").where(p.possible("x_n", "x_pos", "n", "pos"))
    pairs = pairs.select(F.least("x_doc_id", "doc_id").alias("a"), F.greatest("x_doc_id", "doc_id").alias("b")).distinct()
    return materialize(pairs.join(_either_way(answers), ["a", "b"], "left_anti"), "join-rest")


def _around(answers: DataFrame, hubs: DataFrame, shown: DataFrame, weights: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, links, other`` from the blocks around hubs, and the ``hub`` of each such group.

    A group of a hub and one more set needs none: their answer is known.
    """
    groups = hubs.groupBy("hub").agg(F.count_if(F.col("hub") != F.col("doc_id")).alias("others")).where("others > 1").select("hub")
    groups = materialize(groups, "join-groups")
    near = answers.where("unlike is not null")
    ends = near.select(F.col("a").alias("hub"), F.col("b").alias("doc_id"), F.col("nb").alias("n"), "unlike").union(near.select("b", "a", "na", "unlike"))
    # A pair can be asked for from either side; the hub itself differs in nothing.
    ends = ends.join(hubs.select("hub", "doc_id"), ["hub", "doc_id"], "left_semi").dropDuplicates(["hub", "doc_id"])
    own = hubs.where("hub = doc_id").select("hub", "doc_id").join(shown.select("doc_id", F.col("n").cast("long").alias("n")), "doc_id").select("hub", "doc_id", "n", F.array().cast("array<long>").alias("unlike"))
    unlike = materialize(ends.union(own).join(groups.hint("merge"), "hub", "left_semi").join(weights, "doc_id"), "join-unlike")
    sizes = unlike.groupBy("hub").agg(F.count("*").alias("m"), F.sum(F.size("unlike")).alias("tokens"))
    chunks = F.ceil(F.greatest(F.col("m") / CHUNK, F.col("tokens") / CHUNK_TOKENS)).cast("int")
    x = unlike.join(sizes.select("hub", chunks.alias("chunks")), "hub")
    x = x.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), "chunks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    x = x.select("hub", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high"), "chunk", "doc_id", "n", "w", "unlike")
    # Dealt by pairs of chunks: what the join was dealt by would put all of a hub's into one task.
    x = x.repartition("hub", "low", "high")
    out = materialize(x.groupBy("hub", "low", "high").applyInArrow(_blocks(percent), "doc_id long, links long, other long"), "join-around")
    release(unlike)
    return out, groups


def jaccard_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id`` (smallest id reachable by links) and ``n_links``."""
    if dict(df.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is to be a whole number; number the rows first")
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    repeated = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("again")), "join-repeated")
    several = not repeated.isEmpty()
    if several:
        # Each text of a repeated id is a node of its own; the id ties their components together.
        docs = materialize(docs.join(repeated, "doc_id", "left").select(F.when(F.col("again"), F.xxhash64("doc_id", "text")).otherwise(F.col("doc_id")).alias("doc_id"), "text", F.col("doc_id").alias("id")), "join-nodes")
    members, counts, comps = linked_classes(docs, "doc_id", "text", width, percent, several)
    label = comps.select(F.col("node").alias("rep"), "component")
    if several:
        names = docs.where("id is not null").select("doc_id", "id").distinct()
        ids = materialize(members.join(names, "doc_id", "left").join(label, "rep", "left").withColumn("component", F.coalesce("component", "rep", "doc_id")), "join-ids")
        least = ids.where("id is not null").groupBy("component").agg(F.min("id").alias("low"))
        ties = components(ids.where("id is not null").join(least, "component").select(F.col("id").alias("a"), F.col("low").alias("b")))
        out = ids.join(ties.select(F.col("node").alias("id"), F.col("component").alias("tied")), "id", "left").select(F.col("id").alias("doc_id"), "n", "rep", F.coalesce("tied", "id").alias("component"))
    else:
        out = members.join(label, "rep", "left")
    out = out.join(counts, "rep", "left")
    links = F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"), links.alias("n_links"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its component; of several rows of one id the one with the least text.

    Rows without an id link with nothing, so all of them stay.
    """
    name, place = free_name(df, "_kept"), free_name(df, "_place")
    own = F.col(f"`{id_col}`")
    groups = jaccard_join(df, id_col, text_col, width, percent).where("doc_id = component_id or doc_id is null").select(F.col("doc_id").alias(name)).distinct()
    kept = df.join(groups, own.eqNullSafe(F.col(name)), "left_semi")
    again = materialize(df.where(own.isNotNull()).groupBy(own.alias(name)).count().where("count > 1").select(name), "join-again")
    if again.isEmpty():
        return kept
    first = F.row_number().over(Window.partitionBy(own).orderBy(F.col(f"`{text_col}`").asc_nulls_last()))
    one = kept.join(again, own == F.col(name), "left_semi").withColumn(place, first).where(F.col(place) == 1).drop(place)
    return kept.join(again, own == F.col(name), "left_anti").unionByName(one)


def query(docs: DataFrame) -> DataFrame:
    return jaccard_join(docs)


ORACLE = """
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s from w),
e as (select doc_id, len(s) as n, hash(unnest(s)) as t from s),
p as (select x.doc_id as a, y.doc_id as b, any_value(x.n) as na, any_value(y.n) as nb, count(*) as shared from e x join e y on x.t = y.t and x.doc_id < y.doc_id group by 1, 2),
o as (select a, b from p where 100 * shared >= 80 * (na + nb - shared)),
l as (select a, b from o union all select b, a from o),
r as (select a as node, b as reach from l union select r.node, l.b from r join l on l.a = r.reach),
c as (select node, min(reach) as low from r group by 1),
d as (select a as node, count(*) as n_links from l group by 1)
select doc_id, cast(len(s) as bigint) as n_shingles, least(doc_id, coalesce(low, doc_id)) as component_id, cast(coalesce(n_links, 0) as bigint) as n_links
from s left join c on c.node = doc_id left join d on d.node = doc_id"""
