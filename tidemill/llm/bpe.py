"""Byte-pair encoding by speculation and verification, and decoding.

For each new word, greedy longest match speculates on its tokens.  A token sequence is
the true encoding exactly when every adjacent pair is one that merging would leave apart
(and each token encodes to itself), so the speculation is verified by testing all pairs
of all new words at once, in vectors.  Only words with a failing pair are merged one
merge at a time.  Normalising and splitting into words are the tokenizer file's own.

When does merging leave a pair (x, y) apart?  At any time the bytes beside the border
belong to a node of x's right spine and one of y's left spine.  Such nodes l and r join
across the border if (l, r) is a merge that comes before the merge that takes l into its
parent, and not after the one that takes r into its parent (equal merges go from the
left).  So x and y stay apart when no pair of spine nodes does that.

Words do not cross ASCII white space, so each distinct run of other characters is
encoded once and kept while there are not too many; long texts and long words need no
more than their own length.

Defined results: null and empty texts have no tokens and decode to the empty text;
special tokens that stand in a text become their ids; repeated rows are encoded one by
one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TOKENIZER = "word_bpe_49k.json"
#: Words of these characters are normalised and split here; all Unicode versions agree on them.
_PLAIN = re.compile(r"[\x21-\x7e\u00a1-\u024f]+")
#: The normalising steps for which that is right: canonical composition, white space, lower case.
_STEPS = ["NFC", "Replace", "Lowercase"]
#: The alternative of a word pattern that takes letters.
_LETTERS = r"[\p{L}]+"
#: Up to so many symbols, merging scans a list instead of keeping a heap.
_SHORT = 32
#: A vocabulary file is shipped to the executors only up to this size.
MAX_FILE = 64 << 20
#: Words remembered by a worker.
REMEMBERED = 1 << 19


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def read(path: str) -> str:
    """The tokenizer file's text, its size checked."""
    with open(path, encoding="utf-8") as f:
        text = f.read(MAX_FILE + 1)
    if len(text) > MAX_FILE:
        raise ValueError(f"{path} is larger than {MAX_FILE} bytes")
    return text


class Codec:
    """Encoder and decoder for one tokenizer file with a BPE model."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        spec = json.loads(text)
        model = spec["model"]
        assert model["type"] == "BPE" and not model.get("byte_fallback") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
        library = Tokenizer.from_str(text)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.pattern = self._own_pattern(spec)
        # Whether the pattern takes a run of letters whole: it has that alternative, and none before it begins with a letter.
        options = self.pattern.pattern.split("|") if self.pattern is not None else []
        self.letters = _LETTERS in options and not any(o[:1].isalpha() or o[:1] in "[(\\." for o in options[: options.index(_LETTERS)])
        # Bytes as the characters that stand for them in the vocabulary.
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        others = [b for b in range(256) if b not in set(printable)]
        self.chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.border = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ", 1)
            new = self.ids[a + b]
            pair = (self.ids[a], self.ids[b])
            if pair not in self.merges:
                self.merges[pair] = (rank, new)
                parts.setdefault(new, (rank, *pair))
        self._spines(parts)
        # Only tokens that their own merging yields may be proposed: inside a piece, or (less the end mark) at its end.
        self.inside: dict[str, int] = {}
        self.at_end: dict[str, int] = {}
        for t, i in self.ids.items():
            if i not in parts or self._itself(t, i):
                if self.suffix and t.endswith(self.suffix):
                    self.at_end[t[: -len(self.suffix)]] = i
                else:
                    self.inside[t] = i
        if not self.suffix:
            self.at_end = self.inside
        # The longest proposal that begins with three given characters; without any, two characters are tried at most.
        self.longest: dict[str, int] = {}
        for t in [*self.inside, *self.at_end]:
            self.longest[t[:3]] = max(len(t), self.longest.get(t[:3], 2))
        self.pieces_known: dict[str, tuple[bytes, str]] = {}
        self.known: dict[bytes, tuple[bytes, str]] = {}

    @staticmethod
    def _own_pattern(spec: dict):
        """The file's word pattern, if its steps are those that ``pieces`` can take by itself."""
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if steps != _STEPS or [x["type"] for x in splits] != ["Split", "ByteLevel"]:
            return None
        split, level = splits
        own = split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]
        return regex.compile(split["pattern"]["Regex"]) if own and "Regex" in split["pattern"] else None

    def _itself(self, token: str, i: int) -> bool:
        return self.merge(self._symbols(token)) == [i]

    def _symbols(self, token: str) -> list[int]:
        """A token's or piece's starting symbols; a piece has the end mark already."""
        end = self.suffix if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix) else ""
        body = token[: len(token) - len(end)]
        chars = [*body[:-1], body[-1:] + end] if body else []
        return [self.ids[c] for c in chars if c in self.ids]

    def _spines(self, parts: dict[int, tuple[int, int, int]]) -> None:
        """For each token the nodes of its outer spines with the rank of the merge that takes each in."""
        size, never = max(self.names, default=0) + 1, np.iinfo(np.int32).max
        lists = {1: [[] for _ in range(size)], 2: [[] for _ in range(size)]}
        for side in (1, 2):
            for t in range(size):
                node, taken = t, never
                while True:
                    lists[side][t].append((node, taken))
                    if node not in parts:
                        break
                    taken, node = parts[node][0], parts[node][side]
        table = lambda rows, k: np.array([[x[k] for x in r] + [-1] * (depth - len(r)) for r in rows], dtype=np.int64)
        depth = max((len(r) for s in lists.values() for r in s), default=1)
        self.left, self.left_taken = table(lists[1], 0), table(lists[1], 1)
        self.right, self.right_taken = table(lists[2], 0), table(lists[2], 1)
        keys = np.array([a << 32 | b for a, b in self.merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.merges.values()], dtype=np.int64)[order]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether merging leaves them apart."""
        out = np.ones(len(x), dtype=bool)
        if not len(self.keys):
            return out
        for i in range(self.right.shape[1]):
            some = np.flatnonzero(self.right[x, i] >= 0)
            if not len(some):
                break
            for j in range(self.left.shape[1]):
                at = some[self.left[y[some], j] >= 0]
                if not len(at):
                    break
                l, r = self.right[x[at], i], self.left[y[at], j]
                key = l << 32 | r
                k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                m = self.ranks[k]
                joins = (self.keys[k] == key) & (m < self.right_taken[x[at], i]) & (m <= self.left_taken[y[at], j])
                out[at[joins]] = False
        return out

    def propose(self, piece: str) -> list[int] | None:
        """Greedy longest match over a piece whose end mark is its last token's; None where nothing matches."""
        n, i, out = len(piece), 0, []
        inside, longest = self.inside, self.longest
        while i < n:
            j = i + longest.get(piece[i : i + 3], 2)
            if j >= n:
                t = self.at_end.get(piece[i:])
                if t is not None:
                    out.append(t)
                    return out
                j = n - 1
            while j > i:
                t = inside.get(piece[i:j])
                if t is not None:
                    break
                j -= 1
            else:
                return None
            out.append(t)
            i = j
        return out

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact merging: always the least rank, from the left; n log n by a heap over a linked list."""
        n = len(symbols)
        if n <= _SHORT:
            return self._merge_short(list(symbols))
        ids, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merges.get((ids[i], ids[j]))):
                heapq.heappush(heap, (m[0], i, ids[i], ids[j], m[1]))

        for i in range(n):
            push(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                push(before[i])
            push(i)
        return [x for x in ids if x >= 0]

    def _merge_short(self, ids: list[int]) -> list[int]:
        get, none = self.merges.get, (1 << 60, -1)
        ranks = [get(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            k = ranks.index(best)
            ids[k : k + 2] = [best[1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), none)
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), none)
        return ids

    def _chars(self, piece: str) -> str:
        """A piece's bytes as the characters that stand for them."""
        return piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.chars)

    def pieces(self, text: str) -> Iterator[str | int]:
        """Pieces to encode, and ids of special tokens, in order."""
        for k, part in enumerate(self.border.split(text) if self.border else [text]):
            if k % 2:
                yield self.special[part]
            elif self.pattern is not None and _PLAIN.fullmatch(part):
                yield from map(self._chars, self.pattern.findall(part.lower()))
            elif part:
                for piece, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part)):
                    if piece:
                        yield piece

    def _split(self, words: list[bytes]) -> list[list[str | int]]:
        """The pieces of each word; one of plain letters alone is a single piece where the file's pattern takes letters whole."""
        out = []
        for w in words:
            text = w.decode("utf-8", "surrogatepass")
            if self.letters and (low := text.lower()).isalpha() and _PLAIN.fullmatch(text):
                out.append([self._chars(low)])
            else:
                out.append(list(self.pieces(text)))
        return out

    def _packed(self, ids: list[int]) -> tuple[bytes, str]:
        return struct.pack(f"<{len(ids)}I", *ids), "".join([self.names[i] + " " for i in ids])

    def encode_pieces(self, pieces: list[str]) -> None:
        """Remember the encodings of new pieces, all of them verified together."""
        guesses = [self.propose(p) for p in pieces]
        sizes = np.array([len(g) if g else 0 for g in guesses], dtype=np.int64)
        flat = np.fromiter((t for g in guesses if g for t in g), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(pieces)), sizes)
        good = np.array([g is not None for g in guesses], dtype=bool)
        near = np.flatnonzero(owner[1:] == owner[:-1])
        ok = self.apart(flat[near], flat[near + 1])
        good[owner[near[~ok]]] = False
        for p, g, sure in zip(pieces, guesses, good.tolist(), strict=True):
            self.pieces_known[p] = self._packed(g if sure else self.merge(self._symbols(p + self.suffix)))

    def learn(self, words: set[bytes]) -> None:
        """Remember the encodings of words, and of their pieces."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            self.pieces_known.clear()
            new = list(words)
        parts, known = self._split(new), self.pieces_known
        self.encode_pieces(list(dict.fromkeys(p for ps in parts for p in ps if isinstance(p, str) and p not in known)))
        for w, ps in zip(new, parts, strict=True):
            if len(ps) == 1 and isinstance(ps[0], str):
                self.known[w] = known[ps[0]]
            else:
                got = [known[p] if isinstance(p, str) else self._packed([p]) for p in ps]
                self.known[w] = (b"".join([x for x, _ in got]), "".join([t for _, t in got]))

    def encode_all(self, texts: list[str | None]) -> Iterator[tuple[bytes, str]]:
        """Packed little-endian ids and the decoded text of each text."""
        split = [[] if t is None else t.encode("utf-8", "surrogatepass").split() for t in texts]
        self.learn({w for ws in split for w in ws})
        known = self.known
        for ws in split:
            got = [known[w] for w in ws]
            ids, names = zip(*got, strict=True) if got else ((), ())
            yield b"".join(ids), "".join(names)[:-1]

    def decode(self, ids: bytes) -> str:
        return " ".join(self.names[i] for i in np.frombuffer(ids, dtype="<u4").tolist() if i in self.names)


_CODECS: dict[str, Codec] = {}


def codec(text: str) -> Codec:
    """A worker's codec, kept from task to task."""
    if text not in _CODECS:
        _CODECS.clear()
        _CODECS[text] = Codec(text)
    return _CODECS[text]


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: ids packed as little-endian unsigned 32-bit integers."""
    shared = df.sparkSession.sparkContext.broadcast(read(path or default_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                got = list(c.encode_all(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(x) // 4 for x, _ in got], pa.int64()), pa.array([x for x, _ in got], pa.binary()), pa.array([t for _, t in got], pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )

    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids binary, decoded string")


def decode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, decoded`` from packed ids; ids that the vocabulary lacks are passed over."""
    shared = df.sparkSession.sparkContext.broadcast(read(path or default_path()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([c.decode(x.as_py() or b"") for x in b.column("ids")], pa.string())], names=["doc_id", "decoded"])

    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{ids_col}`").alias("ids"))
    return docs.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, decoded string")


def query(docs: DataFrame) -> DataFrame:
    x = encode(docs)
    return x.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
