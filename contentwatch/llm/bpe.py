"""Operator 10: byte-level BPE encoding and decoding by monoid tree reduction.

A text is cut in halves down to leaves of at most ``leaf`` characters, each leaf is encoded by itself, and neighbours are
joined by encoding a window around the cut anew.  The window grows until the tokens outside are proven final:

* between words: no piece of the pattern holds white space after another character, so a change from
  the one to the other starts a piece whatever stands around it.  A window between two such places can't
  reach tokens beyond them; the halves give up the tokens inside it and keep the others;
* inside one long piece: an encoding by merges is final exactly when each pair of neighbouring tokens
  encodes to itself (Berglund & van der Merwe 2023).  Pairs away from the cut hold already, so only the two
  pairs at the window's ends are tested.

A stretch of over eight leaves without such a place (a long run, or a script without spaces) is one node: its pieces are
told by the pattern, and one of over ``PIECE`` bytes is a tree over its tokens.  Decoding joins the tokens' bytes up the same
kind of tree.  No tokenizer library takes part; the tests compare with one.

Cases: a null text encodes as empty (no ids, decoded empty); a very long text costs time in proportion; repeated rows, ties
and empty tables pass through; further columns are kept, and where one has the name of an output column, the new one
gets a bar at its end (``ids_``).
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentwatch.llm.common import arrow_lists, free_name, slices, written

LEAF = 1024
WINDOW = 32
PIECE = 256
WIDE = 24
MEMO = 400_000
MERGED = 1 << 12
BLOCK = 1 << 20
NONE = (1 << 31) - 1


class Memo(dict):
    """The ids of pieces met before; it starts anew when it would hold more than ``most``."""

    def __init__(self, tree: TreeBpe, most: int = MEMO):
        super().__init__()
        self.tree, self.most = tree, most

    def __missing__(self, piece: str) -> list[int]:
        return self.tree.piece(piece.encode())

    def learn(self, pieces: set[str]) -> None:
        """Takes in pieces, the short ones all at once."""
        new = [p for p in pieces if p not in self and len(p) <= WIDE]
        if len(self) + len(new) > self.most:
            self.clear()
            new = [p for p in pieces if len(p) <= WIDE]
        self.update(zip(new, map(tuple, self.tree.merge_many([p.encode() for p in new]))))  # tuples of numbers cost the collector nothing


class TreeBpe:
    """Encodes and decodes with the ranks of a tiktoken file's content; ids are ranks."""

    def __init__(self, content: bytes, pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import regex

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.pieces = regex.compile(pattern)
        self.cut_after = regex.compile(r"(?<=\S)(?=\s)")
        self.leaf, self.window = leaf, window
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = {(self.ranks[t[:i]] << 24) + self.ranks[t[i:]]: r for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        self.memo = Memo(self)

    # encoding: a tree is planned first, so that all its new pieces are merged at once, and then reduced

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of texts that are of some MB together, or of one text."""
        new: list[str] = []
        plans = [self.plan(t, 0, len(t), new) if len(t) <= BLOCK else None for t in texts]
        self.memo.learn(set(new))
        return [self.reduce(p) if p is not None else self.span(t, 0, len(t)) for t, p in zip(texts, plans)]

    def span(self, text: str, lo: int, hi: int) -> list[int]:
        """The ids of text[lo:hi], a part of a long text, as a text of its own: halves down to blocks that are planned."""
        if hi - lo <= BLOCK:
            return self.encode_all([text[lo:hi]])[0]
        middle = (lo + hi) // 2
        a, b = self.certain(text, lo, hi, middle)
        if b - a > 8 * self.leaf:
            return self.span(text, lo, a) + self.stretch(text, a, b) + self.span(text, b, hi)
        left, right = self.span(text, lo, middle), self.span(text, middle, hi)
        return self.joined(left, right, self.pieces.findall(text, a, b), len(text[a:middle].encode()), len(text[middle:b].encode()))

    def stretch(self, text: str, lo: int, hi: int) -> list[int]:
        """The ids of a stretch without a certain place, piece by piece."""
        return list(chain.from_iterable(self.memo[m.group()] for m in self.pieces.finditer(text, lo, hi)))

    def leaf_of(self, text: str, lo: int, hi: int, new: list[str]) -> list:
        """The pieces of text[lo:hi]: the ids of those met before, else the piece itself, which is added to ``new``."""
        pieces = self.pieces.findall(text, lo, hi)
        found = list(map(self.memo.get, pieces, pieces))
        new += [x for x in found if x.__class__ is str]
        return found

    def plan(self, text: str, lo: int, hi: int, new: list[str]):
        """The tree of text[lo:hi]: a leaf is a list of pieces; a node (left, right, pieces of the window, its bytes on the left, on the right)."""
        if hi - lo <= self.leaf:
            return self.leaf_of(text, lo, hi, new)
        middle = (lo + hi) // 2
        a, b = self.certain(text, lo, hi, middle)
        if b - a > 8 * self.leaf:
            inner = self.leaf_of(text, a, b, new)
            return (self.plan(text, lo, a, new), (inner, self.plan(text, b, hi, new), [], 0, 0), [], 0, 0)
        left, right = self.plan(text, lo, middle, new), self.plan(text, middle, hi, new)
        if a == middle:
            return (left, right, [], 0, 0)
        return (left, right, self.leaf_of(text, a, b, new), len(text[a:middle].encode()), len(text[middle:b].encode()))

    def reduce(self, node) -> list[int]:
        if isinstance(node, list):
            return list(chain.from_iterable([self.memo[x] if x.__class__ is str else x for x in node]))
        left, right, window, before, after = node
        return self.joined(self.reduce(left), self.reduce(right), window, before, after)

    def joined(self, left: list[int], right: list[int], window: list, before: int, after: int) -> list[int]:
        """Two encoded neighbours as one: their tokens inside the window, ``before`` and ``after`` bytes of it, give way to its own."""
        i, j, size = len(left), 0, self.bytes_of
        while before:
            i -= 1
            before -= len(size[left[i]])
        while after:
            after -= len(size[right[j]])
            j += 1
        return left[:i] + self.reduce(window) + right[j:]

    def certain(self, text: str, lo: int, hi: int, middle: int) -> tuple[int, int]:
        """The nearest certain piece starts at or before and after ``middle``, by growing windows; else the ends."""
        a, b, size = lo, hi, self.window
        while True:
            left = max(lo, middle - size)
            found = [m.start() for m in self.cut_after.finditer(text, left + 1, middle + 1)]
            if found or left == lo:
                a = found[-1] if found else lo
                break
            size *= 2
        size = self.window
        while True:
            right = min(hi, middle + size)
            m = self.cut_after.search(text, middle + 1, min(right + 1, hi))
            if m or right == hi:
                b = m.start() if m else hi
                break
            size *= 2
        return a, b

    def piece(self, piece: bytes) -> list[int]:
        """The ids of one piece: its own, or its merges."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tree(piece)

    def merges(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties: the definition, with a heap."""
        n, ranks = len(piece), self.ranks
        if n < 2:
            return [ranks[piece]] if n else []
        end = list(range(1, n + 1))  # of the part that starts here; 0 once merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := ranks.get(piece[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return ids

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks that pairs of ids merge to; NONE where they don't."""
        keys = (left.astype(np.int64) << 24) + right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE) if len(self.pair_keys) else np.full(len(keys), NONE)

    def merge_many(self, pieces: list[bytes]) -> list[list[int]]:
        """``merges`` of many pieces, all at once: in each step every row merges its lowest pair, the leftmost on ties."""
        out = [[self.ranks[p]] if p in self.ranks else None for p in pieces]
        rest = sorted((i for i, x in enumerate(out) if x is None), key=lambda i: len(pieces[i]))  # alike in length, so that no row is scanned at a longer one's width
        for start in range(0, len(rest), MERGED):
            some = rest[start : start + MERGED]
            sizes = np.array([len(pieces[i]) for i in some])
            width = int(sizes.max()) + 1
            filled = np.arange(width) < sizes[:, None]
            ids = np.full((len(some), width), -1, np.int32)
            ids[filled] = self.byte_id[np.frombuffer(b"".join([pieces[i] for i in some]), np.uint8)]
            after = np.tile(np.arange(1, width + 1, dtype=np.int16), (len(some), 1))  # the next part's column
            before = np.tile(np.arange(-1, width - 1, dtype=np.int16), (len(some), 1))
            rank = np.full((len(some), width), NONE, np.int32)
            pair = filled[:, 1:]
            rank[:, :-1][pair] = self.rank_of(ids[:, :-1][pair], ids[:, 1:][pair])
            rows = np.arange(len(some))
            while len(rows):
                own = rank[rows]
                i = own.argmin(axis=1)
                least = own[np.arange(len(rows)), i]
                on = least < NONE
                rows, i, least = rows[on], i[on], least[on]
                j = after[rows, i]
                k = after[rows, j]
                ids[rows, i], ids[rows, j], rank[rows, j], after[rows, i] = least, -1, NONE, k
                following = k < sizes[rows]
                r, c = rows[following], k[following]
                before[r, c] = i[following]
                rank[rows, i] = NONE
                rank[r, i[following]] = self.rank_of(least[following], ids[r, c])
                p = before[rows, i]
                led = p >= 0
                r, c = rows[led], p[led]
                rank[r, c] = self.rank_of(ids[r, c], least[led])
            left = ids >= 0
            stops = np.cumsum(left.sum(axis=1)).tolist()
            flat = ids[left].tolist()
            for row, begin, stop in zip(some, [0, *stops], stops):
                out[row] = flat[begin:stop]
        return out

    def stable(self, a: int, b: int) -> bool:
        return self.merges(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def tree(self, piece: bytes, least: int = PIECE) -> list[int]:
        """The merges of one piece: halves, joined pairwise up the tree."""
        level = [self.merges(piece[i : i + least]) for i in range(0, len(piece), least)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encoded neighbours."""
        size = 1
        while True:
            i, j = max(0, len(left) - size), min(len(right), size)
            window = self.merges(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            fits_left = i == 0 or (window and self.stable(left[i - 1], window[0]))
            fits_right = j == len(right) or (window and self.stable(window[-1], right[j]))
            if fits_left and fits_right:
                return left[:i] + window + right[j:]
            size *= 2


def decode_ids(ids: list[int], bytes_of: dict[int, bytes], leaf: int = LEAF) -> bytes:
    """The bytes of ids: leaves first, then pairs up the tree."""
    level = [b"".join(map(bytes_of.__getitem__, ids[i : i + leaf])) for i in range(0, len(ids), leaf)]
    while len(level) > 1:
        level = [b"".join(level[i : i + 2]) for i in range(0, len(level), 2)]
    return level[0] if level else b""


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _defaults(path: str | None, pattern: str | None) -> tuple[str, str]:
    if path is None or pattern is None:
        import public_tokenizers

        path, pattern = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return path, pattern


_trees: dict = {}


def _tree(content: bytes, pattern: str) -> TreeBpe:
    """One tree a Python worker, so that its memo lasts from task to task."""
    key = (hash(content), len(content), pattern)
    if key not in _trees:
        _trees.clear()
        _trees[key] = TreeBpe(content, pattern)
    return _trees[key]


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode(df: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None, decoded: str | None = None) -> DataFrame:
    """``df`` with the ids (array<int>) of each text and, if named, the bytes that they decode to.  The rank file, of fixed size, is read on the driver and sent along."""
    path, pattern = _defaults(path, pattern)
    ids, decoded = free_name(df, ids), decoded and free_name(df, decoded)
    content = df.sparkSession.sparkContext.broadcast(_content(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tree(content.value, pattern)
        for batch in slices(batches, text, 1 << 20):
            column = batch.column(batch.schema.names.index(text)).to_pylist()
            found = bpe.encode_all([x or "" for x in column])
            back = [pa.array([decode_ids(x, bpe.bytes_of) for x in found], pa.binary())] if decoded else []
            yield pa.RecordBatch.from_arrays([*batch.columns, arrow_lists([np.frombuffer(array("i", x), np.int32) for x in found], pa.int32()), *back], [*batch.schema.names, ids, *([decoded] if decoded else [])])

    made = _with(df, ids, T.ArrayType(T.IntegerType()))
    return df.mapInArrow(run, made.add(decoded, T.BinaryType()) if decoded else made)


def decode(df: DataFrame, ids: str = "ids", decoded: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with the bytes (binary) of each row's ids; null ids give empty."""
    path, pattern = _defaults(path, pattern)
    decoded = free_name(df, decoded)
    content = df.sparkSession.sparkContext.broadcast(_content(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = {int(b): base64.b64decode(a) for a, b in map(bytes.split, content.value.splitlines())}
        for batch in batches:
            found = [decode_ids(x or [], bytes_of) for x in batch.column(batch.schema.names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*batch.schema.names, decoded])

    return df.mapInArrow(run, _with(df, decoded, T.BinaryType()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: ids and their round trip for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = encode(docs, decoded="decoded")
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose ids decode to their texts (all, unless the tokenizer fails), with the ids and n_tokens, their number; names that are taken get a bar at the end."""
    ids, n_tokens = free_name(docs, "ids"), free_name(docs, "n_tokens")
    decoded = free_name(docs, "decoded")
    checked = encode(docs, decoded=decoded).where(F.col(f"`{decoded}`") == F.coalesce("text", F.lit("")).cast("binary")).drop(decoded)
    return written(checked.withColumn(n_tokens, F.size(f"`{ids}`").cast("long")), "tokens")  # written here, with small batches
