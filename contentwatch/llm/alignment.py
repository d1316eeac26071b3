"""Operator 11: alignment of two tokenizers' tokens over the same bytes.

Both tokenizers cut one byte string; a token is known by the offset where it ends.  The ends that both have cut the text
into groups, and a token of one overlaps a range of tokens of the other.  The shorter list of ends drives a galloping search
into the longer (Bentley & Yao 1976): from the place of its neighbour, steps double until they pass the end that is looked
for, then a binary search finishes.  The ends of all texts of a batch are searched at once, level by level: every 2^k-th end first,
then those between, each from the place of its left neighbour.  A place (the rank among the other list's ends) tells both
whether an end is common and, by the difference of neighbouring ranks, which tokens overlap.

Words are encoded once: where a space stands between characters that aren't white space, both tokenizers have an end (the
pattern of A can't match across it; of B it is checked that no piece holds a space after another character), so what stands between
such spaces is encoded alone and kept in a bounded cache.

Counts of pairs of ids are a table that grows with the corpus.  The most frequent pairs, at most ``SENT`` of them, are sent to the
tasks, and the links of all others are joined with the table; that changes no result.

Cases: a null or empty text, and one whose tokens don't give back a space and the text byte by byte (by normalisation, or
U+2581), has no tokens; special tokens' strings are plain text; a very long text is encoded whole; repeated rows and null
ids each count as documents and come back; an empty table gives no rows; further columns are kept, and a new one whose name is taken gets a
bar at its end.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentwatch.llm.common import arrow_lists, free_name, scratch, slices, written

#: Pairs of ids that are sent to the tasks with their counts, 17 bytes each.
SENT = 1 << 20
#: Words after which a task's cache begins anew, keeping one older one, and the longest word in it.
KEPT, LONGEST = 1 << 17, 48
#: Fixed value: the pattern of byte-level BPE, as the library has it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters, digits and signs that every version of Unicode classes alike, and spaces.
LATIN = re.compile("[\x20-\x7e\u00a1-\u024f]+")
BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each entry of the ascending ``short``, how many entries of the ascending ``long`` are smaller."""
    n, size = len(short), len(long)
    rank = np.zeros(n, np.int64)
    if not n or not size:
        return rank

    def search(at: np.ndarray, low: np.ndarray) -> None:
        """Places of short[at], of which none is before ``low``."""
        x, step = short[at], np.ones(len(at), np.int64)
        more = np.flatnonzero((low < size) & (long[np.minimum(low, size - 1)] < x))
        high = low.copy()  # what stands at ``high`` isn't smaller, or is the end
        while len(more):
            low[more] = high[more] + 1  # what stands before ``low`` is smaller
            high[more] = np.minimum(high[more] + step[more], size)
            step[more] *= 2
            inside = more[high[more] < size]
            more = inside[long[high[inside]] < x[inside]]
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            smaller = long[middle] < x[open_]
            low[open_[smaller]] = middle[smaller] + 1
            high[open_[~smaller]] = middle[~smaller]
            open_ = open_[low[open_] < high[open_]]
        rank[at] = low

    search(np.zeros(1, np.int64), np.zeros(1, np.int64))
    stride = 1 << max(0, (n - 1).bit_length() - 1)
    while stride:
        at = np.arange(stride, n, 2 * stride)
        search(at, rank[at - stride])
        stride >>= 1
    return rank


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A, by its end, the first and last token of B that it overlaps; both lists end with the same offset."""
    if len(a) <= len(b):
        rank = gallop(a, b)
        common = b[np.minimum(rank, len(b) - 1)] == a
        # B's tokens up to the one in which this one ends; the next starts there, or after it where both end
        return np.concatenate([[0], (rank + common)[:-1]]), rank
    rank = gallop(b, a)  # of each end of B, the token of A in which it lies
    common = a[np.minimum(rank, len(a) - 1)] == b
    # A's token i starts in the first token of B whose end lies in i or later and isn't i's start
    inner = np.bincount(rank, minlength=len(a))
    shared = np.zeros(len(a), np.int64)
    shared[rank[common]] = 1
    through = np.cumsum(inner)  # ends of B up to the end of i
    return np.concatenate([[0], through[:-1]]), through - shared


class Encoder:
    """Both tokenizers over words, with the bytes of each id."""

    def __init__(self, a: bytes, b: bytes, ranked: bool = False):
        """ranked: whether the merges of A follow the ids, so that words of Latin letters can be merged by rank (``by_rank``)."""
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a.decode())
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a byte-level vocabulary writes as themselves
        other = [x for x in range(256) if x not in plain]
        byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(other)}
        model = json.loads(a)["model"]
        self.bytes_a = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for entry, i in model["vocab"].items():
            self.bytes_a[i] = bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.apart = not any(re.search("[^▁]▁", p) for p in pieces)
        self.ranks = None
        if ranked:
            import tiktoken

            special = {x["content"] for x in json.loads(a).get("added_tokens", [])}
            self.ranks = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={self.bytes_a[i]: i for entry, i in model["vocab"].items() if entry not in special}, special_tokens={})
        # ids of the words of late and of those before them, as the bytes of int32 arrays
        self.kept_a, self.kept_b, self.older_a, self.older_b = {}, {}, {}, {}
        self.bad: set[str] = set()

    def _ids_a(self, text: str) -> list[int]:
        """The ids of A of a space and the text."""
        if self.ranks and LATIN.fullmatch(text):
            return self.ranks.encode_ordinary(" " + text)
        return self.a.encode(" " + text, add_special_tokens=False).ids

    def _same(self, text: str, x: list[int], y: list[int]) -> bool:
        """Whether both give back a space and the text."""
        given = b" " + text.encode()
        return b"".join(map(self.bytes_a.__getitem__, x)) == given and b"".join(map(self.bytes_b.__getitem__, y)) == given

    def _keep(self, word: str, x: np.ndarray, y: np.ndarray, same: bool) -> None:
        self.kept_a[word], self.kept_b[word] = x.tobytes(), y.tobytes()
        if not same:
            self.bad.add(word)

    def _each(self, words: list[str]) -> None:
        """Keeps words encoded one by one."""
        for word in words:
            x, y = self._ids_a(word), self.b.encode(word)
            self._keep(word, np.array(x, np.int32), np.array(y, np.int32), self._same(word, x, y))

    def _together(self, words: list[str]) -> None:
        """``_each`` for words without white space at their ends, encoded as one text and cut where they end."""
        if not words:
            return
        text = " ".join(words)
        x, y = self._ids_a(text), self.b.encode(text)
        if not self._same(text, x, y):
            if len(words) == 1:
                return self._each(words)
            self._together(words[: len(words) // 2])
            return self._together(words[len(words) // 2 :])
        ends = np.cumsum([len(w) + 1 for w in words]) if text.isascii() else np.cumsum([len(w.encode()) + 1 for w in words])
        for ids, size, kept in ((x, self.size_a, self.kept_a), (y, self.size_b, self.kept_b)):
            ids = np.array(ids, np.int32)
            cuts, whole = [0, *((np.searchsorted(np.cumsum(size[ids]), ends) + 1) * 4).tolist()], ids.tobytes()
            kept.update(zip(words, [whole[i:j] for i, j in zip(cuts, cuts[1:])]))

    def __call__(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text; none for null and empty texts and those that aren't given back."""
        cut = [(BETWEEN.split(t) if self.apart and "▁" not in t else [t]) if t else [] for t in texts]
        missing = set().union(*cut) - self.kept_a.keys()
        for word in missing & self.older_a.keys():
            self.kept_a[word], self.kept_b[word] = self.older_a[word], self.older_b[word]
        missing -= self.older_a.keys()
        odd = [w for w in missing if len(w) > LONGEST or w[0].isspace() or w[-1].isspace() or "▁" in w]
        missing.difference_update(odd)
        # Latin words apart from others, as these are encoded in another way
        latin = [w for w in missing if LATIN.fullmatch(w)] if self.ranks else []
        for some in (latin, list(missing.difference(latin))):
            for i in range(0, len(some), 2048):
                self._together(some[i : i + 2048])
        self._each(odd)
        found = []
        for words in cut:
            good = not self.bad or self.bad.isdisjoint(words)
            found.append(tuple(np.frombuffer(b"".join(map(kept.__getitem__, words)) if good else b"", np.int32) for kept in (self.kept_a, self.kept_b)))
        for word in odd:
            del self.kept_a[word], self.kept_b[word]
        self.bad.difference_update(odd)
        if len(self.kept_a) > KEPT:
            self.older_a, self.older_b, self.kept_a, self.kept_b = self.kept_a, self.kept_b, {}, {}
            self.bad &= self.older_a.keys()
        return found


def by_rank(a: bytes, b: bytes) -> bool:
    """Whether merging by id gives what A's merges give: the same splitting pattern, merges in the order of their ids, and every entry of Latin letters, as a word, alike."""
    encoder, model = Encoder(a, b, True), json.loads(a)
    if model.get("normalizer") or model["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": model["pre_tokenizer"].get("trim_offsets"), "use_regex": True}:
        return False
    vocab, merges = model["model"]["vocab"], model["model"]["merges"]
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
    if made != sorted(made) or model["model"].get("dropout") or model["model"].get("ignore_merges"):
        return False
    words = [w for w in (x.decode("utf-8", "replace").removeprefix(" ") for x in encoder.bytes_a) if w and LATIN.fullmatch(w) and w.strip() == w]
    return all(x.ids == encoder.ranks.encode_ordinary(" " + w) for w, x in zip(words, encoder.a.encode_batch([" " + w for w in words], add_special_tokens=False)))


_encoders: dict[bytes, Encoder] = {}


def _encoder(a: bytes, b: bytes, ranked: bool) -> Encoder:
    """One encoder a Python worker, so that its cache outlives a task."""
    key = hashlib.sha256(a + b).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(a, b, ranked)
    return _encoders[key]


def _tokenizers(docs: DataFrame, path_a: str, path_b: str):
    """The files of both tokenizers and ``by_rank``, sent to the tasks."""
    files = []
    for path in (path_a, path_b):
        with open(path, "rb") as f:
            files.append(f.read())
    return docs.sparkSession.sparkContext.broadcast((*files, by_rank(*files)))


def _align(sent, text: str, rest: list[str], names: list[str]):
    """A function over batches that puts the columns of ``align`` in the place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(*sent.value)
        for batch in slices(batches, text, 1 << 20):
            ids = encoder(batch.column(batch.schema.names.index(text)).to_pylist())
            none = np.zeros(0, np.int32)
            firsts, lasts = [none] * len(ids), [none] * len(ids)
            # the texts' ends follow each other in one list; texts with fewer tokens of A than of B are searched apart from the others
            for side in (True, False):
                some = [i for i, (a, b) in enumerate(ids) if (len(a) <= len(b)) == side and len(a)]
                if not some:
                    continue
                ends = [np.cumsum(size[np.concatenate([ids[i][j] for i in some])]) for j, size in ((0, encoder.size_a), (1, encoder.size_b))]
                first, last = overlaps(*ends)
                place_a = place_b = 0
                for i in some:
                    n = len(ids[i][0])
                    firsts[i], lasts[i] = first[place_a : place_a + n] - place_b, last[place_a : place_a + n] - place_b
                    place_a, place_b = place_a + n, place_b + len(ids[i][1])
            lists = [[x for x, _ in ids], [x for _, x in ids], [x.astype(np.int32) for x in firsts], [x.astype(np.int32) for x in lasts]]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in rest], *[arrow_lists(x, pa.int32()) for x in lists]], [*rest, *names])

    return run


ALIGNED = ("a_ids", "b_ids", "b_first", "b_last")
LINKED = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "pair_a": "array<int>", "pair_b": "array<int>", "times": "array<int>"}


def _schema(docs: DataFrame, rest: list[str], kinds: dict[str, str]) -> T.StructType:
    return T.StructType([*[docs.schema[c] for c in rest], *[T.StructField(n, T._parse_datatype_string(k)) for n, k in kinds.items()]])


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """``docs`` without the text, with a_ids, b_ids array<int> and, for each token of A, the first and last token of B that it overlaps: b_first, b_last array<int> (numbers from 0).

    A is a byte-level BPE of the library tokenizers, given a space and the text; B a sentencepiece model, which adds the space itself.
    Token i of A ends a group where the next token's ``b_first`` is greater than its ``b_last``.
    """
    rest = [c for c in docs.columns if c != text]
    names = [free_name(docs.drop(text), n) for n in ALIGNED]
    return docs.mapInArrow(_align(_tokenizers(docs, path_a, path_b), text, rest, names), _schema(docs, rest, dict.fromkeys(names, "array<int>")))


def align_and_link(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """``linked`` of ``align``, in one pass of one worker."""
    rest = [c for c in docs.columns if c != text]
    inner = [free_name(docs.drop(text), n) for n in ALIGNED]
    names = [free_name(docs.drop(text), n) for n in LINKED]
    first, second = _align(_tokenizers(docs, path_a, path_b), text, rest, inner), _link(inner, rest, names)
    return docs.mapInArrow(lambda batches: second(first(batches)), _schema(docs, rest, dict(zip(names, LINKED.values()))))


def linked(aligned: DataFrame, columns: tuple[str, ...] = ALIGNED) -> DataFrame:
    """``aligned`` with n_a, n_b, n_groups, n_links long, groups_sha256 string (of ``a1,a2|b1;a3|b2,b3`` in hex, or '' without tokens), pair_a, pair_b, times array<int>: the distinct linked id pairs and how often each occurs; without the columns of ``align``."""
    rest = [c for c in aligned.columns if c not in columns]
    names = [free_name(aligned, n) for n in LINKED]
    return aligned.mapInArrow(_link(columns, rest, names), _schema(aligned, rest, dict(zip(names, LINKED.values()))))


def _link(columns, rest: list[str], names: list[str]):
    """A function over batches that puts the columns of ``linked`` in the place of those of ``align``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, np.ndarray] = {}

        def written_as(ids: np.ndarray, after: np.ndarray, marks: str) -> np.ndarray:
            """Each id in decimal, followed by the first mark or, where ``after``, by the second."""
            most = int(ids.max()) + 1
            if marks not in texts or len(texts[marks]) < 2 * most:
                texts[marks] = np.array([f"{i}{m}" for m in marks for i in range(2 * most)], object)
            return texts[marks][ids + after * (len(texts[marks]) // 2)]

        for batch in batches:
            at = [batch.column(batch.schema.names.index(c)) for c in columns]
            lists = [(x.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(x.value_lengths().to_numpy(zero_copy_only=False))])) for x in at]
            out = [[] for _ in names]
            for i in range(batch.num_rows):
                a, b, first, last = (values[cuts[i] : cuts[i + 1]] for values, cuts in lists)
                if not len(a):
                    for x, value in zip(out, (0, 0, 0, 0, "", a, a, a)):
                        x.append(value)
                    continue
                many = last - first + 1
                stop_a = np.append(first[1:] > last[:-1], True)
                stop_b = np.zeros(len(b), bool)
                stop_b[last[stop_a]] = True
                # a group's tokens of A stand before its tokens of B
                group_a, group_b = np.cumsum(stop_a) - stop_a, np.cumsum(stop_b) - stop_b
                shown = np.empty(len(a) + len(b), object)
                before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b))])[group_a]
                before_a = np.cumsum(np.bincount(group_a))[group_b]
                shown[np.arange(len(a)) + before_b] = written_as(a, stop_a, ",|")
                shown[np.arange(len(b)) + before_a] = written_as(b, stop_b, ",;")
                text = "".join(shown.tolist())[:-1]
                link_a = np.repeat(a, many)
                link_b = b[np.arange(int(many.sum())) + np.repeat(first - (np.cumsum(many) - many), many)]
                pairs, times = np.unique(link_a << 32 | link_b, return_counts=True)
                row = (len(a), len(b), int(stop_a.sum()), int(many.sum()), hashlib.sha256(text.encode()).hexdigest(), pairs >> 32, pairs & 0xFFFFFFFF, times)
                for x, value in zip(out, row):
                    x.append(value)
            arrays = [*[pa.array(x, pa.int64()) for x in out[:4]], pa.array(out[4], pa.string()), *[arrow_lists([v.astype(np.int32) for v in x], pa.int32()) for x in out[5:]]]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in rest], *arrays], [*rest, *names])

    return run


def _pairs(batch: pa.RecordBatch) -> np.ndarray:
    """pair_a and pair_b of all rows as one list of longs."""
    a, b = (batch.column(batch.schema.names.index(c)).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pair_a", "pair_b"))
    return a << 32 | b


def pair_counts(links: DataFrame, folder: str) -> DataFrame:
    """(pair long, n, best): of every id pair, a id << 32 | b id, how many rows of ``links`` hold it and whether no pair of its A id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, n = np.unique(_pairs(batch), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], ["pair", "n"])

    counts = written(links.select("pair_a", "pair_b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts", folder)
    a = F.shiftright("pair", 32)
    most = written(counts.groupBy(a.alias("a")).agg(F.max("n").alias("most")), "most", folder)
    return written(counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs", folder)


def _sent(pairs: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(pair, n, best) of the most frequent pairs, ascending by pair, and whether these are all: bands of counts, from the top, as long as they have at most ``limit`` pairs."""
    bands = pairs.groupBy(F.floor(F.log2("n")).alias("band")).agg(F.count("*").alias("many")).orderBy(F.desc("band")).collect()  # 63 at most
    cut, held, all_of = 64, 0, True
    for row in bands:
        if held + row.many > limit:
            all_of = False
            break
        cut, held = row.band, held + row.many
    rows = pairs.where(F.floor(F.log2("n")) >= cut).toPandas().sort_values("pair")
    return rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), rows["best"].to_numpy(bool), all_of


def scored(links: DataFrame, folder: str, limit: int = SENT) -> DataFrame:
    """``links`` (from ``linked``, written) without its pairs, with n_best and count_sum long."""
    pairs = pair_counts(links, folder)
    *table, all_of = _sent(pairs, limit)
    known = links.sparkSession.sparkContext.broadcast(table)
    rest = [c for c in links.columns if c not in ("pair_a", "pair_b", "times")]
    names = ["row", "n_best", "count_sum", "left_pairs", "left_times"]
    kinds = [T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())]
    schema = T.StructType([*[links.schema[c] for c in rest], *[T.StructField(n, k) for n, k in zip(names[1:], kinds[1:])]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for batch in batches:
            own, lengths = _pairs(batch), batch.column(batch.schema.names.index("times")).value_lengths().to_numpy(zero_copy_only=False)
            times = batch.column(batch.schema.names.index("times")).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), lengths)
            place = np.minimum(np.searchsorted(pair, own), max(0, len(pair) - 1))
            found = pair[place] == own if len(pair) else np.zeros(len(own), bool)
            sums = []
            for value in (best, n):
                got = np.zeros(batch.num_rows, np.int64)
                np.add.at(got, row[found], times[found] * value[place[found]])
                sums.append(pa.array(got))
            cuts = np.concatenate([[0], np.cumsum(np.bincount(row[~found], minlength=batch.num_rows))])
            left = [np.split(x[~found], cuts[1:-1]) if batch.num_rows > 1 else [x[~found]] for x in (own, times)]
            lists = [arrow_lists(left[0], pa.int64()), arrow_lists([x.astype(np.int32) for x in left[1]], pa.int32())]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in rest], *sums, *lists], [*rest, *names[1:]])

    told = links.mapInArrow(run, schema)
    if all_of:
        return told.drop("left_pairs", "left_times")
    told = written(told.withColumn("row", F.monotonically_increasing_id()), "told", folder)  # numbers hold once written
    left = told.select("row", F.explode(F.arrays_zip("left_pairs", "left_times")).alias("x")).select("row", F.col("x.left_pairs").alias("pair"), F.col("x.left_times").alias("times"))
    more = left.join(pairs, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    both = told.join(more, "row", "left")
    add = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return both.select(*[F.col(f"`{c}`") for c in rest], add("n_best", "more_best"), add("count_sum", "more_sum"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: groups and links of every document between byte_bpe_50k.json and piece_bpe_32k.model, with the corpus-wide counts of its linked id pairs."""
    import public_tokenizers as P

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with scratch(spark, "alignment") as folder:
        links = written(align_and_link(docs, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")), "links", folder)
        found = scored(links, folder).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        return written(found, "alignment-result")
