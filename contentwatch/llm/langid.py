"""Operator 5: language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability per language.  A word (a run of letters, lower-cased, with
the vocabulary's word mark before it) may be segmented into pieces in many ways; the forward algorithm sums the product
of piece probabilities over all of them, and a text's probability is the product over its words.  Words of up to ``SHORT``
letters are summed together, longer ones one by one with logarithms, in time in proportion to their length.  Probabilities are learned by expectation-maximisation: forward and backward sums give
each piece's expected count per language (Kudo 2018).

Learning reads at most about ``sample`` documents of each of the ``LANGUAGES`` most frequent languages, drawn by a hash of their
ids; with fewer, all.  Scoring reads every text whole, and each distinct word of a block of text is summed once.

Cases: a null text or one without letters is ``und`` with score 0, as is every text where nothing could be learned;
letters outside the vocabulary cost the same in all languages; equal scores go to the language that sorts first; null
languages aren't learned from; a very long text or word is read whole; repeated rows and empty tables pass through; further
columns are kept, and where one has the name of an output column, the new one gets a bar at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentwatch.llm.common import free_name, parted, scratch, slices, written
from contentwatch.llm.words import mix

MARK, SHORT = 0x2581, 32
SAMPLE, ROUNDS, SMOOTHING = 2000, 3, 0.05
UNKNOWN = 1e-7
#: Languages that are learned, or scored, at once; more take further passes.
BLOCK = 64
UND = "und"
_BASE, _INVERSE = 6364136223846793005, pow(6364136223846793005, -1, 1 << 64)


def vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model, in the order of their ids."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(library.get_piece_size())
    return [library.id_to_piece(i) for i in ids if not (library.is_control(i) or library.is_byte(i) or library.is_unknown(i))]


class Lattice:
    """Words of texts and the vocabulary's pieces in them, by hashes of code points."""

    def __init__(self, pieces: list[str]):
        self.n_pieces = len(pieces)
        self.power = np.cumprod(np.append(np.uint64(1), np.full(1 << 16, _BASE, np.uint64)))
        self.inverse = np.cumprod(np.append(np.uint64(1), np.full(1 << 16, _INVERSE, np.uint64)))
        hashes = np.array([self._hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.maybe = np.zeros(1 << 21, bool)
        self.maybe[(hashes >> np.uint64(43)).astype(np.int64)] = True
        self.longest = max(map(len, pieces), default=1)
        self.letter = np.array([chr(c).isalpha() for c in range(0x110000)], bool)

    def _values(self, code: np.ndarray) -> np.ndarray:
        return mix(code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))

    def _hash(self, text: str) -> np.uint64:
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return mix((self._values(code) * self.power[: len(code)]).sum(keepdims=True))[0]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``hashes`` that are pieces, their ids)."""
        at = np.flatnonzero(self.maybe[(hashes >> np.uint64(43)).astype(np.int64)])
        place = np.searchsorted(self.hashes, hashes[at])
        place[place == len(self.hashes)] = 0
        sure = self.hashes[place] == hashes[at]
        return at[sure], self.order[place[sure]]

    def words(self, texts: list[str]):
        """(code points, starts, stops of words, offsets: the words of each text)."""
        code = np.frombuffer("".join(x for t in texts for x in (t.lower(), "\n")).encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.flatnonzero(np.diff(self.letter[code], prepend=False))
        starts, stops = edges[0::2], edges[1::2]
        ends = np.flatnonzero(code == 10)
        # lower-casing keeps line breaks, so the k-th text ends at the break after its own ones
        breaks = np.cumsum([t.count("\n") + 1 for t in texts]) - 1
        return code, starts, stops, np.append(0, np.searchsorted(starts, ends[breaks]))

    def distinct(self, code: np.ndarray, starts: np.ndarray, stops: np.ndarray):
        """(matrix of the distinct words' code points after the mark, longest first; their lengths; each word's row)."""
        n = stops - starts
        width = int(n.max()) if len(n) else 0
        hashed, values = np.zeros(len(n), np.uint64), self._values(code)
        by_length = np.argsort(-n, kind="stable")
        lengths = n[by_length]
        for j in range(width):
            some = by_length[: np.searchsorted(-lengths, -j, side="left")]
            hashed[some] += values[starts[some] + j] * self.power[j]
        _, first, row = np.unique(hashed, return_index=True, return_inverse=True)
        longest_first = np.argsort(-n[first], kind="stable")
        rank = np.empty(len(first), np.int64)
        rank[longest_first] = np.arange(len(first))
        first = first[longest_first]
        matrix = code[np.minimum(starts[first][:, None] + np.arange(width), len(code) - 1)] if len(first) else np.zeros((0, width), np.uint32)
        return np.concatenate([np.full((len(first), 1), MARK, np.uint32), matrix], axis=1), n[first] + 1, rank[row]

    def arcs(self, matrix: np.ndarray, lengths: np.ndarray):
        """For each end j and start i: (i, j, rows, piece ids); the id n_pieces is an unknown letter."""
        sums = np.zeros((matrix.shape[0], matrix.shape[1] + 1), np.uint64)
        np.cumsum(self._values(matrix) * self.power[: matrix.shape[1]], axis=1, out=sums[:, 1:])
        for j in range(1, matrix.shape[1] + 1):
            active = int(np.searchsorted(-lengths, -j, side="right"))
            for i in range(max(0, j - self.longest), j):
                rows, ids = self.find(mix((sums[:active, j] - sums[:active, i]) * self.inverse[i]))
                if i == j - 1 and len(rows) < active:
                    missing = np.ones(active, bool)
                    missing[rows] = False
                    rest = np.flatnonzero(missing)
                    rows, ids = np.append(rows, rest), np.append(ids, np.full(len(rest), self.n_pieces))
                if len(rows):
                    yield i, j, rows, ids

    def log_probability(self, matrix: np.ndarray, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
        """(words, languages): the log of the sum over all segmentations; p: (pieces + 1, languages)."""
        alpha = np.zeros((matrix.shape[1] + 1, matrix.shape[0], p.shape[1]))
        alpha[0] = 1
        for i, j, rows, ids in self.arcs(matrix, lengths):
            alpha[j, rows] += alpha[i, rows] * p[ids]
        return np.log(alpha[lengths, np.arange(len(lengths))])

    def expected(self, matrix: np.ndarray, lengths: np.ndarray, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces for one language's words; p: (pieces + 1)."""
        arcs = list(self.arcs(matrix, lengths))
        alpha, beta = np.zeros((2, matrix.shape[1] + 1, matrix.shape[0]))
        alpha[0] = 1
        beta[lengths, np.arange(len(lengths))] = 1
        for i, j, rows, ids in arcs:
            alpha[j, rows] += alpha[i, rows] * p[ids]
        for i, j, rows, ids in sorted(arcs, key=lambda a: -a[0]):
            beta[i, rows] += beta[j, rows] * p[ids]
        scale = weights / alpha[lengths, np.arange(len(lengths))]
        counts = np.zeros(self.n_pieces + 1)
        for i, j, rows, ids in arcs:
            np.add.at(counts, ids, alpha[i, rows] * p[ids] * beta[j, rows] * scale[rows])
        return counts

    # words of any length, one at a time

    def long_arcs(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, piece ids) of all arcs over the code points of one word after its mark, by ends."""
        code = np.append(np.uint32(MARK), code)
        values, n = self._values(code), len(code)
        hashed, found = np.zeros(n, np.uint64), []
        for size in range(1, min(self.longest, n) + 1):
            hashed = hashed[: n - size + 1] + values[size - 1 :] * self.power[size - 1]
            at, ids = self.find(mix(hashed.copy()))
            if size == 1:
                missing = np.ones(n, bool)
                missing[at] = False
                rest = np.flatnonzero(missing)
                at, ids = np.append(at, rest), np.append(ids, np.full(len(rest), self.n_pieces))
            found.append((at, at + size, ids))
        starts, ends, ids = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(ends, kind="stable")
        return starts[order], ends[order], ids[order]

    def long_log_probability(self, code: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """(languages): as ``log_probability``, of one word; logs: the logarithms of p.  Holds as many sums as a piece is long."""
        starts, ends, ids = self.long_arcs(code)
        n, ring = len(code) + 1, self.longest + 1
        edges = np.searchsorted(ends, np.arange(1, n + 2))
        alpha = np.zeros((ring, logs.shape[1]))
        for j in range(1, n + 1):
            own = slice(edges[j - 1], edges[j])
            alpha[j % ring] = np.logaddexp.reduce(alpha[starts[own] % ring] + logs[ids[own]], axis=0)
        return alpha[n % ring]

    def long_expected(self, code: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids, expected counts) of one word for one language; logs: (pieces + 1)."""
        starts, ends, ids = self.long_arcs(code)
        n = len(code) + 1
        edges = np.searchsorted(ends, np.arange(1, n + 2))
        alpha, beta = np.zeros(n + 1), np.full(n + 1, -np.inf)
        for j in range(1, n + 1):
            own = slice(edges[j - 1], edges[j])
            alpha[j] = np.logaddexp.reduce(alpha[starts[own]] + logs[ids[own]])
        beta[n] = 0
        for j in range(n, 0, -1):
            own = slice(edges[j - 1], edges[j])
            np.logaddexp.at(beta, starts[own], beta[j] + logs[ids[own]])
        return ids, np.exp(alpha[starts] + logs[ids] + beta[ends] - alpha[n])

    # words of texts

    def text_logs(self, code: np.ndarray, starts: np.ndarray, stops: np.ndarray, offsets: np.ndarray, p: np.ndarray, block: int = 4_000) -> np.ndarray:
        """(texts, languages): the log probability of every text, summed over its words in their order, so that equal texts get equal sums."""
        of, short = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), stops - starts <= SHORT
        out = np.zeros((len(offsets) - 1, p.shape[1]))
        matrix, lengths, row = self.distinct(code, starts[short], stops[short])
        if len(lengths):
            known = np.concatenate([self.log_probability(matrix[i : i + block, : int(lengths[i])], lengths[i : i + block], p) for i in range(0, len(lengths), block)])
            for k in range(p.shape[1]):  # one language at a time: words by languages would take many times the text
                out[:, k] = np.bincount(of[short], known[row, k], len(out))
        logs, seen = None if short.all() else np.log(p), {}
        for i in np.flatnonzero(~short).tolist():
            word = code[starts[i] : stops[i]]
            key = word.tobytes()
            if key not in seen:
                seen[key] = self.long_log_probability(word, logs)
            out[of[i]] += seen[key]
        return out

    def word_expected(self, code: np.ndarray, starts: np.ndarray, stops: np.ndarray, p: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces over words with weights, for one language."""
        short = stops - starts <= SHORT
        matrix, lengths, row = self.distinct(code, starts[short], stops[short])
        total = self.expected(matrix, lengths, p, np.bincount(row, weights=weights[short], minlength=len(lengths))) if len(lengths) else np.zeros(self.n_pieces + 1)
        for i in np.flatnonzero(~short).tolist():
            ids, n = self.long_expected(code[starts[i] : stops[i]], np.log(p))
            np.add.at(total, ids, n * weights[i])
        return total


def model_vocabulary(path: str | None) -> list[str]:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return vocabulary(path)


def train(docs: DataFrame, pieces: list[str], text: str = "text", lang: str = "lang", by: str = "doc_id", sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities (pieces + 1, languages)): of every language that occurs, learned in blocks of BLOCK."""
    spark = docs.sparkSession
    sizes = {r[0]: r[1] for r in docs.where(F.col(lang).isNotNull()).groupBy(lang).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((len(pieces) + 1, 0))
    with scratch(spark, "langid") as folder:
        blocks = [languages[i : i + BLOCK] for i in range(0, len(languages), BLOCK)]
        return languages, np.hstack([_train_block(docs, pieces, {k: sizes[k] for k in block}, folder, text, lang, by, sample, rounds) for block in blocks])


def _train_block(docs: DataFrame, pieces: list[str], sizes: dict[str, int], folder: str, text: str, lang: str, by: str, sample: int, rounds: int) -> np.ndarray:
    """The probabilities of the languages of ``sizes``, in their order; sizes: their documents."""
    spark, languages = docs.sparkSession, list(sizes)
    shared = spark.sparkContext.broadcast(pieces)
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, sample / sizes[k]))])
    drawn = docs.where(F.col(lang).isin(languages) & (F.pmod(F.xxhash64(by), F.lit(1_000_003)) < share[F.col(lang)] * 1_000_003)).select(F.col(lang).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for batch in slices(batches, "text", 1 << 20):
            langs, texts = np.array(batch.column(0).to_pylist(), object), np.array(batch.column(1).to_pylist(), object)
            for one in set(langs):
                code, starts, stops, _ = lattice.words(texts[langs == one].tolist())
                short = stops - starts <= SHORT
                matrix, lengths, row = lattice.distinct(code, starts[short], stops[short])
                n = np.bincount(row, minlength=len(lengths)).tolist()
                found = ["".join(map(chr, m[1:k])) for m, k in zip(matrix.tolist(), lengths.tolist())]
                for i in np.flatnonzero(~short).tolist():
                    found.append(code[starts[i] : stops[i]].tobytes().decode("utf-32-le", "surrogatepass"))
                    n.append(1)
                yield pa.RecordBatch.from_arrays([pa.array([one] * len(found), pa.string()), pa.array(found, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

    words = written(drawn.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words", folder)
    p = np.full((len(pieces) + 1, len(languages)), 1.0 / len(pieces))
    p[-1] = UNKNOWN
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(shared.value), np.zeros(now.value.shape)
            for batch in batches:
                langs, texts, n = np.array(batch.column(0).to_pylist(), object), np.array(batch.column(1).to_pylist(), object), batch.column(2).to_numpy()
                for k, one in enumerate(languages):
                    own = texts[langs == one].tolist()
                    if own:
                        code, starts, stops, offsets = lattice.words(own)
                        weights = np.repeat(n[langs == one], np.diff(offsets)).astype(float)
                        total[:, k] += lattice.word_expected(code, starts, stops, now.value[:, k], weights)
            at, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(total[at, k])], ["piece", "k", "n"])

        got = words.mapInArrow(expect, "piece int, k int, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full((len(pieces), len(languages)), SMOOTHING)
        got = got[got["piece"] < len(pieces)]
        np.add.at(counts, (got["piece"].to_numpy(), got["k"].to_numpy()), got["n"].to_numpy())
        p = np.vstack([counts / counts.sum(axis=0), np.full((1, len(languages)), UNKNOWN)])
    return p


def predict(docs: DataFrame, pieces: list[str], languages: list[str], p: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred string and score double, the posterior of lang_pred under a uniform prior."""
    if len(languages) > BLOCK:
        return _predict_blocks(docs, pieces, languages, p, text)
    named = [free_name(docs, "lang_pred"), free_name(docs, "score")]
    shared, names, at = docs.sparkSession.sparkContext.broadcast((pieces, p)), docs.columns, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value[0])
        for batch in slices(batches, text, 1 << 20):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            code, starts, stops, offsets = lattice.words(texts)
            found, scores = [UND] * len(texts), np.zeros(len(texts))
            if len(starts) and languages:
                own = lattice.text_logs(code, starts, stops, offsets, shared.value[1])
                best = own.argmax(axis=1)
                posterior = 1 / np.exp(own - own.max(axis=1, keepdims=True)).sum(axis=1)
                for i in np.flatnonzero(np.diff(offsets)):
                    found[i], scores[i] = languages[best[i]], posterior[i]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(scores)], [*names, *named])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(named[0], T.StringType()), T.StructField(named[1], T.DoubleType())]))


def _predict_blocks(docs: DataFrame, pieces: list[str], languages: list[str], p: np.ndarray, text: str) -> DataFrame:
    """``predict`` for many languages: a pass over the texts for each block, of which the best language and the sum of likelihoods stay."""
    spark, row = docs.sparkSession, free_name(docs, "row_number")
    named = [free_name(docs, "lang_pred"), free_name(docs, "score")]
    shared = spark.sparkContext.broadcast(pieces)
    with scratch(spark, "languages") as folder:
        numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "documents", folder)  # numbers hold once written
        given = numbered.select(F.col(row).alias("row"), F.col(text).alias("text"))

        def logs(own: list[str], sent):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                lattice = Lattice(shared.value)
                for batch in slices(batches, "text", 1 << 20):
                    code, starts, stops, offsets = lattice.words([t or "" for t in batch.column(1).to_pylist()])
                    some = np.flatnonzero(np.diff(offsets))
                    if not len(some):
                        continue
                    found = lattice.text_logs(code, starts, stops, offsets, sent.value)[some]
                    most = found.max(axis=1)
                    total = most + np.log(np.exp(found - most[:, None]).sum(axis=1))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array([own[k] for k in found.argmax(axis=1)], pa.string()), pa.array(most), pa.array(total)], ["row", "lang", "most", "total"])

            return run

        parts = None
        for i in range(0, len(languages), BLOCK):
            sent = spark.sparkContext.broadcast(np.ascontiguousarray(p[:, i : i + BLOCK]))
            part = written(given.mapInArrow(logs(languages[i : i + BLOCK], sent), "row long, lang string, most double, total double"), "logs", folder)
            parts = part if parts is None else parts.unionByName(part)
            sent.destroy()
        # of equal likelihoods the first language, as in one pass
        best = parts.groupBy("row").agg(F.min_by("lang", F.struct(-F.col("most"), "lang")).alias(named[0]), F.max("most").alias("most"), F.collect_list("total").alias("totals"))
        score = 1 / F.aggregate("totals", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("most")))
        judged = written(best.select(F.col("row").alias(row), named[0], score.alias(named[1])), "judged", folder)
        out = numbered.join(judged, row, "left").select(*[numbered[f"`{c}`"] for c in docs.columns], F.coalesce(named[0], F.lit(UND)).alias(named[0]), F.coalesce(named[1], F.lit(0.0)).alias(named[1]))
        return written(out, "languages")


def held_out(doc_id: str, of: int):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the predicted language of every document, learned from four fifths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    pieces = model_vocabulary(None)
    languages, p = train(docs.where(~held_out("doc_id", 5)), pieces)
    found = predict(docs.select("doc_id", "text"), pieces, languages, p)
    return found.select("doc_id", held_out("doc_id", 5).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """The documents with a language: not ``und``, and with a posterior of at least ``least``."""
    pieces = model_vocabulary(None)
    languages, p = train(docs.where(~held_out("doc_id", 5)), pieces)
    name = free_name(docs, "digest")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias(name)
    with scratch(spark, "language"):
        # a verdict follows from the text alone, so those that go are written (with small batches) and not the texts
        judged = predict(docs.select("text"), pieces, languages, p)
        gone = written(judged.where(~((F.col("lang_pred") != UND) & (F.col("score") >= least))).select(digest).distinct(), "gone")
        some, others = parted(docs.select("*", digest), F.xxhash64(name), gone.select(F.xxhash64(name)))
    columns = [f"`{c}`" for c in docs.columns]
    return some.join(gone, name, "left_anti").select(*columns).union(others.select(*columns))
