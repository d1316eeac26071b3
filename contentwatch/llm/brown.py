"""Operator 3: language-model scores from Brown class-based n-grams.

Exchange clustering (Brown et al. 1992; Uszkoreit & Brants 2008 for the distributed form) gives every word of the training
texts a class, in two steps.  First up to ``frequent`` of the most common words, each a unit of its own, and the groups of all
other words that end in the same two bytes move between classes: in each round half of the units go to the class
that makes their neighbours' classes most likely, until that gains little.  Then each of the other words, however many
there are, moves from its group's class to the one that its own neighbours make most likely.  A word's probability is

    P(class | class before) * P(word | class)

with the first smoothed by P(class) and the second by adding 0.1 to each word's count and to one unseen word's.  A text's score
is the base-10 logarithm over its words and an end; perplexity is 10 ** (-score / n_tokens).

All counts cover all training rows, and the classes of words are a table that grows with them: words meet their count and class
in a join.  What goes through the driver has a size fixed by parameters: the units and the counts between classes (whose
number grows with the third root of the vocabulary, 16 to 128), and, to spare most tokens the join, the ``common`` most frequent
words with count and class.

Cases: null and empty texts have one token, the end; a very long text is read whole, in blocks; words never seen in training
have count 0 and the class of their ending, or one class for endings never seen; ties between classes go to the lower
number; common words are told by counts, and where only some of equal counts could be, none is; without training rows every
class is as likely as any other; repeated rows are scored each; an empty table gives no rows; further columns, whatever
their names, are left out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentwatch.llm.common import SPACES, binaries, partitions, scratch, slices, written
from contentwatch.llm.words import Words, mix

FREQUENT, COMMON = 2048, 131_072
CLASSES, ROUNDS, GAIN = (16, 128), 6, 1e-4
ADD, WEIGHT = 0.1, 4.0
END = 0  # the unit and the class of the end; it also stands before the first word
ENDINGS = 1 << 16


def tally(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, counts)."""
    ordered = np.sort(values)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.diff(np.append(first, len(ordered)))


class Reader:
    """The words of texts as hashes with their endings."""

    def __init__(self):
        self.words = Words(SPACES)
        self.lower = np.arange(256, dtype=np.int32)
        self.lower[65:91] += 32

    def __call__(self, texts: list[bytes]):
        """(hashes, endings, number of words of each text)."""
        hashes, endings, counts = [], [], np.zeros(len(texts), np.int64)
        for at, parts in self.words.blocks(texts):
            data, starts, ends, part = self.words.spans(parts)
            hashes.append(self.words.hash_spans(data, starts, ends))
            before = np.where(ends - starts > 1, self.lower[data[ends - 2]], 0)
            endings.append(before * 256 + self.lower[data[ends - 1]])
            np.add.at(counts, np.asarray(at), np.bincount(part, minlength=len(parts)))
        if not hashes:
            return np.zeros(0, np.uint64), np.zeros(0, np.int32), counts
        return np.concatenate(hashes), np.concatenate(endings), counts


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, ending, n): how often each word stands in the column text; word: its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader()

        def counted(parts: list) -> pa.RecordBatch:
            both = np.concatenate([p[0] for p in parts])
            words, first = tally(both)
            ending = np.zeros(len(words), np.int32)
            ending[np.searchsorted(words, both)] = np.concatenate([p[1] for p in parts])
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(ending), pa.array(first)], ["word", "ending", "n"])

        held, size = [], 0
        for batch in slices(batches, "text", 4 << 20):
            hashes, endings, _ = read(binaries(batch.column(0)))
            held.append((hashes, endings))
            size += len(hashes)
            if size > 4_000_000:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    return texts.select("text").mapInArrow(run, "word long, ending int, n long").groupBy("word").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


class Units:
    """What exchange moves: the end, frequent words and groups of endings; the last unit stands for endings never seen."""

    def __init__(self, words: np.ndarray, n: np.ndarray, groups: dict, n_texts: int, n_classes: int):
        order = np.argsort(words)
        self.words, self.n_classes = words[order], n_classes
        self.single = 1 + len(words)  # units below this one are one word each
        listed = sorted(groups)
        self.n_units = self.single + len(listed) + 1
        self.of_ending = np.full(ENDINGS, self.n_units - 1, np.int32)
        self.of_ending[listed] = self.single + np.arange(len(listed), dtype=np.int32)
        self.n = np.zeros(self.n_units)
        self.n[END], self.n[1 : self.single] = n_texts, n[order]
        self.n[self.single : -1] = [groups[e] for e in listed]
        self.classes = np.zeros(self.n_units, np.int32)
        self.between = np.zeros((n_classes, n_classes))

    def __call__(self, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
        unit = self.of_ending[endings]
        if len(self.words) and len(hashes):
            at = np.searchsorted(self.words, hashes)
            at[at == len(self.words)] = 0
            unit = np.where(self.words[at] == hashes, 1 + at, unit).astype(np.int32)
        return unit

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """(logarithms of the next class's probability, of the classes' sizes) for the gains of moves."""
        n = self.between.sum(axis=1)
        return np.log((self.between + 0.01) / (n + 0.01 * self.n_classes)[:, None]), np.log(n + 0.01 * self.n_classes)


def best_classes(dense: np.ndarray, after: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The likeliest class of each row of ``dense``: how often each class follows it, then how often each precedes it."""
    k = len(size)
    gain = dense[:, :k] @ after.T + dense[:, k:] @ after - dense[:, :k].sum(axis=1, keepdims=True) * size
    gain[:, END] = -np.inf  # the end stays alone
    return gain.argmax(axis=1).astype(np.int32)


class Model:
    """What scoring needs besides the table of words; its size is bounded by COMMON, ENDINGS and CLASSES."""

    def __init__(self, common: pd.DataFrame, ending_class: np.ndarray, n_texts: int, n_words: int, n_distinct: int, n_classes: int):
        order = np.argsort(common["word"].to_numpy().view(np.uint64))
        self.common = common["word"].to_numpy().view(np.uint64)[order]
        self.common_n, self.common_class = common["n"].to_numpy()[order], common["class"].to_numpy()[order].astype(np.int32)
        self.ending_class, self.n_texts, self.n_classes = ending_class, n_texts, n_classes
        self.total, self.distinct = n_words + n_texts, n_distinct + (n_texts > 0)
        self.log_base = float(np.log10(self.total + ADD * (self.distinct + 1)))

    def look(self, hashes: np.ndarray):
        """(class, count) of words, -1 where only the join has them."""
        kind, n = np.full(len(hashes), -1, np.int32), np.full(len(hashes), -1, np.int64)
        if len(self.common) and len(hashes):
            own, row = np.unique(hashes, return_inverse=True)
            at = np.searchsorted(self.common, own)
            at[at == len(self.common)] = 0
            known = self.common[at] == own
            at, known = at[row], known[row]
            kind[known], n[known] = self.common_class[at[known]], self.common_n[at[known]]
        return kind, n

    def finish(self, between: np.ndarray, n: np.ndarray, members: np.ndarray) -> None:
        """Fixes the probabilities; between: counts of neighbouring classes; n, members: tokens and distinct words of the classes, the end's left out."""
        size = n.astype(float)
        size[END] = self.n_texts
        own = (size + 1) / (size + 1).sum()
        self.log_next = np.log10((between + WEIGHT * own) / (between.sum(axis=1, keepdims=True) + WEIGHT))
        self.log_class = np.log10(n + ADD * (members + 1))
        self.log_class[END] = 0


def most_common(counts: DataFrame, most: int):
    """The condition for words of the highest counts, by eighths of powers of two, as far as they are at most ``most``."""
    level = F.floor(F.log2("n") * 8)
    sizes = sorted((r.level, r.words) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect())
    held, least = 0, None
    for at, words in reversed(sizes):
        held += words
        if held > most:
            break
        least = at
    return level >= least if least is not None else F.lit(False)


def neighbours(texts: DataFrame, units: Units, folder: str) -> DataFrame:
    """(unit, other, side, n): how often units stand beside each other; side 0: other follows unit, 1: it precedes."""
    shared = texts.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, own = Reader(), shared.value

        def counted(parts: list) -> pa.RecordBatch:
            pairs, n = tally(np.concatenate(parts))
            return pa.RecordBatch.from_arrays([pa.array((pairs // own.n_units).astype(np.int32)), pa.array((pairs % own.n_units).astype(np.int32)), pa.array(n)], ["unit", "other", "n"])

        held, size = [], 0
        for batch in slices(batches, "text", 4 << 20):
            hashes, endings, counts = read(binaries(batch.column(0)))
            line = with_ends(own(hashes, endings), counts)
            held.append(line[:-1].astype(np.int64) * own.n_units + line[1:])
            size += len(line)
            if size > 4_000_000:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    pairs = written(texts.select("text").mapInArrow(run, "unit int, other int, n long").groupBy("unit", "other").agg(F.sum("n").alias("n")), "unit-pairs", folder)
    both = pairs.withColumn("side", F.lit(0)).union(pairs.select(F.col("other").alias("unit"), F.col("unit").alias("other"), "n", F.lit(1).alias("side")))
    return written(both.repartition(partitions(texts.sparkSession), "unit"), "neighbours", folder)


def with_ends(units: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The units of all texts in a row, an end before the first and after each."""
    line = np.full(len(units) + len(counts) + 1, END, np.int64)
    line[np.arange(len(units)) + 1 + np.repeat(np.arange(len(counts)), counts)] = units
    return line


def cluster(units: Units, beside: DataFrame, folder: str, rounds: int = ROUNDS) -> None:
    """Gives the units their classes and the counts between these, by exchange."""
    spark, k = beside.sparkSession, units.n_classes
    rank = np.argsort(-units.n, kind="stable")
    units.classes[rank] = 1 + np.arange(units.n_units) % (k - 1)
    units.classes[END] = END
    best, past = (-np.inf, None, None), []
    for r in range(rounds + 1):
        classes = spark.sparkContext.broadcast(units.classes)

        def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit, other, side = (batch.column(batch.schema.names.index(c)).to_numpy().astype(np.int64) for c in ("unit", "other", "side"))
                keys, row = np.unique((unit * 2 + side) * k + classes.value[other], return_inverse=True)
                n = np.bincount(row, weights=batch.column(batch.schema.names.index("n")).to_numpy()).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((keys // (2 * k)).astype(np.int32)), pa.array((keys % (2 * k)).astype(np.int32)), pa.array(n)], ["unit", "cell", "n"])

        cells = written(beside.mapInArrow(by_class, "unit int, cell int, n long").groupBy("unit", "cell").agg(F.sum("n").alias("n")).repartition(partitions(spark), "unit"), "cells", folder)

        def between_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k), np.int64)
            for batch in batches:
                unit, cell, n = (c.to_numpy() for c in batch.columns)
                after = cell < k
                np.add.at(total, (classes.value[unit[after]], cell[after]), n[after])
            yield matrix_rows(total)

        between = matrix_of(cells.mapInArrow(between_classes, "a int, b int, n long"), k)
        n = between.sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            likelihood = np.nansum(between * np.log(between)) - 2 * np.nansum(n * np.log(n))
        past.append(likelihood)
        if likelihood > best[0]:
            best = (likelihood, units.classes.copy(), between)
        # two rounds move each unit once
        if r == rounds or (r >= 2 and past[-1] - past[-3] < GAIN * abs(past[-3])):
            break
        units.between = between
        after, size = units.weights()

        def moved(batches: Iterator[pa.RecordBatch], r=r, after=after, size=size) -> Iterator[pa.RecordBatch]:
            parts = [[c.to_numpy() for c in b.columns] for b in batches]
            if not parts:
                return
            unit, cell, n = (np.concatenate(x) for x in zip(*parts))
            own, row = np.unique(unit, return_inverse=True)
            dense = np.zeros((len(own), 2 * k))
            np.add.at(dense, (row, cell), n)
            turn = (mix(own.astype(np.uint64)) % np.uint64(2) == r % 2) & (own != END)
            yield pa.RecordBatch.from_arrays([pa.array(own[turn].astype(np.int32)), pa.array(best_classes(dense, after, size)[turn])], ["unit", "to"])

        for row in cells.mapInArrow(moved, "unit int, to int").toPandas().itertuples():
            units.classes[row.unit] = row.to
    _, units.classes, units.between = best


def matrix_rows(total: np.ndarray) -> pa.RecordBatch:
    a, b = np.nonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b].astype(np.int64))], ["a", "b", "n"])


def matrix_of(rows: DataFrame, k: int) -> np.ndarray:
    """The sum of rows (a, b, n) as a matrix of k times k."""
    total = np.zeros((k, k))
    for row in rows.groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        total[row.a, row.b] = row.n
    return total


def swept(texts: DataFrame, units: Units) -> DataFrame:
    """(word, class): for every word that is no unit of its own, the class that its neighbours make most likely.

    A block of tokens sends each word's counts of classes beside it to the word's partition, where they are added up.  Frequent
    words have units of their own, so no word takes more than a small share.
    """
    spark, k = texts.sparkSession, units.n_classes
    shared, (after, size) = spark.sparkContext.broadcast(units), units.weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, own = Reader(), shared.value

        def counted(parts: list) -> pa.RecordBatch:
            words, row = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            keys, n = tally(np.concatenate([row * (2 * k) + np.concatenate([p[1] for p in parts]), row * (2 * k) + k + np.concatenate([p[2] for p in parts])]))
            return pa.RecordBatch.from_arrays([pa.array(words[keys // (2 * k)].view(np.int64)), pa.array((keys % (2 * k)).astype(np.int16)), pa.array(n.astype(np.int32))], ["word", "cell", "n"])

        held, many = [], 0
        for batch in slices(batches, "text", 4 << 20):
            hashes, endings, counts = read(binaries(batch.column(0)))
            unit = own(hashes, endings)
            line = with_ends(own.classes[unit], counts)
            at = (np.arange(len(hashes)) + 1 + np.repeat(np.arange(len(counts)), counts))[unit >= own.single]
            held.append((hashes[unit >= own.single], line[at + 1], line[at - 1]))
            many += len(at)
            if many > 2_000_000:
                yield counted(held)
                held, many = [], 0
        if many:
            yield counted(held)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = [np.zeros(0, t) for t in (np.int64, np.int16, np.int32)]  # the last word's rows may go on in the next batch

        def chosen(word, cell, n) -> pa.RecordBatch:
            own, row = np.unique(word, return_inverse=True)
            to = []
            for i in range(0, len(own), 4096):
                some = (row >= i) & (row < i + 4096)
                dense = np.zeros((min(4096, len(own) - i), 2 * k))
                np.add.at(dense, (row[some] - i, cell[some]), n[some])
                to.append(best_classes(dense, after, size))
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate(to))], ["word", "class"])

        for batch in batches:
            word, cell, n = (np.concatenate([a, b.to_numpy()]) for a, b in zip(left, batch.columns))
            if not len(word):
                continue
            last = np.searchsorted(word, word[-1])
            # the rows of one word are added up, so that they never are more than its cells
            keys, row = np.unique(cell[last:], return_inverse=True)
            left = [np.full(len(keys), word[-1]), keys, np.bincount(row, weights=n[last:]).astype(np.int64)]
            if last:
                yield chosen(word[:last], cell[:last], n[:last])
        if len(left[0]):
            yield chosen(*left)

    cells = texts.select("text").mapInArrow(run, "word long, cell short, n int")
    return cells.repartition(partitions(spark), "word").sortWithinPartitions("word").mapInArrow(choose, "word long, class int")


def far_rows(texts: DataFrame, model: Model, columns: str, local) -> DataFrame:
    """Rows (word, row, pos, prev, next, fallback, info): one for each word that only the join knows, with the classes beside it (-1: the join's too).

    ``local(ids, rows, counts, line, value)`` gives each block's other rows, for its classes in order and their words'
    counts: a struct ``info`` of ``columns`` and the rows' numbers.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    shared, info = texts.sparkSession.sparkContext.broadcast(model), to_arrow_type(StructType.fromDDL(columns))
    names = ["word", "row", "pos", "prev", "next", "fallback", "info"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        read, own = Reader(), shared.value
        next_row = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", 4 << 20):
            hashes, endings, counts = read(binaries(batch.column(1)))
            kind, n = own.look(hashes)
            line, value = with_ends(kind, counts), with_ends(n, counts)
            place = np.arange(len(hashes)) + 1 + np.repeat(np.arange(len(counts)), counts)
            rows = next_row + np.arange(len(counts))
            next_row += len(counts)
            far = np.flatnonzero(kind < 0)
            stops = np.cumsum(counts)
            pos = far - np.repeat(stops - counts, counts)[far]
            numbers, told = local(own, batch.column(0), rows, counts, line, value)
            keys = mix(numbers.astype(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))  # spreads the blocks' own rows
            short = lambda x: pa.array(x.astype(np.int16))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(numbers), pa.array(np.full(len(numbers), -1, np.int32)), *[pa.nulls(len(numbers), pa.int16())] * 3, pa.StructArray.from_arrays(told, fields=list(info))], names)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[far].view(np.int64)), pa.array(np.repeat(rows, counts)[far]), pa.array(pos.astype(np.int32)), short(line[place[far] - 1]), short(line[place[far] + 1]), short(own.ending_class[endings[far]]), pa.nulls(len(far), info)], names)

    return texts.mapInArrow(run, f"word long, row long, pos int, prev short, next short, fallback short, info struct<{columns}>")


def classed(parts: DataFrame, words: DataFrame) -> DataFrame:
    """Rows of ``far_rows`` with n and class from the join, and ``before``: the class before."""
    joined = parts.join(words.select("word", "n", "class").hint("merge"), "word", "left").withColumn("class", F.when(F.col("pos") >= 0, F.coalesce("class", "fallback")))
    # of two such words in a row, the first one's class comes from the row before
    return joined.withColumn("before", F.when(F.col("prev") >= 0, F.col("prev")).otherwise(F.lag("class").over(W.partitionBy("row").orderBy("pos"))))


def transitions(texts: DataFrame, model: Model, words: DataFrame) -> np.ndarray:
    """How often each class follows each other one in the column text."""
    k = model.n_classes

    def local(own: Model, ids, rows, counts, line, value):
        both = (line[:-1] >= 0) & (line[1:] >= 0)
        total = np.bincount(line[:-1][both] * k + line[1:][both], minlength=k * k).reshape(k, k)
        told = matrix_rows(total)
        return np.full(told.num_rows, rows[0] if len(rows) else 0), told.columns

    parts = far_rows(texts.select(F.lit(0).alias("doc_id"), "text"), model, "a int, b int, n long", local)
    pair = lambda a, b, n: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), n.cast("long").alias("n"))
    one = F.lit(1)
    after = F.when(F.col("next") >= 0, pair(F.col("class"), F.col("next"), one))
    events = F.when(F.col("pos") < 0, F.array(F.col("info"))).otherwise(F.array(pair(F.col("before"), F.col("class"), one), after))
    found = classed(parts, words).select(F.explode(events).alias("e")).where("e IS NOT NULL").select("e.*")
    return matrix_of(found, k)


def score(docs: DataFrame, model: Model, words: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row."""

    def local(own: Model, ids, rows, counts, line, value):
        cur, n = line[1:], value[1:].copy()
        stops = np.cumsum(counts + 1)
        starts = stops - counts - 1
        end = np.zeros(len(cur), bool)
        end[stops - 1] = True
        n[end] = own.n_texts
        near, both = cur >= 0, (line[:-1] >= 0) & (cur >= 0)
        counted = np.where(near, np.log10(np.maximum(n, 0) + ADD), 0)
        logs = np.where(both, own.log_next[line[:-1], cur], 0) + np.where(near & ~end, counted - own.log_class[cur], 0)
        sums = [np.add.reduceat(x, starts) if len(starts) else np.zeros(0) for x in (counted - own.log_base, logs, (near & (n > 0)).astype(np.int64))]
        return rows, [ids, pa.array(counts + 1), pa.array(sums[2].astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])]

    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = classed(far_rows(given, model, "doc_id long, n_tokens long, n_known long, base double, score double", local), words)
    table = lambda x: F.from_json(F.lit(json.dumps(x.ravel().tolist())), "array<double>")
    step = lambda a, b: F.get(table(model.log_next), a.cast("int") * model.n_classes + b.cast("int"))
    far, kind = F.col("pos") >= 0, F.col("class")
    log = F.log10(F.coalesce("n", F.lit(0)) + ADD)
    own = log - F.get(table(model.log_class), kind.cast("int")) + step(F.col("before"), kind) + F.when(F.col("next") >= 0, step(kind, F.col("next"))).otherwise(0.0)
    sums = found.groupBy("row").agg(
        F.max("info.doc_id").alias("doc_id"),
        F.sum("info.n_tokens").alias("n_tokens"),
        (F.sum(F.coalesce("info.n_known", F.lit(0))) + F.sum((far & F.col("n").isNotNull()).cast("long"))).alias("n_known"),
        F.sum(F.when(far, log).otherwise(F.col("info.base"))).alias("base_score"),
        F.sum(F.when(far, own).otherwise(F.col("info.score"))).alias("score"),
    )
    return sums.select("doc_id", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def train(texts: DataFrame, frequent: int = FREQUENT, common: int = COMMON, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """(model, table of all words (word, ending, n, class)) of the column text."""
    spark = texts.sparkSession
    with scratch(spark, "brown") as folder:
        counts = written(word_counts(texts), "word-counts", folder)
        n_texts = texts.count()
        n_words, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        n_classes = int(np.clip(round(n_distinct ** (1 / 3)), *CLASSES))
        sent = most_common(counts, common)
        top = counts.orderBy(F.desc("n"), "word").limit(frequent).toPandas()  # whatever the counts, as many as there are
        own, n, ending = (top[c].to_numpy() for c in ("word", "n", "ending"))
        groups = {r.ending: r.n for r in counts.groupBy("ending").agg(F.sum("n").alias("n")).collect()}
        for e, m in zip(ending.tolist(), n.tolist()):
            groups[e] -= m
        units = Units(own.view(np.uint64), n, {e: m for e, m in groups.items() if m}, n_texts, n_classes)
        cluster(units, neighbours(texts, units, folder), folder, rounds)
        singles = spark.createDataFrame(pd.DataFrame({"word": units.words.view(np.int64), "class": units.classes[1 : units.single]}), "word long, class int")
        classes = swept(texts, units).union(singles)
        words = written(counts.join(classes, "word").select("word", "ending", "n", "class"), "words")
        model = Model(words.where(sent).select("word", "n", "class").toPandas(), units.classes[units.of_ending], n_texts, int(n_words), int(n_distinct), n_classes)
        size, members = np.zeros((2, n_classes))
        for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
            size[r["class"]], members[r["class"]] = r.n, r.words
        model.finish(transitions(texts, model, words), size, members)
        return model, words


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the score of every document under a model of nine tenths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    with scratch(spark, "brown-query"):
        model, words = train(docs.where(remainder != 0).select("text"))
        found = score(docs, model, words)
        out = found.select("doc_id", (remainder == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
        return written(out, "brown-scores")
