"""Operator 13: importance resampling towards a target distribution, with hashed n-grams (Xie et al. 2023).

A batch's texts are joined with separator sentinels, and one pass of a regular expression finds the words of all of them.  The
documents' offsets, searched for the words' places, tell each word's document, which masks the n-grams that would reach across; what is left is
counted by ``bincount``.  A feature's bucket is the CRC-32 of its bytes.  CRC-32 is linear: that of ``x y`` follows from
those of x and y and the length of y (as zlib's ``crc32_combine`` does), so each word is hashed once and runs of words by table look-ups.

Gains of all buckets come from two counts (raw and target) of ``buckets`` numbers each; weights are their sums over a document, and the
draw without replacement takes the highest weights with Gumbel noise added (Kool, van Hoof & Welling 2019), seeded by the id.  Ranks
come from a range partitioning by score: rows are numbered within their range, and the ranges' sizes give what
stands before.  Nothing is gathered but counts of buckets and of ranges.

Cases: a null or empty text has no words and no features; a very long text is read whole, in blocks that hand on their last words; equal
scores go to the smaller id, null ids first; repeated rows each come back and are each drawn; a null id draws its noise as the
text ``null``; empty tables count nothing, and an empty one to draw from gives no rows; further columns are kept, and a new one whose name is taken
gets a bar at its end.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentwatch.llm.common import binaries, free_name, partitions, scratch, slices, written

BUCKETS, NGRAM = 10_000, 3
SEED, PERCENT, LEAST_WORDS = 42, 5, 20
#: Words: runs of anything but ASCII other than digits and (lower-cased) letters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
#: Bytes that are joined and searched at once.
BLOCK = 1 << 20


def _shift_tables(lengths: int) -> np.ndarray:
    """tables[n, i, x]: what the byte x at place i of a CRC-32 is after n more zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> np.uint32(1)) ^ np.uint32(0xEDB88320), one >> np.uint32(1))
    tables = np.empty((lengths, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(1, lengths):
        tables[n] = one[tables[n - 1] & 255] ^ (tables[n - 1] >> np.uint32(8))
    return tables


class Crc:
    """CRC-32 of runs of words from those of the words."""

    SHORT = 64

    def __init__(self):
        self.tables = _shift_tables(self.SHORT)
        self.space = np.uint32(zlib.crc32(b" "))

    def shift(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The CRCs as they count towards that of a text which goes on for n bytes."""
        out, left = crc.copy(), n.copy()
        at = np.arange(len(out))
        while len(at):  # once, but for words of 64 bytes or more
            now = np.minimum(left[at], self.SHORT - 1)
            x = out[at]
            out[at] = self.tables[now, 0, x & 255] ^ self.tables[now, 1, x >> 8 & 255] ^ self.tables[now, 2, x >> 16 & 255] ^ self.tables[now, 3, x >> 24]
            left[at] -= now
            at = at[left[at] > 0]
        return out

    def then(self, before: np.ndarray, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The CRC of ``before``, a space and a word of ``size`` bytes with the CRC ``crc``."""
        spaced = self.shift(before, np.ones(len(before), np.int64)) ^ self.space
        return self.shift(spaced, size) ^ crc


def _cuts(text: bytes) -> list[bytes]:
    """A text in blocks of about BLOCK bytes that end after a word."""
    if len(text) <= BLOCK:
        return [text]
    parts, start = [], 0
    while len(text) - start > BLOCK:
        gap = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]").search(text, start + BLOCK)
        stop = gap.start() if gap else len(text)
        parts.append(text[start:stop])
        start = stop
    return [*parts, text[start:]]


def features(texts: list[bytes], crc: Crc, n: int = NGRAM) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(document of each feature, CRC-32 of each feature, how many of them are single words: those stand first) for blocks of the texts."""

    def blocks():
        at, parts, held = [], [], 0
        for i, text in enumerate(texts):
            for part in _cuts(text):
                if parts and held + len(part) > BLOCK:
                    yield at, parts
                    at, parts, held = [], [], 0
                at.append(i)
                parts.append(part)
                held += len(part) + 1
        if parts:
            yield at, parts

    # the last words of the block before: their documents, and their runs of 1, 2, ... words
    last_doc, last_runs = np.zeros(0, np.int64), [np.zeros(0, np.uint32)] * n
    for at, parts in blocks():
        joined = b"\n".join(parts).translate(LOWER)
        words = [(m.start(), m.group()) for m in WORD.finditer(joined)]
        if not words:
            continue
        starts = np.array([x for x, _ in words], np.int64)
        hashes = np.array([zlib.crc32(w) for _, w in words], np.uint32)
        size = np.array([len(w) for _, w in words], np.int64)
        offsets = np.cumsum([0, *[len(p) + 1 for p in parts[:-1]]])
        doc = np.asarray(at, np.int64)[np.searchsorted(offsets, starts, side="right") - 1]
        k = len(last_doc)
        all_doc = np.concatenate([last_doc, doc])
        runs, docs, found = [hashes], [doc], [hashes]
        for j in range(1, n):
            # the run of j words that ends before each word, continued by the word
            before = np.concatenate([last_runs[j - 1], runs[-1]])
            # a word has a run of j + 1 words where the j words before it are there and of its document
            end = np.arange(k, k + len(doc))
            whole = end >= j
            whole[whole] = all_doc[end[whole] - j] == doc[whole]
            run = np.zeros(len(doc), np.uint32)
            run[whole] = crc.then(before[end[whole] - 1], hashes[whole], size[whole])
            runs.append(run)
            docs.append(doc[whole])
            found.append(run[whole])
        yield np.concatenate(docs), np.concatenate(found), len(doc)
        keep = max(0, n - 1)
        last_runs = [np.concatenate([old, new])[-keep:] if keep else new[:0] for old, new in zip(last_runs, runs)]
        last_doc = all_doc[-keep:] if keep else doc[:0]


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, n: int = NGRAM) -> np.ndarray:
    """How many features of all rows fall into each bucket; a task sends one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, total = Crc(), np.zeros(buckets, np.int64)
        for batch in slices(batches, text, BLOCK):
            for _, found, _ in features(binaries(batch.column(0)), crc, n):
                total += np.bincount(found % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    rows = docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most ``buckets``
    out = np.zeros(buckets, np.int64)
    for row in rows:
        out[row.bucket] = row.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(p / q)) of each bucket, p and q the target's and the raw share with one feature added to each bucket."""
    n, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(y) + 1) * (s + n) / ((int(x) + 1) * (t + n)))) for x, y in zip(raw, target)], np.int64)


def noise(doc_id, seed: int = SEED) -> int:
    """floor(1000 * g), g the Gumbel noise that the seed and the id determine."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gain: np.ndarray, text: str = "text", doc_id: str = "doc_id", n: int = NGRAM, seed: int = SEED) -> DataFrame:
    """``docs`` without the text, with n_words, n_features, weight (the sum of the gains of its features) and score (weight and noise), all long."""
    table = docs.sparkSession.sparkContext.broadcast(gain)
    rest = [c for c in docs.columns if c != text]
    names = [free_name(docs.drop(text), x) for x in ("n_words", "n_features", "weight", "score")]
    schema = T.StructType([*[docs.schema[c] for c in rest], *[T.StructField(x, T.LongType()) for x in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crc, own = Crc(), table.value
        for batch in slices(batches, text, BLOCK):
            column = lambda c: batch.column(batch.schema.names.index(c))
            words, count, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for doc, found, single in features(binaries(column(text)), crc, n):
                words += np.bincount(doc[:single], minlength=batch.num_rows)
                count += np.bincount(doc, minlength=batch.num_rows)
                np.add.at(weight, doc, own[found % np.uint32(len(own))])
            score = weight + np.array([noise(x, seed) for x in column(doc_id).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*map(column, rest), *map(pa.array, (words, count, weight, score))], [*rest, *names])

    return docs.mapInArrow(run, schema)


def ranked(rows: DataFrame, order: list, name: str, folder: str) -> DataFrame:
    """``rows`` with ``name`` long: 1, 2, 3, ... in the order of the columns ``order``, by ranges of it, of which any task has one."""
    spark, place = rows.sparkSession, free_name(rows, "place")
    # an id of a row that grows: the number of its range, then that of the row in it
    ranges = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    placed = written(ranges.withColumn(place, F.monotonically_increasing_id()), "placed", folder)
    part, within = F.shiftright(place, 33), F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.part, r.many) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("many")).collect())  # a row a range
    before, starts = 0, []
    for p, many in sizes:
        starts.append((p, before))
        before += many
    start = free_name(rows, "start")
    known = spark.createDataFrame(starts, f"part int, {start} long")
    return placed.withColumn("part", part.cast("int")).join(F.broadcast(known), "part").withColumn(name, within + F.col(start) + 1).drop("part", start, place)


def resample(docs: DataFrame, target: DataFrame, text: str = "text", doc_id: str = "doc_id", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, n: int = NGRAM, seed: int = SEED) -> DataFrame:
    """``docs`` without the text, with n_words, n_features, weight, score and rank: the place of the drawn rows, ``percent`` of those with ``least_words`` words; null for the others."""
    spark = docs.sparkSession
    with scratch(spark, "resampling") as folder:
        gain = gains(bucket_counts(docs, text, buckets, n), bucket_counts(target, target_text, buckets, n))
        weighed = weights(docs, gain, text, doc_id, n, seed)
        words, count, weight, score = weighed.columns[-4:]
        weighed = written(weighed, "weights", folder)
        able = weighed.where(F.col(f"`{words}`") >= least_words)
        drawn = percent * able.count() // 100
        rank = free_name(weighed, "rank")
        order = [F.col(f"`{score}`").desc(), F.col(f"`{doc_id}`").asc_nulls_first(), F.col(f"`{count}`"), F.col(f"`{weight}`")]
        placed = ranked(able, order, rank, folder).withColumn(rank, F.when(F.col(rank) <= drawn, F.col(rank)))
        rest = weighed.where(F.col(f"`{words}`") < least_words).withColumn(rank, F.lit(None).cast("long"))
        return written(placed.unionByName(rest), "resampled")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: weights, scores and the drawn 5 % of the documents, towards the benchmark's texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
