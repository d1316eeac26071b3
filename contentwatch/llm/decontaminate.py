"""Operator 9: benchmark decontamination by winnowing.

A window is ``span`` consecutive words of an item (a shorter item is one window of its own length m).  For
windows of m words, k-grams of k = (m + 1) // 2 words are hashed and the least hash of every m - k + 1
consecutive k-grams is kept (Schleimer, Wilkerson & Aiken 2003).  Equal spans of m words have equal kept
hashes, so no shared span is missed.  Kept hashes of documents are joined with those of the benchmark, and
the hits are extended to whole windows and confirmed by 128-bit keys of their words.

A benchmark whose index takes at most ``block_bytes`` as sorted arrays (WINDOW_BYTES a window) is sent to the tasks, and the documents are never
shuffled.  A larger one stays a table: the documents' kept hashes meet its own in a shuffle join, and the windows of documents that had one in another.

Cases: a null or empty text has no words and no hits; a very long text is read whole; items without words have no windows; an
item with a null id hits words but is not listed; repeated items and rows count once and each; empty tables give no hits;
further columns are kept, and where one has the name of an output column, the new one gets a bar at its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentwatch.llm.common import binaries, free_name, scratch, slices, written
from contentwatch.llm.words import Words, grams, grams_at

#: Bytes between words: all ASCII but digits and letters.
SEPARATORS = bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
SPAN = 10
BLOCK_BYTES = 32 << 20
#: Of the index: two halves of a key, a kept hash, the item's number, and what building it takes besides.
WINDOW_BYTES = 40


def shape(m: int) -> tuple[int, int]:
    """(k, number of k-grams in a window) for windows of m words."""
    k = (m + 1) // 2
    return k, m - k + 1


def least(found: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive entries."""
    n = len(found) - w + 1
    if n <= 0:
        return found[:0]
    out = found[:n].copy()
    for j in range(1, w):
        np.minimum(out, found[j : j + n], out=out)
    return out


def keys_of(windows: np.ndarray, again: np.ndarray) -> np.ndarray:
    """128-bit keys as pairs of longs, from two independent hashes."""
    return np.stack([windows, again], axis=1).view(np.int64)


def index_rows(items: DataFrame, item_id: str, text: str, span: int) -> DataFrame:
    """(m, kept, high, low, item) of every window of the items: its length in words, kept hash and 128-bit key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, others = Words(SEPARATORS), Words(SEPARATORS, seed=1)
        for batch in slices(batches, "text"):
            texts = binaries(batch.column(1))
            (hashes, offsets), (second, _) = words(texts), others(texts)
            for i, item in enumerate(batch.column(0).to_pylist()):
                own, again = hashes[offsets[i] : offsets[i + 1]], second[offsets[i] : offsets[i + 1]]
                m = min(span, len(own))
                if m:
                    k, w = shape(m)
                    keys, kept = keys_of(grams(own, m), grams(again, m)), least(grams(own, k), w)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), m, np.int32)), pa.array(kept.view(np.int64)), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array([item] * len(keys), pa.string())], ["m", "kept", "high", "low", "item"])

    # equal texts are read once each id
    given = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text")).distinct()
    return given.mapInArrow(run, "m int, kept long, high long, low long, item string")


class Index:
    """Windows of m words of a benchmark: sorted arrays of their keys and items."""

    def __init__(self, rows: pa.Table):
        high, low, kept = (rows[c].to_numpy().view(np.uint64) for c in ("high", "low", "kept"))
        item = rows["item"].combine_chunks().dictionary_encode()
        self.names = item.dictionary.to_pylist()
        numbers = item.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        order = np.lexsort((low, high))
        self.kept, self.high, self.low, self.item = np.unique(kept), high[order], low[order], numbers[order]

    def among(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the keys, row of the index) for each row that has one of the keys."""
        first, after = np.searchsorted(self.high, high), np.searchsorted(self.high, high, side="right")
        which = np.repeat(np.arange(len(high)), after - first)
        row = np.arange(len(which)) - np.repeat(np.cumsum(after - first) - after, after - first)
        same = self.low[row] == low[which]
        return which[same], row[same]


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def candidates(hashes: np.ndarray, text_of: np.ndarray, m: int, kept: np.ndarray) -> np.ndarray:
    """The places of windows of m words, each within one text, whose kept hash is among ``kept``."""
    k, w = shape(m)
    if len(hashes) < m:
        return np.zeros(0, np.int64)
    minima = least(grams(hashes, k), w)
    first = np.flatnonzero(np.append(True, minima[1:] != minima[:-1]))  # what winnowing keeps
    at = np.flatnonzero(np.repeat(_among(minima[first], kept), np.diff(np.append(first, len(minima)))))
    return at[text_of[at] == text_of[at + m - 1]]


def hits(texts: list[bytes], words: Words, others: Words, index: dict[int, Index]):
    """(offsets of the texts' words, mask of hit words, (text, item) pairs)."""
    hashes, offsets = words(texts)
    text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    mask, pairs = np.zeros(len(hashes) + 1, np.int64), set()
    for m, one in index.items():
        at = candidates(hashes, text_of, m, one.kept)
        at = at[_among(grams_at(hashes, at, m), one.high)]
        if not len(at):
            continue
        # the second hash of the texts that are left decides
        some = np.unique(text_of[at])
        second, starts = others([texts[i] for i in some.tolist()])
        moved = at - offsets[text_of[at]] + starts[np.searchsorted(some, text_of[at])]
        which, row = one.among(grams_at(hashes, at, m), grams_at(second, moved, m))
        hit = at[np.unique(which)]
        np.add.at(mask, hit, 1)
        np.add.at(mask, hit + m, -1)
        named = one.item[row] >= 0
        pairs.update((t, one.names[i]) for t, i in set(zip(text_of[at[which[named]]].tolist(), one.item[row[named]].tolist())))
    return offsets, np.cumsum(mask[:-1]) > 0, pairs


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = SPAN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words long, hit_spans array<struct<start, stop>> (word numbers, merged, ascending) and hit_items array<string> (sorted, distinct)."""
    names = [free_name(docs, n) for n in ("n_words", "hit_spans", "hit_items")]
    found = index_rows(items, item_id, item_text, span)
    if found.count() * WINDOW_BYTES > block_bytes:
        return _by_join(docs, items, text, item_id, item_text, span, names)
    rows = found.toArrow()
    index = docs.sparkSession.sparkContext.broadcast({m: Index(rows.filter(pc.equal(rows["m"], m))) for m in pc.unique(rows["m"]).to_pylist()})
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()), T.StructField(names[1], SPANS), T.StructField(names[2], T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, others = Words(SEPARATORS), Words(SEPARATORS, seed=1)
        for batch in slices(batches, text, 4 << 20):
            offsets, mask, pairs = hits(binaries(batch.column(batch.schema.names.index(text))), words, others, index.value)
            spans, listed = [[] for _ in range(batch.num_rows)], [set() for _ in range(batch.num_rows)]
            for i in np.unique(np.searchsorted(offsets, np.flatnonzero(mask), side="right") - 1).tolist():
                edges = np.flatnonzero(np.diff(mask[offsets[i] : offsets[i + 1]], prepend=False, append=False))
                spans[i] = [{"start": a, "stop": b} for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist())]
            for i, item in pairs:
                listed[i].add(item)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(offsets)), pa.array(spans, SPAN_TYPE), pa.array([sorted(x) for x in listed], pa.list_(pa.string()))], [*batch.schema.names, *names])

    return docs.mapInArrow(run, schema)


def _by_join(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, span: int, names: list[str]) -> DataFrame:
    """``decontaminate`` for a benchmark of any size: kept hashes meet in a join, then the windows of the documents that had one."""
    spark, row = docs.sparkSession, free_name(docs, "row_number")
    with scratch(spark, "decontaminate") as folder:
        numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "documents", folder)  # numbers hold once written
        index = written(index_rows(items, item_id, item_text, span), "index", folder)
        lengths = sorted(r.m for r in index.select("m").distinct().collect())  # at most ``span``
        given = numbered.select(F.col(row).alias("row"), F.col(text).alias("text"))

        def kept_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = Words(SEPARATORS)
            for batch in slices(batches, "text", 4 << 20):
                hashes, offsets = words(binaries(batch.column(1)))
                numbers = batch.column(0).to_numpy()
                for m in lengths:
                    k, w = shape(m)
                    found = [np.unique(least(grams(hashes[a:b], k), w)) for a, b in zip(offsets[:-1], offsets[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(numbers, [len(x) for x in found])), pa.array(np.full(sum(map(len, found)), m, np.int32)), pa.array(np.concatenate(found).view(np.int64))], ["row", "m", "kept"])

        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words, others = Words(SEPARATORS), Words(SEPARATORS, seed=1)
            for batch in slices(batches, "text", 1 << 20):
                texts = binaries(batch.column(1))
                (hashes, offsets), (second, _) = words(texts), others(texts)
                for number, ms, a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                    for m in ms:
                        keys = keys_of(grams(hashes[a:b], m), grams(second[a:b], m))
                        n = len(keys)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.full(n, m, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy())], ["row", "m", "start", "high", "low"])

        met = given.mapInArrow(kept_hashes, "row long, m int, kept long").join(written(index.select("m", "kept").distinct(), "kept", folder), ["m", "kept"], "left_semi")
        touched = written(met.groupBy("row").agg(F.collect_set("m").alias("ms")), "touched", folder)
        own = given.join(touched, "row").mapInArrow(windows, "row long, m int, start int, high long, low long")
        found = written(own.join(written(index.select("m", "high", "low").distinct(), "windows", folder), ["m", "high", "low"], "left_semi"), "found", folder)
        listed = found.select("row", "m", "high", "low").distinct().join(index.where("item IS NOT NULL").select("m", "high", "low", "item").distinct(), ["m", "high", "low"]).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias(names[2]))
        order = W.partitionBy("row").orderBy("start", "stop")
        reach = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
        islands = found.select("row", "start", (F.col("start") + F.col("m")).alias("stop")).withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(0))).withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
        merged = islands.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(names[1]))
        told = written(merged.join(listed, "row", "left").withColumnRenamed("row", row), "told", folder)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = Words(SEPARATORS)
            for batch in slices(batches, text, 4 << 20):
                _, offsets = words(binaries(batch.column(batch.schema.names.index(text))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(offsets))], [*batch.schema.names, names[0]])

        counted = numbered.mapInArrow(count, T.StructType([*numbered.schema.fields, T.StructField(names[0], T.LongType())]))
        empty = [F.coalesce(names[1], F.array().cast(SPANS)).alias(names[1]), F.coalesce(names[2], F.array().cast("array<string>")).alias(names[2])]
        return written(counted.join(told, row, "left").select(*[f"`{c}`" for c in docs.columns], names[0], *empty), "decontaminated")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: hit words and items of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    found = decontaminate(docs, items).select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"))
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with no word inside a benchmark window."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    spans = free_name(docs, "hit_spans")
    return decontaminate(docs, items).where(F.size(f"`{spans}`") == 0).select(*[f"`{c}`" for c in docs.columns])
