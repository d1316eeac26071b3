"""Operator 7: substring dedup by content-defined chunking.

A gear hash rolls over the bytes (each step doubles it and adds the byte's fixed random value, so 32 bits
forget what is 16 bytes back here).  A text may be cut before a word whose preceding 16 bytes hash to zero in the top two
bits, and within a run of ``RUN`` bytes without white space before a character where the top four bits are zero; its start and
end are cuts too.  From every cut a chunk runs to the first cut at least ``LEAST`` bytes on.  Cuts depend on near bytes only, so
an insertion changes the chunks around it and no others, and a passage has the same chunks wherever it stands.

Chunks are deduplicated by 128-bit digest, as is each whole text of ``LEAST_CHARS`` characters or more: one is repeated if a
document with a smaller id has it too.  The first document keeps it; elsewhere, overlapping and touching repeated chunks join to
spans, and spans of at least ``least_chars`` characters are reported.  Exact copies of that length are always found; a shared
passage of over 50 words is found but for chance (2 in 100 of 51 words, fewer of longer ones).

Cases: null and empty texts and those of fewer than ``LEAST`` bytes have no chunks and no spans; a very long text is chunked
whole, its chunks being rows of their own; rows that share a doc_id count as one document and don't repeat each other; equal
texts under other ids do; rows without an id count as one document that comes before all others, and ids come out null;
ties can't occur, as ids decide; an empty table gives no rows; further columns are kept by ``remove_spans``, whose own one gets a
bar at its end where a column has its name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentwatch.llm.common import SPACES, binaries, filter_array, free_name, parted, passes, scratch, slices, written
from contentwatch.llm.words import mix

WINDOW, BITS = 16, 2
RUN, RUN_BITS = 32, 4
LEAST = 60
LEAST_CHARS = 120
NO_ID = -(1 << 63)


def gear_values() -> np.ndarray:
    return (mix(np.arange(1000, 1256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def gear(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte, of it and the 15 before: windows of 1, 2, 4, 8 and 16 bytes by doubling."""
    found, size = values[data], 1
    while size < WINDOW:
        longer = found.copy()
        longer[size:] += found[:-size] << np.uint32(size)
        found, size = longer, 2 * size
    return found


class Chunks:
    """Cuts texts; gives each one's chunks as (starts, stops) in bytes, the same in characters, and digests of two longs."""

    def __init__(self, least: int = LEAST):
        self.values, self.least = gear_values(), least
        self.space = np.zeros(256, bool)
        self.space[np.frombuffer(SPACES + b"\0", np.uint8)] = True

    def __call__(self, texts: list[bytes]):
        from xxhash import xxh3_128_digest

        gap = b"\0" * WINDOW
        data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
        hashed = gear(data, self.values)
        space, inside = self.space[data], (data & 0xC0) == 0x80
        at = np.arange(len(data))
        since = at - np.maximum.accumulate(np.where(space, at, 0))  # bytes since white space, this one among them
        word = space[:-1] & ~space[1:] & (hashed[:-1] >> np.uint32(32 - BITS) == 0)
        run = (since[:-1] >= RUN) & ~space[1:] & ~inside[1:] & (hashed[:-1] >> np.uint32(32 - RUN_BITS) == 0)
        places = np.flatnonzero(word | run) + 1
        chars = np.cumsum(~inside)
        sizes = np.array([len(t) for t in texts], np.int64)
        begins = WINDOW + np.cumsum(sizes + WINDOW) - sizes - WINDOW
        lo, hi = np.searchsorted(places, begins, side="right"), np.searchsorted(places, begins + sizes)
        for text, b, n, i, j in zip(texts, begins.tolist(), sizes.tolist(), lo.tolist(), hi.tolist()):
            cuts = np.concatenate([[b], places[i:j], [b + n]])
            starts = cuts[cuts + self.least <= b + n]
            stops = cuts[np.searchsorted(cuts, starts + self.least)] if len(starts) else starts
            first, last = chars[starts - 1] - chars[b - 1], chars[stops - 1] - chars[b - 1]
            n_chars = int(chars[b + n - 1] - chars[b - 1])
            if n_chars >= LEAST_CHARS:
                starts, stops, first, last = np.append(starts, b), np.append(stops, b + n), np.append(first, 0), np.append(last, n_chars)
            digests = b"".join([xxh3_128_digest(text[x:y]) for x, y in zip((starts - b).tolist(), (stops - b).tolist())])
            yield starts - b, stops - b, first, last, np.frombuffer(digests, np.int64).reshape(-1, 2)


def chunk_table(docs: DataFrame, doc_id: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """(doc_id, row, high, low, start, stop): every chunk, its digest and characters; row: the text's hash.

    only: high words of digests; chunks that a filter of them (32 MB at most) shows to have none of these are left out.
    """
    sent = None if only is None else docs.sparkSession.sparkContext.broadcast(filter_array(only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks()
        for batch in slices(batches, "text", 1 << 20):
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = list(chunks(binaries(batch.column(2))))
            counts = [len(x[0]) for x in found]
            start, stop, digests = (np.concatenate([x[k] for x in found]) for k in (2, 3, 4))
            columns = [np.repeat(ids, counts), np.repeat(rows, counts), digests[:, 0].copy(), digests[:, 1].copy(), start.astype(np.int32), stop.astype(np.int32)]
            if sent:
                some = passes(sent.value, columns[2])
                columns = [x[some] for x in columns]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc_id", "row", "high", "low", "start", "stop"])

    given = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("row"), F.coalesce(text, F.lit("")).alias("text"))
    return given.mapInArrow(run, "doc_id long, row long, high long, low long, start int, stop int")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, row, span_start, span_stop, first_doc_id): spans, in characters, that documents with smaller ids hold too."""
    id_or_null = lambda c: F.nullif(F.col(c), F.lit(NO_ID)).alias(c)
    with scratch(docs.sparkSession, "substrings") as folder:
        # chunks are computed twice: a table of them takes more than the texts do
        seen = chunk_table(docs, doc_id, text).groupBy("high", "low").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
        # a table of its own, so Spark can split a frequent chunk's rows when they join
        firsts = written(seen.select("high", "low", "first"), "firsts", folder)
        later = chunk_table(docs, doc_id, text, firsts.select("high")).join(firsts, ["high", "low"]).where("doc_id > first").select("doc_id", "row", "start", "stop", "first").distinct()
        own = W.partitionBy("doc_id", "row").orderBy("start", "stop")
        reach = F.max("stop").over(own.rowsBetween(W.unboundedPreceding, -1))
        islands = later.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(0))).withColumn("island", F.sum("new").over(own.rowsBetween(W.unboundedPreceding, 0)))
        spans = islands.groupBy("doc_id", "row", "island").agg(F.min("start").alias("span_start"), F.max("stop").alias("span_stop"), F.min("first").alias("first_doc_id"))
        return written(spans.where(F.col("span_stop") - F.col("span_start") >= least_chars).select(id_or_null("doc_id"), "row", "span_start", "span_stop", id_or_null("first_doc_id")), "spans")


def remove_spans(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text", removed: str = "removed_chars") -> DataFrame:
    """``docs`` with the spans cut out of the texts and, in ``removed``, the number of characters that went."""
    names = [free_name(docs, n) for n in ("span_doc_id", "span_row", "span_list", removed)]
    of, row, listed, removed = names
    lists = spans.groupBy(F.col("doc_id").alias(of), F.col("row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("span_start", "span_stop"))).alias(listed))
    keyed = docs.withColumn(row, F.xxhash64(text))
    with scratch(docs.sparkSession, "remove"):
        # texts without spans stay where they are
        some, others = parted(keyed, F.xxhash64(F.col(f"`{doc_id}`").cast("long"), row), spans.select(F.xxhash64(F.col("doc_id").cast("long"), "row")))
    met = some.join(lists, some[f"`{doc_id}`"].cast("long").eqNullSafe(lists[of]) & (some[row] == lists[row]), "left").select(*[some[f"`{c}`"] for c in docs.columns], listed)
    joined = met.union(others.select(*[f"`{c}`" for c in docs.columns], F.lit(None).cast(lists.schema[listed].dataType).alias(listed)))
    starts = F.concat(F.array(F.lit(0)), F.transform(listed, lambda s: s["span_stop"]))
    stops = F.concat(F.transform(listed, lambda s: s["span_start"]), F.array(F.length(text)))
    pieces = F.zip_with(starts, stops, lambda a, b: F.substring(F.col(text), a + 1, b - a))
    gone = F.aggregate(listed, F.lit(0), lambda n, s: n + s["span_stop"] - s["span_start"])
    return joined.withColumns({text: F.when(F.col(listed).isNull(), F.col(text)).otherwise(F.array_join(pieces, "")), removed: F.coalesce(gone, F.lit(0))}).drop(listed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every span of a document that one with a smaller id holds already."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = repeated_spans(docs)
    return found.select("doc_id", F.col("span_start").cast("long").alias("span_start"), F.col("span_stop").cast("long").alias("span_stop"), (F.col("span_stop") - F.col("span_start")).cast("long").alias("n_chars"), "first_doc_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without repeated spans; one of which less than LEAST_CHARS stay goes.  n_chars, where it is a column, follows the text."""
    removed = free_name(docs, "removed_chars")
    cut = remove_spans(docs, repeated_spans(docs.select("doc_id", "text")))
    kept = cut.where((F.col(removed) == 0) | (F.length(F.trim("text")) >= LEAST_CHARS))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.drop(removed)
