"""Operator 6: token counts through a digest cache.

The cache is a table (digest, tokenizer, n_tokens): the SHA-256 of a text's UTF-8 and of the tokenizer's
file.  Texts that the cache lacks are brought together by digest, each distinct one is encoded once, and
the new counts are appended.  Counts then come from a join of digests; texts aren't part of it.

Cases: a null text counts as empty; a very long text is encoded whole; equal texts, in however many rows, are encoded once;
an empty table gives no rows and appends nothing; a cache that another tokenizer filled has no hits; further columns are
kept, and where one has the name of the count, the count gets a bar at its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentwatch.llm.common import BATCH, free_name, partitions, scratch, slices, settings, written

CACHE = "digest binary, tokenizer string, n_tokens long"


def digest_of(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def tokenizer_version(path: str) -> str:
    """The digest of the tokenizer's file; another file is another version."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path_suffix: str, content: bytes):
    """A function from texts to token counts, by the library for the kind of file."""
    if path_suffix == "model":
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(x) for x in library.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(content.decode())
    library.no_truncation()
    library.no_padding()
    library.encode_special_tokens = True
    return lambda texts: [len(x.ids) for x in library.encode_batch(texts, add_special_tokens=False)]


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose digest is new to this task."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, digest in enumerate(batch.column(0).to_pylist()):
            if digest not in seen:
                seen.add(digest)
                keep.append(i)
        if keep:
            yield batch.take(pa.array(keep, pa.int64()))


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The counts stored for one tokenizer version; none where nothing has been stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)


def fill(docs: DataFrame, cache: str, path: str, text: str = "text") -> None:
    """Encodes the distinct texts that ``cache`` lacks and appends their counts."""
    spark, version = docs.sparkSession, tokenizer_version(path)
    with open(path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())
    suffix = path.rpartition(".")[2]

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(suffix, content.value)
        for batch in slices(_once(batches), "text", 2 << 20):
            found = count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(found), pa.string()), pa.array(found, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    texts = docs.select(digest_of(text).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = read_cache(spark, cache, version).select("digest")
    # copies are dropped before the shuffle, so a text that fills a third of the table sends a row a task
    apart = texts.mapInArrow(_once, texts.schema).join(known, "digest", "left_anti").repartition(partitions(spark), "digest")
    with settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": f"{BATCH}b"}):
        apart.mapInArrow(encoded, CACHE).write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, cache: str, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` without the text, with ``out``: each text's tokens as the library for ``path`` counts them."""
    out, key = free_name(docs, out), free_name(docs, "digest")
    fill(docs, cache, path, text)
    counts = read_cache(docs.sparkSession, cache, tokenizer_version(path)).groupBy(F.col("digest").alias(key)).agg(F.first("n_tokens").alias(out))
    # a table of its own, so Spark can split the rows of a frequent text when they join
    counts = written(counts, "token-counts")
    return docs.withColumn(key, digest_of(text)).drop(text).join(counts, key).drop(key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: tokens of every document; the cache starts empty, so each distinct text is encoded here."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    with scratch(spark, "token-cache") as cache:
        found = count_tokens(docs, cache, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))
