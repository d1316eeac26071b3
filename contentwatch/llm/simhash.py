"""Operator 8: SimHash fingerprints and permuted block tables.

Terms are pairs of neighbouring words (the word itself in a text of one word), A-Z lower-cased, weighted by
how often they occur.  Each term's 128-bit hash votes its weight for or against every bit (Charikar 2002).
Fingerprints are strings of 32 hex digits; likeness is 1 - Hamming distance / 128.

``search`` finds every fingerprint within a Hamming radius r.  Each block of bits has a tolerance, and the tolerances plus
one sum to r + 1; so of two fingerprints within r, one block at least differs in no more bits than its tolerance.  The
table has one key a block (the permuted tables of Manku, Jain & Das Sarma 2007, in one), and the asked fingerprints, of
which there are few, are looked up under every key within the tolerance.  At the radius of 12, with 5 blocks of 24 or 28
bits, that is 961 keys of each asked one, where tables of equal blocks alone would take hundreds of keys of every row.
A pair is given by the first block that fits, so once.  It runs over distinct fingerprints, so copies meet no more often
than one text does.

Cases: a null or empty text, or one without words, has the fingerprint of all zeros; equal texts have equal
fingerprints; a very long text is read whole, its votes summed a block of terms at a time; repeated ids are ordered by
fingerprint and text; a single document is its own next one; an empty table gives no rows; null ids come first in the order;
``fingerprints`` keeps further columns and puts a bar at the end of its own where a column has its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentwatch.llm.common import SPACES, binaries, free_name, partitions, scratch, slices, written
from contentwatch.llm.words import Words, grams, mix

BITS = 128
RADIUS = 12
#: Blocks of the search; fewer give longer keys, so fewer chance candidates in a large table, and more keys of each asked fingerprint.
BLOCKS = 5
_TAG = 56


def votes(terms: np.ndarray) -> np.ndarray:
    """Per bit, how many terms have it set."""
    total = np.zeros(BITS, np.int64)
    for i in range(0, len(terms), 1 << 15):
        part = terms[i : i + (1 << 15)]
        both = np.stack([part, mix(part + np.uint64(0x9E3779B97F4A7C15))], axis=1)
        total += np.unpackbits(both.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(words: np.ndarray) -> str:
    terms = grams(words, 2) if len(words) > 1 else mix(words)
    return np.packbits(2 * votes(terms) > len(terms)).tobytes().hex()


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``df`` with the fingerprint of each text."""
    out = free_name(df, out)
    at, names = df.columns.index(text), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(SPACES)
        for batch in slices(batches, text, 4 << 20):
            hashes, offsets = words(binaries(batch.column(at)))
            found = [fingerprint(hashes[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def likeness(a: str, b: str):
    """1 - Hamming distance / 128 of two fingerprint columns."""
    distance = sum((F.bit_count(_word(a, i).bitwiseXOR(_word(b, i))) for i in range(4)), F.lit(0))
    return 1.0 - distance / F.lit(float(BITS))


def _word(fingerprint: str, i: int):
    """The i-th 32 bits as a long."""
    return F.conv(F.substring(fingerprint, 8 * i + 1, 8), 16, 10).cast("long")


def tolerances(radius: int, blocks: int) -> list[tuple[int, int, int]]:
    """(first hex digit, the one after the last, bits that may differ) of the blocks; shorter blocks tolerate more, a block that isn't needed is left out."""
    digits = BITS // 4
    edges = [digits * i // blocks for i in range(blocks + 1)]
    least, more = divmod(radius + 1, blocks)
    shorter = sorted(range(blocks), key=lambda i: edges[i + 1] - edges[i])
    found = {i: least - 1 + (rank < more) for rank, i in enumerate(shorter)}
    return [(edges[i], edges[i + 1], found[i]) for i in range(blocks) if found[i] >= 0]


def _masks(bits: int, most: int) -> list[int]:
    """The numbers of ``bits`` bits of which at most ``most`` are set."""
    return [sum(1 << i for i in chosen) for n in range(most + 1) for chosen in combinations(range(bits), n)]


def _halves(a: int, b: int) -> tuple[int, int]:
    """The hex digits a to b of a fingerprint as masks of its two signed longs."""
    whole = ((1 << 4 * (b - a)) - 1) << 4 * (BITS // 4 - b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(whole >> 64), signed(whole & ((1 << 64) - 1))


def search(queries: DataFrame, table: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, found, distance): distinct fingerprints of ``table`` within ``radius`` of each distinct one of ``queries``; both have a column fingerprint.  At least 3 blocks."""
    parts = tolerances(radius, blocks)
    long = lambda a, b: F.conv(F.substring("fingerprint", a + 1, b - a), 16, 10).cast("long")
    half = lambda a: F.shiftleft(long(a, a + 8), 32).bitwiseOR(long(a + 8, a + 16))

    def blocked(df: DataFrame, name: str) -> DataFrame:
        return df.select("fingerprint").distinct().select(half(0).alias(f"{name}0"), half(16).alias(f"{name}1"), F.array(*[long(a, b) for a, b, _ in parts]).alias("v"))

    masks = [m | i << _TAG for i, (a, b, most) in enumerate(parts) for m in _masks(4 * (b - a), most)]
    asked = blocked(queries, "q").select("q0", "q1", "v", F.explode(F.expr(f"array({', '.join(f'{m}L' for m in masks)})")).alias("m"))
    asked = asked.select("q0", "q1", F.get("v", F.shiftright("m", _TAG).cast("int")).bitwiseXOR(F.col("m")).alias("asked"))
    keyed = blocked(table, "f").select("f0", "f1", F.posexplode("v").alias("i", "x"))
    keyed = keyed.select("f0", "f1", F.shiftleft(F.col("i").cast("long"), _TAG).bitwiseOR(F.col("x")).alias("key"))

    differ = [F.col(f"q{i}").bitwiseXOR(F.col(f"f{i}")) for i in (0, 1)]
    count = lambda masks: sum((F.bit_count(d.bitwiseAND(F.lit(m).cast("long"))) for d, m in zip(differ, masks) if m), F.lit(0))
    first = None
    for i, (a, b, most) in enumerate(parts):
        fits = count(_halves(a, b)) <= most
        first = F.when(fits, i) if first is None else first.when(fits, i)
    distance = count((-1, -1))
    # a merge join: the keys of either side grow with the table, so none of them is to be broadcast
    met = asked.hint("merge").join(keyed, (F.col("asked") == F.col("key")) & (distance <= radius) & (first == F.shiftright("key", _TAG)))
    text = lambda n: F.concat(*[F.lpad(F.lower(F.hex(f"{n}{i}")), 16, "0") for i in (0, 1)])
    return met.select(text("q").alias("query"), text("f").alias("found"), distance.alias("distance"))


def with_next(df: DataFrame, key: str, text: str, carried: str, ids: DataFrame | None = None) -> DataFrame:
    """(key, text, carried, edited, next_carried): each row with the next one in the order of ``key``, the first after the last.

    Rows go to ranges of ids; a range's first row is sent to the range before as well.  ``edited`` is the text with its
    last quarter of characters replaced by as many of the next one's first.  ids: the same keys where reading them costs less.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    shares = F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5))
    low, cut = (df if ids is None else ids).select(order.alias("o")).agg(F.min("o"), F.percentile_approx("o", shares, F.lit(100 * n))).first()
    bounds = np.array(sorted({low, *cut}) if low is not None else [0], np.int64)  # ids that occur; at most one a partition
    schema = T.StructType([df.schema[key], T.StructField(text, T.StringType()), T.StructField(carried, T.StringType()), T.StructField("o", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("own", T.BooleanType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            o = batch.column(3).to_numpy()
            bucket = np.searchsorted(bounds, o, side="right") - 1
            first = np.flatnonzero(bounds[bucket] == o)
            rows = np.concatenate([np.arange(len(o)), first])
            to = np.concatenate([bucket, (bucket[first] - 1) % len(bounds)]).astype(np.int32)
            own = np.arange(len(rows)) < len(o)
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(to), pa.array(own)], [*batch.schema.names, "bucket", "own"])

    dealt = df.select(key, F.coalesce(F.col(text), F.lit("")).alias(text), carried, order.alias("o")).mapInArrow(deal, schema)
    # a range's own rows come first, then the first row of the next range
    ordered = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", F.col("own").desc(), "o", carried, text)
    out = T.StructType([*schema.fields[:3], T.StructField("edited", T.StringType()), T.StructField("next_carried", T.StringType())])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in slices(batches, text, 4 << 20):
            found = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if last is not None and last[5] and last[4] == row[4]:
                    n_new = len(last[1]) // 4
                    found.append((*last[:3], last[1][: len(last[1]) - n_new] + row[1][:n_new], row[2]))
                last = row
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found) if found else [[]] * 5, made)], schema=made)

    from pyspark.sql.pandas.types import to_arrow_schema

    made = to_arrow_schema(out)
    return ordered.mapInArrow(pair, out)


def near_counts(queries: DataFrame, table: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fingerprint, n_near, n_near_rows): for each distinct one of ``queries``, the other fingerprints of ``table`` within the radius, and the rows that have them or itself."""
    rows = table.groupBy("fingerprint").agg(F.count("*").alias("rows"))
    found = search(queries, table, radius).join(rows.withColumnRenamed("fingerprint", "found"), "found")
    return found.groupBy(F.col("query").alias("fingerprint")).agg(F.sum((F.col("query") != F.col("found")).cast("long")).alias("n_near"), F.sum("rows").alias("n_near_rows"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: fingerprints of every document and of its edited text; for ids divisible by 50 (else null) n_near, the other distinct fingerprints within the radius, and n_near_docs, the other documents there, copies included."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    paired = with_next(fingerprints(docs), "doc_id", "text", "fingerprint", docs.select("doc_id"))
    edited = fingerprints(paired.select("doc_id", "fingerprint", "next_carried", F.length("text").cast("long").alias("n_chars"), "edited"), "edited", "edited_fingerprint")
    asked = F.col("doc_id") % 50 == 0
    with scratch(spark, "simhash") as folder:
        digests = written(edited.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "next_carried"), "digests", folder)
        # a table of its own, so Spark can split the rows of a frequent fingerprint when they join
        near = written(near_counts(digests.where(asked), digests), "near", folder)
        return written(digests.join(near.hint("merge"), "fingerprint", "left").select(
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
            likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_carried").alias("near_next"),
            F.when(asked, F.col("n_near")).alias("n_near"), F.when(asked, F.col("n_near_rows") - 1).alias("n_near_docs"),
        ), "fingerprints")
