"""What the corpus operators share: the shared folder, written tables and Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentwatch.operators.tables import moved, read_back, remove, scratch, shared_dir, table_path  # noqa: F401

#: Words of the contracts: runs of anything but space and the ASCII controls tab to carriage return.
SPACES = bytes([0x20, *range(0x09, 0x0E)])


#: Bytes a task holds of a table that it writes; texts are long, and tasks share memory.
BLOCK = 32 << 20

#: Bytes that go to a Python worker at once; texts are long, and tasks share memory.
BATCH = 8 << 20

#: Bits of a filter: at least so many a key, but no more than the second in all (32 MB); a fuller filter lets more through.
KEY_BITS, MOST_BITS = 16, 1 << 28


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings ``values`` while it lasts, then those of before."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` as a table in ``folder``, reread: cuts the lineage and survives lost executors.  Without a folder it is the result of the innermost ``scratch`` block and outlives that.

    Its shuffle files are deleted with the end of the write, as nothing reads them after it.
    """
    spark = df.sparkSession
    path = table_path(spark, name, folder)
    with settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": f"{BATCH}b", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        df.write.option("parquet.block.size", BLOCK).parquet(path)
    return read_back(spark, path, df.schema)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``written``, but a table that was just written is moved and not written again."""
    found = moved(df, name)
    return written(df, name) if found is None else found


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many bars after it as no column of ``df`` (whose names ignore case) has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """As many partitions as the session shuffles to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def binaries(column: pa.Array) -> list[bytes]:
    """The values of a string or binary column as UTF-8; null gives empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``most`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(text))), 0).to_pylist()
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # workers live on from task to task


def arrow_lists(rows: list, kind: pa.DataType) -> pa.ListArray:
    """A list column of numpy arrays."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(x) for x in rows], out=offsets[1:])
    values = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def filter_bits(hashes: DataFrame) -> tuple[int, DataFrame]:
    """(size, table of bucket, bits): a filter of the longs in the one column of ``hashes``, of which bit ``pmod(hash, size)`` is set."""
    size = min(MOST_BITS, 1 << max(15, (KEY_BITS * hashes.count()).bit_length()))
    place = F.pmod(F.col(hashes.columns[0]), F.lit(size)) + 1  # Spark counts from one
    return size, hashes.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))


def filter_array(hashes: DataFrame) -> np.ndarray:
    """The filter of ``filter_bits`` as bytes (a power of two, 32 MB at most), for Arrow tasks."""
    size, bits = filter_bits(hashes)
    found = np.zeros((size >> 15, 1 << 12), np.uint8)
    for r in bits.collect():
        found[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    return found.ravel()


def passes(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes (int64) a filter's bytes let through."""
    place = hashes & np.int64(8 * len(found) - 1)
    return (found[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def parted(df: DataFrame, hashed: Column, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` that may have one of the ``hashes`` (longs in one column), all that have one among them, and those that have none: these need no join.

    A filter of 32 MB at most is sent to the tasks, so rows meet it where they are.  It outlives the innermost ``scratch`` block.
    """
    size, bits = filter_bits(hashes)
    bucket, held = free_name(df, "filter_bucket"), free_name(df, "filter_bits")
    place = F.pmod(hashed, F.lit(size)) + 1
    at = F.bitmap_bit_position(place).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(held), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    met = df.join(F.broadcast(written(bits.toDF(bucket, held), "filter")), F.bitmap_bucket_number(place) == F.col(bucket), "left")
    may = F.coalesce(F.getbit(byte, at % 8), F.lit(0)) == 1
    return tuple(met.where(x).drop(bucket, held) for x in (may, ~may))
