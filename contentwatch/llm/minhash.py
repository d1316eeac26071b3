"""Operator 1: MinHash near-duplicate components with tensored banding.

A document's set holds the hashes of its distinct five-word shingles.  Two collections of m groups of k
minimum hashes each are computed, and table (i, j) is keyed by group i of the first and group j of the second:
m * m tables of 2k hashes from 2 * m * k minima, about the square root of what separate tables need
(Andoni & Indyk 2006; Christiani 2019).  With k = 3 and m = 9, a pair at similarity 0.85 shares a table with probability
0.9996, one at 0.9 with 0.99998.

Equal sets (by a 128-bit digest) become one class first, so copies never meet.  In each bucket all classes are compared to its
least one and to that with most copies; what that links is one component, and only members of different
components are then compared with each other, if enough of their shingles are not theirs alone: a shingle that no
other compared class has can't be shared, so it counts against both bounds of a pair.  Every link is confirmed on the
full sets.

Cases: a text with fewer than five words has its whole sequence as one shingle; a null or empty text, or one
without words, has an empty set and is linked with nothing; a very long text is read whole, its minima taken a block of
shingles at a time; repeated rows each come back; a null id never names a component; an empty table gives no rows;
further columns, whatever their names, are kept out of the result of ``near_duplicates`` and kept by ``stage``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentwatch.llm.common import SPACES, arrow_lists, binaries, free_name, parted, scratch, slices, written
from contentwatch.llm.components import components
from contentwatch.llm.words import Words, grams, mix

SHINGLE, PERCENT = 5, 85
GROUPS, ROWS = 9, 3
STAGE_PERCENT, STAGE_GROUPS = 80, 10  # of the pipeline: a pair at 0.8 shares a table with probability 0.9985
SEED = np.uint64(0x9E3779B97F4A7C15)
NO_ID = -(1 << 63)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The sorted set of shingle hashes."""
    if not len(words):
        return words
    found = np.sort(grams(words, min(size, len(words))))
    return found[np.append(True, found[1:] != found[:-1])]


def class_of(found: np.ndarray) -> bytes:
    """A 128-bit digest of the whole set; equal sets have equal ones, other sets but for chance other ones."""
    both = np.stack([found.sum(), mix(found ^ SEED).sum() + np.uint64(len(found))])
    return mix(both).tobytes()


def _multipliers(count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * SEED) | np.uint64(1)


def _salts(count: int) -> np.ndarray:
    return mix(np.arange(1 << 20, (1 << 20) + count, dtype=np.uint64) * SEED)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, groups: int = GROUPS, rows: int = ROWS, kind: str = "long") -> DataFrame:
    """(doc_id of type ``kind``, n_shingles, class, left, right): the set's size and digest and the groups of both collections; class is null and the groups are empty for an empty set."""
    count = 2 * groups * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, times, salts = Words(SPACES), _multipliers(count)[:, None], _salts(count)[:, None]
        none = np.zeros(0, np.uint64)
        for batch in slices(batches, "text"):
            hashes, offsets = words(binaries(batch.column(1)))
            sizes, classes, left, right = [], [], [], []
            for a, b in zip(offsets[:-1], offsets[1:]):
                own = shingles(hashes[a:b], size)
                sizes.append(len(own))
                if not len(own):
                    classes.append(None)
                    left.append(none)
                    right.append(none)
                    continue
                classes.append(class_of(own))
                minima = np.full((count, 1), ~np.uint64(0))
                for i in range(0, len(own), 1 << 14):
                    minima = np.minimum(minima, ((own[None, i : i + (1 << 14)] ^ salts) * times).min(axis=1, keepdims=True))
                grouped = np.zeros(2 * groups, np.uint64)
                for column in minima.reshape(2 * groups, rows).T:
                    grouped = mix(grouped + column)
                left.append(grouped[:groups])
                right.append(grouped[groups:])
            lists = [arrow_lists([x.view(np.int64) for x in side], pa.int64()) for side in (left, right)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), *lists], ["doc_id", "n_shingles", "class", "left", "right"])

    return docs.select(F.col(doc_id).cast(kind).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_shingles long, class binary, left array<long>, right array<long>")


def full_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(class, shingles): the sets of (text) rows as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(SPACES)
        for batch in slices(batches, "text"):
            hashes, offsets = words(binaries(batch.column(0)))
            found = [x for a, b in zip(offsets[:-1], offsets[1:]) if len(x := shingles(hashes[a:b], size))]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["class", "shingles"])

    return docs.select("text").mapInArrow(run, "class binary, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (x, y) pairs of class numbers with 100 * |intersection| >= percent * |union|."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (a, b) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                both = np.sort(np.concatenate([np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)]))
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(["x", "y"])

    x = sets.select(F.col("num").alias("x"), F.col("shingles").alias("a"))
    y = sets.select(F.col("num").alias("y"), F.col("shingles").alias("b"))
    return pairs.join(x, "x").join(y, "y").select("x", "y", "a", "b").mapInArrow(run, "x long, y long")


def shared_sizes(sets: DataFrame) -> DataFrame:
    """(num, alone): how many of each class's shingles no other class of ``sets`` has; classes without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "shingles", 4 << 20):
            found = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), [len(x) for x in found])), pa.array(np.concatenate(found))], ["num", "shingle"])

    single = sets.select("num", "shingles").mapInArrow(run, "num long, shingle long").groupBy("shingle").agg(F.min("num").alias("num"), F.count("*").alias("n")).where("n = 1")
    return single.groupBy("num").agg(F.count("*").alias("alone"))


def row_of(doc_id: str, kind: str) -> Column:
    """The id by which a class's text is found again."""
    return F.coalesce(F.col(doc_id).cast(kind), F.lit(NO_ID if kind == "long" else b""))


def numbered(found: DataFrame, folder: str, kind: str = "long") -> DataFrame:
    """(class, num, row, n, left, right, copies, least): the distinct sets of ``found``, numbered; row: one of their rows' ids, least: the least id that isn't null."""
    classes = found.where("class IS NOT NULL").groupBy("class").agg(F.min(row_of("doc_id", kind)).alias("row"), F.min("doc_id").alias("least"), F.first("n_shingles").cast("int").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"), F.count("*").alias("copies"))
    return written(classes.withColumn("num", F.monotonically_increasing_id()), "classes", folder)  # numbers hold once written


def table_keys(classes: DataFrame, folder: str, groups: int) -> DataFrame:
    """(num, n, copies, table, key): the keys of each class in all tables where another class may have the same.

    Classes that share a key share both its groups, so a class's 2 * groups groups are counted first, and only those
    that several classes have make keys.
    """
    own = classes.select("num", "n", "copies", F.posexplode(F.concat("left", "right")).alias("place", "value"))
    several = own.groupBy("place", "value").agg(F.count("*").alias("many")).where("many > 1").select("place", "value")
    # a table of its own, so Spark can split a frequent group's rows when they join
    met = own.join(written(several, "groups", folder), ["place", "value"])
    shared = written(met.groupBy("num", "n", "copies").agg(F.collect_list(F.struct("place", "value")).alias("all")), "shared", folder)
    left = shared.select("num", "n", "copies", "all", F.explode(F.filter("all", lambda g: g["place"] < groups)).alias("x"))
    both = left.select("num", "n", "copies", "x", F.explode(F.filter("all", lambda g: g["place"] >= groups)).alias("y"))
    i, j = F.col("x.place"), F.col("y.place") - groups
    return both.select("num", "n", "copies", (i * groups + j).alias("table"), F.xxhash64(i, j, "x.value", "y.value").alias("key"))


def links(docs: DataFrame, classes: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, groups: int = GROUPS, kind: str = "long") -> DataFrame:
    """Confirmed (x, y) links between numbers of classes: enough of them to connect what all links connect.  classes: from ``numbered``."""
    keys = table_keys(classes, folder, groups)
    ends = keys.groupBy("key").agg(F.min(F.struct("num", "n")).alias("low"), F.max(F.struct("copies", "num", "n")).alias("high"), F.count("*").alias("many")).where("many > 1")
    # the aggregate is a table of its own, so Spark can split a large key's rows when they join
    members = written(keys.join(written(ends, "ends", folder), "key").select("key", "table", "num", "n", "low", "high"), "members", folder)
    near = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * percent
    ordered = lambda df: df.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()

    wanted = written(classes.select("num", "row").join(members.select("num").distinct(), "num"), "wanted", folder)
    given = docs.select(row_of(doc_id, kind).alias("row"), F.col(text).alias("text"))
    with scratch(docs.sparkSession, "candidates"):
        given, _ = parted(given, F.xxhash64("row"), wanted.select(F.xxhash64("row")))  # so few other texts are shuffled
    texts = given.join(wanted.select("row").distinct(), "row", "left_semi")
    named = classes.select("class", "num").join(wanted.select("num"), "num")
    sets = written(full_sets(texts, size).join(named, "class").groupBy("num").agg(F.first("shingles").alias("shingles")), "sets", folder)

    stars = [members.where(F.col("num") != F.col(end)["num"]).where(near(F.col("n"), F.col(end)["n"])).select(F.col("num").alias("x"), F.col(end)["num"].alias("y")) for end in ("low", "high")]
    first = written(confirmed(ordered(stars[0].union(stars[1])), sets, percent), "links", folder)

    known = components(first)
    labelled = members.select("key", "table", "num", "n").join(known.withColumnRenamed("node", "num"), "num", "left").withColumn("component", F.coalesce("component", "num"))
    labelled = written(labelled, "labelled", folder)
    counted = labelled.groupBy("key", "component").agg(F.count("*").alias("many"))
    mixed = counted.groupBy("key").agg(F.max_by("component", F.struct("many", "component")).alias("main"), F.count("*").alias("kinds")).where("kinds > 1").select("key", "main")
    rest = labelled.join(written(mixed, "mixed", folder), "key").withColumn("most", F.col("n"))
    for _ in range(2):
        # whoever has no partner that could share enough of what isn't its own alone is out, and no partner to others
        alone = shared_sizes(sets.join(rest.select("num").distinct(), "num", "left_semi"))
        bounded = rest.drop("most").join(alone, "num", "left").withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
        rest = written(bounded.where(F.col("most") * 100 >= F.col("n") * percent), "rest", folder)
    able = rest.join(classes.select("num", "left", "right"), "num")
    own = lambda df, c: df.select("key", "table", *[F.col(a).alias(f"{b}_{c}") for a, b in (("num", "num"), ("n", "n"), ("most", "most"), ("component", "of"), ("left", "left"), ("right", "right"))])
    # every pair of different components has at least one member outside the bucket's largest component
    pairs = own(able.where("component != main"), "x").join(own(able, "y").drop("table"), "key")
    enough = F.least("most_x", "most_y") * (100 + percent) >= (F.col("n_x") + F.col("n_y")) * percent
    # a pair meets in each table whose two groups are equal; it is taken from the first
    place = lambda side: F.array_position(F.zip_with(f"{side}_x", f"{side}_y", lambda a, b: a == b), F.lit(True)) - 1
    once = (place("left") == F.floor(F.col("table") / F.size("right_x"))) & (place("right") == F.col("table") % F.size("right_x"))
    pairs = pairs.where("of_x != of_y").where(near(F.col("n_x"), F.col("n_y")) & enough & once).select(F.col("num_x").alias("x"), F.col("num_y").alias("y"))
    return first.union(written(confirmed(ordered(pairs), sets, percent), "links", folder))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, groups: int = GROUPS, kind: str = "long") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``; ids are of type ``kind``, long or binary."""
    with scratch(docs.sparkSession, "minhash") as folder:
        found = written(signatures(docs, doc_id, text, size, groups, kind=kind), "signatures", folder)
        classes = numbered(found, folder, kind)
        joined = components(links(docs, classes, folder, doc_id, text, size, percent, groups, kind)).withColumnRenamed("node", "num")
        named = classes.select("class", "num", "least").join(joined, "num", "left").withColumn("component", F.coalesce("component", "num"))
        names = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("class", "component_id")
        out = found.select("doc_id", "n_shingles", "class").join(written(names, "names", folder), "class", "left")
        out = out.withColumn("component_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        return written(out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), "near-duplicates")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: near-duplicate components of all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, percent: int = STAGE_PERCENT, groups: int = STAGE_GROUPS) -> DataFrame:
    """One row of each component at a similarity of 0.8 stays: that of the least id, null ids last; of equal ids that of the least key.

    Rows are told apart by a 128-bit digest of id and text, not by id; of rows equal in both one stays.  The key of a row starts
    with its id, so the least key of a component is the row that stays.  Only rows that may go are shuffled with their texts.
    """
    row = F.concat_ws(",", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit("")))
    digest = F.md5(F.concat(F.when(F.col("text").isNull(), "0").otherwise("1"), row).cast("binary"))
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(NO_ID))), 16, "0")  # sorts as the number does
    key = F.unhex(F.concat(F.coalesce(F.concat(F.lit("00"), number), F.lit("01")), digest))
    name = free_name(docs, "row_key")
    chosen = docs.withColumn(name, key)
    stays = free_name(chosen, "stays")
    with scratch(spark, "near-duplicates"):
        named = near_duplicates(docs.select(key.alias("row_key"), "text"), "row_key", "text", SHINGLE, percent, groups, "binary")
        rows = named.groupBy(F.col("doc_id").alias(name)).agg(F.max("kept").alias(stays), F.count("*").alias("many"))
        told = written(rows.where(~F.col(stays) | (F.col("many") > 1)).select(name, stays), "told")
        some, others = parted(chosen, F.xxhash64(name), told.select(F.xxhash64(name)))
    judged = some.join(told, name, "left").where(F.coalesce(stays, F.lit(True))).dropDuplicates([name])
    columns = [f"`{c}`" for c in docs.columns]
    return judged.select(*columns).union(others.select(*columns))
