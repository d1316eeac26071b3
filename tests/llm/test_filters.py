"""Filters that spare rows a shuffle, and what the pipeline's stages leave on disk."""

from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from contentwatch.llm import common, minhash


@pytest.mark.parametrize("most", [1 << 28, 1 << 15])  # the second: a filter that is too full to tell much
def test_parted_lets_every_key_through(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MOST_BITS", most)
    df = spark.range(20_000).withColumn("filter_bits", F.lit("own"))
    keys = spark.range(0, 30_000, 7).select(F.xxhash64("id"))
    some, others = common.parted(df, F.xxhash64("id"), keys)
    assert some.columns == others.columns == df.columns
    may, none = ([r.id for r in x.collect()] for x in (some, others))
    assert sorted(may + none) == list(range(20_000))
    assert set(range(0, 20_000, 7)) <= set(may)
    assert most < 1 << 20 or len(may) < 5_000
    hashes = np.array([r[0] for r in df.select(F.xxhash64("id")).collect()])
    ids = [r.id for r in df.collect()]
    passed = common.passes(common.filter_array(keys), hashes)
    assert {i for i, p in zip(ids, passed) if p} == set(may)


def test_parted_without_keys_or_rows(spark):
    some, others = common.parted(spark.range(9), F.xxhash64("id"), spark.range(0).select(F.xxhash64("id")))
    assert some.count() == 0 and others.count() == 9
    some, others = common.parted(spark.range(0), F.xxhash64("id"), spark.range(9).select(F.xxhash64("id")))
    assert some.count() == others.count() == 0


def test_table_keys_are_all_that_several_classes_have(spark):
    rng = np.random.default_rng(5)
    sides = [(i, rng.integers(0, 40, 4).tolist(), rng.integers(0, 40, 4).tolist()) for i in range(60)]
    sides += [(i, [1000 * i + k for k in range(4)], [1000 * i + k for k in range(4, 8)]) for i in range(60, 90)]
    classes = spark.createDataFrame([(i, 9, 1, a, b) for i, a, b in sides], "num long, n int, copies long, left array<long>, right array<long>")
    with common.scratch(spark, "test") as folder:
        got = [(r.num, r.table, r.key) for r in minhash.table_keys(classes, folder, 4).collect()]
    every = classes.select("num", F.posexplode(F.flatten(F.transform("left", lambda x, i: F.transform("right", lambda y, j: F.xxhash64(i, j, x, y))))).alias("table", "key")).collect()
    assert set(got) <= {tuple(r) for r in every} and len(got) == len(set(got))
    holders = {}
    for r in every:
        holders.setdefault(r.key, set()).add((r.num, r.table))
    assert {(n, t, k) for k, own in holders.items() if len(own) > 1 for n, t in own} <= set(got)
    assert all(n < 60 for n, _, _ in got)  # groups of one class alone make no keys


def test_stages_leave_no_copy_of_the_texts(spark, small_tables):
    """A stage's result is read from the given table; only what is small beside the texts stays for it."""
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    texts = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    for name, stage in corpus_pipeline.STAGES[:-1]:  # the last one's table is the result
        known = set(folder.iterdir())
        got = stage(spark, docs, small_tables)
        assert got.count() > 0
        left = sum(f.stat().st_size for top in set(folder.iterdir()) - known for f in top.rglob("*.parquet"))
        assert left < texts / 10, (name, left, texts)
