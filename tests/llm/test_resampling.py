import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from contentwatch.llm import resampling as rs


def brute_words(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute_features(text):
    w = brute_words(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target, percent=5):
    bucket = lambda x: zlib.crc32(x.encode()) % 10000
    s, t = (Counter(bucket(f) for x in texts for f in brute_features(x)) for texts in ([x for _, x in docs], target))
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10000) / ((s[b] + 1) * (total_t + 10000))))
    rows = []
    for d, text in docs:
        own = brute_features(text)
        weight = sum(gain(bucket(f)) for f in own)
        h = int(hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(brute_words(text))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1], r[2]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return [tuple(r[:5]) for r in rows]


def plain(rows):
    return sorted(rows, key=str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB9 .é漢\n\x00"), max_size=30), max_size=6), st.sampled_from([4, 16, 1 << 20]))
def test_features_of_a_batch(texts, block):
    before, rs.BLOCK = rs.BLOCK, block
    try:
        got = [Counter() for _ in texts]
        for doc, found, _ in rs.features([t.encode() for t in texts], rs.Crc()):
            for d, f in zip(doc.tolist(), found.tolist()):
                got[d][f] += 1
        assert got == [Counter(zlib.crc32(f.encode()) for f in brute_features(t)) for t in texts]
    finally:
        rs.BLOCK = before


def test_crc_of_long_words():
    words = [b"a" * n for n in (1, 63, 64, 65, 127, 1000)]
    before = np.array([zlib.crc32(b"x")] * len(words), np.uint32)
    got = rs.Crc().then(before, np.array([zlib.crc32(w) for w in words], np.uint32), np.array([len(w) for w in words], np.int64))
    assert got.tolist() == [zlib.crc32(b"x " + w) for w in words]


def test_odd_rows_against_brute_force(spark):
    prose = "the quick brown fox jumps over one lazy dog while Ünïcode w0rds go by and more of them come along here again"
    docs = [(None, prose), (None, prose), (3, prose), (3, prose), (4, None), (5, ""), (6, " .,;"), (7, "x" * 100_000), (8, prose * 3000), *[(i, f"{prose} number {i % 7}") for i in range(20, 140)]]
    target = ["the quick brown fox", None, "", "lazy dogs " * 30]
    df = spark.createDataFrame([(d, t, "a", 1) for d, t in docs], "doc_id long, text string, rank string, place int")
    got = rs.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=60)
    assert got.columns == ["doc_id", "rank", "place", "n_words", "n_features", "weight", "score", "rank_"]
    assert plain((r.doc_id, r.n_features, r.weight, r.score, r["rank_"]) for r in got.collect()) == plain(brute(docs, target, 60))


def test_empty_tables(spark):
    empty, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b " * 20)], "doc_id long, text string")
    assert rs.resample(empty, some).count() == 0
    assert [(r.n_features, r["rank"]) for r in rs.resample(some, empty, percent=100).collect()] == [(117, 1)]


def test_query(spark, small_tables):
    docs = [tuple(r) for r in spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{small_tables}/benchmark.parquet").collect()]
    got = rs.query(spark, small_tables)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert plain(map(tuple, got.collect())) == plain(brute(docs, target))
