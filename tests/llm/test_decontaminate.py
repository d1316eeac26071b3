import hashlib
import random
import re

import pytest

from contentwatch.llm import decontaminate as de

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(10, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(item)
    found = []
    for doc, text in docs:
        w, hit, got = words(text), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if (key := tuple(w[i : i + m])) in windows:
                    hit |= set(range(i, i + m))
                    got |= windows[key]
        found.append((doc, len(w), len(hit), sorted(str(x) for x in got if x is not None)))
    return found


def result(df):
    return [(r.doc_id, r.n_words, sum(s.stop - s.start for s in r.hit_spans), r.hit_items) for r in df.orderBy("doc_id").collect()]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_equals_brute_force(spark, block_bytes):
    rng = random.Random(3)
    few = ["a", "b", "C", "ü"]
    items = [(i, " ".join(rng.choices(few, k=rng.choice([0, 1, 3, 7, 9, 10, 12, 30])))) for i in range(25)] + [(30, None), (None, "null item id has words " * 3), (3, "repeated id here"), (31, "...")]
    docs = [(i, ", ".join(rng.choices(few, k=rng.randrange(60)))) for i in range(120)] + [(200, None), (201, ""), (202, "x " * 5000 + items[5][1]), (203, "null item ID has words null item id has words")]
    df = spark.createDataFrame([(a, b, "z") for a, b in docs], "doc_id long, text string, item_id string")
    got = result(de.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes))
    assert got == sorted(brute(docs, items))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert result(de.decontaminate(docs, items.limit(0))) == [(1, 2, 0, [])]
    assert de.decontaminate(docs.limit(0), items).count() == 0
    assert result(de.decontaminate(docs, items, block_bytes=0)) == [(1, 2, 1, ["1"])]


@pytest.mark.parametrize("block_bytes", [1 << 20, 0])
def test_columns_of_the_same_names(spark, block_bytes):
    docs, items = spark.createDataFrame([(1, "a b", 7, 8, 9)], "doc_id long, text string, n_words int, hit_items int, row_number int"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    got = de.decontaminate(docs, items, block_bytes=block_bytes)
    assert got.columns == [*docs.columns, "n_words_", "hit_spans", "hit_items_"]
    r = got.first()
    assert (r.n_words, r.hit_items, r.row_number, r.n_words_, r.hit_items_) == (7, 8, 9, 2, ["1"])


def test_query(spark, small_tables):
    read = lambda t: [tuple(r)[:2] for r in spark.read.parquet(f"{small_tables}/{t}.parquet").collect()]
    want = brute(read("documents"), read("benchmark"))
    got = {r.doc_id: r for r in de.query(spark, small_tables).collect()}
    assert any(n for _, _, n, _ in want)
    for doc, n, hit, items in want:
        r = got[doc]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(items), hit > 0)
        assert r.items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest()
