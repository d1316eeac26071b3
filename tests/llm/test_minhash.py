import random
import re

import pytest

from contentwatch.llm import minhash as mh
from contentwatch.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(docs, percent=85):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    return sorted(((d, len(sets[i]), d if not sets[i] else least.get(find(i))) for i, (d, _) in enumerate(docs)), key=key)


def result(df):
    rows = [(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()]
    assert all(r.kept == (r.doc_id == r.component_id) for r in df.collect())
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def near_texts(rng, groups, size, edits):
    docs = []
    for _ in range(groups):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 200, 400]))]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(edits)):
                own[rng.randrange(len(own))] = f"W{rng.randrange(10**6)}"
            docs.append(" ".join(own))
    return docs


def test_equals_brute_force(spark):
    rng = random.Random(5)
    texts = near_texts(rng, 6, 25, 7) + ["a b", "A B", "a b c d e f", None, "", "  ", "x " * 4000, "x " * 90]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[1]), (None, "alone with null id"), (500, texts[2])]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, num int")
    assert result(mh.near_duplicates(df)) == brute(docs)


def test_empty_table(spark):
    assert mh.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chance_of_a_table():
    for similarity, least in ((0.85, 0.9992), (0.9, 0.9999)):
        assert (1 - (1 - similarity**mh.ROWS) ** mh.GROUPS) ** 2 > least


@pytest.mark.parametrize("n", [2, 33])
def test_components_of_a_chain_and_a_hub(spark, n):
    links = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, n)] + [(5000, 5000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(n)}


def test_query(spark, small_tables):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_tables}/documents.parquet").collect()]
    assert result(mh.query(spark, small_tables)) == brute(docs)


def test_stage_keeps_one_row_of_each_component(spark):
    words = [f"w{i}" for i in range(200)]
    near = words[:90] + ["x"] + words[91:150] + ["y"] + words[151:170] + ["z"] + words[171:190] + ["v"] + words[191:]  # 20 of 196 shingles differ: 0.815
    a, b = " ".join(words), " ".join(near)
    # ids shared by a near copy and a clean text, clean rows and copies without an id
    docs = [(1, a), (2, b), (2, "a clean text under an id that is used twice"), (None, "clean without id"), (None, "clean without id"), (None, a), (None, "another without id")]
    got = mh.stage(spark, spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, row_key string"), "")
    want = [(None, "another without id"), (None, "clean without id"), (1, a), (2, docs[2][1])]
    assert got.columns == ["doc_id", "text", "row_key"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=lambda r: (r[0] or 0, r[1])) == want


def test_texts_of_a_hundred_thousand_words(spark):
    rng = random.Random(8)
    long = [f"w{rng.randrange(10**6)}" for _ in range(100_000)]
    other = [w if i % 200 else "x" for i, w in enumerate(long)]
    docs = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(reversed(long)))]
    assert result(mh.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
