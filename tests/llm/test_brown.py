import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from contentwatch.llm import brown

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def base(docs, trained):
    c = Counter()
    for d, t in docs:
        if trained(d):
            c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    for d, t in docs:
        w = [*words(t), None]
        yield d, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)


def test_query_equals_base_and_beats_it(spark, small_tables):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_tables}/documents.parquet").collect()]
    rows = {r.doc_id: r for r in brown.query(spark, small_tables).collect()}
    out = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    for d, n, known, total, score in base(docs, lambda d: not out(d)):
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(d), n, known, total)
        assert math.isclose(r.base_score, score, rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def texts(spark, rows):
    return spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(rows)], "doc_id long, text string, score double")


def brute_scores(trained, docs, words_table, model):
    """Scores from the definition, given the words' classes: counts between classes, smoothing and sums."""
    reader = brown.Reader()
    rows = {r.word: r for r in words_table.collect()}

    def classes(text):
        hashes, endings, _ = reader([(text or "").encode()])
        found = [rows.get(h) for h in hashes.view(np.int64).tolist()]
        return [(r["class"], r.n) if r else (int(model.ending_class[e]), 0) for r, e in zip(found, endings.tolist())]

    k = model.n_classes
    between, size, members = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    for t in trained:
        line = [0, *[c for c, _ in classes(t)], 0]
        for x, y in zip(line, line[1:]):
            between[x, y] += 1
    for r in rows.values():
        size[r["class"]] += r.n
        members[r["class"]] += 1
    size[0] = len(trained)
    own = (size + 1) / (size + 1).sum()
    nxt = (between + 4 * own) / (between.sum(axis=1, keepdims=True) + 4)
    for t in docs:
        told, last, total = classes(t), 0, 0.0
        for c, n in told:
            total += math.log10(nxt[last, c]) + math.log10((n + 0.1) / (size[c] + 0.1 * (members[c] + 1)))
            last = c
        yield total + math.log10(nxt[last, 0])


@pytest.mark.parametrize("frequent,common", [(2, 3), (50, 50), (1, 1), (2, 0)])
def test_scores_equal_the_definition_and_sum_to_one(spark, frequent, common):
    rows = ["a bb cbb. dd", "A bb", None, "dd dd e", "bb a bb a", "q w e r t y u i o p a s d f", "q w x x x y"]
    df = texts(spark, rows)
    model, table = brown.train(df, frequent, common, rounds=2)
    assert np.allclose((10**model.log_next).sum(axis=1), 1)
    asked = [*rows, "unseen words here", "a unseen bb", "dd", ""]
    got = [r.score for r in brown.score(texts(spark, asked), model, table).orderBy("doc_id").collect()]
    assert np.allclose(got, list(brute_scores(rows, asked, table, model)))
    # the words of one class and one unseen word share its mass
    words_of = {r.word: r for r in table.collect()}
    for c in {r["class"] for r in words_of.values()}:
        own = [r.n for r in words_of.values() if r["class"] == c]
        assert math.isclose(sum(10 ** (math.log10(n + 0.1) - model.log_class[c]) for n in own) + 0.1 * 10 ** -model.log_class[c], 1)


def test_odd_rows(spark):
    df = texts(spark, ["a b", "a b", None, "", "zz " * 3000])
    for trained in (df, df.limit(0), df.where("text IS NULL")):
        model, table = brown.train(trained, rounds=1)
        got = sorted((r.doc_id, r.n_tokens) for r in brown.score(df, model, table).collect())
        assert got == [(0, 3), (1, 3), (2, 1), (3, 1), (4, 3001)]
        assert brown.score(df.limit(0), model, table).count() == 0


def test_classes_separate_two_vocabularies(spark):
    rng = np.random.default_rng(1)
    left, right = [f"l{i}x" for i in range(40)], [f"r{i}y" for i in range(40)]
    df = texts(spark, [" ".join(rng.choice(side, 60)) for side in (left, right) for _ in range(150)])
    model, table = brown.train(df, 100, 100)
    reader = brown.Reader()
    of_word = {r.word: r["class"] for r in table.collect()}
    of = [{of_word[h] for h in reader([w.encode() for w in side])[0].view(np.int64).tolist()} for side in (left, right)]
    assert not of[0] & of[1]


def test_rare_words_join_the_class_of_their_neighbours(spark):
    """Words beyond the frequent ones get classes by their own neighbours, not by their endings."""
    rng = np.random.default_rng(2)
    sides = [[f"{s}{i}x" for i in range(30)] for s in "lr"]
    rare = [[f"rare{s}{i}same" for i in range(20)] for s in "lr"]
    rows = []
    for side, own in zip(sides, rare):
        for _ in range(200):
            line = list(rng.choice(side, 40))
            line[20] = str(rng.choice(own))
            rows.append(" ".join(line))
    model, table = brown.train(texts(spark, rows), 60, 60)
    reader = brown.Reader()
    of_word = {r.word: r["class"] for r in table.collect()}
    of = [{of_word[h] for h in reader([w.encode() for w in side])[0].view(np.int64).tolist()} for side in rare]
    assert not of[0] & of[1]


def test_units_whatever_the_counts(spark):
    """Words of one count, more than are sent along: the first of them are units all the same."""
    texts = spark.createDataFrame([(" ".join(f"w{i}" for i in range(300)),)], "text string")
    model, words = brown.train(texts, frequent=50, common=100, rounds=1)
    assert words.count() == 300 and len(set(r["class"] for r in words.collect())) > 1
