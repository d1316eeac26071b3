import math
import zlib

import numpy as np

from contentwatch.llm import langid as li


def segmentations(word, pieces):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            yield from ([word[:k], *rest] for rest in segmentations(word[k:], pieces))
        elif k == 1:
            yield from ([None, *rest] for rest in segmentations(word[1:], pieces))


PIECES = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "abab", "é", "▁b"]


def test_forward_and_expected_counts_sum_all_segmentations():
    lattice, rng = li.Lattice(PIECES), np.random.default_rng(1)
    p = np.vstack([rng.random((len(PIECES), 2)), np.full((1, 2), li.UNKNOWN)])
    texts = ["abab Ba é\nzab", "", "bb-ab2a"]
    code, starts, stops, offsets = lattice.words(texts)
    words = ["".join(map(chr, code[a:b])) for a, b in zip(starts, stops)]
    assert words == ["abab", "ba", "é", "zab", "bb", "ab", "a"] and offsets.tolist() == [0, 4, 4, 7]
    matrix, lengths, row = lattice.distinct(code, starts, stops)
    logs = lattice.log_probability(matrix, lengths, p)
    at = {x: i for i, x in enumerate(PIECES)}
    for w, r in zip(words, row):
        for k in range(2):
            ways = [[p[at.get(x, len(PIECES)), k] for x in s] for s in segmentations("▁" + w, at)]
            assert math.isclose(math.exp(logs[r, k]), sum(map(math.prod, ways)), rel_tol=1e-9)
    want = np.zeros(len(PIECES) + 1)
    for w in words:
        ways = [(s, math.prod(p[at.get(x, len(PIECES)), 0] for x in s)) for s in segmentations("▁" + w, at)]
        total = sum(q for _, q in ways)
        for s, q in ways:
            for x in s:
                want[at.get(x, len(PIECES))] += q / total
    got = lattice.expected(matrix, lengths, p[:, 0], np.bincount(row, minlength=len(lengths)).astype(float))
    assert np.allclose(got, want)


def test_long_words_are_summed_whole():
    lattice, rng = li.Lattice(PIECES), np.random.default_rng(3)
    p = np.vstack([rng.random((len(PIECES), 2)), np.full((1, 2), li.UNKNOWN)])
    words = ["".join(rng.choice(list("abéz"), size=n)) for n in (1, 2, 5, 31, 32, 33, 60)]
    code, starts, stops, _ = lattice.words([" ".join(words)])
    for a, b, w in zip(starts, stops, words):
        assert "".join(map(chr, code[a:b])) == w
        matrix, lengths, _ = lattice.distinct(code, np.array([a]), np.array([b]))
        assert np.allclose(lattice.long_log_probability(code[a:b], np.log(p)), lattice.log_probability(matrix, lengths, p)[0])
        total = np.zeros(len(PIECES) + 1)
        np.add.at(total, *lattice.long_expected(code[a:b], np.log(p[:, 1])))
        assert np.allclose(total, lattice.expected(matrix, lengths, p[:, 1], np.ones(1)))
    code, starts, stops, offsets = lattice.words(["z" * 20_000, "1 2", "ab " + "z" * 20_000])
    assert offsets.tolist() == [0, 1, 1, 3]
    logs = lattice.text_logs(code, starts, stops, offsets, p)
    matrix, lengths, _ = lattice.distinct(code, starts[1:2], stops[1:2])
    assert np.isfinite(logs).all() and np.allclose(logs[0], logs[2] - lattice.log_probability(matrix, lengths, p)[0]) and logs[0, 0] < 20_000 * np.log(li.UNKNOWN) + 1
    assert (logs[1] == 0).all()


def test_equal_texts_get_equal_sums_wherever_they_stand():
    lattice, rng = li.Lattice(PIECES), np.random.default_rng(5)
    p = np.vstack([rng.random((len(PIECES), 3)), np.full((1, 3), li.UNKNOWN)])
    texts = [" ".join("".join(rng.choice(list("abéz"), size=n)) for n in rng.integers(1, 40, size=200)) for _ in range(4)]
    alone = [lattice.text_logs(*lattice.words([t]), p)[0] for t in texts]
    together = lattice.text_logs(*lattice.words(texts + texts[::-1]), p, block=17)
    assert (together == np.array(alone + alone[::-1])).all()


def brute_predict(text, pieces, languages, p):
    """The definition, word by word and piece by piece."""
    at, sums = {x: i for i, x in enumerate(pieces)}, np.zeros(len(languages))
    longest, some = max(map(len, pieces)), False
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" "):
        if not word:
            continue
        some, word = True, "\u2581" + word
        alpha = [np.zeros(len(languages))]
        for j in range(1, len(word) + 1):
            ways = [alpha[i] + np.log(p[at[word[i:j]]]) for i in range(max(0, j - longest), j) if word[i:j] in at]
            if word[j - 1] not in at:
                ways.append(alpha[j - 1] + np.log(p[-1]))
            alpha.append(np.logaddexp.reduce(ways, axis=0))
        sums += alpha[-1]
    if not some or not languages:
        return li.UND, 0.0
    return languages[int(sums.argmax())], float(1 / np.exp(sums - sums.max()).sum())


def test_query_equals_the_definition(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "text", "lang")
    pieces = li.model_vocabulary(None)
    languages, p = li.train(docs.where(~li.held_out("doc_id", 5)), pieces)
    rows = {r.doc_id: r for r in li.query(spark, small_tables).collect()}
    for d in sorted(docs.collect(), key=lambda r: r.doc_id)[:60]:
        lang, score = brute_predict(d.text, pieces, languages, p)
        assert rows[d.doc_id].lang_pred == lang and math.isclose(rows[d.doc_id].score, score, rel_tol=1e-6, abs_tol=1e-9)


def test_held_out_accuracy(spark, small_tables):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small_tables}/documents.parquet").collect()}
    rows = li.query(spark, small_tables).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    sure = [r for r in rows if r.held_out and r.lang_pred != li.UND]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in sure) >= 0.95 * len(sure)


def test_odd_rows(spark):
    rows = [(1, "le la les une", "fr"), (2, "the and of", "en"), (3, None, "en"), (4, "", None), (5, "123 !", "fr"), (5, "123 !", "fr"), (6, "la une", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, extra string")
    pieces = li.model_vocabulary(None)
    languages, p = li.train(docs, pieces)
    assert languages == ["en", "fr"]
    got = {r.doc_id: r for r in li.predict(docs, pieces, languages, p).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["fr", "en", "und", "und", "und", "fr"]
    assert got[3].score == 0 and got[1].score > 0.5 and got[1].extra == "x"
    none = li.train(docs.where("lang = 'xx'"), pieces)
    assert {r.lang_pred for r in li.predict(docs, pieces, *none).collect()} == {"und"}
    assert li.predict(docs.limit(0), pieces, languages, p).count() == 0
    clash = li.predict(docs.withColumnRenamed("extra", "score"), pieces, languages, p)
    assert clash.columns == ["doc_id", "text", "lang", "score", "lang_pred", "score_"] and clash.first().score == "x"
    long = spark.createDataFrame([(1, "the and of " * 50_000 + "z" * 5_000)], "doc_id long, text string")
    assert li.predict(long, pieces, languages, p).first().lang_pred == "en"


def test_many_languages(spark):
    """More languages than a block: each is learned and found."""
    pieces = ["\u2581"] + [chr(0x4E00 + i) for i in range(1200)] + list("ab")
    rows = [(i, chr(0x4E00 + i) * 30 + " ab", f"l{i:04}") for i in range(1200)]
    docs = spark.createDataFrame([*rows, (5000, None, None), (5001, "12 .", "l0000")], "doc_id long, text string, lang string")
    languages, p = li.train(docs, pieces, rounds=1)
    assert languages == sorted({r[2] for r in rows}) and p.shape == (len(pieces) + 1, 1200)
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(docs, pieces, languages, p).collect()}
    assert all(got[i][0] == lang and got[i][1] > 0.99 for i, _, lang in rows)
    assert got[5000] == got[5001] == ("und", 0.0)


def test_blocks_score_as_one_pass(spark, small_tables, monkeypatch):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").limit(80)
    pieces = li.model_vocabulary(None)
    languages, p = li.train(docs, pieces)
    want = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(docs, pieces, languages, p).collect()}
    monkeypatch.setattr(li, "BLOCK", 3)
    again, q = li.train(docs, pieces)
    assert again == languages and abs(p - q).max() < 1e-12
    got = {r.doc_id: (r.lang_pred, r.score) for r in li.predict(docs, pieces, languages, q).collect()}
    assert {d: x for d, (x, _) in got.items()} == {d: x for d, (x, _) in want.items()}
    assert all(abs(got[d][1] - s) < 1e-9 for d, (_, s) in want.items())
