import hashlib
import random
import re
from collections import Counter

import pytest

from contentwatch.llm import simhash as sh


def distance(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_search_equals_brute_force(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(128) for _ in range(30)]
    prints = sorted({b ^ sum(1 << rng.randrange(128) for _ in range(rng.randrange(18))) & ((1 << 128) - 1) for b in base for _ in range(20)})
    prints = [f"{p:032x}" for p in prints]
    df = spark.createDataFrame([(p, "x") for p in prints * 2], "fingerprint string, found string")
    asked = df.where(df.fingerprint < "8")
    for radius, blocks in ((12, 5), (12, 6), (9, 4), (3, 5), (3, 4), (1, 3), (0, 5)):
        rows = [tuple(r) for r in sh.search(asked, df, radius, blocks).collect()]
        got = set(rows)
        assert len(rows) == len(got)
        assert got == {(a, b, distance(a, b)) for a in prints if a < "8" for b in prints if distance(a, b) <= radius}


def slow_fingerprint(text):
    """The definition, a word, a term and a bit at a time."""
    whole, golden, base = (1 << 64) - 1, 0x9E3779B97F4A7C15, 6364136223846793005

    def mix(x):
        x = ((x ^ x >> 30) * 0xBF58476D1CE4E5B9) & whole
        x = ((x ^ x >> 27) * 0x94D049BB133111EB) & whole
        return x ^ x >> 31

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    hashes = [mix(sum(mix((1 + b) * golden & whole) * pow(base, i, 1 << 64) for i, b in enumerate(w.encode())) & whole) for w in words]
    terms = [mix((a * base + b) & whole) for a, b in zip(hashes, hashes[1:])] if len(words) > 1 else [mix(h) for h in hashes]
    weights = Counter(terms)
    out = bytearray(16)
    for i in range(128):
        votes = 0
        for term, weight in weights.items():
            data = term.to_bytes(8, "little") + mix((term + golden) & whole).to_bytes(8, "little")
            votes += weight if data[i // 8] >> 7 - i % 8 & 1 else -weight
        if votes > 0:
            out[i // 8] |= 1 << 7 - i % 8
    return out.hex()


def test_fingerprint_equals_its_slow_form(spark, small_tables):
    docs = [r.text for r in spark.read.parquet(f"{small_tables}/documents.parquet").orderBy("doc_id").limit(30).collect()]
    texts = [*docs, "one", "One TWO", "a b a b a b a", "Ä ß 漢字 Ä ß", " \t\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert [r.fingerprint for r in sh.fingerprints(df).orderBy("i").collect()] == [slow_fingerprint(t) for t in texts]


def brute_edits(docs):
    docs = sorted(docs)
    for (d, text), (_, other) in zip(docs, docs[1:] + docs[:1]):
        n = len(text) // 4
        yield d, len(text), hashlib.sha256((text[: len(text) - n] + other[:n]).encode()).hexdigest()


def test_query(spark, small_tables):
    rows = {r.doc_id: r for r in sh.query(spark, small_tables).collect()}
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{small_tables}/documents.parquet").collect()]
    assert len(rows) == len(docs)
    for d, n, digest in brute_edits(docs):
        assert (rows[d].n_chars, rows[d].edited_sha256) == (n, digest)
    by_id = sorted(rows)
    for a, b in zip(by_id, by_id[1:] + by_id[:1]):
        assert rows[a].near_next == 1 - distance(rows[a].fingerprint, rows[b].fingerprint) / 128
        assert rows[a].near_edited == 1 - distance(rows[a].fingerprint, rows[a].edited_fingerprint) / 128
    prints = {d: rows[d].fingerprint for d in by_id}
    for a in by_id:
        near = [b for b in by_id if distance(prints[a], prints[b]) <= sh.RADIUS]
        want = (len({prints[b] for b in near}) - 1, len(near) - 1) if a % 50 == 0 else (None, None)
        assert (rows[a].n_near, rows[a].n_near_docs) == want
    mean = lambda name: sum(r[name] for r in rows.values()) / len(rows)
    assert mean("near_edited") > mean("near_next") + 0.15


@pytest.mark.parametrize("n", [0, 1, 2, 40])
def test_next_with_odd_rows(spark, n):
    rng = random.Random(n)
    docs = [(rng.randrange(30), None if rng.random() < 0.2 else "wort " * rng.randrange(9), "f") for _ in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, text string, extra string")
    paired = sh.with_next(sh.fingerprints(df), "doc_id", "text", "fingerprint")
    assert paired.count() == n
    prints = sorted((d, sh_of, t or "") for (d, t, _), sh_of in zip(docs, [r.fingerprint for r in sh.fingerprints(df).collect()]))
    got = sorted((r.doc_id, r.fingerprint, r.text, r.next_carried) for r in paired.collect())
    assert got == sorted((d, f, t, nxt) for (d, f, t), (_, nxt, _) in zip(prints, prints[1:] + prints[:1]))


def test_empty_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "one"), (5, "ONE")], "doc_id long, text string")
    got = [r.fingerprint for r in sh.fingerprints(df).orderBy("doc_id").collect()]
    assert got[:3] == ["0" * 32] * 3 and got[3] == got[4] != got[0]


def test_clash_and_long_text(spark):
    df = spark.createDataFrame([(1, "a b c " * 80_000, "x")], "doc_id long, text string, fingerprint string")
    got = sh.fingerprints(df)
    assert got.columns == [*df.columns, "fingerprint_"] and got.first().fingerprint == "x"
    assert got.first().fingerprint_ == sh.fingerprints(df.selectExpr("'A b c A b c a' AS text")).first().fingerprint
