import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from contentwatch.llm import alignment as al

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def encoder():
    return al.Encoder(open(A, "rb").read(), open(B, "rb").read())


def brute_tokens(text, libraries, encoder):
    """[(id, start, end)] of both, by the libraries over the whole text; empty where the bytes differ."""
    if not text:
        return [], []
    ids = libraries[0].encode(" " + text, add_special_tokens=False).ids, libraries[1].encode(text)
    out = []
    for own, table in zip(ids, (encoder.bytes_a, encoder.bytes_b)):
        at, tokens = 0, []
        for i in own:
            tokens.append((i, at, at + len(table[i])))
            at += len(table[i])
        if b"".join(table[i] for i in own) != (" " + text).encode():
            return [], []
        out.append(tokens)
    return tuple(out)


def brute(texts, libraries, encoder):
    tokens = [brute_tokens(t, libraries, encoder) for t in texts]
    links = []
    for a, b in tokens:
        own, j = [], 0
        for x, start, end in a:
            while j and b[j][1] > start:
                j -= 1
            while j < len(b) and b[j][2] <= start:
                j += 1
            k = j
            while k < len(b) and b[k][1] < end:
                own.append((x, b[k][0]))
                k += 1
        links.append(own)
    count = Counter(p for own in links for p in set(own))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    rows = []
    for (a, b), own in zip(tokens, links):
        common = sorted({e for *_, e in a} & {e for *_, e in b})
        shown, start = [], 0
        for end in common:
            shown.append("|".join(",".join(str(i) for i, s, _ in side if start <= s < end) for side in (a, b)))
            start = end
        rows.append((len(a), len(b), len(common), len(own), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(";".join(shown).encode()).hexdigest() if common else ""))
    return rows


ODD = [None, "", " ", "a ", "  two  spaces ", "\n\na b\t c\r\n d ", "é漢字 x 👩‍👩‍👧", "it's <|endoftext|> <s> </s> <unk> <0x41>", "x　y  z", "a\x00b \x1c c", "w" * 3000, "a▁b c", "ﬁ ŀ ① Å", "can't 12 345,6", " x \u0085y"]


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 200), max_size=60), st.sets(st.integers(1, 200), max_size=60))
def test_gallop_and_overlaps(a, b):
    a, b = (np.array(sorted(x) + [201]) for x in (a, b))
    assert (al.gallop(a, b) == np.searchsorted(b, a)).all() and len(al.gallop(a[:0], b)) == 0 and (al.gallop(a, b[:0]) == 0).all()
    first, last = al.overlaps(a, b)
    for i in range(len(a)):
        start = a[i - 1] if i else 0
        met = [j for j in range(len(b)) if (b[j - 1] if j else 0) < a[i] and b[j] > start]
        assert (met[0], met[-1]) == (first[i], last[i])


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab Z0.'s\n\t 　é漢▁́😀-<>|"), max_size=40))
def test_words_encode_as_the_whole_text(text):
    encoder = test_words_encode_as_the_whole_text.__dict__.setdefault("encoder", None) or al.Encoder(open(A, "rb").read(), open(B, "rb").read(), al.by_rank(open(A, "rb").read(), open(B, "rb").read()))
    test_words_encode_as_the_whole_text.__dict__["encoder"] = encoder
    (words,) = encoder([text])
    if not encoder.a.encode(" " + text, add_special_tokens=False).ids or not brute_tokens(text, (encoder.a, encoder.b), encoder)[0]:
        assert not len(words[0]) and not len(words[1])
        return
    for side, want in ((0, encoder.a.encode(" " + text, add_special_tokens=False).ids), (1, encoder.b.encode(text))):
        assert words[side].tolist() == want


def test_odd_texts_against_brute_force(spark, tmp_path, libraries, encoder):
    texts = [*ODD, *ODD, "the cat sat on the mat", "The cat's hat."]
    docs = spark.createDataFrame([(i if i % 5 else None, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, a_ids string, n int").withColumn("n", F.monotonically_increasing_id()).coalesce(1)
    aligned = al.align(docs, A, B)
    assert aligned.columns == ["doc_id", "a_ids", "n", "a_ids_", "b_ids", "b_first", "b_last"]
    names = ("a_ids_", "b_ids", "b_first", "b_last")
    links = al.written(al.linked(aligned, names), "links", str(tmp_path))
    want = brute(texts, libraries, encoder)
    for limit in (al.SENT, 20, 0):  # all pairs sent, some, none
        got = al.scored(links, str(tmp_path), limit).toPandas().sort_values("n")
        assert [tuple(r) for r in got[list(NAMES)].itertuples(index=False)] == want
    empty = al.written(al.linked(al.align(docs.limit(0), A, B), names), "links", str(tmp_path))
    assert al.scored(empty, str(tmp_path)).count() == 0


def test_merging_by_rank():
    a, b = open(A, "rb").read(), open(B, "rb").read()
    assert al.by_rank(a, b)
    assert not al.by_rank(a.replace(b'"use_regex":true', b'"use_regex":false').replace(b'"use_regex": true', b'"use_regex": false'), b)


def test_query(spark, small_tables, libraries, encoder):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").collect()
    got = {r.doc_id: tuple(r[n] for n in NAMES) for r in al.query(spark, small_tables).collect()}
    assert got == dict(zip([d.doc_id for d in docs], brute([d.text for d in docs], libraries, encoder)))
