import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from contentwatch.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


TREE = bpe.TreeBpe(bpe._content(PATH), P.PATTERN, leaf=16, window=4)
PRODUCTION = bpe.TreeBpe(bpe._content(PATH), P.PATTERN)
LIBRARY = tiktoken.Encoding("library", pat_str=P.PATTERN, mergeable_ranks=TREE.ranks, special_tokens={})


def same(tree, text):
    want = LIBRARY.encode_ordinary(text)
    got = tree.encode(text)
    assert got == want
    assert bpe.decode_ids(got, tree.bytes_of, leaf=4) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aab  \n\t'sé漢1-𝛼́."), max_size=200))
def test_texts_encode_as_the_library_does(text):
    same(TREE, text)


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, " " * 3000, "ab" * 2000 + " " * 50 + "x" * 700, "é" * 900, "<|endoftext|>" * 40, "it's we'll they've " * 60, "\r\n" * 400, "thethe" * 500])
def test_long_runs(text):
    same(TREE, text)
    same(PRODUCTION, text * 40)


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=300))
def test_tree_over_one_piece_equals_plain_merges(piece):
    assert TREE.tree(piece, least=7) == TREE.merges(piece)
    parts = [piece[i : i + 9] for i in range(0, len(piece), 9)]
    assert TREE.merge_many(parts) == [[TREE.ranks[p]] if p in TREE.ranks else TREE.merges(p) for p in parts]


def test_texts_over_a_block(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 200)
    for text in ("it's a text of words " * 100, "word" * 900 + " and then " * 60 + "漢字" * 700, "a b" * 600):
        same(TREE, text)
        same(PRODUCTION, text)


def test_memo_starts_anew():
    small = bpe.TreeBpe(bpe._content(PATH), P.PATTERN, leaf=16, window=4)
    small.memo.most = 5
    for i in range(20):
        same(small, f"some words {i} that differ{i} from others{i}")
    assert len(small.memo) <= 40


def test_query_columns_and_null(spark):
    df = spark.createDataFrame([(1, "héllo wörld " * 50, 7), (2, None, 8), (2, None, 8), (3, "", 9)], "doc_id long, text string, extra long")
    rows = bpe.decode(bpe.encode(df)).orderBy("doc_id").collect()
    assert [r.extra for r in rows] == [7, 8, 8, 9]
    assert bytes(rows[0].decoded).decode() == "héllo wörld " * 50
    assert rows[0].ids == LIBRARY.encode_ordinary("héllo wörld " * 50)
    assert rows[1].ids == [] and bytes(rows[3].decoded) == b""
    assert bpe.encode(df.limit(0)).count() == 0
    clash = bpe.decode(bpe.encode(df.withColumnRenamed("extra", "ids")), "ids_")
    assert clash.columns == ["doc_id", "text", "ids", "ids_", "decoded"]
    assert {(r.doc_id, r.ids): bytes(r.decoded).decode() for r in clash.collect()}[1, 7] == "héllo wörld " * 50


def test_stage_keeps_columns_of_the_same_names(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, 7), (None, None, None, None, None)], "doc_id long, text string, ids int, n_tokens int, decoded int")
    got = bpe.stage(spark, df, "")
    assert got.columns == [*df.columns, "ids_", "n_tokens_"]
    assert {tuple(r)[:5] + (len(r.ids_), r.n_tokens_) for r in got.collect()} == {(1, "a b", 5, 6, 7, 2, 2), (None, None, None, None, None, 0, 0)}


def test_query_on_documents(spark, small_tables):
    rows = {r.doc_id: r for r in bpe.query(spark, small_tables).collect()}
    for doc in spark.read.parquet(f"{small_tables}/documents.parquet").collect():
        ids = LIBRARY.encode_ordinary(doc.text or "")
        assert rows[doc.doc_id].n_tokens == len(ids)
        assert rows[doc.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[doc.doc_id].decoded_sha256 == hashlib.sha256((doc.text or "").encode()).hexdigest()


def test_a_long_piece_does_not_widen_the_short_ones():
    import tracemalloc

    tree, rng = PRODUCTION, random.Random(4)
    pieces = ["".join(rng.choices("abcdefgh", k=9)).encode() for _ in range(1 << 14)]
    pieces.insert(100, ("é" * 12 + "xqzj" * 12).encode())
    tracemalloc.start()
    found = tree.merge_many(pieces)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 << 20
    assert [list(found[i]) for i in (0, 100, 101, 5000, -1)] == [tree.ranks.get(pieces[i]) and [tree.ranks[pieces[i]]] or tree.merges(pieces[i]) for i in (0, 100, 101, 5000, -1)]
