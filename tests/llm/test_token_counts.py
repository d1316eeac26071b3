import public_tokenizers as P
import sentencepiece

from contentwatch.llm import token_counts as tc

MODEL = P.path("piece_bpe_32k.model")


def test_counts_misses_and_hits(spark, tmp_path):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = ["a b c", None, "", "a b c", "<s> </s> é漢字", "  two   spaces ", "w" * 3000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, digest string")
    cache = str(tmp_path / "cache")
    for _ in range(2):
        rows = {r.doc_id: r.n_tokens for r in tc.count_tokens(df, cache, MODEL).collect()}
        assert rows == {i: len(library.encode(t or "")) for i, t in enumerate(texts)}
        assert spark.read.parquet(cache).count() == len({t or "" for t in texts})  # the second round appends nothing
    more = df.union(spark.createDataFrame([(9, "new one", "x")], df.schema))
    assert tc.count_tokens(more, cache, MODEL).count() == 8
    assert spark.read.parquet(cache).count() == len({t or "" for t in texts}) + 1
    other = P.path("byte_bpe_50k.json")
    assert tc.read_cache(spark, cache, tc.tokenizer_version(other)).count() == 0
    assert tc.count_tokens(df, cache, other).where("doc_id = 0").first().n_tokens > 0


def test_empty_table_and_clash(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tc.count_tokens(df, str(tmp_path / "c"), MODEL).count() == 0
    one = spark.createDataFrame([(5, "a b c " * 50_000)], "n_tokens long, text string")
    got = tc.count_tokens(one, str(tmp_path / "d"), MODEL)
    assert got.columns == ["n_tokens", "n_tokens_"] and tuple(got.first()) == (5, 150_001)


def test_query(spark, small_tables):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = {r.doc_id: r for r in tc.query(spark, small_tables).collect()}
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n = len(library.encode(d.text or ""))
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].n_bytes, rows[d.doc_id].over_limit) == (n, len((d.text or "").encode()), n > 4096)
