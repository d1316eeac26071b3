from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

from contentwatch.llm import common, langid
from tests.llm import test_bpe, test_decontaminate, test_langid, test_minhash, test_substrings


def test_run_equals_the_stages_by_brute_force(spark, small_tables):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small_tables}/documents.parquet").collect()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, small_tables).collect()}
    table = spark.read.parquet(f"{small_tables}/documents.parquet")
    pieces = langid.model_vocabulary(None)
    model = (pieces, *langid.train(table.where(~langid.held_out("doc_id", 5)), pieces))
    judged = {d: test_langid.brute_predict(docs[d].text, *model) for d in docs}
    left = [(d, docs[d].text) for d in sorted(docs) if judged[d][0] != "und" and judged[d][1] >= 0.5]
    assert len(left) > 0.9 * len(docs)
    component = {d: c for d, _, c in test_minhash.brute(left, percent=80)}
    left = [(d, t) for d, t in left if component[d] == d]
    spans = test_substrings.brute(left)
    after = []
    for d, t in left:
        own, text, at = [(a, b) for x, a, b, _ in spans if x == d], "", 0
        for a, b in own:
            text, at = text + t[at:a], b
        text += t[at:]
        if not own or len(text.strip(" ")) >= 120:
            after.append((d, text))
    items = [tuple(r)[:2] for r in spark.read.parquet(f"{small_tables}/benchmark.parquet").collect()]
    hit = {d for d, _, n, _ in test_decontaminate.brute(after, items) if n}
    want = {d: t for d, t in after if d not in hit}
    assert {d: r.text for d, r in out.items()} == want
    for d, r in out.items():
        assert r.ids == test_bpe.LIBRARY.encode_ordinary(r.text) and r.n_tokens == len(r.ids) and r.n_chars == len(r.text)


def test_stages_keep_columns_and_survive_odd_rows(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").limit(60)
    own = ("lang_pred", "score", "row_key", "span_doc_id", "span_row", "span_list", "removed_chars", "n_words", "hit_spans", "hit_items", "ids", "n_tokens", "decoded", "num", "class", "digest", "_id")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "x", 0), (10**6 + 1, "", "en", "x", 0), (None, "the and of that", "en", "x", 15)], docs.schema)
    crowded = docs.union(odd).withColumns({n: F.lit(n) for n in own})
    for given in (crowded, docs.limit(0)):
        columns = given.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, given, small_tables)
            assert got.columns == columns
            assert not got.where(" OR ".join(f"`{n}` != '{n}'" for n in own if n in columns) or "false").count()
            assert got.count() <= given.count()
            given = got
        last = corpus_pipeline.STAGES[-1][1](spark, given, small_tables)
        ids, n = ("ids_", "n_tokens_") if "ids" in columns else ("ids", "n_tokens")
        assert last.columns == [*columns, ids, n] and last.where(F.size(ids) != F.col(n)).count() == 0


def test_tables_left_in_the_shared_folder(spark, small_tables):
    """Each query leaves the one table that its result is read from, or none."""
    from contentwatch.llm import registry

    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    for name, query in {**registry.queries(), "pipeline": corpus_pipeline.run}.items():
        known = set(folder.iterdir())
        query(spark, small_tables).count()
        left = set(folder.iterdir()) - known
        assert len(left) <= 1, (name, left)
