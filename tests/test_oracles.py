"""Every registered SQL text in DuckDB against its query."""

import duckdb
import pytest

from contentwatch.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    """Values as both engines print them alike."""
    if isinstance(value, bool):
        return str(value)
    try:
        number = float(value)
        return f"{number:.6g}" if abs(number) < 1e15 else str(int(value))
    except (TypeError, ValueError):
        return str(value).removesuffix(" 00:00:00")


def rows_of(frame):
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


def compare(spark, duck, query, sql, folder):
    want, got = duck.execute(sql).fetch_df(), query(spark, folder).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
    return got


@pytest.fixture(scope="session")
def duck(small_tables):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small_tables}/{name}.parquet'")
    return con


SQL, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, small_tables, name):
    compare(spark, duck, QUERIES[name], SQL[name], small_tables)


def test_every_query_without_sql_is_known():
    known = {"deduplicate", "similar_title_pairs", "title_similarity", "page_text", "page_text_blocks", "article_signals", "classify_article", "extract_pipeline", "monitor_pipeline"}
    assert set(QUERIES) - set(SQL) <= known
