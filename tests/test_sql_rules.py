"""Queries against their SQL on rows that the small tables lack: long pages, cut references, requests within a millisecond."""

from datetime import datetime, timedelta

import duckdb
import pytest

from tests.test_oracles import QUERIES, SQL, compare

BODY = "<!DOCTYPE html><html lang=\"en\"><head><title>{t}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body><!-- x --><h1>{t}</h1>{ps}</body></html>"


def tables(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    return con


@pytest.mark.parametrize("name, head", [("extract_date", 3000), ("extract_date_p1", 5000)])
def test_labels_after_300_elements(spark, tmp_path, name, head):
    label = len(" Published on 5 January 1999")
    chars = lambda n, total: "".join(f"<p>{'&amp;' * k}</p>" for k in [1] * (n - 1) + [total - label - 2 * (n - 1) - 2 * len("t ")])
    pages = [chars(299, 9000), chars(300, 9000), chars(300, head), chars(300, head + 1)]
    rows = [(4 + 900 * i, f"https://a.b/{i}", BODY.format(t="t", ps=ps)) for i, ps in enumerate(pages)]
    got = compare(spark, tables(spark, tmp_path, "pages", rows, "page_id long, url string, html string"), QUERIES[name], SQL[name], str(tmp_path))
    assert [x is not None for x in got.sort_values("page_id").published] == [True, False, True, False]


def test_references_without_semicolons(spark, tmp_path):
    titles = ["one &amp; two&amp", "a &l", "x &lt;b&gt y", "&amp;lt", "&am", "  &amp", "&amp;amp;&ampamp;", "say &quot;x&quot it&#x27;s"]
    rows = [(i, f"https://a.b/{i}", BODY.format(t=t, ps="<p>p</p>")) for i, t in enumerate(titles)]
    got = compare(spark, tables(spark, tmp_path, "pages", rows, "page_id long, url string, html string"), QUERIES["page_title"], SQL["page_title"], str(tmp_path))
    assert got.sort_values("page_id").title.tolist() == ["one & two&", "a &l", "x <b> y", "&lt", "&am", "&", "&amp;&amp;", "say \"x\" it's"]


def test_quota_windows_in_whole_milliseconds(spark, tmp_path):
    t0, us = datetime(2024, 1, 1), lambda n: timedelta(microseconds=n)
    times = [t0 + us(900), t0 + timedelta(minutes=15) + us(100), t0 + timedelta(minutes=29), t0 + timedelta(minutes=30) + us(50), t0 + timedelta(hours=1) + us(20)]
    rows = [(i, t, 0, "view", 1.0, "{}") for i, t in enumerate(times)]
    got = compare(spark, tables(spark, tmp_path, "events", rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"), QUERIES["stream_quota"], SQL["stream_quota"], str(tmp_path))
    assert sorted(got.requests) == [1, 1, 2]
