"""Sitemaps read from files, against the form that reads whole bodies and against plain text search."""

import re

from pyspark.sql import functions as F

from contentwatch.sources import feeds


def entry(n, extra=""):
    day = f"<lastmod>2026-01-{n % 28 + 1:02d}</lastmod>" if n % 3 else ""
    return f"<url>\n  <loc>https://a.example.com/{n}?x=1&amp;y={n}</loc>{day}{extra}\n</url>"


def test_one_large_file_is_dealt_over_tasks_and_equals_the_whole_body(spark, tmp_path):
    n = 60_000
    body = '<?xml version="1.0"?>\n<urlset xmlns="http://x" xmlns:image="http://i">' + "\n".join(entry(i, "<image:image><image:loc>https://i/p.png</image:loc></image:image>" if i % 5 == 0 else "") for i in range(n)) + "</urlset>\n"
    path = tmp_path / "large.xml"
    path.write_text(body)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500k")
    try:
        got = feeds.read_sitemaps(spark, str(path))
        with_rows = got.select(F.spark_partition_id().alias("p")).distinct().count()
        rows = sorted((r.url, r.date_raw or "") for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert with_rows > 8
    whole = feeds.parse_sitemap(spark.createDataFrame([("s", body)], "url string, body string"))
    assert rows == sorted((r.url, r.date_raw or "") for r in whole.collect())
    assert len(rows) == n == len(re.findall("</url>", body))
    assert got.select("source").first().source.endswith("/large.xml")


def test_files_of_all_sorts(spark, tmp_path):
    files = {
        "plain.xml": f"<urlset>{entry(1)}<url><loc> https://a/f.pdf#x </loc></url><url><loc></loc></url><url/><url></url></urlset>",
        "attributes.xml": '<urlset><url id="1"><loc>https://a/attr</loc></url><url><loc><![CDATA[https://a/c?d=1&e=2]]></loc></url></urlset>',
        "malformed.xml": "<urlset><url><loc>https://a/bad<b></loc></url><url><loc>https://a/after</loc></url></urlset>",
        "unclosed.xml": "<urlset><url><loc>https://a/lost</loc><url><loc>https://a/kept</loc></url></urlset>",
        "cut.xml": "<urlset><url><loc>https://a/whole</loc></url><url><loc>https://a/cut",
        "comment.xml": "<urlset><!-- a <url> --><url><!-- old --><loc>https://a/seen</loc></url><!-- <url><loc>https://a/hidden</loc></url> --><url><loc>https://a/next</loc></url></urlset>",
        "first.xml": "<urlset><!-- <url><loc>https://a/hidden</loc></url> --><url><loc>https://a/only</loc></url></urlset>",
        "rss.xml": "<rss><channel><image><url>https://a/i.png</url></image><item><link>https://a/r</link></item></channel></rss>",
        "empty.xml": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    got = {}
    for r in feeds.read_sitemaps(spark, str(tmp_path)).collect():
        got.setdefault(r.source.rsplit("/", 1)[1], set()).add(r.url)
    assert got == {
        "plain.xml": {"https://a.example.com/1?x=1&y=1", "https://a/f.pdf"},
        "attributes.xml": {"https://a/attr", "https://a/c?d=1&e=2"},
        "malformed.xml": {"https://a/after"},
        "unclosed.xml": {"https://a/kept"},
        "cut.xml": {"https://a/whole"},
        "comment.xml": {"https://a/seen", "https://a/next"},
        "first.xml": {"https://a/only"},
    }
    assert {r.url for r in feeds.read_sitemaps(spark, str(tmp_path / "plain.xml"), pages_only=True).collect()} == {"https://a.example.com/1?x=1&y=1"}


def test_prefixes_and_indexes(spark, tmp_path):
    (tmp_path / "p.xml").write_text('<sm:urlset xmlns:sm="http://x"><sm:url><sm:loc>https://a/2</sm:loc><sm:lastmod>2026-02-03</sm:lastmod></sm:url></sm:urlset>')
    assert [(r.url, r.date_raw) for r in feeds.read_sitemaps(spark, str(tmp_path / "p.xml"), prefix="sm:").collect()] == [("https://a/2", "2026-02-03")]
    assert feeds.read_sitemaps(spark, str(tmp_path / "p.xml")).collect() == []
    (tmp_path / "i.xml").write_text("<sitemapindex><sitemap><loc>s1</loc></sitemap><sitemap><loc>s2</loc><lastmod>2026-01-01</lastmod></sitemap><sitemap><loc>s3</loc><lastmod>2026-03-01</lastmod></sitemap></sitemapindex>")
    assert [r.url for r in feeds.read_sitemap_indexes(spark, str(tmp_path / "i.xml")).collect()] == ["s3", "s2", "s1"]
