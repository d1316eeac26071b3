"""Sitemaps, feeds and robots files from tables of fetched bodies (url, body), and sitemaps from files of any size.  Malformed bodies give no rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contentwatch.functions.text import strip_tags
from contentwatch.functions.urls import is_page_url, normalize_url
from contentwatch.operators.tables import scratch, written

# Where sitemaps and feeds usually are.
SITEMAP_PATHS = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap/sitemap.xml", "/wp-sitemap.xml", "/sitemapindex.xml", "/news-sitemap.xml", "/sitemap1.xml"]
FEED_PATHS = ["/feed/", "/feed", "/rss/", "/rss", "/rss.xml", "/atom.xml", "/feed.xml", "/index.xml", "/feeds/posts/default", "/comments/feed/", "/blog/feed/", "/blog/rss/", "/news/feed/", "/?feed=rss2"]


def sniff_xml(body: Column) -> Column:
    """Whether a body looks like a sitemap or feed."""
    start = F.ltrim(F.regexp_replace(F.substring(body, 1, 4096), r"^\s+", ""))
    head = F.lower(F.substring(start, 1, 200))
    return F.coalesce(head.startswith("<?xml") | head.rlike("<(urlset|sitemapindex|rss|feed)"), F.lit(False))


def xml_kind(body: Column) -> Column:
    """urlset, index, rss or feed by the root element; null for anything else."""
    root = F.lower(F.regexp_extract(body, r"^(?:\s|<\?[^>]*\?>|<!--(?s:.)*?-->|<!DOCTYPE[^>]*>)*<(?:[\w.-]+:)?([\w.-]+)", 1))
    return F.when(root == "sitemapindex", "index").when(root.isin("urlset", "rss", "feed"), root)


ENTRY = "loc string, lastmod string"


def _xml(text: Column, prefix: Column, schema: str) -> Column:
    """Parsed XML, null where it is malformed.  ``prefix`` is taken from the names: from_xml takes them as written."""
    plain = F.when(prefix == "", text).otherwise(F.replace(F.replace(text, F.concat(F.lit("<"), prefix), F.lit("<")), F.concat(F.lit("</"), prefix), F.lit("</")))
    return F.from_xml(plain, schema, {"mode": "PERMISSIVE", "attributePrefix": "_", "valueTag": "_VALUE"})


def _parsed(docs: DataFrame, kind: str, schema: str) -> DataFrame:
    some = docs.where(sniff_xml(F.col("body")) & (xml_kind(F.col("body")) == kind))
    # a root with a prefix has it on its elements too
    prefix = F.concat(F.regexp_extract("body", r"<([\w.-]+:)(?:urlset|sitemapindex|rss|feed)\b", 1))
    return some.select(F.col("url").alias("source"), _xml(F.col("body"), prefix, schema).alias("x"))


def _clean(url: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(url), "#.*$", ""))


def parse_sitemap(docs: DataFrame, pages_only: bool = False) -> DataFrame:
    """(source, pos, url, date_raw) of urlset bodies; entries without an address are skipped."""
    rows = _parsed(docs, "urlset", f"url array<struct<{ENTRY}>>").select("source", F.posexplode("x.url").alias("pos", "u"))
    return _sitemap_entries(rows, ["source", "pos"], pages_only)


def _sitemap_entries(rows: DataFrame, keys: list[str], pages_only: bool) -> DataFrame:
    out = rows.select(*keys, _clean(F.col("u.loc")).alias("url"), F.nullif(F.trim("u.lastmod"), F.lit("")).alias("date_raw")).where("url != ''")
    return out.where(is_page_url(F.col("url"), keywords=["\0"])) if pages_only else out


def parse_sitemap_index(docs: DataFrame) -> DataFrame:
    """(source, pos, url, lastmod) of child sitemaps, the latest first."""
    rows = _parsed(docs, "index", f"sitemap array<struct<{ENTRY}>>").select("source", F.posexplode("x.sitemap").alias("pos", "u"))
    return _children(rows, ["source", "pos"]).orderBy(F.desc_nulls_last("lastmod"), "source", "pos")


def _children(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.select(*keys, _clean(F.col("u.loc")).alias("url"), F.trim("u.lastmod").alias("lastmod")).where("url != ''")


def _elements(spark: SparkSession, path: str, name: str, prefix: str) -> DataFrame:
    """(source, u): every element ``name`` of the files under ``path``, each parsed by itself.

    Files are text whose records end with the element's end tag, so one file is dealt over many tasks (a compressed one is
    read by one) and no row holds more than an element, whatever the file's size; the XML source's ``rowTag`` reads a file in
    one task, or line by line.
    """
    files = spark.read.text(path, lineSep=f"</{prefix}{name}>").select(F.col("_metadata.file_path").alias("source"), F.regexp_replace("value", "(?s)<!--.*?-->", "").alias("value"))
    # from the last start tag: what stands before it belongs to no whole element
    inside = F.regexp_extract("value", rf"(?s)^.*<{re.escape(prefix + name)}(?:\s[^>]*)?>(.*)$", 1)
    # a comment that is still open at the end tag has that tag inside
    some = files.where(~F.contains("value", F.lit("<!--"))).select("source", inside.alias("inside")).where("inside != ''")
    return some.select("source", _xml(F.concat(F.lit("<x>"), "inside", F.lit("</x>")), F.lit(prefix), ENTRY).alias("u"))


def read_sitemaps(spark: SparkSession, path: str, pages_only: bool = False, prefix: str = "") -> DataFrame:
    """(source, url, date_raw) of urlset files, the source being a file's path; for files too large for a row of a table.

    As ``parse_sitemap``, but an entry is judged by itself: a malformed one is left out and the others stay, and what is
    cut off at a file's end counts if its address is whole.  Entries have no position, and of several in one comment only the
    first is left out.  ``prefix`` ("sm:") is that of the files' names; their text is UTF-8.  Files without entries, empty
    ones and those of another kind have no rows.
    """
    return _sitemap_entries(_elements(spark, path, "url", prefix), ["source"], pages_only)


def read_sitemap_indexes(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(source, url, lastmod) of the child sitemaps that sitemapindex files name, the latest first; read like ``read_sitemaps``."""
    return _children(_elements(spark, path, "sitemap", prefix), ["source"]).orderBy(F.desc_nulls_last("lastmod"), "source", "url")


def parse_rss(docs: DataFrame) -> DataFrame:
    """(source, pos, url, title, date_raw, summary) of RSS items with a link."""
    rows = _parsed(docs, "rss", "channel struct<item: array<struct<link: string, title: string, pubDate: string, description: string>>>").select("source", F.posexplode("x.channel.item").alias("pos", "i"))
    return rows.select("source", "pos", _clean(F.col("i.link")).alias("url"), F.trim("i.title").alias("title"), F.nullif(F.trim("i.pubDate"), F.lit("")).alias("date_raw"), strip_tags(F.coalesce("i.description", F.lit(""))).alias("summary")).where("url != ''")


def parse_atom(docs: DataFrame) -> DataFrame:
    """(source, pos, url, title, date_raw, summary) of Atom entries; the alternate link before the first."""
    rows = _parsed(docs, "feed", "entry array<struct<title: string, published: string, updated: string, summary: string, content: string, link: array<struct<_href: string, _rel: string>>>>").select("source", F.posexplode("x.entry").alias("pos", "e"))
    alternate = F.try_element_at(F.filter("e.link", lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate"), F.lit(1))["_href"]
    url = F.coalesce(alternate, F.try_element_at(F.col("e.link"), F.lit(1))["_href"])
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.select("source", "pos", _clean(url).alias("url"), F.trim("e.title").alias("title"), F.coalesce(filled("e.published"), filled("e.updated")).alias("date_raw"), strip_tags(F.coalesce(filled("e.summary"), F.col("e.content"), F.lit(""))).alias("summary")).where("url != ''")


def entries(docs: DataFrame) -> DataFrame:
    """(source, pos, url, date_raw) of all kinds of leaf bodies."""
    shared = ["source", "pos", "url", "date_raw"]
    return parse_sitemap(docs).select(*shared).unionByName(parse_rss(docs).select(*shared)).unionByName(parse_atom(docs).select(*shared))


def resolve_sitemaps(roots: DataFrame, docs: DataFrame, levels: int = 2) -> DataFrame:
    """(root, source, pos, url, date_raw): leaf entries of root bodies (column url), through at most ``levels`` of child sitemaps."""
    frontier = roots.select(F.col("url").alias("root"), "url").distinct()
    out = None
    with scratch(docs.sparkSession, "sitemaps") as folder:
        for level in range(levels + 1):
            # each level's bodies are a table, so that no level reads the ones before again; a body is parsed once, whatever names it
            bodies = written(docs.join(frontier.select("url").distinct(), "url", "left_semi").select("url", "body").distinct(), "bodies", folder)
            found = entries(bodies).join(frontier.withColumnRenamed("url", "source"), "source").select("root", "source", "pos", "url", "date_raw")
            out = found if out is None else out.unionByName(found)
            if level < levels:
                children = parse_sitemap_index(bodies).select("source", F.col("url").alias("child"))
                frontier = written(children.join(frontier.withColumnRenamed("url", "source"), "source").select("root", F.col("child").alias("url")).distinct(), "frontier", folder)
        return written(out, "sitemap-entries")


def robots_rules(robots: DataFrame) -> DataFrame:
    """(host, kind, value): the sitemaps and disallowed path prefixes of robots bodies (host, body), for all agents alike."""
    line = robots.select("host", F.explode(F.split("body", r"\r?\n")).alias("line"))
    line = line.select("host", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("kind"), F.trim(F.regexp_replace("line", r"^[^:]*:", "")).alias("value"))
    return line.where("kind IN ('sitemap', 'disallow') AND value != ''").distinct()


def candidate_locations(sites: DataFrame, known: DataFrame | None = None, paths: list[str] = SITEMAP_PATHS + FEED_PATHS) -> DataFrame:
    """(site, url, pos): what ``known`` (site, url, pos) names, then the usual places; each address once, at its first position."""
    usual = sites.select("site", F.posexplode(F.array(*map(F.lit, paths))).alias("pos", "path")).select("site", F.concat("site", "path").alias("url"), (F.col("pos") + 1_000_000).alias("pos"))
    every = usual if known is None else known.select("site", "url", F.col("pos").cast("int").alias("pos")).unionByName(usual)
    return every.groupBy("site", "url").agg(F.min("pos").alias("pos"))


def normalized_entries(found: DataFrame) -> DataFrame:
    return found.withColumn("url", normalize_url(F.col("url")))
