"""Filters and verdicts over candidate pages and articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentwatch.functions.urls import UTILITY_PATHS, url_path
from contentwatch.operators.joins import first_per_key, title_key

# Titles and paths of pages that aren't articles.
UTILITY_TITLES = r"(?i)\b(cookie policy|terms & conditions|terms and conditions|privacy policy|about us|contact us|cookie-policy|terms-conditions|privacy-policy|terms of service|terms of use|legal notice|disclaimer|copyright)\b"
LISTS = r"(?i)/(category|categories|tag|tags|archive|archives|sitemap|search|feed|rss)\b"
JUNK = r"(?i)(cookie|privacy|terms|gdpr|disclaimer|legal|contact-us|about-us|contact us|about us|login|signup|subscribe)"


def utility_reason(url: Column, title: Column, text_chars: Column, link_chars: Column) -> Column:
    """Why a page is no article, the first of five reasons; null for none."""
    path = F.lower(url_path(url))
    return (
        F.when(path.isin("/", "/index.html", "/index.htm", "/index.php", ""), "Homepage")
        .when(F.coalesce(title, F.lit("")).rlike(UTILITY_TITLES), "Utility page based on title")
        .when(path.rlike(LISTS), "Category/Tag/Archive/Search/Sitemap page")
        .when(path.rlike(UTILITY_PATHS), "Navigation/Utility page")
        .when((text_chars > 0) & (link_chars / text_chars > 0.65), "Contains mostly links and navigation elements")
    )


def cleanup_articles(articles: DataFrame) -> DataFrame:
    """Stored articles without those whose url, title or summary is a legal or utility page's."""
    looks = lambda c: F.coalesce(F.col(c), F.lit("")).rlike(JUNK)
    return articles.where(~looks("url") & ~looks("title") & ~F.coalesce("summary", F.lit("")).rlike(r"(?i)(we use cookies|cookie policy|privacy policy|terms and conditions)"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))


def content_gates(html: Column, text: Column) -> Column:
    """The first gate that a page fails: too little markup, markup that is XML, too little text, too few words; null if none."""
    return (
        F.when(F.coalesce(F.length(html), F.lit(0)) <= 500, "short html")
        .when(F.lower(F.ltrim(F.substring(html, 1, 400))).rlike(r"^\s*(<\?xml|<rss|<feed|<urlset|<sitemapindex)"), "xml")
        .when(F.coalesce(F.length(text), F.lit(0)) < 80, "short text")
        .when(word_count(text) < 200, "few words")
    )


def rejection_reason(pages: DataFrame, window: Column, relevant: Column, keyword_hit: Column, order: str = "pos") -> DataFrame:
    """``pages`` (plan_id, date, title, excluded, text) with reason: the first gate that each fails, else "selected".

    A title counts as used from the first page that passes the gates before it, whether or not that page is selected.
    """
    early = F.when(F.col("date").isNull(), "no date").when(~window, "out of range").when(F.col("excluded").isNotNull(), "excluded page").when(F.coalesce("text", F.lit("")) == "", "no content").when(word_count(F.col("text")) < 200, "few words")
    judged = pages.withColumns({"_early": early, "_key": title_key(F.col("title")), "_late": F.when(~keyword_hit, "keyword mismatch").when(~relevant, "not relevant").otherwise("selected")})
    passed = judged.where("_early IS NULL")
    firsts = first_per_key(passed, ["plan_id", "_key"], order).select("plan_id", "_key", F.col(order).alias("_first"))
    joined = judged.join(firsts, ["plan_id", "_key"], "left")
    reason = F.coalesce("_early", F.when(F.col(order) > F.col("_first"), "duplicate title").otherwise(F.col("_late")))
    return joined.withColumn("reason", reason).drop("_early", "_key", "_late", "_first")


def search_activity_log(log: DataFrame, kind: str = "all", text: str = "") -> DataFrame:
    """Log rows of a type whose event or plan holds the text, newest first."""
    some = log if kind == "all" else log.where(F.col("type") == kind)
    if text.strip():
        some = some.where(F.coalesce(F.lower("event"), F.lit("")).contains(text.lower()) | F.coalesce(F.lower("plan_name"), F.lit("")).contains(text.lower()))
    return some.orderBy(F.desc("ts"), F.desc("id"))


def filter_by_source(articles: DataFrame, plan_id: str | None = None, text: str = "", label: str = "") -> DataFrame:
    some = articles if plan_id is None else articles.where(F.col("plan_id") == plan_id)
    if not text:
        return some
    company = F.coalesce(F.lower("company"), F.lit(""))
    hit = F.coalesce(F.lower("url"), F.lit("")).contains(text.lower()) | company.contains(text.lower())
    return some.where(hit | company.contains(label.lower()) if label else hit)
