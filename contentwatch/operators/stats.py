"""Aggregates, rankings and dashboard numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Log events that mark a crawled address.
CRAWL_MARKERS = ["━━━ Crawling [", "??? Crawling [", "Failed to crawl URL"]


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def article_counts(plans: DataFrame, articles: DataFrame) -> DataFrame:
    """``plans`` with articles_count as counted."""
    counts = articles.groupBy(F.col("plan_id").alias("_plan")).agg(F.count("*").cast("int").alias("_n"))
    return plans.drop("articles_count").join(counts, F.col("id") == F.col("_plan"), "left").withColumn("articles_count", F.coalesce("_n", F.lit(0))).drop("_plan", "_n")


def overview(plans: DataFrame, articles: DataFrame, emails: DataFrame, log: DataFrame, today: Column) -> DataFrame:
    """One row: running plans, articles of today, e-mails sent, errors logged."""
    rows = plans.select(F.count_if(F.col("status") == "running").alias("running"))
    return rows.crossJoin(articles.select(F.count_if(F.col("pub_date") == today).alias("today"))).crossJoin(emails.select(F.count("*").alias("emails"))).crossJoin(log.select(F.count_if(F.col("type") == "error").alias("errors")))


def top_sources(articles: DataFrame, n: int = 5) -> DataFrame:
    source = F.coalesce(F.nullif("company", F.lit("")), F.lit("Unknown source"))
    return articles.groupBy(source.alias("source")).agg(F.count("*").alias("articles")).orderBy(F.desc("articles"), "source").limit(n)


def share_of_max(rows: DataFrame, count: str = "articles", out: str = "share") -> DataFrame:
    """Each count as percent of the largest, at least 1; for a shown set, which is small."""
    most = rows.agg(F.greatest(F.max(count), F.lit(1)).alias("_most"))
    return rows.crossJoin(F.broadcast(most)).withColumn(out, js_round(100.0 * F.col(count) / F.col("_most"))).drop("_most")


def knowledge_summary(articles: DataFrame) -> DataFrame:
    return articles.groupBy("plan_id").agg(F.count("*").alias("articles"), F.countDistinct("company").alias("sources"), F.min("pub_date").alias("first_date"), F.max("pub_date").alias("last_date"))


def plan_status_join(plans: DataFrame, articles: DataFrame, emails: DataFrame) -> DataFrame:
    """Every plan with its numbers of articles and e-mails."""
    count = lambda df, name: df.groupBy("plan_id").agg(F.count("*").alias(name))
    joined = plans.withColumnRenamed("id", "plan_id").join(count(articles, "articles"), "plan_id", "left").join(count(emails, "emails"), "plan_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("articles", "emails")})


def plan_stats(plans: DataFrame, articles: DataFrame, emails: DataFrame) -> DataFrame:
    """Per plan its urls, articles, e-mails and recipients, the latter as often as they are listed."""
    sizes = plans.select("id", F.coalesce(F.size("urls"), F.lit(0)).alias("urls"), F.coalesce(F.aggregate("recipient_groups", F.lit(0), lambda n, g: n + F.coalesce(F.size(g["emails"]), F.lit(0))), F.lit(0)).alias("recipients"))
    return plan_status_join(sizes, articles, emails)


def date_coverage_route(entries: DataFrame, sites: DataFrame, parsed: str = "date") -> DataFrame:
    """(site, coverage, route): 1 where at least nine tenths of the entries have a date, 2 elsewhere, 3 without entries."""
    share = entries.groupBy("site").agg(F.avg(F.col(parsed).isNotNull().cast("int")).alias("coverage"))
    return sites.join(share, "site", "left").withColumn("route", F.when(F.col("coverage").isNull(), 3).when(F.col("coverage") >= 0.9, 1).otherwise(2))


def crawl_summary(judged: DataFrame) -> DataFrame:
    """Per seed: pages processed, rejected by date and by prompt, selected, and the verdict."""
    count = lambda *reasons: F.count_if(F.col("reason").isin(*reasons))
    rows = judged.groupBy("seed").agg(F.count("*").alias("processed"), count("no date", "out of range").alias("by_date"), count("keyword mismatch", "not relevant").alias("by_prompt"), count("selected").alias("selected"))
    verdict = F.when((F.col("processed") == 0) | (F.col("selected") > 0), "ok").when(F.col("by_date") == F.col("processed"), "No articles found for the selected date range.").when(F.col("by_prompt") == F.col("processed"), "No articles matched the monitoring scope prompt.").otherwise("No relevant articles found.")
    return rows.withColumn("verdict", verdict)


def metric_totals(metrics: DataFrame, providers: list[str]) -> DataFrame:
    """Sums of counters and seconds, and calls per provider, over metric rows (name, value, provider)."""
    sums = [F.coalesce(F.sum(F.when(F.col("name") == n, F.col("value"))), F.lit(0.0)).alias(n) for n in ("processed", "selected", "rejected", "seconds")]
    calls = [F.count_if((F.col("name") == "call") & (F.col("provider") == p)).alias(f"calls_{p}") for p in providers]
    return metrics.agg(*sums, *calls)


def dashboard_cube(judged: DataFrame) -> DataFrame:
    """(level, plan_id, source, selected, rejected, selected_pct, rejected_pct) for all, each plan, and each source of each plan in one pass."""
    sets = judged.groupingSets([[], ["plan_id"], ["plan_id", "source"]], "plan_id", "source").agg(F.grouping_id().alias("g"), F.count_if(F.col("reason") == "selected").alias("selected"), F.count_if(F.col("reason") != "selected").alias("rejected"))
    total = F.col("selected") + F.col("rejected")
    pct = lambda c: F.when(total == 0, 0).otherwise(js_round(100.0 * F.col(c) / total))
    level = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "plan").otherwise("source")
    return sets.select(level.alias("level"), "plan_id", "source", "selected", "rejected", pct("selected").alias("selected_pct"), pct("rejected").alias("rejected_pct"))


def prorated_metrics(selections: DataFrame, totals: DataFrame) -> DataFrame:
    """Per selection (key, urls, selected, plan_selected, plan_rejected): time by share of urls, calls by share of articles, rejections by share of the plan's; ``totals`` has one row (total_urls, total_selected, total_seconds, total_calls)."""
    safe = lambda c: F.when(F.col(c) == 0, 1).otherwise(F.col(c))
    rows = selections.crossJoin(F.broadcast(totals))
    rejected = F.when(F.col("plan_selected") > 0, js_round(F.col("plan_rejected") * (F.col("selected") / F.col("plan_selected")))).otherwise(F.col("plan_rejected"))
    return rows.select("key", js_round(F.col("total_seconds") * (F.col("urls") / safe("total_urls"))).alias("seconds"), js_round(F.col("total_calls") * (F.col("selected") / safe("total_selected"))).alias("calls"), rejected.cast("long").alias("rejected"))


def urls_processed_from_log(log: DataFrame, markers: list[str] = CRAWL_MARKERS) -> DataFrame:
    hit = F.exists(F.array(*map(F.lit, markers)), lambda m: F.col("event").contains(m))
    return log.groupBy("plan_name").agg(F.count_if(hit).alias("urls"))


def distinct_monitored_urls(plan_urls: DataFrame) -> DataFrame:
    """(url, label): each monitored url once, with its first label."""
    return plan_urls.groupBy("url").agg(F.min_by("label", F.struct("plan_id", "pos")).alias("label"))


def log_type_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("type").agg(F.count("*").alias("events"))


def delivery_outcome(sends: DataFrame, by: list[str]) -> DataFrame:
    """Per send: delivered, failed, and whether all, some or none went out."""
    rows = sends.groupBy(*by).agg(F.count_if(F.col("status") == "sent").alias("sent"), F.count_if(F.col("status") != "sent").alias("failed"))
    return rows.withColumn("outcome", F.when(F.col("failed") == 0, "sent").when(F.col("sent") == 0, "failed").otherwise("partial"))


def last_n_per_key(log: DataFrame, key: str, n: int, *newest) -> DataFrame:
    """The newest n rows of each key."""
    return log.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(*newest))).where(F.col("_n") <= n).drop("_n")


def email_history(emails: DataFrame) -> DataFrame:
    """Sends (plan_id, ts, recipients) newest first, the first two recipients named."""
    more = F.size("recipients") - 2
    named = F.concat(F.array_join(F.slice("recipients", 1, 2), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"), F.lit(" more"))).otherwise(""))
    return emails.select("plan_id", "ts", named.alias("recipients"), F.coalesce("articles_count", F.lit(0)).alias("articles"), "status").orderBy(F.desc("ts"), "plan_id")


def rank_links_by_keywords(links: DataFrame, keywords: list[str]) -> DataFrame:
    """Links (url, text, pos) with score 2 for a keyword in the text, 1 in path or query; others go.  Keywords of up to three characters must stand alone."""
    import re

    from contentwatch.functions.urls import url_path, url_query

    words = [k.strip().lower() for k in keywords if k.strip()]
    if not words:
        return links.withColumn("score", F.lit(0))
    pattern = "|".join(rf"(?:^|[^a-zA-Z0-9]){re.escape(k)}(?:[^a-zA-Z0-9]|$)" if len(k) <= 3 else re.escape(k) for k in words)
    place = F.concat(url_path(F.lower("url")), url_query(F.lower("url")))
    score = F.when(F.lower(F.coalesce("text", F.lit(""))).rlike(pattern), 2).when(place.rlike(pattern), 1).otherwise(0)
    return links.withColumn("score", score).where("score > 0")
