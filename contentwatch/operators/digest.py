"""E-mail digests: recipients, items and delivery rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentwatch.functions.text import esg_category


def plan_recipients(groups: Column) -> Column:
    """The distinct addresses of active groups, sorted."""
    none = F.array().cast("array<string>")
    active = F.filter(F.coalesce(groups, F.array().cast("array<struct<name: string, active: boolean, emails: array<string>>>")), lambda g: F.coalesce(g["active"], F.lit(False)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(active, lambda g: F.coalesce(g["emails"], none)))))


def split_addresses(text: Column) -> Column:
    """The addresses of free text, split at line breaks and commas; they hold an @."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\n,]"), lambda a: F.trim(a)), lambda a: a.contains("@"))


def number_items(articles: DataFrame, *order) -> DataFrame:
    """Articles with their place in their plan's digest, from 1."""
    return articles.withColumn("item", F.row_number().over(W.partitionBy("plan_id").orderBy(*order)))


def subject(name: Column, n: Column) -> Column:
    return F.concat(name, F.lit(" — "), n.cast("string"), F.lit(" new article"), F.when(n == 1, "").otherwise("s"))


def build_digest(plans: DataFrame, articles: DataFrame, *order) -> DataFrame:
    """(plan_id, recipient, subject, n_articles, items) of plans with recipients and articles, a row for each recipient."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    items = number_items(articles.withColumn("category", esg_category(text)), *order)
    listed = items.groupBy("plan_id").agg(F.array_sort(F.collect_list(F.struct("item", "title", "url", "category"))).alias("items"))
    to = plans.select(F.col("id").alias("plan_id"), "name", F.explode(plan_recipients(F.col("recipient_groups"))).alias("recipient"))
    rows = to.join(listed, "plan_id")
    n = F.size("items")
    return rows.select("plan_id", "recipient", subject(F.col("name"), n).alias("subject"), n.alias("n_articles"), "items")


def chat_context(articles: DataFrame, *order, n: int = 15) -> DataFrame:
    """(plan_id, context): the first n articles of each plan as one text."""
    some = number_items(articles, *order).where(F.col("item") <= n)
    line = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\nDate: "), F.coalesce(F.col("pub_date").cast("string"), F.lit("")), F.lit("\nSummary: "), F.coalesce("summary", F.lit("")), F.lit("\nURL: "), F.coalesce("url", F.lit("")))
    parts = some.select("plan_id", F.struct("item", line.alias("line")).alias("p")).groupBy("plan_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return parts.select("plan_id", F.array_join(F.transform("ps", lambda p: p["line"]), "\n\n---\n\n").alias("context"))
