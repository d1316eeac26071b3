"""Joins, set operations and walks over the monitoring tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from contentwatch.functions.urls import normalize_url, url_authority, url_path


def first_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def new_articles_only(batch: DataFrame, seen: DataFrame, *order) -> DataFrame:
    """Rows whose (plan_id, url) is neither in ``seen`` nor earlier in the batch; empty urls go.

    The history is cut to the batch's keys before the anti join, so it is read once and not sorted.
    """
    some = first_per_key(batch.where("url IS NOT NULL AND url != ''"), ["plan_id", "url"], *order)
    known = seen.join(some.select("plan_id", "url"), ["plan_id", "url"], "left_semi").select("plan_id", "url")
    return some.join(known, ["plan_id", "url"], "left_anti")


def title_key(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(title, F.lit("")))), "[^a-z0-9]", "")


def new_titles_only(batch: DataFrame, history: DataFrame, *order) -> DataFrame:
    """Rows whose title is new to the plan, letters and digits alone counting; the empty key of history doesn't count."""
    some = first_per_key(batch.withColumn("_key", title_key(F.col("title"))), ["plan_id", "_key"], *order)
    known = history.select("plan_id", title_key(F.col("title")).alias("_key")).where("_key != ''").distinct()
    return some.join(known, ["plan_id", "_key"], "left_anti").drop("_key")


def stamp_owner(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """user_id of each row: its own, else its plan's."""
    owners = plans.select(F.col("id").alias("plan_id"), F.col("user_id").alias("_owner"))
    return rows.join(owners, "plan_id", "left").withColumn("user_id", F.coalesce("user_id", "_owner")).drop("_owner")


def claim_orphans(rows: DataFrame, user_id: str) -> DataFrame:
    return rows.withColumn("user_id", F.coalesce("user_id", F.lit(user_id)))


def articles_in_plan_window(records: DataFrame, windows: DataFrame, date: str, today: Column) -> DataFrame:
    """Records of plan_id whose date lies in their plan's closed window; windows: (plan_id, cutoff, stop)."""
    inside = F.col(date).cast("date").between(F.col("cutoff").cast("date"), F.coalesce(F.col("stop").cast("date"), today.cast("date")))
    return records.join(windows, "plan_id").where(inside)


def enrich_feed(candidates: DataFrame, pages: DataFrame, keep_feed_only: bool = False) -> DataFrame:
    """Candidates with their pages by url; those without a page stay only if asked, and if the feed gave a title."""
    joined = candidates.join(pages, "url", "left" if keep_feed_only else "inner")
    return joined.where(F.col("page_title").isNotNull() | (F.coalesce("feed_title", F.lit("")) != "")) if keep_feed_only else joined


def enrich_fallbacks(joined: DataFrame) -> DataFrame:
    """date, title and content of pages, with the feed's where the page has none (or fewer than 30 words)."""
    page_title = F.when(~F.coalesce(F.trim("page_title"), F.lit("")).isin("", "Untitled"), F.col("page_title"))
    words = F.size(F.filter(F.split(F.coalesce("page_content", F.lit("")), r"\s+"), lambda w: w != ""))
    content = F.when((words < 30) & (F.coalesce("feed_summary", F.lit("")) != ""), F.col("feed_summary")).otherwise(F.coalesce("page_content", F.lit("")))
    return joined.withColumns({"date": F.coalesce("page_date", "feed_date"), "title": F.coalesce(page_title, F.nullif(F.trim("feed_title"), F.lit("")), F.lit("Untitled")), "content": content})


def robots_allowed(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Pages whose path starts with no disallowed prefix of their host; hosts without rules allow all.

    A path's own prefixes, of the lengths that its host's rules have, meet the rules by equality of host and prefix.  So a rule is found by
    hash and not by comparing a host's pages with all its rules, and a host of any size is dealt over all tasks by its prefixes.
    """
    shut = rules.where("kind = 'disallow'").select(F.col("host").alias("_host"), F.col("value").alias("_prefix")).distinct()
    sizes = shut.groupBy("_host").agg(F.array_sort(F.collect_set(F.length("_prefix"))).alias("_sizes"))  # lengths of addresses: few a host
    host, path = url_authority(F.col(url)), F.coalesce(F.nullif(url_path(F.col(url)), F.lit("")), F.lit("/"))
    paths = pages.select(host.alias("_host"), path.alias("_path")).distinct()
    own = F.transform(F.filter("_sizes", lambda n: n <= F.length("_path")), lambda n: F.substring(F.col("_path"), F.lit(1), n))
    closed = paths.join(sizes, "_host").select("_host", "_path", F.explode(own).alias("_prefix")).join(shut, ["_host", "_prefix"], "left_semi").select("_host", "_path").distinct()
    rows = pages.withColumns({"_host_": host, "_path_": path})
    # a page without a host is closed by nothing
    return rows.join(closed, (F.col("_host_") == F.col("_host")) & (F.col("_path_") == F.col("_path")), "left_anti").drop("_host_", "_path_")


def cascade_delete(plans: DataFrame, articles: DataFrame, seen: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the plans of ``doomed`` (plan_id)."""
    ids = doomed.select("plan_id").distinct()
    return plans.join(ids, plans["id"] == ids["plan_id"], "left_anti"), articles.join(ids, "plan_id", "left_anti"), seen.join(ids, "plan_id", "left_anti")


def delete_articles(articles: DataFrame, seen: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles and their seen urls without those of ``doomed`` (id)."""
    ids = doomed.select("id").distinct()
    gone = articles.join(ids, "id", "left_semi").select("plan_id", "url").distinct()
    return articles.join(ids, "id", "left_anti"), seen.join(gone, ["plan_id", "url"], "left_anti")


def clear_user(plans: DataFrame, articles: DataFrame, seen: DataFrame, logs: DataFrame, user_id: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The tables without what belongs to a user: plans, articles and logs by user_id (null: nobody's, so they stay), seen urls by the user's plans."""
    others = lambda df: df.where(~F.col("user_id").eqNullSafe(F.lit(user_id)))
    own = plans.where(F.col("user_id") == user_id).select(F.col("id").alias("plan_id")).distinct()
    return others(plans), others(articles), seen.join(own, "plan_id", "left_anti"), others(logs)


def union_candidates(*lists: DataFrame, key: str = "url") -> DataFrame:
    """Candidate lists (url, pos) one after the other, each url once at its first place."""
    every = None
    for i, one in enumerate(lists):
        part = one.select(key, F.lit(i).alias("list"), F.col("pos").cast("long").alias("pos"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy(key).agg(F.min(F.struct("list", "pos")).alias("_f")).select(key, "_f.list", "_f.pos")


def longest_anchor(links: DataFrame) -> DataFrame:
    """Per page and target the longest anchor text, the earliest on ties."""
    return first_per_key(links, ["src", "dst"], F.desc(F.length("anchor")), "pos", "anchor")


def link_reach(edges: DataFrame, seeds: DataFrame, depth: int = 2, budget: int = 150, same_host: bool = False) -> DataFrame:
    """(seed, url, depth): pages that a walk of at most ``depth`` levels and ``budget`` pages reaches from each seed.

    edges: (src, dst, pos).  A level keeps the order in which its links were found, so the budget cuts as a walk would.
    same_host: addresses are normalised first, and links to another host than the seed's are never walked: they go before
    the walk, as a page's links stay on its own host.  Links are stored by the hash of the page that has them, so a level's frontier
    meets them where they lie.
    """
    from contentwatch.operators.tables import scratch, written

    spark = edges.sparkSession
    if same_host:
        normal = lambda c: normalize_url(F.col(c))
        edges = edges.select(normal("src").alias("src"), normal("dst").alias("dst"), "pos").where(F.lower(url_authority(F.col("src"))) == F.lower(url_authority(F.col("dst"))))
        edges = edges.groupBy("src", "dst").agg(F.min("pos").alias("pos"))
        seeds = seeds.select(normal("seed").alias("seed")).distinct()
    with scratch(spark, "walk") as folder:
        if same_host:
            edges = written(edges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "src"), "edges", folder)
        return written(_walk(edges, seeds, depth, budget, folder), "reached")


def _walk(edges: DataFrame, seeds: DataFrame, depth: int, budget: int, folder: str) -> DataFrame:
    from contentwatch.operators.tables import written

    frontier = seeds.select("seed", F.col("seed").alias("url"), F.array(F.lit(0)).alias("order"))
    visited = None
    for level in range(depth + 1):
        if visited is not None:
            frontier = frontier.join(visited.select("seed", "url"), ["seed", "url"], "left_anti")
        own = W.partitionBy("seed").orderBy("order")
        counted = frontier.withColumn("_n", F.row_number().over(own))
        if visited is None:
            taken = counted.where(F.col("_n") <= budget)
        else:
            used = visited.groupBy("seed").agg(F.count("*").alias("_used"))
            taken = counted.join(used, "seed").where(F.col("_n") + F.col("_used") <= budget)
        level_rows = written(taken.select("seed", "url", F.lit(level).alias("depth"), F.col("_n").alias("rank")), "level", folder)
        visited = level_rows if visited is None else visited.unionByName(level_rows)
        if level < depth:
            found = level_rows.join(edges, level_rows["url"] == edges["src"]).select("seed", F.col("dst").alias("url"), F.array("rank", "pos").alias("order"))
            frontier = found.groupBy("seed", "url").agg(F.min("order").alias("order"))
    return visited.select("seed", "url", "depth")
