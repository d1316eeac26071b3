"""Queries over joins, windows, aggregates and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentwatch.functions import dates
from contentwatch.functions.text import STOP_WORDS, with_simhash
from contentwatch.operators import dedup, digest, gates, joins, sentences, stats
from contentwatch.operators.tables import scratch, written
from contentwatch.plans.catalog import ARTICLES, DATED, LOG, NOW, PLANS, Tables, query
from contentwatch.plans.url_queries import SIMHASHES, clean, stemmed

N = f"TIMESTAMP '{NOW}'"


def now():
    return F.lit(NOW).cast("timestamp")

CUTOFF = f"(CASE fetch_period WHEN 'day' THEN {N} - INTERVAL 1 DAY WHEN 'week' THEN {N} - INTERVAL 7 DAY WHEN 'month' THEN {N} - INTERVAL 30 DAY WHEN 'custom' THEN {N} - to_days(fetch_period_days::INTEGER) ELSE {N} - INTERVAL 7 DAY END)"


def windows(t: Tables):
    w = dates.plan_window(now(), F.col("fetch_period"), F.col("fetch_period_days"))
    return t.plans().select(F.col("id").alias("plan_id"), w.alias("w")).select("plan_id", "w.cutoff", "w.stop")


@query("plan_window", f"SELECT id AS plan_id, {CUTOFF} AS cutoff FROM {PLANS}")
def plan_window(spark, sf):
    return windows(Tables(spark, sf)).select("plan_id", "cutoff")


@query("in_date_window", f"SELECT id, pub_date BETWEEN DATE '2001-06-10' AND DATE '2001-07-10' AS inside FROM {DATED}")
def in_date_window(spark, sf):
    return Tables(spark, sf).dated().select("id", dates.in_date_window(F.col("pub_date"), now() - F.expr("INTERVAL 30 DAYS"), F.lit(None).cast("timestamp"), now()).alias("inside"))


@query("recent_instants", "SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-13 12:00:00' AND ts <= TIMESTAMP '2024-01-21 12:00:00'")
def recent_instants(spark, sf):
    return Tables(spark, sf).events.where(dates.recent_instant(F.col("ts"), F.lit("2024-01-20 12:00:00").cast("timestamp"), 7)).select(F.col("event_id").alias("id"))


@query("articles_in_plan_window", f"SELECT a.id, a.plan_id, a.pub_date FROM {DATED} a JOIN {PLANS} p ON p.id = a.plan_id WHERE a.pub_date BETWEEN {CUTOFF}::DATE AND DATE '{NOW[:10]}'")
def articles_in_plan_window(spark, sf):
    t = Tables(spark, sf)
    return joins.articles_in_plan_window(t.dated(), windows(t), "pub_date", now()).select("id", "plan_id", "pub_date")


STYLES = "CASE id % 6 WHEN 0 THEN strftime(pub_date, '%Y-%m-%d') WHEN 1 THEN strftime(pub_date, '%B %-d, %Y') ELSE '' END"


@query("normalize_date", f"SELECT id, CASE id % 7 WHEN 5 THEN DATE '2001-06-19' WHEN 6 THEN NULL ELSE CASE WHEN year(pub_date) >= 1995 THEN pub_date END END AS date FROM {DATED}")
def normalize_date(spark, sf):
    d, k = F.col("pub_date"), F.col("id") % 7
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MMMM d, yyyy")).when(k == 2, F.concat(F.lit("Published on "), F.date_format(d, "d MMM yyyy"))).when(k == 3, F.date_format(d, "yyyy-MM-dd'T'08:30:00'Z'")).when(k == 4, F.date_format(d, "MM/dd/yyyy")).when(k == 5, "3 weeks ago").otherwise("soon")
    return Tables(spark, sf).dated().select("id", dates.normalize_date(raw, now()).alias("date"))


@query("find_date_text", f"SELECT id, CASE id % 3 WHEN 0 THEN strftime(pub_date, '%Y-%m-%d') WHEN 1 THEN strftime(pub_date, '%-d %b %Y') END AS found FROM {DATED}")
def find_date_text(spark, sf):
    d, k = F.col("pub_date"), F.col("id") % 3
    raw = F.when(k == 0, F.concat(F.lit("on 3 May "), F.date_format(d, "yyyy-MM-dd"), F.lit(" at"))).when(k == 1, F.concat(F.lit("seen "), F.date_format(d, "d MMM yyyy"), F.lit("!"))).otherwise("none 12 here")
    return Tables(spark, sf).dated().select("id", dates.find_date_text(raw).alias("found"))


@query("parse_lastmod", f"SELECT id, CASE id % 4 WHEN 0 THEN pub_date::TIMESTAMP WHEN 1 THEN pub_date + INTERVAL 30600 SECOND WHEN 2 THEN pub_date + INTERVAL 30660 SECOND END AS ts FROM {DATED}")
def parse_lastmod(spark, sf):
    d, k = F.date_format("pub_date", "yyyy-MM-dd"), F.col("id") % 4
    raw = F.when(k == 0, d).when(k == 1, F.concat(d, F.lit("T08:30:00+05:30"))).when(k == 2, F.concat(d, F.lit("T08:31Z"))).otherwise("yesterday")
    return Tables(spark, sf).dated().select("id", dates.parse_lastmod(raw).alias("ts"))


@query("prefilter_lastmod", f"SELECT id FROM {DATED} WHERE id % 5 = 0 OR pub_date >= DATE '2000-01-01'")
def prefilter_lastmod(spark, sf):
    lastmod = F.when(F.col("id") % 5 != 0, F.col("pub_date").cast("timestamp"))
    return Tables(spark, sf).dated().where(dates.prefilter_lastmod(lastmod, F.lit("2000-01-01").cast("timestamp"))).select("id")


@query("next_run", f"SELECT id, CASE id % 4 WHEN 0 THEN CASE WHEN id % 24 > 12 THEN DATE '2001-07-10' ELSE DATE '2001-07-11' END + to_hours((id % 24)::INTEGER) WHEN 1 THEN CASE WHEN id % 24 > 12 THEN DATE '2001-07-10' ELSE DATE '2001-07-12' END + to_hours((id % 24)::INTEGER) WHEN 2 THEN CASE WHEN id % 28 + 1 > 10 OR (id % 28 + 1 = 10 AND id % 24 > 12) THEN DATE '2001-07-01' ELSE DATE '2001-08-01' END + to_days((id % 28)::INTEGER) + to_hours((id % 24)::INTEGER) ELSE {N} + INTERVAL 45 MINUTE END AS next FROM {PLANS}")
def next_run(spark, sf):
    k = F.col("id")
    freq = F.element_at(F.array(*map(F.lit, ["daily", "weekly", "monthly", "interval"])), (k % 4 + 1).cast("int"))
    clock = F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":00"))
    return Tables(spark, sf).plans().select("id", dates.next_run(now(), freq, clock, F.array(F.lit("Tue"), F.lit("Thu")), (k % 28 + 1).cast("int"), F.lit(45)).alias("next"))


@query("format_duration", "SELECT event_id AS id, CASE WHEN s = 0 THEN '0s' ELSE trim(CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' ELSE '' END || CASE WHEN s % 3600 >= 60 THEN (s % 3600 // 60) || 'm ' ELSE '' END || CASE WHEN s % 60 > 0 THEN (s % 60) || 's' ELSE '' END) END AS out FROM (SELECT event_id, event_id * 7 % 9000 AS s FROM events)")
def format_duration(spark, sf):
    return Tables(spark, sf).events.select(F.col("event_id").alias("id"), dates.format_duration(F.col("event_id") * 7 % 9000).alias("out"))


# joins


@query("new_articles_only", f"SELECT id, plan_id, url FROM (SELECT * FROM {ARTICLES} WHERE id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY plan_id, url ORDER BY id) = 1) a WHERE NOT EXISTS (SELECT 1 FROM {ARTICLES} s WHERE s.id % 3 = 0 AND s.plan_id = a.plan_id AND s.url = a.url)")
def new_articles_only(spark, sf):
    a = Tables(spark, sf).articles()
    return joins.new_articles_only(a.where("id % 3 != 0"), a.where("id % 3 = 0"), "id").select("id", "plan_id", "url")


@query("new_titles_only", f"SELECT id, plan_id FROM (SELECT *, regexp_replace(lower(trim(title)), '[^a-z0-9]', '', 'g') AS k FROM {ARTICLES} WHERE id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY plan_id, regexp_replace(lower(trim(title)), '[^a-z0-9]', '', 'g') ORDER BY id) = 1) a WHERE k = '' OR k NOT IN (SELECT regexp_replace(lower(trim(title)), '[^a-z0-9]', '', 'g') FROM {ARTICLES} h WHERE h.id % 2 = 0 AND h.plan_id = a.plan_id)")
def new_titles_only(spark, sf):
    a = Tables(spark, sf).articles()
    return joins.new_titles_only(a.where("id % 2 = 1"), a.where("id % 2 = 0"), "id").select("id", "plan_id")


@query("stamp_owner", f"SELECT a.id, coalesce(CASE WHEN a.id % 10 = 0 THEN 'own' END, p.user_id) AS user_id FROM {DATED} a LEFT JOIN {PLANS} p ON p.id = a.plan_id")
def stamp_owner(spark, sf):
    t = Tables(spark, sf)
    return joins.stamp_owner(t.dated().withColumn("user_id", F.when(F.col("id") % 10 == 0, "own")), t.plans()).select("id", "user_id")


@query("claim_orphans", "SELECT CASE WHEN id % 4 = 0 THEN 'admin' ELSE 'u' END AS user_id, count(*) AS n FROM (SELECT o_orderkey AS id FROM orders) GROUP BY 1")
def claim_orphans(spark, sf):
    rows = Tables(spark, sf).dated().withColumn("user_id", F.when(F.col("id") % 4 != 0, "u"))
    return joins.claim_orphans(rows, "admin").groupBy("user_id").agg(F.count("*").alias("n"))


@query("enrich_feed", "SELECT d.doc_id, p.page_id FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id WHERE p.page_id IS NOT NULL OR d.doc_id % 2 = 0")
def enrich_feed(spark, sf):
    t = Tables(spark, sf)
    candidates = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("url"), F.when(F.col("doc_id") % 2 == 0, "t").alias("feed_title"))
    pages = t.pages.select("page_id", F.col("page_id").cast("string").alias("url"), F.lit("x").alias("page_title"))
    return joins.enrich_feed(candidates, pages, True).select("doc_id", "page_id")


@query("enrich_fallbacks", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Page' WHEN 1 THEN 'Feed' ELSE 'Untitled' END AS title, CASE WHEN len(regexp_split_to_array(trim(text), '\\s+')) < 30 THEN 'short' ELSE md5(text) END AS content FROM documents")
def enrich_fallbacks(spark, sf):
    k = F.col("doc_id") % 3
    rows = Tables(spark, sf).documents.select("doc_id", F.when(k == 0, "Page").when(k == 1, "Untitled").alias("page_title"), F.when(k == 1, " Feed ").when(k == 2, " ").alias("feed_title"), F.col("text").alias("page_content"), F.lit("short").alias("feed_summary"), F.lit(None).cast("date").alias("page_date"), F.lit(None).cast("date").alias("feed_date"))
    out = joins.enrich_fallbacks(rows)
    return out.select("doc_id", "title", F.when(F.col("content") == "short", "short").otherwise(F.md5(F.col("content").cast("binary"))).alias("content"))


@query("robots_allowed", "SELECT page_id FROM pages WHERE NOT (regexp_matches(url, '^https?://(m|blog)\\.') AND regexp_matches(url, '^https?://[^/]*/(en/[1-4]|fr)'))")
def robots_allowed(spark, sf):
    pages = Tables(spark, sf).pages
    hosts = pages.select(F.regexp_extract("url", "^https?://([^/]*)", 1).alias("host")).where("host LIKE 'm.%' OR host LIKE 'blog.%'").distinct()
    rules = hosts.select("host", F.lit("disallow").alias("kind"), F.explode(F.array(*[F.lit(x) for x in ("/en/1", "/en/2", "/en/3", "/en/4", "/fr")])).alias("value"))
    return joins.robots_allowed(pages, rules).select("page_id")


@query("plan_status_join", f"SELECT p.id AS plan_id, p.status, (SELECT count(*) FROM {DATED} a WHERE a.plan_id = p.id) AS articles, (SELECT count(*) FROM events e WHERE e.user_id = p.id) AS emails FROM {PLANS} p")
def plan_status_join(spark, sf):
    t = Tables(spark, sf)
    return stats.plan_status_join(t.plans().select("id", "status"), t.dated(), t.events.select(F.col("user_id").alias("plan_id")))


@query("candidate_locations", "SELECT 's' || n_nationkey AS site, 's' || n_nationkey || p AS url, CASE WHEN p = '/rss' THEN 0 ELSE 1000000 + i - 1 END AS pos FROM nation, (SELECT unnest(ps) AS p, unnest(generate_series(1, len(ps))) AS i FROM (SELECT ['/a.xml', '/rss', '/feed'] AS ps))")
def candidate_locations(spark, sf):
    from contentwatch.sources.feeds import candidate_locations

    sites = Tables(spark, sf).nation.select(F.concat(F.lit("s"), "n_nationkey").alias("site"))
    known = sites.select("site", F.concat("site", F.lit("/rss")).alias("url"), F.lit(0).alias("pos"))
    return candidate_locations(sites, known, ["/a.xml", "/rss", "/feed"])


EDGES = "(SELECT o_custkey AS src, (o_custkey * 7 + o_orderkey % 5) % 1500 AS dst, o_orderkey AS pos FROM orders)"


@query("link_reach", f"""
WITH s AS (SELECT c_custkey AS seed FROM customer WHERE c_custkey % 20 = 3),
f1 AS (SELECT seed, dst AS url, min(pos) AS pos FROM s JOIN {EDGES} e ON e.src = s.seed WHERE dst <> seed GROUP BY 1, 2),
l1 AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY pos) AS rank FROM f1 QUALIFY rank + 1 <= 12),
f2 AS (SELECT seed, dst AS url, min(rank * 1000000000 + e.pos) AS pos FROM l1 JOIN {EDGES} e ON e.src = l1.url WHERE dst <> seed AND NOT EXISTS (SELECT 1 FROM l1 x WHERE x.seed = l1.seed AND x.url = dst) GROUP BY 1, 2),
l2 AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY pos) AS rank FROM f2 QUALIFY rank + 1 + (SELECT count(*) FROM l1 x WHERE x.seed = f2.seed) <= 12)
SELECT seed, seed AS url, 0 AS depth FROM s UNION ALL SELECT seed, url, 1 FROM l1 UNION ALL SELECT seed, url, 2 FROM l2
""")
def link_reach(spark, sf):
    """Walks from a twentieth of the plans, with a budget that cuts their second level."""
    t = Tables(spark, sf)
    edges = t.orders.select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") * 7 + F.col("o_orderkey") % 5) % 1500).alias("dst"), F.col("o_orderkey").cast("int").alias("pos"))
    seeds = t.customer.where("c_custkey % 20 = 3").select(F.col("c_custkey").alias("seed"))
    return joins.link_reach(edges, seeds, 2, 12)


@query("cascade_delete", f"SELECT id FROM {DATED} WHERE plan_id % 5 <> 0")
def cascade_delete(spark, sf):
    t = Tables(spark, sf)
    doomed = t.plans().where("id % 5 = 0").select(F.col("id").alias("plan_id"))
    return joins.cascade_delete(t.plans(), t.dated(), t.dated().select("plan_id", "url"), doomed)[1].select("id")


@query("delete_articles", f"SELECT plan_id, url FROM {DATED} WHERE (plan_id, url) NOT IN (SELECT plan_id, url FROM {DATED} WHERE status = 'F')")
def delete_articles(spark, sf):
    """What stays seen once all articles of one status are deleted."""
    articles = Tables(spark, sf).dated()
    return joins.delete_articles(articles, articles.select("plan_id", "url"), articles.where("status = 'F'").select("id"))[1]


@query("clear_user", f"""
WITH own AS (SELECT id FROM {PLANS} WHERE user_id = '3')
SELECT 'plans' AS tab, count(*) AS n FROM {PLANS} WHERE user_id <> '3'
UNION ALL SELECT 'articles', count(*) FROM {DATED} WHERE plan_id % 25 <> 3
UNION ALL SELECT 'seen', count(*) FROM {DATED} WHERE plan_id NOT IN (SELECT id FROM own)
UNION ALL SELECT 'logs', count(*) FROM {LOG} WHERE user_id <> 3
""")
def clear_user(spark, sf):
    """How much of each table stays without one user's rows."""
    t = Tables(spark, sf)
    articles = t.dated().withColumn("user_id", (F.col("plan_id") % 25).cast("string"))
    kept = joins.clear_user(t.plans(), articles, t.dated().select("plan_id", "url"), t.log().withColumn("user_id", F.col("user_id").cast("string")), "3")
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n") for name, df in zip(("plans", "articles", "seen", "logs"), kept)]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query("near_duplicate_pairs", f"""
WITH v AS (SELECT DISTINCT simhash AS v FROM ({SIMHASHES}) WHERE simhash <> 0)
SELECT a.v AS value, b.v AS other FROM v a JOIN v b ON a.v <> b.v AND bit_count(xor(a.v, b.v)) <= 3
""")
def near_duplicate_pairs(spark, sf):
    documents = Tables(spark, sf).documents.select("doc_id", "text")
    return dedup.near_simhashes(with_simhash(documents).select(F.col("simhash").alias("value")))


@query("similar_title_pairs")
def similar_title_pairs(spark, sf):
    """Among the plans' names, of which many differ in a digit."""
    return dedup.similar_titles(Tables(spark, sf).customer.select(F.lower("c_name").alias("value")))


@query("deduplicate")
def deduplicate(spark, sf):
    from contentwatch.functions.text import content_hash, strip_tags
    from contentwatch.functions.urls import normalize_url

    text = strip_tags(F.col("html"))
    records = Tables(spark, sf).pages.select(F.col("page_id").alias("pos"), normalize_url(F.col("url")).alias("canonical_url"), content_hash(text).alias("content_hash"), text.alias("text"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return dedup.deduplicate(with_simhash(records).drop("text")).select("pos")


@query("union_candidates", "SELECT url, min_by(list, list * 100000000 + pos) AS list, min_by(pos, list * 100000000 + pos) AS pos FROM (SELECT o_custkey % 700 AS url, 0 AS list, o_orderkey AS pos FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_custkey % 900, 1, o_orderkey FROM orders) GROUP BY 1")
def union_candidates(spark, sf):
    o = Tables(spark, sf).orders
    return joins.union_candidates(o.where("o_orderkey % 2 = 0").select((F.col("o_custkey") % 700).alias("url"), F.col("o_orderkey").alias("pos")), o.select((F.col("o_custkey") % 900).alias("url"), F.col("o_orderkey").alias("pos")))


@query("frontier_minus_visited", "SELECT DISTINCT o_custkey AS url FROM orders WHERE o_orderkey % 9 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 2)")
def frontier_minus_visited(spark, sf):
    o = Tables(spark, sf).orders.select(F.col("o_custkey").alias("url"), "o_orderkey")
    return o.where("o_orderkey % 9 = 1").select("url").distinct().join(o.where("o_orderkey % 9 = 2").select("url"), "url", "left_anti")


@query("upsert_by_key", "SELECT o_custkey AS key, max_by(o_orderkey, o_orderkey) AS value FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1 UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0)")
def upsert_by_key(spark, sf):
    from contentwatch.sources.store import upsert

    t = Tables(spark, sf)
    existing = t.customer.select(F.col("c_custkey").alias("key"), F.lit(-1).cast("long").alias("value"))
    batch = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"))
    return upsert(existing, batch, ["key"], [F.desc("value")])


@query("upsert_buckets", "SELECT c_custkey AS key, CASE WHEN c_custkey % 3 = 0 THEN o.value ELSE -1 END AS value FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS value FROM orders GROUP BY 1) o ON o_custkey = c_custkey WHERE c_custkey % 3 <> 0 OR o.value IS NOT NULL UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey % 3 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def upsert_buckets(spark, sf):
    """Customers' newest orders, put into a stored table by key."""
    from contentwatch.operators.tables import table_path
    from contentwatch.sources import store

    t = Tables(spark, sf)
    store.write_buckets(t.customer.select(F.col("c_custkey").alias("key"), F.lit(-1).cast("long").alias("value")), path := table_path(spark, "store"), ["key"])
    batch = t.orders.where("o_custkey % 3 = 0").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"))
    store.upsert_buckets(batch, path, ["key"], [F.desc("value")])
    return spark.read.parquet(path).select("key", "value")


@query("title_similarity")
def title_similarity(spark, sf):
    """Each plan's name beside the next one's, both ways."""
    named = Tables(spark, sf).customer.select("c_custkey", F.lower("c_name").alias("title"))
    after = named.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("title").alias("other"))
    return named.join(after, "c_custkey").select("c_custkey", dedup.title_ratio("title", "other").alias("there"), dedup.title_ratio("other", "title").alias("back"))


# windows and rankings


@query("first_per_url", f"SELECT id, plan_id, url FROM {ARTICLES} QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1")
def first_per_url(spark, sf):
    return joins.first_per_key(Tables(spark, sf).articles(), ["url"], "id").select("id", "plan_id", "url")


@query("longest_anchor", "SELECT src, dst, anchor, pos FROM (SELECT l_orderkey % 100 AS src, l_partkey % 50 AS dst, l_returnflag || repeat('x', (l_linenumber % 3)::INTEGER) AS anchor, l_orderkey * 10 + l_linenumber AS pos FROM lineitem) QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY length(anchor) DESC, pos, anchor) = 1")
def longest_anchor(spark, sf):
    anchor = F.concat("l_returnflag", F.repeat(F.lit("x"), (F.col("l_linenumber") % 3).cast("int")))
    links = Tables(spark, sf).lineitem.select((F.col("l_orderkey") % 100).alias("src"), (F.col("l_partkey") % 50).alias("dst"), anchor.alias("anchor"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return joins.longest_anchor(links)


@query("last_n_per_plan", f"SELECT plan_name, id FROM {LOG} QUALIFY row_number() OVER (PARTITION BY plan_name ORDER BY ts DESC, id DESC) <= 100")
def last_n_per_plan(spark, sf):
    return stats.last_n_per_key(Tables(spark, sf).log(), "plan_name", 100, F.desc("ts"), F.desc("id")).select("plan_name", "id")


@query("number_digest_items", f"SELECT id, plan_id, row_number() OVER (PARTITION BY plan_id ORDER BY pub_date DESC, id) AS item FROM {DATED}")
def number_digest_items(spark, sf):
    return digest.number_items(Tables(spark, sf).dated(), F.desc("pub_date"), "id").select("id", "plan_id", "item")


@query("share_of_max", f"WITH c AS (SELECT company AS source, count(*) AS articles FROM {DATED} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) SELECT source, articles, floor(100.0 * articles / (SELECT max(articles) FROM c) + 0.5)::BIGINT AS share FROM c")
def share_of_max(spark, sf):
    return stats.share_of_max(stats.top_sources(Tables(spark, sf).dated()))


@query("sentence_rank", f"SELECT doc_id, i, s FROM (SELECT doc_id, ss[i] AS s, i - 1 AS i FROM (SELECT doc_id, ss, unnest(generate_series(1, len(ss))) AS i FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])\\s+([A-Z0-9\"''])', '\\1␞\\2', 'g'), '␞'), lambda s: trim(s)), lambda s: s <> '') AS ss FROM documents))) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length(s) DESC, i) <= 5")
def sentence_rank(spark, sf):
    from contentwatch.functions.text import sentences

    rows = Tables(spark, sf).documents.select("doc_id", F.posexplode(sentences(F.col("text"))).alias("i", "s"))
    return stats.last_n_per_key(rows, "doc_id", 5, F.desc(F.length("s")), "i").select("doc_id", "i", "s")


@query("articles_newest_first", f"SELECT id, pub_date FROM {DATED} ORDER BY pub_date DESC NULLS FIRST, id LIMIT 500")
def articles_newest_first(spark, sf):
    return Tables(spark, sf).dated().select("id", "pub_date").orderBy(F.desc_nulls_first("pub_date"), "id").limit(500)


@query("recent_logs", f"SELECT id, ts, type FROM {LOG} ORDER BY ts DESC, id LIMIT 1000")
def recent_logs(spark, sf):
    return Tables(spark, sf).log().select("id", "ts", "type").orderBy(F.desc("ts"), "id").limit(1000)


@query("recent_errors", f"SELECT id, ts FROM {LOG} WHERE type = 'error' ORDER BY ts DESC, id LIMIT 20")
def recent_errors(spark, sf):
    return Tables(spark, sf).log().where("type = 'error'").select("id", "ts").orderBy(F.desc("ts"), "id").limit(20)


@query("recent_articles", f"SELECT id, title FROM {ARTICLES} WHERE plan_id = 'src3' ORDER BY id DESC LIMIT 5")
def recent_articles(spark, sf):
    return gates.filter_by_source(Tables(spark, sf).articles(), "src3").select("id", "title").orderBy(F.desc("id")).limit(5)


@query("email_history", "SELECT user_id AS plan_id, ts, CASE WHEN event_id % 4 < 3 THEN array_to_string(['a', 'b', 'c'][1:event_id % 4], ', ') ELSE 'a, b +1 more' END AS recipients, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 7 END AS articles, event_type AS status FROM events")
def email_history(spark, sf):
    k = (F.col("event_id") % 4).cast("int")
    sends = Tables(spark, sf).events.select(F.col("user_id").alias("plan_id"), "ts", F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), k).alias("recipients"), F.when(F.col("event_id") % 2 == 1, 7).alias("articles_count"), F.col("event_type").alias("status"))
    return stats.email_history(sends)


@query("page_budget", f"SELECT id, plan_id FROM {ARTICLES} QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY id) <= 20")
def page_budget(spark, sf):
    return stats.last_n_per_key(Tables(spark, sf).articles(), "plan_id", 20, "id").select("id", "plan_id")


@query("rank_links_by_keywords", f"SELECT id, CASE WHEN regexp_matches(lower(title), '(^|[^a-z0-9])on([^a-z0-9]|$)|tion') THEN 2 ELSE 1 END AS score FROM {ARTICLES} WHERE regexp_matches(lower(title), '(^|[^a-z0-9])on([^a-z0-9]|$)|tion|/77') OR regexp_matches(url, 'org/77')")
def rank_links_by_keywords(spark, sf):
    links = Tables(spark, sf).articles().select("id", "url", F.col("title").alias("text"))
    return stats.rank_links_by_keywords(links, ["on", "TION", " /77 ", ""]).select("id", "score")


QUESTION = "Which whation shonthe ereron?"
ANSWERS = f"""
WITH t AS (SELECT id, title, url, string_split(regexp_replace(title || '. ' || content, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM {ARTICLES}),
s AS (SELECT id, title, url, i AS pos, trim(parts[i]) AS sentence FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM t)),
q AS (SELECT {stemmed(f"list_distinct({clean(chr(39) + QUESTION + chr(39))})")} AS qs),
h AS (SELECT s.*, len(list_filter(qs, lambda x: list_contains({stemmed(clean('sentence'))}, x))) / least(len(qs), 3) AS score FROM s, q WHERE length(sentence) >= 15),
b AS (SELECT * FROM h WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY regexp_replace(lower(sentence), '[^a-z0-9_]', '', 'g') ORDER BY score DESC, id, pos) = 1)
SELECT sentence, title, url, score FROM b ORDER BY score DESC, id, pos LIMIT 3"""


@query("search_sentences", ANSWERS)
def search_sentences(spark, sf):
    return sentences.search(Tables(spark, sf).articles().withColumn("summary", F.col("content")), QUESTION, n=3)


@query("ask_sentence_index", ANSWERS)
def ask_sentence_index(spark, sf):
    with scratch(spark, "sentences") as folder:
        sentences.write_index(Tables(spark, sf).articles().withColumn("summary", F.col("content")), folder, buckets=16)
        return written(sentences.ask(spark, folder, QUESTION, n=3, buckets=16), "answers")


# aggregates


@query("article_counts", f"SELECT p.id, (SELECT count(*) FROM {DATED} a WHERE a.plan_id = p.id)::INTEGER AS articles_count FROM {PLANS} p")
def article_counts(spark, sf):
    t = Tables(spark, sf)
    return stats.article_counts(t.plans().select("id"), t.dated())


@query("overview", f"SELECT (SELECT count(*) FROM {PLANS} WHERE status = 'running') AS running, (SELECT count(*) FROM {DATED} WHERE pub_date = DATE '2001-07-10') AS today, (SELECT count(*) FROM events WHERE event_type = 'signup') AS emails, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors")
def overview(spark, sf):
    t = Tables(spark, sf)
    return stats.overview(t.plans(), t.dated(), t.log().where("type = 'signup'"), t.log(), now().cast("date"))


@query("top_sources", f"SELECT CASE WHEN company = '5-LOW' THEN 'Unknown source' ELSE company END AS source, count(*) AS articles FROM {DATED} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_sources(spark, sf):
    return stats.top_sources(Tables(spark, sf).dated().withColumn("company", F.when(F.col("company") == "5-LOW", F.when(F.col("id") % 2 == 0, "")).otherwise(F.col("company"))))


@query("knowledge_summary", f"SELECT plan_id, count(*) AS articles, count(DISTINCT company) AS sources, min(pub_date) AS first_date, max(pub_date) AS last_date FROM {DATED} GROUP BY 1")
def knowledge_summary(spark, sf):
    return stats.knowledge_summary(Tables(spark, sf).dated())


@query("plan_stats", f"SELECT p.id AS plan_id, 2 AS urls, 3 AS recipients, (SELECT count(*) FROM {DATED} a WHERE a.plan_id = p.id) AS articles, (SELECT count(*) FROM events e WHERE e.user_id = p.id) AS emails FROM {PLANS} p")
def plan_stats(spark, sf):
    t = Tables(spark, sf)
    return stats.plan_stats(t.plans(), t.dated(), t.events.select(F.col("user_id").alias("plan_id")))


@query("date_coverage_route", "SELECT c_custkey AS site, avg(CASE WHEN o_orderkey IS NULL THEN NULL WHEN o_orderkey % 11 <> 0 THEN 1 ELSE 0 END) AS coverage, CASE WHEN count(o_orderkey) = 0 THEN 3 WHEN avg(CASE WHEN o_orderkey % 11 <> 0 THEN 1 ELSE 0 END) >= 0.9 THEN 1 ELSE 2 END AS route FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_custkey % 3 > 0 GROUP BY 1")
def date_coverage_route(spark, sf):
    t = Tables(spark, sf)
    entries = t.orders.where("o_custkey % 3 > 0").select(F.col("o_custkey").alias("site"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate")).alias("date"))
    return stats.date_coverage_route(entries, t.customer.select(F.col("c_custkey").alias("site")))


REASON = "CASE event_type WHEN 'view' THEN 'selected' WHEN 'click' THEN 'out of range' WHEN 'signup' THEN 'no date' WHEN 'error' THEN 'not relevant' ELSE 'few words' END"


def judged(t: Tables):
    reason = F.when(F.col("event_type") == "view", "selected").when(F.col("event_type") == "click", "out of range").when(F.col("event_type") == "signup", "no date").when(F.col("event_type") == "error", "not relevant").otherwise("few words")
    return t.events.select((F.col("user_id") % 200).alias("seed"), (F.col("user_id") % 20).alias("plan_id"), F.concat(F.lit("s"), F.col("event_id") % 7).alias("source"), reason.alias("reason"))


@query("crawl_summary", f"SELECT seed, count(*) AS processed, count(*) FILTER (reason IN ('no date', 'out of range')) AS by_date, count(*) FILTER (reason = 'not relevant') AS by_prompt, count(*) FILTER (reason = 'selected') AS selected, CASE WHEN count(*) FILTER (reason = 'selected') > 0 THEN 'ok' WHEN count(*) FILTER (reason IN ('no date', 'out of range')) = count(*) THEN 'No articles found for the selected date range.' WHEN count(*) FILTER (reason = 'not relevant') = count(*) THEN 'No articles matched the monitoring scope prompt.' ELSE 'No relevant articles found.' END AS verdict FROM (SELECT user_id % 200 AS seed, {REASON} AS reason FROM events) GROUP BY 1")
def crawl_summary(spark, sf):
    return stats.crawl_summary(judged(Tables(spark, sf)))


@query("metric_totals", "SELECT sum(value) FILTER (event_type = 'view') AS processed, sum(value) FILTER (event_type = 'click') AS selected, 0.0::DOUBLE AS rejected, sum(value) FILTER (event_type = 'error') AS seconds, count(*) FILTER (event_type = 'signup' AND user_id % 2 = 0) AS calls_a, count(*) FILTER (event_type = 'signup' AND user_id % 2 = 1) AS calls_b FROM events")
def metric_totals(spark, sf):
    name = F.element_at(F.create_map(*map(F.lit, ["view", "processed", "click", "selected", "error", "seconds", "signup", "call", "purchase", "other"])), F.col("event_type"))
    found = stats.metric_totals(Tables(spark, sf).events.select(name.alias("name"), "value", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("provider")), ["a", "b"])
    return found.select(*[F.round(c, 6).alias(c) if k == "double" else c for c, k in found.dtypes])


@query("dashboard_cube", f"SELECT CASE grouping(plan_id, source) WHEN 3 THEN 'all' WHEN 1 THEN 'plan' ELSE 'source' END AS level, plan_id, source, count(*) FILTER (reason = 'selected') AS selected, count(*) FILTER (reason <> 'selected') AS rejected, floor(100.0 * count(*) FILTER (reason = 'selected') / count(*) + 0.5)::BIGINT AS selected_pct, floor(100.0 * count(*) FILTER (reason <> 'selected') / count(*) + 0.5)::BIGINT AS rejected_pct FROM (SELECT user_id % 20 AS plan_id, 's' || (event_id % 7) AS source, {REASON} AS reason FROM events) GROUP BY GROUPING SETS ((), (plan_id), (plan_id, source))")
def dashboard_cube(spark, sf):
    return stats.dashboard_cube(judged(Tables(spark, sf)))


@query("prorated_metrics", f"WITH s AS (SELECT user_id % 20 AS key, count(*) AS urls, count(*) FILTER (event_type = 'view') AS selected, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1), t AS (SELECT sum(urls) AS u, sum(selected) AS sel FROM s) SELECT key, floor(12345 * (urls / u) + 0.5)::BIGINT AS seconds, floor(777 * (selected / sel) + 0.5)::BIGINT AS calls, floor(bad * (selected / (selected + 3)) + 0.5)::BIGINT AS rejected FROM s, t")
def prorated_metrics(spark, sf):
    e = Tables(spark, sf).events
    s = e.groupBy((F.col("user_id") % 20).alias("key")).agg(F.count("*").alias("urls"), F.count_if(F.col("event_type") == "view").alias("selected"), F.count_if(F.col("event_type") == "error").alias("plan_rejected")).withColumn("plan_selected", F.col("selected") + 3)
    totals = e.agg(F.count("*").alias("total_urls"), F.count_if(F.col("event_type") == "view").alias("total_selected"), F.lit(12345).alias("total_seconds"), F.lit(777).alias("total_calls"))
    return stats.prorated_metrics(s, totals)


@query("urls_processed_from_log", f"SELECT plan_name, count(*) FILTER (contains(event, 'click') OR contains(event, '\"k\": 7')) AS urls FROM {LOG} GROUP BY 1")
def urls_processed_from_log(spark, sf):
    return stats.urls_processed_from_log(Tables(spark, sf).log(), ["click", '"k": 7'])


@query("distinct_monitored_urls", f"SELECT url, min_by(label, id * 10 + i) AS label FROM (SELECT id, urls[i] AS url, urls[i] AS label, i FROM {PLANS}, (SELECT unnest([1, 2]) AS i)) GROUP BY 1")
def distinct_monitored_urls(spark, sf):
    from contentwatch.sources.store import explode_plan_urls

    return stats.distinct_monitored_urls(explode_plan_urls(Tables(spark, sf).plans()))


@query("explode_plan_urls", f"SELECT id AS plan_id, i - 1 AS pos, urls[i] AS url, urls[i] AS label, 'default' AS method, 2 AS depth FROM {PLANS}, (SELECT unnest([1, 2]) AS i)")
def explode_plan_urls(spark, sf):
    from contentwatch.sources.store import explode_plan_urls

    return explode_plan_urls(Tables(spark, sf).plans())


@query("explode_mixed_urls", f"""
SELECT id AS plan_id, 0 AS pos, urls[1] AS url, urls[1] AS label, 'default' AS method, 2 AS depth FROM {PLANS}
UNION ALL SELECT id, 1, urls[2], 'nation ' || c_nationkey, 'bfs', CASE id % 4 WHEN 0 THEN 2 ELSE id % 4 END FROM {PLANS}
UNION ALL SELECT id, 3, 'https://c' || id || '.example.org', 'https://c' || id || '.example.org', 'default', 3 FROM {PLANS}""")
def explode_mixed_urls(spark, sf):
    from contentwatch.sources.store import explode_plan_urls

    plans = Tables(spark, sf).plans()
    entry = F.to_json(F.struct(F.get("urls", F.lit(1)).alias("url"), F.concat(F.lit("nation "), "user_id").alias("label"), F.lit("bfs").alias("crawlMethod"), (F.col("id") % 4).alias("depth")))
    listed = F.concat(F.lit('["'), F.get("urls", F.lit(0)), F.lit('", '), entry, F.lit(', 7, {"depth": "3", "url": "https://c'), "id", F.lit('.example.org"}]'))
    return explode_plan_urls(plans.select("id", F.parse_json(listed).alias("urls")))


@query("log_type_counts", f"SELECT type, count(*) AS events FROM {LOG} GROUP BY 1")
def log_type_counts(spark, sf):
    return stats.log_type_counts(Tables(spark, sf).log())


@query("delivery_outcome", "SELECT user_id AS send, count(*) FILTER (event_type = 'view') AS sent, count(*) FILTER (event_type <> 'view') AS failed, CASE WHEN count(*) FILTER (event_type <> 'view') = 0 THEN 'sent' WHEN count(*) FILTER (event_type = 'view') = 0 THEN 'failed' ELSE 'partial' END AS outcome FROM events GROUP BY 1")
def delivery_outcome(spark, sf):
    sends = Tables(spark, sf).events.select(F.col("user_id").alias("send"), F.when(F.col("event_type") == "view", "sent").otherwise("failed").alias("status"))
    return stats.delivery_outcome(sends, ["send"])


@query("plan_recipients", f"SELECT id, CASE WHEN id % 3 = 0 THEN c_mktsegment || '@example.org' ELSE name || '@example.org,' || c_mktsegment || '@example.org' END AS recipients FROM {PLANS}")
def plan_recipients(spark, sf):
    listed = digest.plan_recipients(F.col("recipient_groups"))
    return Tables(spark, sf).plans().select("id", F.array_join(F.array_sort(listed, lambda a, b: F.when(a.startswith("Customer"), -1).when(b.startswith("Customer"), 1).otherwise(0)), ",").alias("recipients"))


@query("chat_context", f"SELECT plan_id, string_agg('Title: ' || title || chr(10) || 'Date: ' || pub_date || chr(10) || 'Summary: ' || status || chr(10) || 'URL: ' || url, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pub_date DESC, id) AS context FROM (SELECT * FROM {DATED} QUALIFY row_number() OVER (PARTITION BY plan_id ORDER BY pub_date DESC, id) <= 15) GROUP BY 1")
def chat_context(spark, sf):
    return digest.chat_context(Tables(spark, sf).dated().withColumnRenamed("status", "summary"), F.desc("pub_date"), "id")


@query("build_digest", f"SELECT p.id AS plan_id, r AS recipient, p.name || ' — ' || count(*) || CASE WHEN count(*) = 1 THEN ' new article' ELSE ' new articles' END AS subject, count(*)::INTEGER AS n_articles, string_agg(a.title || '=General', '|' ORDER BY a.pub_date DESC, a.id) AS listed FROM (SELECT *, unnest(CASE WHEN id % 3 = 0 THEN [c_mktsegment || '@example.org'] ELSE [name || '@example.org', c_mktsegment || '@example.org'] END) AS r FROM {PLANS}) p JOIN {DATED} a ON a.plan_id = p.id GROUP BY p.id, p.name, r")
def build_digest(spark, sf):
    t = Tables(spark, sf)
    rows = digest.build_digest(t.plans(), t.dated().withColumnRenamed("status", "summary"), F.desc("pub_date"), "id")
    return rows.select("plan_id", "recipient", "subject", "n_articles", F.array_join(F.transform("items", lambda i: F.concat(i["title"], F.lit("="), i["category"])), "|").alias("listed"))


@query("search_activity_log", f"SELECT id, event FROM {LOG} WHERE type = 'click' AND (contains(lower(event), 'k\": 1') OR contains(lower(plan_name), 'k\": 1'))")
def search_activity_log(spark, sf):
    return gates.search_activity_log(Tables(spark, sf).log(), "click", 'K": 1').select("id", "event")


@query("filter_by_source", f"SELECT id, plan_id FROM {ARTICLES} WHERE contains(lower(url), 'src1') OR contains(company, 'fr')")
def filter_by_source(spark, sf):
    return gates.filter_by_source(Tables(spark, sf).articles(), None, "SRC1", "FR").select("id", "plan_id")


@query("content_gates", "SELECT page_id, CASE WHEN length(html) <= 500 THEN 'short html' WHEN length(t) < 80 THEN 'short text' WHEN len(list_filter(regexp_split_to_array(trim(t), '\\s+'), lambda w: w <> '')) < 200 THEN 'few words' END AS gate FROM (SELECT page_id, html, trim(regexp_replace(regexp_replace(html, '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages)")
def content_gates(spark, sf):
    t = F.trim(F.regexp_replace(F.regexp_replace("html", "(?s)<[^>]+>", " "), r"\s+", " "))
    return Tables(spark, sf).pages.select("page_id", gates.content_gates(F.col("html"), t).alias("gate"))


@query("cleanup_articles", f"SELECT id FROM {ARTICLES} WHERE NOT regexp_matches(title, '(?i)(cookie|privacy|terms|gdpr|disclaimer|legal|contact-us|about-us|contact us|about us|login|signup|subscribe)')")
def cleanup_articles(spark, sf):
    return gates.cleanup_articles(Tables(spark, sf).articles().withColumn("summary", F.lit(None).cast("string"))).select("id")


KEY = "regexp_replace(lower(trim(title)), '[^a-z0-9]', '', 'g')"


@query("rejection_reason", f"""
WITH a AS (SELECT id, plan_id, {KEY} AS k, CASE WHEN id % 9 = 0 THEN 'no date' WHEN id % 7 = 0 THEN 'out of range' WHEN id % 11 = 0 THEN 'excluded page' WHEN len(list_filter(regexp_split_to_array(trim(content), '\\s+'), lambda w: w <> '')) < 200 THEN 'few words' END AS early FROM {ARTICLES}),
f AS (SELECT plan_id, k, min(id) AS first FROM a WHERE early IS NULL GROUP BY 1, 2)
SELECT a.id, coalesce(early, CASE WHEN a.id > f.first THEN 'duplicate title' WHEN a.id % 5 = 0 THEN 'keyword mismatch' WHEN a.id % 4 = 0 THEN 'not relevant' ELSE 'selected' END) AS reason FROM a LEFT JOIN f USING (plan_id, k)
""")
def rejection_reason(spark, sf):
    a = Tables(spark, sf).articles().withColumns({"pos": F.col("id"), "date": F.when(F.col("id") % 9 != 0, F.lit("2001-01-01").cast("date")), "excluded": F.when(F.col("id") % 11 == 0, "Homepage"), "text": F.col("content")})
    return gates.rejection_reason(a, F.col("id") % 7 != 0, F.col("id") % 4 != 0, F.col("id") % 5 != 0).select("id", "reason")
