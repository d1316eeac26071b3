"""Queries over URLs and text."""

from __future__ import annotations

from pyspark.sql import functions as F

from contentwatch.functions import relevance, text, urls
from contentwatch.plans.catalog import ARTICLES, Tables, query

NORMAL = "(CASE WHEN length(replace(regexp_replace({u}, '#.*$', ''), '/', '--')) - length(regexp_replace({u}, '#.*$', '')) > 2 THEN regexp_replace(regexp_replace({u}, '#.*$', ''), '/+$', '') ELSE regexp_replace({u}, '#.*$', '') END)"
PATH = "regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
HOST = "regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def of(template: str, u: str) -> str:
    return template.replace("{u}", u)


SLUG = f"coalesce(lower(list_filter(string_split({of(PATH, 'url')}, '/'), lambda s: s <> '')[-1]), '')"


@query("normalize_url", f"SELECT page_id, {of(NORMAL, 'url')} AS out FROM pages")
def normalize_url(spark, sf):
    return Tables(spark, sf).pages.select("page_id", urls.normalize_url(F.col("url")).alias("out"))


@query("resolve_url", "SELECT page_id, regexp_replace(regexp_replace(url, '(\\?|&)(utm_source|ref)=[^&#]*', '\\1', 'g'), '\\?(#|$)', '\\1') AS out FROM pages WHERE url NOT LIKE '%&%' UNION ALL SELECT page_id, regexp_replace(regexp_replace(url, '(utm_source|ref)=[^&#]*&', '', 'g'), '[&?](utm_source|ref)=[^&#]*', '', 'g') FROM pages WHERE url LIKE '%&%'")
def resolve_url(spark, sf):
    return Tables(spark, sf).pages.select("page_id", urls.drop_tracking(F.col("url")).alias("out"))


@query("url_slug", f"SELECT page_id, {SLUG} AS out FROM pages")
def url_slug(spark, sf):
    return Tables(spark, sf).pages.select("page_id", urls.url_slug(F.col("url")).alias("out"))


@query("url_source", f"SELECT {of(HOST, 'url')} AS source, count(*) AS pages FROM pages GROUP BY 1")
def url_source(spark, sf):
    return Tables(spark, sf).pages.groupBy(urls.url_source(F.col("url")).alias("source")).agg(F.count("*").alias("pages"))


DATED_URL = "'https://n.example.org/' || strftime(o_orderdate + INTERVAL 10 YEAR, CASE o_orderkey % 3 WHEN 0 THEN '%Y/%m/%d' WHEN 1 THEN '%Y-%-m-%-d' ELSE '%Y_%m_39' END) || '/story'"


@query("url_date", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 < 2 THEN (o_orderdate + INTERVAL 10 YEAR)::DATE END AS out FROM orders")
def url_date(spark, sf):
    d = F.col("o_orderdate") + F.expr("INTERVAL 10 YEARS")
    path = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "yyyy/MM/dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "yyyy-M-d")).otherwise(F.date_format(d, "yyyy_MM_'39'"))
    return Tables(spark, sf).orders.select(F.col("o_orderkey").alias("id"), urls.url_date(F.concat(F.lit("https://n.example.org/"), path, F.lit("/story"))).alias("out"))


TITLED = "(url || replace(regexp_extract(html, '<title>([^<]*)</title>', 1), ' ', CASE page_id % 3 WHEN 0 THEN '-' ELSE '/' END))"


@query("url_looks_like_article", f"SELECT page_id, regexp_matches({of(PATH, 'u')}, '[^/]') AND (regexp_matches(u, '/(19|20)\\d{{2}}[/-](0?[1-9]|1[0-2])[/-]') OR len(list_filter(regexp_split_to_array({SLUG.replace('url', 'u')}, '[-_]'), lambda w: w <> '')) >= 3) AS out FROM (SELECT page_id, {TITLED} AS u FROM pages)")
def url_looks_like_article(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    u = F.concat("url", F.regexp_replace(title, " ", F.when(F.col("page_id") % 3 == 0, "-").otherwise("/")))
    return Tables(spark, sf).pages.select("page_id", urls.url_looks_like_article(u).alias("out"))


@query("choose_canonical", f"SELECT page_id, CASE WHEN page_id % 4 < 2 THEN {of(NORMAL, 'c')} ELSE {of(NORMAL, 'url')} END AS out FROM (SELECT page_id, url, 'https://x.example.org/a/' || {SLUG} || '-more' AS c FROM pages)")
def choose_canonical(spark, sf):
    own = F.concat(F.lit("https://x.example.org/a/"), urls.url_slug(F.col("url")), F.lit("-more"))
    candidate = F.when(F.col("page_id") % 4 < 2, own).when(F.col("page_id") % 4 == 2, "https://x.example.org/other")
    return Tables(spark, sf).pages.select("page_id", urls.choose_canonical(candidate, F.col("url")).alias("out"))


HREFS = "(SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages)"


@query("page_url_filter", "SELECT page_id, url FROM pages WHERE NOT regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.(jpg|jpeg|png|gif|svg|webp|ico|pdf|zip|rar|7z|doc|docx|xls|xlsx|csv|ppt|pptx|mp3|mp4|mov|avi|xml|json|rss|atom|txt)$') AND NOT regexp_matches(url, 'tag/|/search|\\?s=|/page/|/author/|/login|/terms|/contact|/privacy|/events|/videos')")
def page_url_filter(spark, sf):
    return Tables(spark, sf).pages.where(urls.is_page_url(F.col("url"))).select("page_id", "url")


@query("article_link_filter", f"SELECT page_id, h AS link FROM (SELECT page_id, 'https://' || regexp_replace({of(HOST, 'url')}, '^www\\.', '') || href AS h, href FROM {HREFS} WHERE href LIKE '/%') WHERE regexp_extract(h, '^https://[^/?#]*([^?#]*)', 1) NOT IN ('/', '', '/index.html') AND NOT regexp_matches(href, '(?i)\\b(about|contact|privacy|terms|legal|help|faq|jobs|share|search|feed|events|videos|support|plans|follow|author|trial|login)\\b') AND NOT regexp_matches(href, '(?i)\\.(xml|json|pdf|jpg|png|css|js|svg)$')")
def article_link_filter(spark, sf):
    rows = Tables(spark, sf).pages.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).where(F.col("href").startswith("/"))
    link = F.concat(F.lit("https://"), F.regexp_replace(urls.url_host(F.col("url")), r"^www\.", ""), "href")
    return rows.withColumn("link", link).where(urls.is_article_link(F.col("link"), F.col("url"))).select("page_id", "link")


@query("public_host_filter", "SELECT o_orderkey AS id, o_orderkey % 8 IN (3, 6) AS out FROM orders")
def public_host_filter(spark, sf):
    hosts = ["http://127.0.0.1/x", "http://10.1.2.3:80/", "https://localhost/a", "https://news.example.org/a", "ftp://news.example.org/a", "http://[::1]/", "http://172.32.0.1/", "http://192.168.1.9/"]
    pick = F.element_at(F.array(*map(F.lit, hosts)), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return Tables(spark, sf).orders.select(F.col("o_orderkey").alias("id"), urls.is_public_host(pick).alias("out"))


SQUEEZED = "trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"


@query("content_hash", f"SELECT md5(lower({SQUEEZED.replace('{c}', 'text')})) AS hash, count(*) AS docs, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_hash(spark, sf):
    return Tables(spark, sf).documents.groupBy(text.content_hash(F.col("text")).alias("hash")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')"


SIMHASHES = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+3], ' ')))) AS s FROM w WHERE len(ws) >= 4),
h AS (SELECT doc_id, ('0x' || substr(md5(s), 17, 16))::UBIGINT AS h FROM s),
b AS (SELECT doc_id, i, 2 * sum((h >> i) & 1) > count(*) AS lit FROM h, (SELECT unnest(generate_series(0, 63)) AS i) GROUP BY doc_id, i),
v AS (SELECT doc_id, sum(CASE WHEN lit THEN CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << i) END ELSE 0 END)::BIGINT AS simhash FROM b GROUP BY doc_id)
SELECT d.doc_id, coalesce(simhash, 0) AS simhash FROM documents d LEFT JOIN v USING (doc_id)
"""


@query("simhash64", SIMHASHES)
def simhash64(spark, sf):
    return text.with_simhash(Tables(spark, sf).documents.select("doc_id", "text")).drop("text")


@query("hamming", "SELECT a.o_orderkey AS id, bit_count(xor(a.o_orderkey * 7919, a.o_custkey * 104729))::INTEGER AS out FROM orders a")
def hamming(spark, sf):
    return Tables(spark, sf).orders.select(F.col("o_orderkey").alias("id"), text.hamming(F.col("o_orderkey") * 7919, F.col("o_custkey") * 104729).alias("out"))


SPLIT = "list_filter(list_transform(string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])\\s+([A-Z0-9\"''])', '\\1␞\\2', 'g'), '␞'), lambda s: trim(s)), lambda s: s <> '')"
STOPS = "['" + "', '".join(text.SUMMARY_STOPS) + "']"


@query("summarize", f"""
WITH d AS (SELECT doc_id, {SPLIT} AS ss FROM documents),
s AS (SELECT doc_id, i, ss[i] AS s, regexp_extract_all(lower(ss[i]), '[a-zA-Z'']+') AS ws FROM (SELECT doc_id, ss, unnest(generate_series(1, len(ss))) AS i FROM d)),
f AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM s) WHERE length(w) > 2 AND NOT list_contains({STOPS}, w) GROUP BY 1, 2),
m AS (SELECT doc_id, max(n) AS top FROM f GROUP BY 1),
p AS (SELECT s.doc_id, s.i, sum(coalesce(f.n, 0)) AS total FROM (SELECT doc_id, i, unnest(ws) AS w FROM s) s LEFT JOIN f USING (doc_id, w) GROUP BY 1, 2),
r AS (SELECT s.doc_id, s.i, s.s, row_number() OVER (PARTITION BY s.doc_id ORDER BY round(p.total / (greatest(m.top, 1) * len(s.ws)) * CASE WHEN s.i <= 3 THEN 1.0 ELSE 0.85 END, 12) DESC, s.i) AS n FROM s JOIN p USING (doc_id, i) JOIN m USING (doc_id) WHERE len(s.ws) >= 4),
c AS (SELECT doc_id, list(s ORDER BY i) AS ss FROM r WHERE n <= 5 GROUP BY 1),
t AS (SELECT d.doc_id, array_to_string(CASE WHEN len(c.ss) >= 2 THEN c.ss ELSE d.ss[1:5] END, ' ') AS t FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, CASE WHEN len(regexp_split_to_array(trim(t), '\\s+')) > 100 THEN regexp_replace(array_to_string(regexp_split_to_array(trim(t), '\\s+')[1:100], ' '), '[,.;:]+$', '') || '...' ELSE trim(t) END AS summary FROM t
""")
def summarize(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", text.summarize(F.col("text")).alias("summary"))


PLAIN = "list_filter(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?])\\s+', '\\1␞', 'g'), '␞'), lambda s: s <> '')"


@query("lead_summary", f"""
WITH d AS (SELECT doc_id, {PLAIN} AS ss FROM documents),
l AS (SELECT doc_id, ss, list_filter(ss, lambda s: length(s) > 40)[1:2] AS big FROM d),
u AS (SELECT doc_id, big, list(s ORDER BY i) AS rest FROM (SELECT doc_id, big, s, min(i) AS i FROM (SELECT doc_id, big, ss[i] AS s, i FROM (SELECT doc_id, ss, big, unnest(generate_series(1, len(ss))) AS i FROM l)) WHERE NOT list_contains(big, s) GROUP BY 1, 2, 3) GROUP BY 1, 2),
t AS (SELECT l.doc_id, array_to_string((CASE WHEN len(l.big) < 2 THEN list_concat(l.big, coalesce(u.rest, [])) ELSE l.big END)[1:2], ' ') AS t FROM l LEFT JOIN u USING (doc_id))
SELECT doc_id, CASE WHEN len(regexp_split_to_array(trim(t), '\\s+')) > 150 THEN regexp_replace(array_to_string(regexp_split_to_array(trim(t), '\\s+')[1:150], ' '), '[,;:]$', '') || '...' ELSE trim(t) END AS summary FROM t
""")
def lead_summary(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", text.lead_summary(F.col("text")).alias("summary"))


def _suffixes_off(w: str) -> str:
    first = f"CASE WHEN {w} LIKE '%ies' THEN left({w}, -3) || 'y' WHEN {w} LIKE '%ying' THEN left({w}, -4) || 'y' WHEN {w} LIKE '%ing' THEN left({w}, -3) WHEN {w} LIKE '%ed' OR {w} LIKE '%es' THEN left({w}, -2) WHEN {w} LIKE '%s' THEN left({w}, -1) ELSE {w} END"
    for pattern, put in (("ational$", "ate"), ("tional$", "tion"), ("al$", ""), ("ment$", ""), ("ity$", ""), ("ive$", ""), ("tory$", ""), ("tion$", "")):
        first = f"regexp_replace({first}, '{pattern}', '{put}')"
    return first


def _stem_sql(w: str) -> str:
    return f"CASE WHEN length({w}) <= 3 THEN {w} ELSE (SELECT CASE WHEN length(x) > 3 THEN left(x, 5) ELSE x END FROM (SELECT {_suffixes_off(w)} AS x)) END"


@query("stem", f"SELECT w AS word, {_stem_sql('w')} AS stem, n FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY 1)")
def stem(spark, sf):
    words = Tables(spark, sf).documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).select("word", text.stem(F.col("word")).alias("stem"), "n")


STOP_LIST = "['" + "', '".join(text.STOP_WORDS) + "']"


CLEAN = "list_filter(regexp_split_to_array(regexp_replace(lower({c}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({stops}, w))"


def clean(c: str) -> str:
    """The keywords of a column, in SQL."""
    return CLEAN.replace("{c}", c).replace("{stops}", STOP_LIST)


def stemmed(words: str) -> str:
    """A list of words as their stems, in SQL; a stem of a word of over three letters keeps at most five."""
    return f"list_transform({words}, lambda w: CASE WHEN length(w) <= 3 THEN w ELSE left({_suffixes_off('w')}, 5) END)"


def rare_words(c: str) -> str:
    return f"list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({STOP_LIST}, w))"



@query("clean_keywords", f"SELECT item_id, array_to_string({clean('text')}, ' ') AS words FROM benchmark")
def clean_keywords(spark, sf):
    return Tables(spark, sf).benchmark.select("item_id", F.array_join(text.clean_keywords(F.col("text"), text.STOP_WORDS), " ").alias("words"))


@query("prompt_keywords", "SELECT item_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_\\s-]', '', 'g'), '\\s+'), lambda w: length(w) > 4 AND NOT list_contains(['about','these','their','there','would','should','could','under','which','after','before'], w)), ' ') AS words FROM benchmark")
def prompt_keywords(spark, sf):
    return Tables(spark, sf).benchmark.select("item_id", F.array_join(text.prompt_keywords(F.col("text")), " ").alias("words"))


@query("merge_keywords", """
WITH k AS (SELECT p_partkey AS id, lower(trim(w)) AS w, i FROM (SELECT p_partkey, ws[i] AS w, i FROM (SELECT p_partkey, ws, unnest(generate_series(1, len(ws))) AS i FROM (SELECT p_partkey, list_concat([p_brand], string_split(p_type, ' ')) AS ws FROM part))))
SELECT id, string_agg(w, '|' ORDER BY i) AS words FROM (SELECT id, w, min(i) AS i FROM k WHERE w <> '' GROUP BY 1, 2) GROUP BY 1
""")
def merge_keywords(spark, sf):
    return Tables(spark, sf).part.select(F.col("p_partkey").alias("id"), F.array_join(text.merge_keywords(F.concat(F.lit(" , "), "p_brand", F.lit(",")), F.split("p_type", " ")), "|").alias("words"))


@query("esg_category", "SELECT doc_id, " + "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i)\\b({w})\\b') THEN '{n}'" for n, w in text.ESG.items()) + " ELSE 'General' END AS category FROM documents")
def esg_category(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", text.esg_category(F.col("text")).alias("category"))


@query("clean_paragraphs", "SELECT d.doc_id, coalesce(out, '') AS out FROM documents d LEFT JOIN (SELECT doc_id, array_to_string(list(p ORDER BY i), chr(10) || chr(10)) AS out FROM (SELECT doc_id, p, min(i) AS i FROM (SELECT doc_id, i, trim(regexp_replace(ps[i], '\\s+', ' ', 'g')) AS p FROM (SELECT doc_id, ps, unnest(generate_series(1, len(ps))) AS i FROM (SELECT doc_id, string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)) AS ps FROM documents))) WHERE p <> '' AND NOT regexp_matches(lower(p), '^(share on |share this|follow us)') AND NOT regexp_matches(lower(p), '" + "|".join(text.BOILERPLATE) + "') GROUP BY doc_id, regexp_replace(lower(p), '[^a-z0-9]', '', 'g'), p QUALIFY row_number() OVER (PARTITION BY doc_id, regexp_replace(lower(p), '[^a-z0-9]', '', 'g') ORDER BY min(i)) = 1) GROUP BY 1) x USING (doc_id)")
def clean_paragraphs(spark, sf):
    out = text.clean_paragraphs(F.regexp_replace("text", "\n", "\n\n"))
    return Tables(spark, sf).documents.select("doc_id", out.alias("out"))


@query("escape_html", "SELECT page_id, length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS n, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS out FROM pages")
def escape_html(spark, sf):
    made = text.escape_html(F.col("html"))
    return Tables(spark, sf).pages.select("page_id", F.length(made).alias("n"), F.md5(made.cast("binary")).alias("out"))


@query("bold_md", "SELECT doc_id, md5(regexp_replace(replace(replace(text, ' the ', ' **the** '), ' de ', ' **de** '), '\\*\\*([^*]+)\\*\\*', '<strong>\\1</strong>', 'g')) AS out FROM documents")
def bold_md(spark, sf):
    marked = F.replace(F.replace("text", F.lit(" the "), F.lit(" **the** ")), F.lit(" de "), F.lit(" **de** "))
    return Tables(spark, sf).documents.select("doc_id", F.md5(text.bold_md(marked).cast("binary")).alias("out"))


@query("strip_html", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS out FROM pages")
def strip_html(spark, sf):
    return Tables(spark, sf).pages.select("page_id", F.md5(text.strip_tags(F.col("html")).cast("binary")).alias("out"))


PROMPT = "Articles about carbon emissions, the regulations of nations and her community"
LOCAL_PROMPT = PROMPT + " shonthe ereron"


@query("local_relevance", f"""
WITH q AS (SELECT list(w ORDER BY i) AS qs FROM (SELECT w, min(i) AS i FROM (SELECT ws[i] AS w, i FROM (SELECT ws, unnest(generate_series(1, len(ws))) AS i FROM (SELECT {clean("'" + LOCAL_PROMPT + "'")} AS ws))) GROUP BY 1)),
s AS (SELECT s, arg_min(w, i) AS w, min(i) AS i FROM (SELECT qs[i] AS w, {stemmed('qs')}[i] AS s, i FROM (SELECT qs, unnest(generate_series(1, len(qs))) AS i FROM q)) GROUP BY 1),
a AS (SELECT id, {stemmed(clean("title || ' ' || content"))} AS ds FROM {ARTICLES}),
m AS (SELECT a.id, count(*) FILTER (WHERE list_contains(ds, s)) AS m, count(*) AS n, coalesce(string_agg(w, ',' ORDER BY i) FILTER (WHERE list_contains(ds, s)), '') AS matched FROM a, s GROUP BY 1)
SELECT id, score, matched, n::INTEGER AS n_terms, score >= 70 AS related FROM (SELECT *, (CASE WHEN m = 0 THEN 0 WHEN m >= least(n, 2) THEN floor(70 + 30 * m / n + 0.5) ELSE floor(50 * m / least(n, 2) + 0.5) END)::INTEGER AS score FROM m)""")
def local_relevance(spark, sf):
    found = relevance.local_relevance_of(Tables(spark, sf).articles(), "id", F.lit(LOCAL_PROMPT), F.col("title"), F.col("content"), text.STOP_WORDS)
    return found.select("id", "relevance.score", F.array_join("relevance.matched", ",").alias("matched"), "relevance.n_terms", "relevance.related")


@query("term_overlap_relevance", f"SELECT id, 100.0 * len(list_filter(ws, lambda w: contains(lower(title || ' ' || content), w))) / len(ws) AS score FROM (SELECT *, list_filter(regexp_extract_all(lower('{PROMPT}'), '\\w+'), lambda w: length(w) > 2) AS ws FROM {ARTICLES})")
def term_overlap_relevance(spark, sf):
    return Tables(spark, sf).articles().select("id", relevance.term_overlap_relevance(F.lit(PROMPT), F.col("title"), F.col("content")).alias("score"))


@query("tfidf_relevance", f"""
WITH p AS (SELECT w, count(*) AS n FROM (SELECT unnest({rare_words("'" + PROMPT + "'")}) AS w) GROUP BY 1),
d AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest({rare_words("title || chr(10) || chr(10) || content")}) AS w FROM {ARTICLES}) GROUP BY 1, 2),
x AS (SELECT d.id, sum(CASE WHEN p.w IS NULL THEN (d.n * (ln(1.5) + 1)) ** 2 ELSE d.n ** 2 END) AS dd, sum(coalesce(d.n * p.n, 0)) AS dot, sum(coalesce(p.n ** 2, 0)) AS pp FROM d LEFT JOIN p USING (w) GROUP BY 1),
t AS (SELECT sum((n * (ln(1.5) + 1)) ** 2) AS every FROM p),
r AS (SELECT d.id, sum((p.n * (ln(1.5) + 1)) ** 2) AS rare FROM d JOIN p USING (w) GROUP BY 1)
SELECT a.id, round(CASE WHEN coalesce(dot, 0) = 0 THEN 0.0 ELSE least(100.0, 250 * dot / (sqrt(dd) * sqrt(pp + every - rare))) END, 6) AS score FROM {ARTICLES} a LEFT JOIN x USING (id) LEFT JOIN r USING (id), t""")
def tfidf_relevance(spark, sf):
    return Tables(spark, sf).articles().select("id", F.round(relevance.tfidf_relevance(F.lit(PROMPT), F.col("title"), F.col("content"), text.STOP_WORDS), 6).alias("score"))


@query("direct_keyword_match", f"SELECT id, len(list_filter(['her', 'stone'], lambda w: contains(lower(title || chr(10) || content), w))) > 0 AS hit FROM {ARTICLES}")
def direct_keyword_match(spark, sf):
    return Tables(spark, sf).articles().select("id", relevance.direct_keyword_match(F.lit("her; stone|of"), F.col("title"), F.col("content")).alias("hit"))


@query("body_keyword_match", f"SELECT id, regexp_matches(lower(title || ' ' || content || ' ' || url), 'ening|src1\\.') AS hit FROM {ARTICLES}")
def body_keyword_match(spark, sf):
    return Tables(spark, sf).articles().select("id", relevance.body_keyword_match(F.array(F.lit("Ening"), F.lit("src1.")), F.col("title"), F.col("content"), F.col("url")).alias("hit"))


@query("relevance_filter", f"SELECT id FROM (SELECT *, len(list_filter(regexp_extract_all(lower('tion stone'), '\\w+'), lambda w: contains(lower(title || ' ' || content), w))) AS n FROM {ARTICLES}) WHERE id % 7 = 0 OR n > 0")
def relevance_filter(spark, sf):
    prompt = F.lit("tion stone")
    score = relevance.term_overlap_relevance(prompt, F.col("title"), F.col("content"))
    direct = relevance.direct_keyword_match(prompt, F.col("title"), F.col("content"))
    return Tables(spark, sf).articles().where(relevance.relevant(score, direct, prompt, F.col("id") % 7 != 0)).select("id")


@query("parse_verdict", "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN 70.0 WHEN 2 THEN value ELSE 70.0 END AS score, CASE event_id % 4 WHEN 0 THEN value >= 70 WHEN 1 THEN true WHEN 2 THEN false ELSE true END AS related, CASE event_id % 4 WHEN 0 THEN event_type ELSE '' END AS reason FROM events")
def parse_verdict(spark, sf):
    reply = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('```json\n{"score": '), "value", F.lit(', "reason": "'), "event_type", F.lit('"}\n```'))).when(F.col("event_id") % 4 == 1, "not json").when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"score": '), "value", F.lit(', "related": false}')))
    return Tables(spark, sf).events.select(F.col("event_id").alias("id"), relevance.parse_verdict(reply).alias("v")).select("id", "v.score", "v.related", "v.reason")


@query("key_insights", f"""
WITH s AS (SELECT doc_id, i, trim(ss[i]) AS s FROM (SELECT doc_id, ss, unnest(generate_series(1, len(ss))) AS i FROM (SELECT doc_id, {PLAIN} AS ss FROM documents))),
f AS (SELECT doc_id, s, min(i) AS i FROM s WHERE length(s) BETWEEN 30 AND 250 AND list_has_any({stemmed(clean('s'))}, ['ening', 'shon', 'entio', 'para', 'nicht']) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) <= 3)
SELECT d.doc_id, coalesce(string_agg(s, '|' ORDER BY i), '') AS insights FROM documents d LEFT JOIN f USING (doc_id) GROUP BY 1""")
def key_insights(spark, sf):
    stems = F.array(*[F.lit(s) for s in ("ening", "shon", "entio", "para", "nicht")])
    return Tables(spark, sf).documents.select("doc_id", F.array_join(text.key_insights(F.col("text"), stems, text.STOP_WORDS), "|").alias("insights"))
