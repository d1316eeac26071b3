"""Rules of the monitoring library on hand-made rows."""

import difflib
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from contentwatch.functions import dates, html, relevance, text, urls
from contentwatch.operators import dedup, digest, gates, joins, stats
from contentwatch.sources import feeds, store
from contentwatch.streaming import jobs

NOW = datetime(2026, 7, 10, 12)


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def strings(spark, values, schema="s string"):
    return spark.createDataFrame([(v,) for v in values], schema)


def test_raw_dates(spark):
    want = {
        "just now": date(2026, 7, 10), "yesterday": date(2026, 7, 9), "3 weeks ago": date(2026, 6, 19), "2 months ago": date(2026, 5, 11), "3rd July 2026": date(2026, 7, 3),
        "July 3, 2026": date(2026, 7, 3), "12/05/2026": date(2026, 12, 5), "13/05/2026": date(2026, 5, 13), "May": None, "July 4": None, "2026": date(2026, 1, 1),
        "1994-12-31": None, "2028-01-01": None, "soon": None, None: None, "": None, "Updated today 2026-01-01": date(2026, 7, 10), "2026-07-03T10:00:00+05:30": date(2026, 7, 3),
    }
    rows = strings(spark, list(want)).select("s", dates.normalize_date(F.col("s"), NOW).alias("d")).collect()
    assert {r.s: r.d for r in rows} == want


def test_windows(spark):
    days = spark.createDataFrame([(date(2026, 7, 3),), (date(2026, 7, 2),), (date(2026, 7, 10),), (date(2026, 7, 11),), (None,)], "d date")
    inside = lambda keep: [r[0] for r in days.select(dates.in_date_window(F.col("d"), F.lit(datetime(2026, 7, 3, 12)), F.lit(None).cast("timestamp"), NOW, keep)).collect()]
    assert inside(False) == [True, False, True, False, False]
    assert inside(True)[-1] is True
    lit = lambda x: F.lit(x).cast("string")
    cutoff = lambda *a: one(spark, dates.plan_window(NOW, *map(lit, a))["cutoff"])[0]
    assert cutoff(None, None) == datetime(2026, 7, 3, 12) and cutoff("custom", "x") == datetime(2026, 7, 3, 12) and cutoff("custom", "3") == datetime(2026, 7, 7, 12)
    assert cutoff("other", None, "last90", None, None) == datetime(2026, 4, 11, 12) and cutoff("other", None, "custom", "2026-01-02", None) == datetime(2026, 1, 2)
    assert cutoff("other", None, "nonsense", None, None) == datetime(2026, 6, 10, 12)


def test_lastmod_keeps_the_wall_clock(spark):
    rows = strings(spark, ["2026-07-01T23:30:00+05:30", "2026-07-01T23:30:00Z", "2026-07-01", "x", None]).select(dates.parse_lastmod(F.col("s"))).collect()
    assert [r[0] for r in rows] == [datetime(2026, 7, 1, 23, 30)] * 2 + [datetime(2026, 7, 1), None, None]


def test_urls(spark):
    lit = F.lit
    assert one(spark, urls.normalize_url(lit("https://a.b/c/#x")), urls.normalize_url(lit("https://a.b/")), urls.url_slug(lit("https://a.b/C/Dé/?q=/z")), urls.url_slug(lit("https://a.b/")))[:4] == ["https://a.b/c", "https://a.b", "dé", ""]
    assert one(spark, urls.drop_tracking(lit("https://a.b/?utm_source=x&p=1&ref=2#f")), urls.url_source(lit("https://a.b:80/x y"))) == ["https://a.b/?p=1#f", "a.b:80"]
    assert one(spark, urls.url_date(lit("https://a.b/2026/07/3/x")), urls.url_date(lit("https://a.b/2026/13/3")), urls.choose_canonical(lit("https://c.d/story-1"), lit("https://a.b/story/")), urls.choose_canonical(lit("https://c.d/other"), lit("https://a.b/story/"))) == [date(2026, 7, 3), None, "https://c.d/story-1", "https://a.b/story"]


def test_html_dates_titles_and_signals(spark):
    body = "".join(f"<p>{'word ' * 11}end {i}.</p>" for i in range(12))
    page = f"""<html lang=en><head><title>T | Site</title><meta property="og:title" content="OG"><meta property="og:type" content="Article">
    <link rel="canonical" href="https://a.b/x-y-z"><script>var t = "</p><p>no";</script><script type="application/ld+json">[{{"@type": ["NewsArticle"], "datePublished": "soon"}}]</script></head>
    <body><nav><p>menu</p></nav><div class="cookie-bar"><p>cookies</p></div><article><h1>One &amp; only</h1><h2>s</h2>{body}<time datetime="2026-07-01">x</time><p>open<p>more</article><a href="/y#f"> link <b>text</b></a></body></html>"""
    pages = html.parse_pages(spark.createDataFrame([(1, "https://a.b/x-y-z", page), (2, "https://a.b/", None), (3, "https://a.b/2026/02/03/a", "<p>Published on 5 March 2026</p>")], "page_id long, url string, html string"))
    p = F.col("page")
    got = html.extract_date(pages, NOW).select("page_id", "published", html.page_title(p).alias("t"), html.page_title(p, "social").alias("s"), html.page_text(p).alias("x"), html.article_signals(p, F.col("url")).alias("g"), "page").withColumn("c", html.classify_article(F.col("g"))).orderBy("page_id").collect()
    assert [r.published for r in got] == [date(2026, 7, 1), None, date(2026, 3, 5)]
    assert [r.t for r in got] == ["One & only", "Untitled", "Untitled"] and got[0].s == "OG"
    assert "cookies" not in got[0].x and "menu" not in got[0].x and got[0].x.endswith("open\nmore")
    g = got[0].g
    assert (g.jsonld_article, g.jsonld_news, g.open_graph, g.time_tag, g.heading_structure, g.url_structure, g.content_density) == (False, True, True, True, True, True, True)
    assert got[0].c.decision_path == "strong_declaration" and not got[1].c.is_article
    assert [(x.url, x.text) for x in got[0].page.links] == [("https://a.b/y", "link text")] and got[0].page.canonical == "https://a.b/x-y-z"


def test_feeds(spark):
    docs = spark.createDataFrame([
        ("s1", '<?xml version="1.0"?><urlset xmlns="http://x"><url><loc> https://a/1#f </loc><lastmod>2026-01-01</lastmod></url><url><loc></loc></url><url><loc>https://a/f.pdf</loc></url></urlset>'),
        ("s2", '<?xml version="1.0"?><sm:urlset xmlns:sm="http://x"><sm:url><sm:loc>https://a/2</sm:loc></sm:url></sm:urlset>'), ("bad", "<urlset><url><loc>https://a/3"), ("none", None),
        ("i", "<sitemapindex><sitemap><loc>s1</loc></sitemap><sitemap><loc>j</loc></sitemap></sitemapindex>"), ("j", "<sitemapindex><sitemap><loc>s2</loc></sitemap></sitemapindex>"),
        ("r", "<rss><channel><item><link>https://a/r</link><description>&lt;b&gt;d&lt;/b&gt;</description></item><item><title>no link</title></item></channel></rss>"),
    ], "url string, body string")
    assert {(r.source, r.url, r.date_raw) for r in feeds.parse_sitemap(docs.where("url != 'bad'")).collect()} == {("s1", "https://a/1", "2026-01-01"), ("s1", "https://a/f.pdf", None), ("s2", "https://a/2", None)}
    assert [r.url for r in feeds.parse_sitemap(docs.where("url = 's1'"), pages_only=True).collect()] == ["https://a/1"]
    assert [(r.url, r.summary) for r in feeds.parse_rss(docs).collect()] == [("https://a/r", "d")]
    found = feeds.resolve_sitemaps(spark.createDataFrame([("i",)], "url string"), docs)
    assert {r.url for r in found.collect()} == {"https://a/1", "https://a/f.pdf", "https://a/2"}
    assert {r.url for r in feeds.resolve_sitemaps(spark.createDataFrame([("i",)], "url string"), docs, levels=1).collect()} == {"https://a/1", "https://a/f.pdf"}


def greedy(records):
    kept = []
    for r in records:
        pos, url, digest_, sim, title = r
        title = (title or "").lower()
        for k in kept:
            other = (k[4] or "").lower()
            if url == k[1] or digest_ and digest_ == k[2] or sim and k[3] and (sim ^ k[3]).bit_count() <= 3 or title and other and difflib.SequenceMatcher(None, title, other).ratio() >= 0.9:
                break
        else:
            kept.append(r)
    return [r[0] for r in kept]


@pytest.mark.parametrize("seed", [1, 2])
def test_deduplicate_equals_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    base = [rng.getrandbits(62) for _ in range(6)]
    titles = ["quarterly report on water use", "quarterly report on water uses", "quarterly reports on water uses", "Untitled", "", None, "ab", "a completely other heading"]
    records = [(i, f"u{rng.randrange(60)}", rng.choice([None, "", f"h{rng.randrange(60)}"]), rng.choice([0, rng.getrandbits(62), rng.choice(base) ^ 1 << rng.randrange(62)]), rng.choice(titles) if rng.random() < 0.4 else f"t{rng.getrandbits(60)}") for i in range(70)]
    df = spark.createDataFrame(records, "pos long, canonical_url string, content_hash string, simhash long, title string")
    assert sorted(r.pos for r in dedup.deduplicate(df.repartition(5)).collect()) == greedy(records)


def test_similar_titles_lose_nothing(spark):
    rng = random.Random(9)
    titles = {"".join(rng.choices("abcd ", k=rng.randrange(1, 26))) for _ in range(60)}
    titles |= {t[:i] + rng.choice("abcd") + t[i + 1 :] for t in list(titles) for i in [rng.randrange(len(t))]}
    got = {(r.value, r.other) for r in dedup.similar_titles(strings(spark, sorted(titles), "value string")).collect()}
    assert got == {(a, b) for a in titles for b in titles if a != b and len(a) > 2 and len(b) > 2 and difflib.SequenceMatcher(None, a, b).ratio() >= 0.9}


def test_stems_relevance_and_verdicts(spark):
    words = ["policies", "carrying", "running", "based", "cities", "boxes", "cats", "as", "national", "regulation"]
    assert [r[0] for r in strings(spark, words).select(text.stem(F.col("s"))).collect()] == ["polic", "carry", "runn", "bas", "c", "box", "cat", "as", "nate", "regul"]
    stops = text.STOP_WORDS
    score = lambda q, t: one(spark, relevance.local_relevance(F.lit(q), F.lit(""), F.lit(t), stops)["score"])[0]
    assert [score("the of", "x"), score("carbon", "carbon"), score("carbon water solar", "carbon"), score("carbon water solar", "carbon water"), score("carbon", "none")] == [70, 100, 25, 90, 0]
    v = [list(r[0]) for r in strings(spark, ['```json\n{"score": 40}\n```', "nonsense", '{"related": false}', None]).select(relevance.parse_verdict(F.col("s"))).collect()]
    assert [(x[0], x[1]) for x in v] == [(40.0, False), (70.0, True), (70.0, False), (70.0, True)]


def test_summaries(spark):
    assert one(spark, text.summarize(F.lit("")), text.summarize(F.lit("One only."))) == ["", "One only."]
    long = " ".join(f"Sentence number {i} tells about water and about carbon today." for i in range(30))
    got = one(spark, text.summarize(F.lit(long)))[0]
    assert got.startswith("Sentence number 0 tells") and len(got.split()) <= 101


def test_gates_links_and_walk(spark):
    edges = spark.createDataFrame([("a", "b", 0), ("a", "c", 1), ("b", "a", 0), ("b", "d", 1), ("c", "e", 0), ("d", "f", 0)], "src string, dst string, pos int")
    seeds = spark.createDataFrame([("a",)], "seed string")
    reach = lambda d, n: {(r.url, r.depth) for r in joins.link_reach(edges, seeds, d, n).collect()}
    assert reach(2, 100) == {("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 2)}
    assert reach(2, 4) == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    links = spark.createDataFrame([("https://ab.c/x?eu=1", "About EU law", 0), ("https://eu.c/europe", "other", 1), ("https://x.c/eu", "museum", 2)], "url string, text string, pos int")
    assert [(r.pos, r.score) for r in stats.rank_links_by_keywords(links, ["eu"]).orderBy("pos").collect()] == [(0, 2), (2, 1)]
    assert one(spark, gates.utility_reason(F.lit("https://a.b/"), F.lit(None).cast("string"), F.lit(1), F.lit(0)), gates.utility_reason(F.lit("https://a.b/x"), F.lit("t"), F.lit(100), F.lit(66)))[:2] == ["Homepage", "Contains mostly links and navigation elements"]


def test_recipients_and_upsert(spark):
    groups = [[("a", True, ["b@x", "a@x"]), ("b", False, ["z@x"]), ("c", True, ["a@x", "c@x"])], None]
    df = spark.createDataFrame([(g,) for g in groups], "g array<struct<name: string, active: boolean, emails: array<string>>>")
    assert [r[0] for r in df.select(digest.plan_recipients(F.col("g"))).collect()] == [["a@x", "b@x", "c@x"], []]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    assert sorted(tuple(r) for r in store.upsert(old, new, ["k"], [F.desc("v")]).collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_new_articles_batches_are_tried_again_safely(spark, tmp_path):
    got = []
    run = jobs.new_articles_batch(str(tmp_path / "seen"), lambda rows, n: got.append((n, sorted(r.url for r in rows.collect()))), "url")
    rows = lambda *u: spark.createDataFrame([("p", x) for x in u], "plan_id string, url string")
    run(rows("a", "b", "a"), 0)
    run(rows("b", "c"), 1)
    run(rows("b", "c"), 1)
    assert got == [(0, ["a", "b"]), (1, ["c"]), (1, ["c"])]
