"""Streams with keyed state, the outbox, bucketed upserts, prefix tables, walks and titles against plain models."""

import difflib
import random
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from contentwatch.operators import dedup, joins
from contentwatch.plans.page_queries import state_store
from contentwatch.sources import store
from contentwatch.streaming import jobs

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)


def run_stream(spark, tmp_path, job, schema, mode, until):
    """Runs a job over the files that lie in ``in``, from its checkpoint, and gives all rows it has put out so far."""
    out = str(tmp_path / "out")

    def put(batch, number):
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(out)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with state_store(spark):
        job(stream).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(out)


def put_file(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))


def test_quota_windows_from_the_first_request(spark, tmp_path):
    rng, schema = random.Random(3), "ts timestamp, client string, route string"
    events = [(T0 + timedelta(seconds=rng.randrange(0, 4 * 3600)), f"c{rng.randrange(3)}", rng.choice(["a", "b"])) for _ in range(400)]
    events += [(T0, "edge", "a"), (T0 + timedelta(minutes=14, seconds=59), "edge", "a"), (T0 + timedelta(minutes=15), "edge", "a")]
    events.sort(key=lambda e: e[0] + timedelta(seconds=rng.randrange(0, 800)))  # out of order, within the delay
    end = [(T0 + timedelta(hours=9), "end", "a")]
    for part in (events[:150], events[150:300]):
        put_file(spark, tmp_path, part, schema)
    job = lambda s: jobs.quota(s, {"a": 3, "b": 5})
    run_stream(spark, tmp_path, job, schema, "append", 2)
    for part in (events[300:], end):  # a restart from the checkpoint
        put_file(spark, tmp_path, part, schema)
    rows = run_stream(spark, tmp_path, job, schema, "append", 4).collect()
    times = defaultdict(list)
    for ts, client, route in events:
        times[client, route].append(ts)
    want = set()
    for (client, route), own in times.items():
        start, n = None, 0
        for ts in sorted(own):
            if start is not None and ts >= start + timedelta(minutes=15):
                want.add((start, client, route, n, n > {"a": 3, "b": 5}[route]))
                start, n = None, 0
            start, n = start or ts, n + 1
        want.add((start, client, route, n, n > {"a": 3, "b": 5}[route]))
    utc = lambda t: t.astimezone(timezone.utc)
    assert len(rows) == len(want) and {(utc(r.start), r.client, r.route, r.requests, r.over) for r in rows} == want


def test_last_n_keeps_a_bounded_list(spark, tmp_path):
    schema, rng, rows = "plan_id long, id long, ts timestamp, event string", random.Random(4), []
    for k in range(6):
        part = [(rng.randrange(2), 100 * k + i, T0 + timedelta(seconds=rng.randrange(9000)), None if i % 9 == 0 else "e") for i in range(40)]
        rows += part
        put_file(spark, tmp_path, part, schema)
    found = run_stream(spark, tmp_path, lambda s: jobs.last_n(s, 7), schema, "update", 6)
    assert found.groupBy("plan_id", "_batch").count().agg(F.max("count")).first()[0] == 7
    for plan in (0, 1):
        own = sorted((r[2], r[1]) for r in rows if r[0] == plan)[-7:]
        last = found.where(F.col("plan_id") == str(plan)).where(F.col("_batch") == found.agg(F.max("_batch")).first()[0]).collect()
        assert sorted(r.id for r in last) == sorted(i for _, i in own)


def test_digest_is_delivered_once(spark, tmp_path):
    plans = spark.createDataFrame([(1, "one", True, [("g", True, ["a@x.y", "b@x.y"])]), (2, "two", False, [("g", True, ["c@x.y"])])], "id long, name string, auto_mail boolean, recipient_groups array<struct<name: string, active: boolean, emails: array<string>>>")
    articles = spark.createDataFrame([(1, 1, "t", "s", "u"), (2, 1, "t2", "s", "u2"), (3, 2, "t3", "s", "u3")], "id long, plan_id long, title string, summary string, url string")
    mailed, outbox = [], str(tmp_path / "outbox")

    def deliver(rows, number):
        mailed.extend((number, r.plan_id, r.recipient) for r in rows.collect())
        if number == 5 and not failed:
            failed.append(1)
            raise RuntimeError("after delivery")

    failed: list = []
    batch = jobs.digest_batch(plans, deliver, "id", outbox=outbox)
    with pytest.raises(RuntimeError):
        batch(articles, 5)
    assert jobs.undelivered(spark, outbox).count() == 2
    batch(articles, 5)
    batch(articles, 6)
    batch(articles, 6)
    assert sorted(mailed) == [(n, 1, r) for n in (5, 6) for r in ("a@x.y", "b@x.y")]
    assert {r.batch for r in jobs.undelivered(spark, outbox).collect()} == {5}


def test_upsert_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    path, rng = str(tmp_path / "store"), random.Random(2)
    rows = [(i, f"k{i % 3}", i) for i in range(300)]
    store.write_buckets(spark.createDataFrame(rows, "a long, b string, v long"), path, ["a", "b"], 16)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    before, want = files(), {(a, b): v for a, b, v in rows}
    batch = [(7, "k1", 70), (7, "k1", 71), (7, "k1", 71), (1000, None, 5)]
    store.upsert_buckets(spark.createDataFrame(batch, "a long, b string, v long"), path, ["a", "b"], buckets=16)
    want |= {(7, "k1"): 71, (1000, None): 5}
    kept = {p for p, t in before.items() if files().get(p) == t}
    assert len(before) - 2 <= len(kept) < len(before)
    assert {(r.a, r.b): r.v for r in spark.read.parquet(path).collect()} == want and spark.read.parquet(path).count() == len(want)
    store.upsert_buckets(spark.createDataFrame([(rng.randrange(400), "k0", -i) for i in range(50)], "a long, b string, v long").limit(0), path, ["a", "b"], buckets=16)
    assert spark.read.parquet(path).count() == len(want)


def test_robots_by_prefix(spark):
    rng = random.Random(1)
    hosts = ["big.example.com"] * 9 + ["small.example.com"]
    urls = [f"https://{rng.choice(hosts)}/" + "/".join(rng.choice("abc") for _ in range(rng.randrange(4))) for _ in range(600)] + ["https://big.example.com", "https://none.example.com/a", "nonsense", None]
    rules = [("big.example.com", "disallow", p) for p in ("/a/b", "/c", "/b/b/b", "/a/b")] + [("big.example.com", "sitemap", "/b"), ("small.example.com", "disallow", "/")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    found = joins.robots_allowed(pages, spark.createDataFrame(rules, "host string, kind string, value string"))

    def allowed(url):
        host, _, path = (url or "").removeprefix("https://").partition("/")
        return not any(kind == "disallow" and h == host and f"/{path}".startswith(p) for h, kind, p in rules) or not (url or "").startswith("https://")

    assert sorted(r.page_id for r in found.collect()) == [i for i, u in enumerate(urls) if allowed(u)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StartsWith" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_walk_stays_on_its_host(spark):
    edges = [("https://a.b/", "https://a.b/1#x", 0), ("https://a.b/", "https://c.d/1", 1), ("https://a.b/1/", "https://a.b/2/", 0), ("https://c.d/1", "https://a.b/9", 0), ("https://a.b/2", "https://a.b/3", 0), ("https://a.b/", "https://A.B/1/", 2)]
    rows = spark.createDataFrame(edges, "src string, dst string, pos int")
    got = joins.link_reach(rows, spark.createDataFrame([("https://a.b/",), ("https://a.b",)], "seed string"), 2, 150, same_host=True)
    assert {(r.url.lower(), r.depth) for r in got.collect()} >= {("https://a.b", 0), ("https://a.b/1", 1), ("https://a.b/2", 2)}
    assert not [r for r in got.collect() if "c.d" in r.url or r.url.endswith(("/3", "/9"))]


def test_similar_titles_equal_all_pairs(spark):
    rng, words, titles = random.Random(5), "water use report quarterly on the of annual market news energy".split(), set()
    for _ in range(60):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
        for _ in range(4):
            titles.add(t)
            i = rng.randrange(len(t) + 1)
            t = rng.choice([t[:i] + rng.choice("abx ") + t[i:], t[:i] + t[i + 1 :]]) or "a"
    titles |= {"aa", "ab", "aab", "a", "ab" * 150, "ab" * 150 + "x", "a" * 20, "a" * 21, "customer#01", "customer#02"}
    want = {(a, b) for a in titles for b in titles if a != b and difflib.SequenceMatcher(None, a, b).ratio() >= 0.9}
    rows = spark.createDataFrame([(t,) for t in [*titles, *titles, None, ""]], "value string")
    found = dedup.similar_titles(rows).collect()
    assert len(found) == len(want) and {(r.value, r.other) for r in found} == want
    assert dedup.similar_titles(rows.limit(0)).count() == 0


def test_matched_characters_equal_difflib():
    rng, pairs = random.Random(11), [("ab" * 150, "ba" * 140), ("x\0", "x"), ("é😀a", "😀aé")]
    for _ in range(800):
        alphabet = rng.choice(["ab", "abc ", "abcdefgh", "éü😀a"])
        a = "".join(rng.choices(alphabet, k=rng.randrange(1, 40)))
        b = a[: rng.randrange(len(a) + 1)] + rng.choice(alphabet) + a[rng.randrange(len(a)) :]
        pairs += [(a, b), (b, "".join(rng.choices(alphabet, k=rng.randrange(1, 30))))]
    got = dedup.matched_characters([a for a, _ in pairs], [b for _, b in pairs])
    assert got.tolist() == [sum(m.size for m in difflib.SequenceMatcher(None, a, b).get_matching_blocks()) for a, b in pairs]


def test_pairs_that_meet_twice_come_once(spark):
    titles = ["title ab 0123456789", "title ba 0123456789", "title abab 01234567", "title baba 01234567", "title aa 0123456789"]
    got = [(r.value, r.other) for r in dedup.similar_titles(spark.createDataFrame([(t,) for t in titles], "value string")).collect()]
    assert sorted(got) == sorted((a, b) for a in titles for b in titles if a != b and difflib.SequenceMatcher(None, a, b).ratio() >= 0.9)


def test_near_values_are_not_sent_through_the_driver(spark):
    values = spark.createDataFrame([(1 << i,) for i in range(20)] + [(0,), ((1 << 62) - 1,)], "value long")
    near = dedup.near_simhashes(values)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    assert len(near.collect()) == 20 * 19


def test_titles_cut_at_one_length_meet_in_few_segments(spark):
    """Unrelated titles of 60 characters out of few syllables: their rarest bigrams met nearly all of them."""
    rng, syllables = random.Random(3), "on th er re le ment de la ou tion an in he st ea or".split()
    titles = {"".join(rng.choice(syllables) + rng.choice(["", "", " "]) for _ in range(40))[: rng.choice([60, 60, 60, 59, 57, 55, 48, 34, 30])] for _ in range(300)}
    for t in sorted(titles)[:150]:
        for _ in range(rng.randint(1, 7)):
            i = rng.randrange(len(t))
            t = rng.choice([t[:i] + "x" + t[i:], t[:i] + t[i + 1 :], t[:i] + "y" + t[i + 1 :], t[:i] + t[i + 1 :] + "z"])
        titles |= {t, t[:60]}
    want = {(a, b) for a in titles for b in titles if a != b and difflib.SequenceMatcher(None, a, b).ratio() >= 0.9}
    rows = spark.createDataFrame([(t,) for t in sorted(titles)], "value string")
    found = dedup.similar_titles(rows).collect()
    assert len(found) == len(want) > 200 and {(r.value, r.other) for r in found} == want
    keyed = rows.select("value", F.length("value").alias("n"), F.xxhash64("value").alias("id"))
    assert dedup.by_segments(keyed, 0.9).count() < 10 * len(want)
