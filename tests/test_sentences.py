"""The sentence index, urls of mixed kinds and stores read from a database."""

import json
import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from contentwatch.functions.text import STOP_WORDS
from contentwatch.operators import sentences
from contentwatch.sources import store


def scanned(stems, articles, question, n):
    """A plain scan; ``stems``: word to stem."""
    keywords = lambda text: [w for w in re.split(r"\s+", re.sub(r"[^\w\s]", " ", text.lower(), flags=re.A)) if len(w) > 2 and w not in STOP_WORDS]
    wanted = [stems[w] for w in dict.fromkeys(keywords(question))]
    found = []
    for i, title, summary, url in sorted(articles):
        for pos, s in enumerate(re.split(r"(?<=[.!?])\s+", f"{title or ''}. {summary or ''}")):
            have = {stems[w] for w in keywords(s)}
            hits = sum(w in have for w in wanted)
            if len(s.strip(" ")) >= 15 and hits:
                found.append((-hits / max(1, min(len(wanted), 3)), i, pos, s.strip(" "), title, url))
    out, seen = [], set()
    for score, _, _, s, title, url in sorted(found, key=lambda f: f[:3]):
        key = re.sub(r"[^a-z0-9_]", "", s.lower())
        if key not in seen:
            seen.add(key)
            out.append((s, title, url, -score))
    return out[:n]


def test_index_equals_a_scan(spark, tmp_path):
    rng = random.Random(5)
    words = "carbon carbons targets target report reporting emission emissions policy water energy finance risk audit plan".split()
    sentence = lambda: " ".join(rng.choices(words, k=rng.randrange(1, 7))).capitalize() + rng.choice(".!?")
    articles = [(i, rng.choice([None, sentence()]), rng.choice([None, "", " ".join(sentence() for _ in range(rng.randrange(9)))]), f"u{i}") for i in range(150)]
    df = spark.createDataFrame(articles, "id long, title string, summary string, url string")
    path = str(tmp_path / "index")
    sentences.write_index(df, path, buckets=8)
    stems = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", sentences.stem(F.col("w")).alias("s")).collect()}
    for question in ("carbon targets?", "Reporting of reports: emission, water, energy", "audit", "finance risk finance"):
        for w in re.findall(r"\w+", question.lower()):
            stems.setdefault(w, spark.range(1).select(sentences.stem(F.lit(w)).alias("s")).first().s)
        want = scanned(stems, articles, question, 5)
        assert [tuple(r) for r in sentences.ask(spark, path, question, n=5, buckets=8).collect()] == want
        assert [tuple(r) for r in sentences.search(df, question, n=5).collect()] == want
    for question in ("", "of the", "xylophone"):
        assert sentences.ask(spark, path, question, buckets=8).collect() == sentences.search(df, question).collect() == []


def test_a_question_reads_its_own_folders(spark, tmp_path):
    df = spark.createDataFrame([(i, f"title{i} words alike", f"summary{i} of an article", "u") for i in range(40)], "id long, title string, summary string, url string")
    sentences.write_index(df, str(tmp_path), buckets=8)
    read = sentences.lists_of(spark, str(tmp_path), ["title"], 8)
    assert read.count() == 40
    assert len({re.search(r"_bucket=(\d+)", f)[1] for f in read.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}) == 1
    plan = read._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*_bucket", plan) and re.search(r"PushedFilters: \[.*stem", plan)


def test_nothing_to_find(spark, tmp_path):
    df = spark.createDataFrame([], "id long, title string, summary string, url string")
    assert sentences.search(df, "carbon").collect() == []
    sentences.write_index(spark.createDataFrame([(1, "Long enough to be kept", None, "u"), (2, "short", "", "u")], df.schema), str(tmp_path), buckets=8)
    assert [r.url for r in sentences.ask(spark, str(tmp_path), "enough", buckets=8).collect()] == ["u"]
    assert sentences.ask(spark, str(tmp_path), "short", buckets=8).collect() == []


def test_an_empty_index_has_no_answer(spark, tmp_path):
    for i, rows in enumerate(([], [(1, "short", None, "u")])):
        sentences.write_index(spark.createDataFrame(rows, "id long, title string, summary string, url string"), path := f"{tmp_path}/{i}", buckets=8)
        assert sentences.ask(spark, path, "carbon", buckets=8).collect() == sentences.ask(spark, path, "", buckets=8).collect() == []


def test_the_index_is_smaller_than_its_texts_and_nothing_is_shuffled(spark, tmp_path):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(5000)]
    line = lambda: " ".join(rng.choices(words, k=9)) + "."
    # titles are long, as where a text is a single line
    articles = [(i, t := " ".join(line() for _ in range(30)), f"{t} {line()}", "https://a.example.com/") for i in range(400)]
    df = spark.createDataFrame(articles, "id long, title string, summary string, url string").repartition(2).localCheckpoint()
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: {(f := found.apply(i).getName()) for found in [disk.getAllFiles()] for i in range(found.length())}
    before = files()
    sentences.write_index(df, str(tmp_path), buckets=4)
    assert not [f for f in files() - before if f.startswith("shuffle")]
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < sum(len(t) + len(s) for _, t, s, _ in articles)


@pytest.mark.parametrize("first", [(1, 2), (1, 1000)])
def test_answers_among_many_alike_equal_a_scan(spark, tmp_path, monkeypatch, first):
    """Copies fill the first sentences of the lists; ids that aren't unique; letters that become ASCII; lists in parts."""
    monkeypatch.setattr(sentences, "FIRST", first)
    monkeypatch.setattr(sentences, "LISTED_CHARS", 300)
    monkeypatch.setattr(sentences, "KNOWN_WORDS", 20)
    alike = ["Carbon targets of the water plan", "carbon, targets. Of the water-plan!", "CARBON TARGETS of the waterplan"]
    articles = [(i, alike[i % 3], f"{alike[0]}. Something else is told here {i}. {alike[i % 2]}.", f"u{i}") for i in range(60)]
    articles += [(100, "Carbon \u0130stanbul \u212aelvin report.", "Targets \u00e9carbon alone\x1cin \u03a3\u03a3 reports; water_plan. ", "u100"), (101, "A plan for the targets of water only", None, "u101")]
    articles += [(200 + i % 2, f"Water and energy {i} are reported", "Carbon stands in the other sentence " + "of energy " * i, f"v{i}") for i in range(4)]
    df = spark.createDataFrame(articles, "id long, title string, summary string, url string").repartition(3, "id")
    sentences.write_index(df, str(tmp_path), buckets=4)
    assert sentences.lists(df.coalesce(1)).where("stem = 'water'").count() > 10
    for question, n in (("carbon targets water plan", 3), ("Report of water and energy?", 2), ("kelvin stanbul", 3), ("plans", 7)):
        want = sentences.search(df, question, n=n).collect()
        assert want and sorted(sentences.ask(spark, str(tmp_path), question, n=n, buckets=4).collect()) == sorted(want)


@pytest.mark.parametrize("kind", ["variant", "string"])
def test_mixed_urls(spark, kind):
    lists = [["https://a", {"url": "https://b", "label": "B", "depth": 0}, None, 3, {"url": "https://c", "crawlMethod": "bfs", "depth": "4"}, {"label": "no url"}], [], "https://alone", {"url": "https://object"}]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(lists)] + [(9, None)], "id int, urls string")
    if kind == "variant":
        df = df.withColumn("urls", F.parse_json("urls"))
    else:
        df = df.unionByName(spark.createDataFrame([(10, "not [json")], "id int, urls string"))
    got = sorted((tuple(r) for r in store.explode_plan_urls(df).collect()), key=lambda r: r[:2])
    assert got == [(0, 0, "https://a", "https://a", "default", 2), (0, 1, "https://b", "B", "default", 2), (0, 4, "https://c", "https://c", "bfs", 4), (0, 5, None, "no url", "default", 2)]


def test_structs_and_strings(spark):
    df = spark.sql("SELECT 1 AS id, array('https://a', 'https://b') AS urls")
    assert [tuple(r) for r in store.explode_plan_urls(df).collect()] == [(1, 0, "https://a", "https://a", "default", 2), (1, 1, "https://b", "https://b", "default", 2)]
    df = spark.sql("SELECT 1 AS id, array(named_struct('url', 'u', 'label', CAST(NULL AS STRING), 'crawlMethod', 'bfs', 'depth', 0)) AS urls")
    assert [tuple(r) for r in store.explode_plan_urls(df).collect()] == [(1, 0, "u", "u", "bfs", 2)]


def test_database_in_ranges(spark, small_tables):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    seen = spark.read.parquet(f"{small_tables}/events.parquet").select(F.col("user_id").cast("string").alias("plan_id"), F.col("event_type").alias("url"), F.col("ts").cast("timestamp").alias("crawled_at"))
    texts = driver | {"createTableColumnTypes": "plan_id VARCHAR(64), url VARCHAR(200)"}
    seen.write.jdbc(url, "seen_urls", properties=texts)
    df = store.read_store(spark, url, "seen_urls", "jdbc", by="crawled_at", parts=5, **driver)
    assert df.rdd.getNumPartitions() == 5
    assert min(df.groupBy(F.spark_partition_id()).count().toPandas()["count"]) > 0
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, seen.collect()))
    one = store.read_store(spark, url, "seen_urls", "jdbc", plan_id="8", by="crawled_at", parts=5, **driver)
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(plan_id,8\)", one._jdf.queryExecution().toString())
    assert one.count() == seen.where("plan_id = '8'").count() > 0
    seen.limit(0).write.jdbc(url, "email_log", properties=texts)
    assert store.read_store(spark, url, "email_log", "jdbc", by="crawled_at", **driver).rdd.getNumPartitions() == 1


def test_plain_stems_equal_the_column_and_are_taken_outside_lambdas(spark):
    from contentwatch.functions import text

    rng = random.Random(8)
    words = ["".join(rng.choices("abcdes1_", k=rng.randrange(1, 7))) + rng.choice(["", "ies", "ying", "ing", "ed", "es", "s", "ational", "tional", "al", "ment", "ity", "ive", "tory", "tion", "als"]) for _ in range(400)]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.stem(F.col("w")).alias("s")).collect()
    assert [text.plain_stem(r.w) for r in rows] == [r.s for r in rows]
    said = ["The Cities, citie's; \u00c9t\u00e9 nation\u00e9al \x1cwater\x0bwaters\u00a0Water_ed 123 about\u2028regulation", "a", "", "ations ational national nations"]
    told = spark.createDataFrame([(i, 0, s) for i, s in enumerate(said)], "id long, pos int, sentence string")
    keywords = F.array_distinct(F.transform(F.array_distinct(text.clean_keywords(F.col("sentence"), text.STOP_WORDS)), text.stem))
    want = {(r.id, x) for r in told.select("id", keywords.alias("k")).collect() for x in r.k}
    got = sentences.postings(told)
    assert sorted((r.id, r.stem) for r in got.collect()) == sorted(want)
    assert "transform(" not in got._jdf.queryExecution().optimizedPlan().toString()
