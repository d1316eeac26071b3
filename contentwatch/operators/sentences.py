"""An index of articles' sentences by the stems of their words, so that a question reads its own stems' lists and not every article.

``write_index`` stores two tables: lists (stem, ids, places: of sentences that hold the stem) in folders by the hash of the stem, sorted
by stem, so that a file's statistics let a reader skip the rest of its folder; and the articles in folders by the hash of their id.
Each task writes what it has read, sorted, to its own file in each folder: nothing is shuffled, and the list of a frequent stem is spread over
as many files as articles were read in.  ``ask`` reads the folders of a question's stems, takes the sentences with the most of them, and finds
the answers in the articles of these; only where too many of them are alike does it scan the index's articles as ``search`` does.

Cases: sentences of under 15 characters aren't listed, of those of an article with the same words in the same places only the first is; a null title or
summary counts as empty; a question without keywords, and an empty index, have no answer; of texts that are alike in letters and digits the first best counts.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentwatch.functions.text import STOP_WORDS, clean_keywords, plain_stem, stem

BUCKET = "_bucket"
#: Between sentences; white space is ASCII's in Java.
BETWEEN = r"(?<=[.!?])\s+"
LEAST_CHARS = 15
#: Characters of the texts whose lists a task makes at once (one text at least), and words whose stems it remembers.
LISTED_CHARS, KNOWN_WORDS = 4_000_000, 200_000
#: Sentences that are looked at for each answer asked for: at first, and if too many of these are alike.
FIRST = (16, 1000)
#: Bytes of words stay, ASCII's white space and all others become spaces.
BARE = bytes(c if chr(c).isalnum() and c < 128 or c == 95 else 32 for c in range(256))


def _text() -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("summary", F.lit("")))


def sentences(articles: DataFrame) -> DataFrame:
    """(id, pos, sentence, title, url) of ``title. summary``."""
    rows = articles.select("id", F.posexplode(F.split(_text(), BETWEEN)).alias("pos", "s"), "title", "url")
    return rows.select("id", "pos", F.trim("s").alias("sentence"), "title", "url").where(F.length("sentence") >= LEAST_CHARS)


def _key(sentence: Column) -> Column:
    """Equal for sentences that are alike in letters and digits."""
    return F.unhex(F.md5(F.regexp_replace(F.lower(sentence), r"[^\w]", "")))


def _stems_of(stops: list[str]):
    """The distinct stems of texts in lower case without punctuation, by ``plain_stem``; each word is stemmed once a batch."""
    left_out = set(stops)

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        stems: dict[str, str] = {}

        def of(text: str) -> list[str]:
            words = [w for w in dict.fromkeys(text.split()) if len(w) > 2 and w not in left_out]
            for w in words:
                if w not in stems:
                    stems[w] = plain_stem(w)
            return list(dict.fromkeys(map(stems.__getitem__, words)))

        return texts.map(of)

    return found


def postings(rows: DataFrame, stops: list[str] = STOP_WORDS) -> DataFrame:
    """(stem, id, pos, key) of sentences, each stem of one once."""
    bare = F.regexp_replace(F.lower(F.col("sentence")), r"[^\w\s]", " ")
    return rows.select(F.explode(_stems_of(stops)(bare)).alias("stem"), "id", "pos", _key(F.col("sentence")).alias("key"))


class _Stems(dict):
    """The number of the stem of each word that was met; -1 for words of up to two letters and those left out."""

    def __init__(self, stops: Iterable[str]):
        super().__init__()
        self.left_out, self.numbers = {w.encode() for w in stops}, {}

    def __missing__(self, word: bytes) -> int:
        n = -1 if len(word) <= 2 or word in self.left_out else self.numbers.setdefault(plain_stem(word.decode()), len(self.numbers))
        self[word] = n
        return n


def _lists(texts: Iterable[tuple[int, str]], stems: _Stems) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(stems, offsets of their lists, rows, places) of numbered texts."""
    split, codes, sizes, rows, places = re.compile(BETWEEN, re.ASCII).split, [], [], [], []
    for row, text in texts:
        seen = set()
        for pos, s in enumerate(split(text)):
            if len(s := s.strip(" ")) < LEAST_CHARS or (bare := s.lower().encode("ascii", "replace").translate(BARE)) in seen:
                continue
            seen.add(bare)
            found = set(map(stems.__getitem__, bare.split()))
            found.discard(-1)
            codes.extend(found)
            sizes.append(len(found))
            rows.append(row)
            places.append(pos)
    codes = np.array(codes, np.int32)
    order = np.argsort(codes, kind="stable")
    at = np.repeat(np.arange(len(sizes)), sizes)[order]
    numbers, starts = np.unique(codes[order], return_index=True)
    names = list(stems.numbers)
    return [names[n] for n in numbers], np.append(starts, len(codes)), np.array(rows, np.int64)[at], np.array(places, np.int32)[at]


def lists(articles: DataFrame, stops: list[str] = STOP_WORDS) -> DataFrame:
    """(stem, ids, places) of stretches of articles: the sentences that hold a stem.

    Of sentences of an article with the same words in the same places the first is always the better answer, so only that is listed.
    """
    id_type = articles.schema["id"].dataType
    schema = T.StructType([T.StructField("stem", T.StringType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("places", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems = _Stems(stops)
        for batch in batches:
            part, held = [], 0
            for row, text in enumerate(batch.column(1)):
                part.append((row, text := text.as_py()))
                held += len(text)
                if held < LISTED_CHARS and row + 1 < batch.num_rows:
                    continue
                names, offsets, rows, places = _lists(part, stems)
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), batch.column(0).take(pa.array(rows)))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), ids, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places))], ["stem", "ids", "places"])
                part, held = [], 0
                if len(stems) > KNOWN_WORDS:
                    stems = _Stems(stops)

    return articles.select("id", F.make_valid_utf8(_text()).alias("text")).mapInArrow(run, schema)


def _bucket(by: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")


def write_index(articles: DataFrame, path: str, stops: list[str] = STOP_WORDS, buckets: int = 64) -> None:
    """The index of articles (id, title, summary, url) as two tables under ``path``."""
    articles = articles.select("id", "title", "summary", "url")
    for name, table, by in (("articles", articles, "id"), ("lists", lists(articles, stops), "stem")):
        dealt = table.withColumn(BUCKET, _bucket(by, buckets)).sortWithinPartitions(BUCKET, by)
        dealt.write.mode("overwrite").option("compression", "zstd").partitionBy(BUCKET).parquet(f"{path}/{name}")
        # a folder without rows, from which a table without any has its columns
        table.sparkSession.createDataFrame([], table.schema).write.parquet(f"{path}/{name}/{BUCKET}=-1")


def hits_of(lists: DataFrame, wanted: list[str], *by: str) -> DataFrame:
    """``by`` and hits, the number of a question's words that a sentence has.

    ``wanted``: the stems of the question's words; two words of one stem count twice.
    """
    weights = F.create_map(*[x for s in dict.fromkeys(wanted) for x in (F.lit(s), F.lit(wanted.count(s)))])
    return lists.where(F.col("stem").isin(wanted)).groupBy(*by).agg(F.sum(F.element_at(weights, F.col("stem"))).alias("hits"))


def rank(lists: DataFrame, wanted: list[str], n: int) -> DataFrame:
    """(id, pos, score): the n best sentences of postings, each text once; ties in the order of articles."""
    hits = hits_of(lists, wanted, "id", "pos", "key")
    best = hits.groupBy("key").agg(F.min(F.struct((-F.col("hits")).alias("less"), "id", "pos")).alias("b"))
    score = -F.col("b.less") / F.lit(float(max(1, min(len(wanted), 3))))
    return best.select("b.id", "b.pos", score.alias("score")).orderBy(F.desc("score"), "id", "pos").limit(n)


def question_stems(spark: SparkSession, question: str, stops: list[str] = STOP_WORDS) -> list[str]:
    return spark.range(1).select(F.transform(F.array_distinct(clean_keywords(F.lit(question), stops)), stem).alias("s")).first().s


def lists_of(spark: SparkSession, path: str, wanted: list[str], buckets: int = 64) -> DataFrame:
    """(stem, id, pos) of some stems; other folders aren't read."""
    stems = F.array(*[F.lit(s) for s in wanted]).cast("array<string>")
    folders = spark.range(1).select(F.array_distinct(F.transform(stems, lambda s: _bucket(s, buckets))).alias("b")).first().b
    found = spark.read.parquet(f"{path}/lists").where(F.col(BUCKET).isin(folders) & F.col("stem").isin(wanted))
    return found.select("stem", F.explode(F.arrays_zip("ids", "places")).alias("at")).select("stem", "at.ids", "at.places").toDF("stem", "id", "pos")


def _best(rows: DataFrame, wanted: list[str], stops: list[str], n: int) -> DataFrame:
    """(sentence, title, url, score) of the n best of ``sentences``."""
    best = rank(postings(rows, stops), wanted, n)  # n rows: a top-k, so a proven size
    return rows.join(F.broadcast(best), ["id", "pos"]).orderBy(F.desc("score"), "id", "pos").select("sentence", "title", "url", "score")


def _one_of(name: str, values: list) -> Column:
    """In tens, as files' statistics are searched for so many values of a list, and only for the range of more; not for thousands."""
    step = 10 if len(values) <= 100 else len(values)
    return functools.reduce(operator.or_, (F.col(name).isin(values[i : i + step]) for i in range(0, len(values), step)), F.lit(False))


def ask(spark: SparkSession, path: str, question: str, stops: list[str] = STOP_WORDS, n: int = 3, buckets: int = 64) -> DataFrame:
    """(sentence, title, url, score) of the n best sentences for a question, by an index that ``write_index`` wrote with as many buckets.

    The first sentences by the lists hold the answers if n of their texts differ.  If they don't, more are taken, and at last all articles.
    """
    wanted = question_stems(spark, question, stops)
    articles = spark.read.parquet(f"{path}/articles")
    if not wanted:
        return _none(articles)
    hits = hits_of(lists_of(spark, path, wanted, buckets), wanted, "id", "pos")
    for most in (k * n for k in FIRST):
        first = hits.withColumn(BUCKET, _bucket("id", buckets)).orderBy(F.desc("hits"), "id", "pos").limit(most).collect()  # a bounded number of rows
        if not first:
            return _none(articles)
        few = articles.where(F.col(BUCKET).isin(list({r[BUCKET] for r in first})) & _one_of("id", sorted({r.id for r in first if r.id is not None})))
        named = spark.createDataFrame([(r.id, r.pos, r.hits) for r in first], hits.schema)
        rows = sentences(few).join(F.broadcast(named.drop("hits")), ["id", "pos"])
        # an id of several articles can have more hits in the lists than any sentence has
        found = hits_of(postings(rows, stops), wanted, "id", "pos", "key").join(F.broadcast(named.withColumnRenamed("hits", "listed")), ["id", "pos"])
        seen = found.agg(F.count_distinct("key").alias("texts"), F.bool_and(F.col("hits") == F.col("listed")).alias("exact")).first()
        if seen.exact and (seen.texts >= n or len(first) < most):
            return _best(rows, wanted, stops, n)
    return _best(sentences(articles), wanted, stops, n)


def _none(articles: DataFrame) -> DataFrame:
    return articles.select(F.col("summary").alias("sentence"), "title", "url", F.lit(0.0).alias("score")).limit(0)


def search(articles: DataFrame, question: str, stops: list[str] = STOP_WORDS, n: int = 3) -> DataFrame:
    """``ask`` without an index: a scan of all articles for one question."""
    wanted = question_stems(articles.sparkSession, question, stops)
    return _best(sentences(articles), wanted, stops, n) if wanted else _none(articles)
