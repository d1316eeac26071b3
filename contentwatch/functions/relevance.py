"""Relevance of a text to a prompt, three ways, and keyword matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contentwatch.functions.text import clean_keywords, let, run_lengths, stem


def _verdict(words: Column, stems: Column, found: Column, threshold: Column | int) -> Column:
    """The judgement of a prompt's words and their stems against the stems ``found`` in a text."""
    js_round = lambda x: F.floor(x + 0.5).cast("int")

    def verdict(v: Column) -> Column:
        n, m = v["n"], F.size(v["hit"])
        required = F.least(n, F.lit(2))
        score = F.when(n == 0, 70).when(m == 0, 0).when(m >= required, js_round(70 + 30 * m / n)).otherwise(js_round(50 * m / required))
        matched = F.transform(v["hit"], lambda s: F.get(v["words"], F.array_position(v["stems"], s).cast("int") - 1))
        return let(score, lambda x: F.struct(x.alias("score"), matched.alias("matched"), n.alias("n_terms"), (x >= threshold).alias("related")))

    wanted = F.array_distinct(stems)
    return let(F.struct(words.alias("words"), stems.alias("stems"), F.size(wanted).alias("n"), F.array_intersect(wanted, found).alias("hit")), verdict)


def local_relevance(prompt: Column, title: Column, text: Column, stops: list[str], threshold: Column | int = 70) -> Column:
    """struct(score, matched, n_terms, related): stems of the prompt found among those of the text.

    Two matches (or all, of fewer) give 70 to 100, fewer up to 50, none 0; a prompt without words gives 70.  ``matched``
    names each matched stem's first word.
    """
    found = F.array_distinct(F.transform(F.array_distinct(clean_keywords(F.concat_ws(" ", title, text), stops)), stem))
    return let(F.array_distinct(clean_keywords(prompt, stops)), lambda words: _verdict(words, F.transform(words, stem), found, threshold))


def local_relevance_of(rows: DataFrame, key: str, prompt: Column, title: Column, text: Column, stops: list[str], threshold: Column | int = 70) -> DataFrame:
    """(key, relevance): ``local_relevance`` of many texts; ``key`` names a row.

    Prompts, of which there are few, are stemmed once each, and so is each distinct word of all texts.  The words whose stem a prompt has
    meet the texts' words again; what is gathered by text is only stems that match.
    """
    asked = rows.select(key, F.coalesce(prompt, F.lit("")).alias("_prompt"), F.concat_ws(" ", title, text).alias("_text"))
    prompts = asked.select("_prompt").distinct().withColumn("_words", F.array_distinct(clean_keywords(F.col("_prompt"), stops))).withColumn("_stems", F.transform("_words", stem))
    spoken = asked.select(key, F.explode(F.array_distinct(clean_keywords(F.col("_text"), stops))).alias("_word"))
    wanted = prompts.select(F.explode("_stems").alias("_stem")).distinct()
    words = spoken.select("_word").distinct().withColumn("_stem", stem(F.col("_word"))).join(wanted, "_stem", "left_semi")
    found = spoken.join(words, "_word").groupBy(key).agg(F.collect_set("_stem").alias("_found"))
    joined = asked.select(key, "_prompt").join(prompts, "_prompt").join(found, key, "left")
    return joined.select(key, _verdict(F.col("_words"), F.col("_stems"), F.coalesce("_found", F.array().cast("array<string>")), threshold).alias("relevance"))


def term_overlap_relevance(prompt: Column, title: Column, text: Column) -> Column:
    """Percent of the prompt's words of over two letters that the text holds as substrings; 100 without any, or without prompt or text."""
    words = F.filter(F.regexp_extract_all(F.lower(prompt), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) > 2)
    body = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))
    hits = F.size(F.filter(words, lambda w: body.contains(w)))
    nothing = F.coalesce(prompt == "", F.lit(True)) | ((F.coalesce(title, F.lit("")) == "") & (F.coalesce(text, F.lit("")) == ""))
    return F.when(nothing | (F.size(words) == 0), 100.0).otherwise(100.0 * hits / F.size(words))


def tfidf_relevance(prompt: Column, title: Column, text: Column, stops: list[str]) -> Column:
    """Cosine of the two documents' TF-IDF vectors times 250, at most 100; 100 without prompt or text.

    With two documents the smoothed weight is 1 for a word in both and ln(3/2) + 1 for one in either.
    """
    words = lambda c: F.array_sort(F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~w.isin(stops)))
    rare = 1.4054651081081644
    squares = lambda runs: F.aggregate(runs, F.lit(0.0), lambda s, r: s + F.pow(r["n"].cast("double"), F.lit(2.0)))

    def cosine(v: Column) -> Column:
        # the prompt's few words are looked up among the text's; what they share weighs less in both norms
        theirs = lambda r: F.get(F.filter(v["b"], lambda x: x["w"] == r["w"]), F.lit(0))["n"]
        both = F.filter(F.transform(v["a"], lambda r: F.struct(r["n"].cast("double").alias("a"), theirs(r).cast("double").alias("b"))), lambda x: x["b"].isNotNull())
        total = lambda f: F.aggregate(both, F.lit(0.0), lambda s, x: s + f(x))
        norm = lambda side: F.sqrt(squares(v[side]) * rare**2 + total(lambda x: x[side] * x[side]) * (1 - rare**2))
        dot = total(lambda x: x["a"] * x["b"])
        return F.when(dot == 0, 0.0).otherwise(dot / (norm("a") * norm("b")))

    pair = let(words(prompt), lambda a: let(words(F.concat_ws("\n\n", title, text)), lambda b: F.struct(run_lengths(a).alias("a"), run_lengths(b).alias("b"))))
    nothing = F.coalesce(prompt == "", F.lit(True)) | ((F.coalesce(title, F.lit("")) == "") & (F.coalesce(text, F.lit("")) == ""))
    return F.when(nothing, 100.0).otherwise(F.least(F.lit(100.0), 250 * let(pair, cosine)))


def direct_keyword_match(prompt: Column, title: Column, text: Column) -> Column:
    """One of the prompt's tokens of over two characters stands in the text; true without tokens."""
    tokens = F.filter(F.split(F.lower(F.coalesce(prompt, F.lit(""))), r"[\s,;|]+"), lambda w: F.length(w) > 2)
    body = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))
    return (F.size(tokens) == 0) | F.exists(tokens, lambda w: body.contains(w))


def body_keyword_match(keywords: Column, title: Column, text: Column, url: Column) -> Column:
    body = F.lower(F.concat_ws(" ", title, text, url))
    return F.exists(keywords, lambda k: body.contains(F.lower(k)))


def relevant(score: Column, direct: Column, prompt: Column, enabled: Column, mode: str = "any", threshold: Column | int = 70) -> Column:
    """Whether a record stays: any score or a direct match, or the threshold; always without an enabled prompt."""
    passes = (score > 0) | direct if mode == "any" else score >= threshold
    return ~F.coalesce(enabled, F.lit(True)) | (F.coalesce(F.trim(prompt), F.lit("")) == "") | passes


def parse_verdict(reply: Column, threshold: Column | int = 70) -> Column:
    """struct(score, related, reason, summary, key_insights) of a model's reply; 70 and related where it isn't JSON."""
    body = F.trim(F.regexp_replace(F.coalesce(reply, F.lit("")), r"```json|```", ""))
    got = F.from_json(body, "score double, related boolean, reason string, summary string, key_insights array<string>")
    score = F.coalesce(got["score"], F.lit(70.0))
    return F.struct(score.alias("score"), F.coalesce(got["related"], F.when(got["score"].isNull(), True).otherwise(score >= threshold)).alias("related"), F.coalesce(got["reason"], F.lit("")).alias("reason"), F.coalesce(got["summary"], F.lit("")).alias("summary"), F.coalesce(got["key_insights"], F.array().cast("array<string>")).alias("key_insights"))


def yes_no(reply: Column) -> Column:
    """The short form of a verdict; an empty reply is a yes."""
    word = F.upper(F.coalesce(reply, F.lit("")))
    return (word == "") | word.contains("YES")
