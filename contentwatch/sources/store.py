"""The seven stored tables: schemas, readers, writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contentwatch.operators.tables import scratch, written

SCHEMAS = {
    "settings": "key string, value string",
    "plans": "id string, user_id string, name string, icon string, bg string, status string, stage string, prompt string, prompt_enabled boolean, keywords string, urls array<struct<id: string, url: string, label: string, crawlMethod: string, depth: int, status: string, added_at: string>>,"
    " recipient_groups array<struct<id: string, name: string, active: boolean, emails: array<string>>>, periods array<string>, sched_week_days array<string>, trigger_times map<string, string>,"
    " crawl_state struct<urlIndex: int, completedUrls: array<string>, failedUrls: array<string>, step: string, progress: int, isActive: boolean>, articles_count int, emails_count int, relevance_threshold int, fetch_period string, fetch_period_days int, date_range string, date_from string, date_to string,"
    " sched_freq string, sched_time string, sched_month_day int, interval_minutes int, sched_custom_unit string, sched_tz string, send_mode string, send_time string, continuous_run boolean, search_body_keywords boolean, enable_ai_keywords boolean, auto_mail boolean, last_run timestamp, created_at timestamp",
    "articles": "id string, plan_id string, user_id string, url string, title string, subtitle string, author string, category string, summary string, content string, language string, canonical_url string, meta_description string, pub_date date, modified_date string, tags array<string>, images array<string>, videos array<string>, attachments array<string>, keywords array<string>, metadata string, created_at timestamp",
    "seen_urls": "plan_id string, url string, crawled_at timestamp",
    "email_log": "id string, plan_id string, plan_name string, ts timestamp, recipient string, subject string, articles_count int, status string, error string, message_id string, user_id string",
    "activity_log": "id string, ts timestamp, event string, plan_name string, type string, user_id string",
    "app_users": "id string, email string, created_at timestamp",
}
KEYS = {"plans": ["id"], "articles": ["id"], "seen_urls": ["plan_id", "url"], "settings": ["key"], "app_users": ["id"]}


def read_store(spark: SparkSession, path: str, table: str, fmt: str = "parquet", plan_id: str | None = None, user_id: str | None = None, by: str | None = None, parts: int = 16, **options) -> DataFrame:
    """A stored table by its schema; filters reach the source.

    For ``jdbc``, ``path`` is the connection's URL.  With ``by``, a number, date or time column of the table, it is read in
    ``parts`` ranges of it, by as many connections (each its own query of the source, which also runs the filters); rows
    without a value go with the first range.  The two ends are asked from the source; an empty table is one range.
    """
    if fmt == "jdbc":
        options = {"url": path, **options}
        df = spark.read.format("jdbc").options(**options, dbtable=table, **_ranges(spark, table, by, parts, options)).load()
    else:
        df = spark.read.format(fmt).options(**options).schema(SCHEMAS[table]).load(f"{path}/{table}")
    if plan_id is not None:
        df = df.where(F.col("id" if table == "plans" else "plan_id") == plan_id)
    return df.where(F.col("user_id") == user_id) if user_id is not None else df


def _ranges(spark: SparkSession, table: str, by: str | None, parts: int, options: dict) -> dict[str, str]:
    if by is None:
        return {}
    quoted = by.replace('"', '""')
    low, high = spark.read.format("jdbc").options(**options, query=f'SELECT MIN("{quoted}") AS low, MAX("{quoted}") AS high FROM {table}').load().selectExpr("string(low)", "string(high)").first()
    return {} if low is None else {"partitionColumn": by, "lowerBound": low, "upperBound": high, "numPartitions": str(parts)}


def read_json_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a store that is one JSON document with plans, articles, emailLog and activityLog."""
    lists = {"plans": "id string, name string, status string, urls array<struct<id: string, url: string, label: string>>", "articles": "id string, plan_id string, url string, title string, summary string, company string, publish_date string", "emailLog": "id string, plan_id string, recipient string, subject string, status string, ts string", "activityLog": "id string, ts string, event string, plan string, type string"}
    doc = spark.read.schema(", ".join(f"{k} array<struct<{_struct(v)}>>" for k, v in lists.items())).json(path, multiLine=True)
    return {k: doc.select(F.inline(k)) for k in lists}


def _struct(ddl: str) -> str:
    """``a string, b array<...>`` as the inside of a struct type."""
    out, depth = [], 0
    part = ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = part.strip().split(" ", 1)
            out.append(f"{name}: {kind}")
            part = ""
        else:
            part += ch
    return ", ".join(out)


def import_seed_urls(spark: SparkSession, path: str) -> DataFrame:
    """(url, label) of a CSV with headers: the column named like a url (else the first), and one named like an authority, label or name (else the url)."""
    df = spark.read.csv(path, header=True, escape='"')
    return seed_urls(df)


def seed_urls(df: DataFrame) -> DataFrame:
    named = lambda *words: next((c for c in df.columns if any(w in c.lower() for w in words)), None)
    url, label = named("url") or df.columns[0], named("authority", "label", "name")
    clean = lambda c: F.regexp_replace(F.trim(F.col(f"`{c}`")), '^"|"$', "")
    out = df.select(clean(url).alias("url"), clean(label or url).alias("label"))
    return out.where(F.col("url").startswith("http"))


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """``existing`` with the rows of ``batch`` in place of those with equal keys; of equal keys in the batch the first by ``order`` counts (else the greatest row, column by column)."""
    order = order or [F.desc_nulls_last(f"`{c}`") for c in batch.columns if c not in keys]
    latest = batch.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*(order or keys)))).where("_n = 1").drop("_n")
    return existing.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


BUCKET = "_bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """A store of rows in folders by the hash of their keys; those that ``rows`` touches are replaced, no others."""
    dealt = rows.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(F.col(BUCKET))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def upsert_buckets(batch: DataFrame, path: str, keys: list[str], order: list[Column] | None = None, buckets: int = 64) -> None:
    """``upsert`` of a batch into a store that ``write_buckets`` wrote: only the buckets that hold a key of the batch are read and written again.

    A bucket is replaced as a whole at the write's commit, so a try that fails leaves the store as it was, and a second try
    of the same batch gives the same rows.
    """
    spark = batch.sparkSession
    with scratch(spark, "upsert") as folder:
        batch = written(batch, "batch", folder)
        touched = [r[0] for r in batch.select(bucket_of(keys, buckets)).distinct().collect()]  # at most ``buckets``
        schema = T.StructType([*batch.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        existing = spark.read.schema(schema).parquet(path).where(F.col(BUCKET).isin(touched)).drop(BUCKET)
        write_buckets(written(upsert(existing, batch, keys, order), "merged", folder), path, keys, buckets)


def rename_store_columns(df: DataFrame, to: str = "app") -> DataFrame:
    """snake_case columns as camelCase ("app") or back ("store")."""
    import re

    camel = lambda c: re.sub(r"_([a-z])", lambda m: m[1].upper(), c)
    snake = lambda c: re.sub(r"([A-Z])", lambda m: "_" + m[1].lower(), c)
    out = df.withColumnsRenamed({c: (camel if to == "app" else snake)(c) for c in df.columns})
    for flag in {"prompt_enabled", "promptEnabled"} & set(out.columns):
        out = out.withColumn(flag, F.coalesce(flag, F.lit(True)))
    return out


def typed_settings(settings: DataFrame) -> DataFrame:
    """(key, kind, value) of settings: JSON objects and lists, booleans, integers, else strings."""
    v = F.trim("value")
    kind = F.when(v.rlike(r"^[\[{]") & F.try_parse_json(v).isNotNull(), "json").when(F.lower(v).isin("true", "false"), "bool").when(v.try_cast("long").isNotNull(), "int").otherwise("string")
    value = F.when(kind == "bool", F.lower(v)).when(kind == "int", v.try_cast("long").cast("string")).otherwise(F.col("value"))
    return settings.select("key", kind.alias("kind"), value.alias("value"))


def flatten_metadata(articles: DataFrame, keys: dict[str, str]) -> DataFrame:
    """Keys of the JSON column metadata as columns (name: type), only where there is no such column."""
    out = articles
    for name, kind in keys.items():
        if name not in articles.columns:
            out = out.withColumn(name, F.try_variant_get(F.try_parse_json("metadata"), f"$.{name}", kind))
    return out


def article_metadata(score: Column, reason: Column, source: Column, host: Column) -> Column:
    """The JSON of an article's metadata; a score of 100 and the host where nothing is known."""
    return F.to_json(F.struct(F.coalesce(score, F.lit(100.0)).alias("relevance_score"), F.coalesce(reason, F.lit("")).alias("relevance_reason"), F.coalesce(F.nullif(source, F.lit("")), host).alias("company")))


def article_id(plan_id: Column, url: Column) -> Column:
    return F.concat(F.lit("art_"), F.substring(F.sha2(F.concat_ws("|", plan_id, url), 256), 1, 32))


def explode_plan_urls(plans: DataFrame, urls: str = "urls") -> DataFrame:
    """(plan_id, pos, url, label, method, depth) of plans whose urls are strings, structs, or a variant or JSON text that may hold both in one list.

    A missing label is the url, a missing method "default", a depth that is missing or 0 is 2.  In a variant, entries that are
    neither text nor object are left out and keep their places; text that isn't JSON, and what isn't a list, has no entries.
    """
    kind = plans.schema[urls].dataType
    if isinstance(kind, (T.VariantType, T.StringType)):
        v = F.col(urls) if isinstance(kind, T.VariantType) else F.try_parse_json(urls)
        lists = plans.select(F.col("id").alias("plan_id"), v.alias("v"))
        entries = lists.lateralJoin(plans.sparkSession.tvf.variant_explode(F.col("v").outer())).where("key IS NULL")
        is_text, is_object = F.schema_of_variant("value") == "STRING", F.schema_of_variant("value").startswith("OBJECT")
        field = lambda name, to="string": F.when(is_object, F.try_variant_get("value", f"$.{name}", to))
        url = F.when(is_text, F.try_variant_get("value", "$", "string")).otherwise(field("url"))
        rows = entries.where(is_text | is_object).select("plan_id", "pos", url.alias("url"), field("label").alias("label"), field("crawlMethod").alias("method"), field("depth", "int").alias("depth"))
    else:
        u = plans.select(F.col("id").alias("plan_id"), F.posexplode(urls).alias("pos", "u"))
        if isinstance(kind.elementType, T.StringType):
            rows = u.select("plan_id", "pos", F.col("u").alias("url"), *[F.lit(None).cast(t).alias(n) for n, t in (("label", "string"), ("method", "string"), ("depth", "int"))])
        else:
            rows = u.select("plan_id", "pos", "u.url", "u.label", F.col("u.crawlMethod").alias("method"), "u.depth")
    return rows.select("plan_id", "pos", "url", F.coalesce("label", "url").alias("label"), F.coalesce("method", F.lit("default")).alias("method"), F.coalesce(F.nullif("depth", F.lit(0)), F.lit(2)).alias("depth"))


def export_rows(articles: DataFrame) -> DataFrame:
    """Articles as flat text columns: lists joined by commas, maps and structs as JSON."""
    flat = lambda n, kind: F.array_join(n, ", ") if kind == "array<string>" else F.to_json(n) if kind.startswith(("struct", "map", "array")) else F.col(n)
    return articles.select(*[flat(n, kind).alias(n) for n, kind in articles.dtypes])


def export_articles(articles: DataFrame, path: str, fmt: str = "csv") -> None:
    """One folder of files for each plan."""
    rows = export_rows(articles) if fmt == "csv" else articles
    writer = rows.repartition("plan_id").sortWithinPartitions("plan_id").write.mode("overwrite").partitionBy("plan_id")
    writer.csv(path, header=True, escape='"') if fmt == "csv" else writer.format(fmt).save(path)


def export_activity_log(log: DataFrame, path: str) -> None:
    """The log, newest first, every field quoted."""
    log.orderBy(F.desc("ts"), "id").write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')
