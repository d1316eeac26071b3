"""Registered queries of the monitoring library with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contentwatch.functions.text import content_hash, esg_category
from contentwatch.operators.joins import first_per_key
from contentwatch.plans import catalog, page_queries, table_queries, url_queries  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles per source and category, each content once."""
    articles = catalog.Tables(spark, sf_dir).articles().withColumn("hash", content_hash(F.col("content")))
    kept = first_per_key(articles, ["hash"], "id").withColumn("category", esg_category(F.col("content")))
    return kept.groupBy(F.col("plan_id").alias("source"), "category").agg(F.count("*").alias("articles"), F.min("id").alias("first_id"))


def queries() -> dict:
    return {"flagship": flagship} | catalog.QUERIES


def oracle_sql() -> dict[str, str]:
    esg = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i)\\b({w})\\b') THEN '{n}'" for n, w in url_queries.text.ESG.items()) + " ELSE 'General' END"
    flagship_sql = f"SELECT source, category, count(*) AS articles, min(doc_id) AS first_id FROM (SELECT source, doc_id, {esg} AS category FROM documents QUALIFY row_number() OVER (PARTITION BY md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) ORDER BY doc_id) = 1) GROUP BY 1, 2"
    return {"flagship": flagship_sql} | catalog.ORACLES
