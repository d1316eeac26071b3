"""The catalog of registered queries, and how the given tables stand in for the monitoring ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: "Now" of the queries, inside the range of the given dates.
NOW = "2001-07-10 12:00:00"


def query(name: str, sql: str | None = None):
    """Registers a query with its DuckDB counterpart."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


class Tables:
    """The tables of a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def articles(self) -> DataFrame:
        """Documents as articles: the source is the plan, the first line the title."""
        title = F.substring_index("text", "\n", 1)
        return self.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("plan_id"), F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("doc_id") % 700).alias("url"), title.alias("title"), F.col("text").alias("content"), F.col("lang").alias("company"))

    def log(self) -> DataFrame:
        """Events as the activity log of 50 plans."""
        return self.events.select(F.col("event_id").alias("id"), "ts", F.concat(F.lit("plan "), F.col("user_id") % 50).alias("plan_name"), F.col("event_type").alias("type"), F.concat("event_type", F.lit(" "), "props").alias("event"), "value", "user_id")

    def dated(self) -> DataFrame:
        """Orders as dated articles of the customers' plans."""
        return self.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("plan_id"), F.col("o_orderdate").cast("date").alias("pub_date"), F.concat(F.lit("https://a.example.com/"), F.col("o_orderkey") % 5000).alias("url"), F.col("o_orderpriority").alias("company"), F.concat(F.lit("Order "), F.col("o_orderkey") % 3000).alias("title"), F.col("o_orderstatus").alias("status"))

    def plans(self) -> DataFrame:
        """Customers as plans."""
        segment = F.col("c_mktsegment")
        status = F.when(segment == "BUILDING", "running").when(segment == "MACHINERY", "paused").otherwise("idle")
        period = F.element_at(F.create_map(*map(F.lit, ["BUILDING", "day", "MACHINERY", "week", "HOUSEHOLD", "month", "FURNITURE", "custom"])), segment)
        group = F.array(F.struct(F.lit("main").alias("name"), (F.col("c_custkey") % 3 != 0).alias("active"), F.array(F.concat("c_mktsegment", F.lit("@example.org")), F.concat("c_name", F.lit("@example.org"))).alias("emails")), F.struct(F.lit("also").alias("name"), F.lit(True).alias("active"), F.array(F.concat("c_mktsegment", F.lit("@example.org"))).alias("emails")))
        return self.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("user_id"), F.col("c_name").alias("name"), status.alias("status"), period.alias("fetch_period"), (F.col("c_custkey") % 40).cast("string").alias("fetch_period_days"), group.alias("recipient_groups"), F.array(F.concat(F.lit("https://"), F.lower("c_mktsegment"), F.lit(".example.org")), F.concat(F.lit("https://n"), F.col("c_nationkey"), F.lit(".example.org"))).alias("urls"))


#: SQL of the same views.
ARTICLES = "(SELECT doc_id AS id, source AS plan_id, 'https://' || source || '.example.org/' || (doc_id % 700) AS url, split_part(text, chr(10), 1) AS title, text AS content, lang AS company FROM documents)"
LOG = "(SELECT event_id AS id, ts, 'plan ' || (user_id % 50) AS plan_name, event_type AS type, event_type || ' ' || props AS event, value, user_id FROM events)"
DATED = "(SELECT o_orderkey AS id, o_custkey AS plan_id, o_orderdate::DATE AS pub_date, 'https://a.example.com/' || (o_orderkey % 5000) AS url, o_orderpriority AS company, 'Order ' || (o_orderkey % 3000) AS title, o_orderstatus AS status FROM orders)"
PLANS = "(SELECT c_custkey AS id, c_nationkey::VARCHAR AS user_id, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'running' WHEN 'MACHINERY' THEN 'paused' ELSE 'idle' END AS status, CASE c_mktsegment WHEN 'BUILDING' THEN 'day' WHEN 'MACHINERY' THEN 'week' WHEN 'HOUSEHOLD' THEN 'month' WHEN 'FURNITURE' THEN 'custom' END AS fetch_period, c_custkey % 40 AS fetch_period_days, c_mktsegment, c_nationkey, ['https://' || lower(c_mktsegment) || '.example.org', 'https://n' || c_nationkey || '.example.org'] AS urls FROM customer)"
