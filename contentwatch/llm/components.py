"""Connected components of a table of links, by alternating stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contentwatch.llm.common import scratch, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (x long, y long); a component is its least node.

    Each step is two aggregations and joins; a hub is never gathered in one list.  It ends with the first step that
    changes nothing; steps grow with the logarithm of the longest chain.
    """
    with scratch(links.sparkSession, "components") as folder:
        edges = written(links.where("x != y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges", folder)
        before = now = None
        while now is None or now != before:
            both = edges.union(edges.select("v", "u"))
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(least, "u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"), "u", "m")
            edges = written(small.select(F.col("a").alias("u"), F.col("b").alias("v")).union(small.select("u", "m")).where("u != v").distinct(), "edges", folder)
            before, now = now, tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        return written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct()), "components")
