"""The corpus pipeline: documents in, documents that are worth training on, with their tokens, out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the folder that
driver and executors share and gives the next stage what it reads back.  All stages but the last return the columns of
``documents``.

Cases, in every stage: a null column other than text is just kept; an empty table gives an empty one; a very long text is read
whole; further columns are kept with their values, also under names that the operators use themselves (their own columns
have other names then and are dropped; the last stage's get a bar at the end: ``ids_``, ``n_tokens_``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contentwatch.llm import bpe, common, decontaminate, langid, minhash, substrings


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that could be told: null texts and texts without letters go; repeated rows and ties are judged alike."""
    return langid.stage(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies, that of the least id, null ids last; of rows equal in id and text one stays; null and empty texts are near to nothing, so each stays."""
    return minhash.stage(spark, docs, sf_dir)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller id has (no id: before all others); rows of one id don't cut each other; null and short texts stay as they are."""
    return substrings.stage(spark, docs, sf_dir)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold part of a benchmark item; null and empty texts hold none; repeated rows go or stay alike."""
    return decontaminate.stage(spark, docs, sf_dir)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts and keeps what decodes to itself; adds ids and their number; a null text has none; repeated rows stay."""
    return bpe.stage(spark, docs, sf_dir)


STAGES = [
    ("language ID", language),
    ("near duplicates", near_duplicates),
    ("substring dedup", repeated_passages),
    ("decontamination", benchmark_leaks),
    ("byte BPE", tokens),
]

#: SQL can't express learning a language model, MinHash components or BPE; the tests have a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``; tables between them are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with common.scratch(spark, "pipeline"):
        for name, stage in STAGES[:-1]:
            with common.scratch(spark, "stage"):
                docs = common.kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return common.kept(STAGES[-1][1](spark, docs, sf_dir), "pipeline-result")
