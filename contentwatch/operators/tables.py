"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_open: ContextVar[tuple[str, ...]] = ContextVar("open", default=())


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder in local mode and RuntimeError on a cluster, whose executors would each write their own."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = _own.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="contentwatch-")
        _own[context.applicationId] = found
    return found.rstrip("/")


@contextmanager
def scratch(spark: SparkSession, name: str):
    """A folder for intermediate tables, deleted at the end.  What leaves the block is written without a folder, so into that of the block around it, or the shared one."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    token = _open.set((*_open.get(), folder))
    try:
        yield folder
    finally:
        _open.reset(token)
        remove(spark, folder)


def table_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new path in ``folder``; without one, for the result of the innermost ``scratch`` block, in the block around that."""
    return f"{folder or (_open.get()[-2] if len(_open.get()) > 1 else shared_dir(spark))}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder that this library wrote."""
    p, files = _file_system(spark, path)
    files.delete(p, True)


def read_back(spark: SparkSession, path: str, schema) -> DataFrame:
    found = spark.read.schema(schema).parquet(path)
    found._table_path = path
    return found


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` as a table, reread: cuts the lineage of loops and survives lost executors."""
    spark = df.sparkSession
    df.write.parquet(path := table_path(spark, name, folder))
    return read_back(spark, path, df.schema)


def moved(df: DataFrame, name: str) -> DataFrame | None:
    """A table that ``written`` gave, moved to where ``written`` without a folder would put it; None for any other frame."""
    spark, path = df.sparkSession, getattr(df, "_table_path", None)
    if path is None:
        return None
    (old, files), (new, _) = _file_system(spark, path), _file_system(spark, to := table_path(spark, name))
    if not files.rename(old, new):
        raise RuntimeError(f"{path} can't be moved")
    return read_back(spark, to, df.schema)
