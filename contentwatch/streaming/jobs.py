"""Streaming jobs: the incremental forms of the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from contentwatch.functions.dates import in_date_window
from contentwatch.operators.digest import build_digest
from contentwatch.operators.joins import new_articles_only
from contentwatch.operators.tables import scratch, written


def new_articles(stream: DataFrame, ts: str = "ts", horizon: str = "7 days") -> DataFrame:
    """Articles of a stream whose (plan_id, url) did not come within the horizon; state older than that is dropped."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(["plan_id", "url"])


def new_articles_batch(seen_path: str, emit: Callable[[DataFrame, int], None], *order) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function against the whole history: emits what is new and appends it to the seen table.

    The batch number is stored with the rows, and a batch that is tried again ignores what its first try appended.  So it emits the same
    rows again: ``emit`` gets the batch number and must replace what it has of that batch, or pass over it.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        schema = "plan_id string, url string, batch long"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(seen_path)
        exists = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        seen = spark.read.schema(schema).parquet(seen_path) if exists else spark.createDataFrame([], schema)
        fresh = new_articles_only(batch, seen.where(F.col("batch") < number), *order).persist()
        emit(fresh, number)
        fresh.select(F.col("plan_id").cast("string"), "url", F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(seen_path)
        fresh.unpersist()

    return run


def window_filter(stream: DataFrame, windows: DataFrame, now, keep_undated: bool = False) -> DataFrame:
    """Articles of a stream within their plan's window (plan_id, cutoff, stop)."""
    return stream.join(windows, "plan_id").where(in_date_window(F.col("pub_date"), F.col("cutoff"), F.col("stop"), now, keep_undated))


#: Keyed state with timers is kept in RocksDB, on disk and in the checkpoint's change logs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WINDOW_MS = 15 * 60 * 1000


class _QuotaWindows(StatefulProcessor):
    """Windows of one client and route: each opens with the first request after the one before has closed.

    Requests wait, as a list of times, until the watermark has passed them, so they count in the order of their times in whatever
    order they come.  The open window is two numbers.  A timer stands at the next waiting request and at the window's end.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long")
        self.window = handle.getValueState("window", "start long, requests long")

    def _settle(self, key, waiting: list[int], watermark: int) -> Iterator[pd.DataFrame]:
        start, requests = self.window.get() or (None, 0)
        closed, waiting = [], sorted(waiting)
        passed = [ms for ms in waiting if ms <= watermark]
        for ms in passed:
            if start is not None and ms >= start + WINDOW_MS:
                closed.append((start, requests))
                start = None
            start, requests = (ms, 1) if start is None else (start, requests + 1)
        if start is not None and start + WINDOW_MS <= watermark:
            closed.append((start, requests))
            start = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        rest = waiting[len(passed) :]
        self.waiting.put([(ms,) for ms in rest]) if rest else self.waiting.clear()
        if rest:
            self.handle.registerTimer(rest[0])
        if start is None:
            self.window.clear()
        else:
            self.window.update((start, requests))
            self.handle.registerTimer(start + WINDOW_MS)
        if closed:
            yield pd.DataFrame({"client": key[0], "route": key[1], "start": [c[0] for c in closed], "requests": [c[1] for c in closed]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting = [ms for (ms,) in self.waiting.get()] if self.waiting.exists() else []
        for pdf in rows:
            waiting += pdf["ms"].tolist()
        yield from self._settle(key, waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting = [ms for (ms,) in self.waiting.get()] if self.waiting.exists() else []
        yield from self._settle(key, waiting, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def quota(stream: DataFrame, limits: dict[str, int], ts: str = "ts", late: str = "15 minutes") -> DataFrame:
    """(start, client, route, requests, limit, over) of windows of 15 minutes that begin with a client's first request to a route, once they are closed.

    Requests more than ``late`` behind the newest may be left out.  Needs the RocksDB state store (``STATE_STORE``).
    """
    limit = F.create_map(*[F.lit(x) for item in limits.items() for x in item])[F.col("route")]
    given = stream.select(F.col(ts).alias("ts"), "client", "route", F.unix_millis(ts).alias("ms")).withWatermark("ts", late)
    found = given.groupBy("client", "route").transformWithStateInPandas(_QuotaWindows(), "client string, route string, start long, requests long", "append", "EventTime")
    return found.select(F.timestamp_millis("start").alias("start"), "client", "route", "requests", limit.alias("limit"), (F.col("requests") > limit).alias("over"))


def metrics(stream: DataFrame) -> DataFrame:
    """Running sums by metric name and calls by provider; for update or complete mode."""
    return stream.groupBy("name", "provider").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def latest_state(stream: DataFrame) -> DataFrame:
    """The latest stage, step and progress of each plan."""
    latest = F.max_by(F.struct("stage", "step", "progress"), F.struct("ts", "id"))
    return stream.groupBy("plan_id").agg(latest.alias("s"), F.max("ts").alias("ts")).select("plan_id", "ts", "s.stage", "s.step", "s.progress")


def _newest(n: int):
    """A processor that keeps a key's newest n events as list state."""

    class Newest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.events = handle.getListState("events", "us long, id long, event string")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            held = [tuple(x) for x in self.events.get()] if self.events.exists() else []
            for pdf in rows:
                held += zip(pdf["us"].tolist(), pdf["id"].tolist(), pdf["event"].tolist())
            held = sorted(held, key=lambda x: (x[0], x[1], x[2] is not None, x[2] or ""))[-n:]
            self.events.put(held)
            yield pd.DataFrame({"plan_id": [str(key[0])] * len(held), "id": [x[1] for x in held], "us": [x[0] for x in held], "event": [x[2] for x in held]})

        def close(self) -> None:
            pass

    return Newest()


def last_n(stream: DataFrame, n: int = 100) -> DataFrame:
    """The newest n events (id, ts, event) of each plan, as a list of at most n in the state; gives a plan's rows whenever it has new ones.  Needs the RocksDB state store (``STATE_STORE``)."""
    given = stream.select("plan_id", "id", F.unix_micros("ts").alias("us"), "event")
    found = given.groupBy("plan_id").transformWithStateInPandas(_newest(n), "plan_id string, id long, us long, event string", "update", "None")
    return found.select("plan_id", "id", F.timestamp_micros("us").alias("ts"), "event")


OUTBOX = "batch long, plan_id string, recipient string"


def _stored(spark, path: str) -> DataFrame:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(OUTBOX).parquet(path) if exists else spark.createDataFrame([], OUTBOX)


def digest_batch(plans: DataFrame, deliver: Callable[[DataFrame, int], None], *order, outbox: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: digests of a batch's articles to the recipients of plans with automatic mail, each at most once.

    ``outbox`` is a folder of (batch, plan_id, recipient): what is to be delivered is claimed there first, and noted as sent after.  A batch
    that is tried again leaves out what an earlier try has claimed.  Of a try that failed on the way, ``undelivered`` tells what was claimed and not noted as sent.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        due = build_digest(plans.where(F.coalesce("auto_mail", F.lit(False))), batch, *order)
        key = [F.lit(number).cast("long").alias("batch"), F.col("plan_id").cast("string").alias("plan_id"), "recipient"]
        claimed = _stored(spark, f"{outbox}/claimed").where(F.col("batch") == number).select(F.col("plan_id").alias("_plan"), F.col("recipient").alias("_to"))
        fresh = due.join(claimed, (F.col("plan_id").cast("string") == F.col("_plan")) & (F.col("recipient") == F.col("_to")), "left_anti")
        with scratch(spark, "digests") as folder:
            fresh = written(fresh, "fresh", folder)  # what is claimed from here on isn't among what it was compared with
            fresh.select(*key).write.mode("append").parquet(f"{outbox}/claimed")
            deliver(fresh, number)
            fresh.select(*key).write.mode("append").parquet(f"{outbox}/sent")

    return run


def undelivered(spark, outbox: str) -> DataFrame:
    """(batch, plan_id, recipient) that were claimed and not noted as sent: by a try that failed, or one that is still running."""
    return _stored(spark, f"{outbox}/claimed").join(_stored(spark, f"{outbox}/sent"), ["batch", "plan_id", "recipient"], "left_anti")
