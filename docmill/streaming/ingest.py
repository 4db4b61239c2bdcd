"""Incremental ingest: a file source, one row for each content key by streaming state, rules that end a run, and a record of progress."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Queries that start inside keep their state in RocksDB, on the executors' disks and in the checkpoint, so that it may outgrow
    their memory; ``partitions`` is how many parts a new checkpoint's state gets, which stays so for its life."""
    wanted = {PROVIDER: ROCKS} | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start_ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str = "image_id", files_per_batch: int = 8, wait: bool = True, partitions: int | None = None) -> StreamingQuery:
    """Read new Parquet files of ``source`` and store each key once, whichever file or batch brings it first.

    The keys seen are streaming state, dealt by key: a batch looks up its own keys there and reads nothing of what is stored.
    Each batch owns the folder ``batch=<number>`` of the target and overwrites it; so a batch that runs again after a failure,
    from the state of the batch before, stores the same rows once. The checkpoint says where to go on after a stop. Batches are
    of ``files_per_batch`` files; the query ends when all are read. Rows with a null key are not stored. Every batch opens and stores
    each part of the state: without ``partitions``, a new one has as many as there are cores, and no more than shuffles have.
    """
    partitions = partitions or min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2, spark.sparkContext.defaultParallelism))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    with state_on_disk(spark, partitions):
        fresh = stream.where(F.col(key).isNotNull()).dropDuplicates([key])
        query = fresh.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if wait:
        query.awaitTermination()
    return query


# --- rules that end a run ----------------------------------------------------------------------------------------------


class StopRules(StatefulProcessor):
    """Watches each run's items (at, is_new) and says once when the run should end: at the item that is one too many, at the last of
    ``window`` items in a row that brought nothing new, or when the run has lasted ``max_seconds``.

    The state of a run is one row: the session it counts for, items, items in a row without anything new, the time it began, and the
    reason once it has ended. A session is one start of the query: a later one begins to count anew. The timer ends a run that gets
    no items at all, too. Items after the one that ended a run are counted as not ``done``.
    """

    def __init__(self, session: str, window: int | None = None, limit: int | None = None, max_seconds: float | None = None) -> None:
        self.session, self.window, self.limit, self.max_seconds = session, window, limit, max_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "session string, items bigint, streak bigint, began bigint, reason string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        session, items, streak, began, reason = self.run.get() if self.run.exists() else (None, 0, 0, 0, None)
        if session != self.session:
            session, items, streak, began, reason = self.session, 0, 0, now, None
            if self.max_seconds is not None:
                self.handle.registerTimer(now + int(self.max_seconds * 1000))
        batch = pd.concat(list(rows)).sort_values("at", kind="stable")
        said = None
        for at, is_new in zip(batch["at"].tolist(), batch["is_new"].tolist(), strict=True):
            if reason:
                break
            items, streak = items + 1, 0 if is_new else streak + 1
            if self.limit is not None and items > self.limit:
                items, reason, said = items - 1, "limit", at
            elif self.window is not None and streak >= self.window:
                reason, said = "plateau", at
        if not reason and self.max_seconds is not None and now - began >= self.max_seconds * 1000:
            reason, said = "seconds", int(batch["at"].iloc[-1])
        self.run.update((session, items, streak, began, reason))
        if said is not None:
            yield pd.DataFrame({"run": [key[0]], "stop_at": [said], "reason": [reason], "items": [items]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.run.exists():
            return
        session, items, streak, began, reason = self.run.get()
        if session == self.session and not reason:
            self.run.update((session, items, streak, began, "seconds"))
            yield pd.DataFrame({"run": [key[0]], "stop_at": pd.array([None], "Int64"), "reason": ["seconds"], "items": [items]})

    def close(self) -> None:
        pass


def stop_signals(items: DataFrame, session: str, window: int | None = None, limit: int | None = None, max_seconds: float | None = None) -> DataFrame:
    """(run, stop_at, reason, items) of a stream (run, at, is_new): one row when a run should end. ``stop_at`` is null if time ended it
    without an item. A task holds a run's items of one batch."""
    return items.select("run", F.col("at").cast("bigint").alias("at"), "is_new").groupBy("run").transformWithStateInPandas(
        StopRules(session, window, limit, max_seconds), "run string, stop_at bigint, reason string, items bigint", "Append", "ProcessingTime"
    )


class UntilStop:
    """A query over a stream (run, at, is_new) that ends when a rule says so, or, with ``drain``, when all is read.

    The batch that meets the rule is finished and committed first, and none after it is: a later start goes on with what has not
    been read. With very many runs, ``out`` is a folder that gets their signals, a folder a batch, and only the first of a batch comes to
    the driver.
    """

    def __init__(self, items: DataFrame, checkpoint: str, *, drain: bool = True, poll: float = 0.2, partitions: int | None = None, out: str | None = None, **rules) -> None:
        self.found: list[dict] = []
        self.session, self.poll = uuid.uuid4().hex, poll

        def hear(batch: DataFrame, number: int) -> None:
            if self.found:  # the query is being stopped: this batch must not be committed
                raise RuntimeError("a rule has ended the run")
            if out:
                batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
                batch = batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/batch={number}").limit(1)
            self.found += [r.asDict() for r in batch.collect()]  # one row a run that ends

        with state_on_disk(items.sparkSession, partitions):
            writer = stop_signals(items, self.session, **rules).writeStream.foreachBatch(hear).option("checkpointLocation", checkpoint)
            self.query = (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=f"{int(poll * 1000)} milliseconds")).start()
        self.watcher = threading.Thread(target=self._watch, daemon=True)
        self.watcher.start()

    def _watch(self) -> None:
        while self.query.isActive:
            if self.found:
                self.query.stop()
                return
            time.sleep(self.poll)

    def wait(self, seconds: float | None = None) -> list[dict]:
        """What ended the runs, after the query has ended."""
        try:
            self.query.awaitTermination(*([seconds] if seconds else []))
        except StreamingQueryException:
            if not self.found:
                raise
        self.watcher.join(seconds)
        return self.found
class Progress(StreamingQueryListener):
    """Keeps the latest progress of each query: rows, rate and the time of the last heartbeat."""

    def __init__(self) -> None:
        self.state: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:
        self.state[str(event.id)] = {"state": "running", "rows": 0, "rate": 0.0, "at": datetime.now(UTC)}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        s = self.state.setdefault(str(p.id), {"rows": 0})
        s.update(state="running", rows=s["rows"] + p.numInputRows, rate=p.processedRowsPerSecond, at=datetime.now(UTC))

    def onQueryIdle(self, event) -> None:
        self.state.setdefault(str(event.id), {})["at"] = datetime.now(UTC)

    def onQueryTerminated(self, event) -> None:
        self.state.setdefault(str(event.id), {})["state"] = "error" if event.exception else "stopped"


def run_state(state: str, age_s: float, own: bool, fresh_s: float = 10.0) -> str:
    """idle, running, stopped, error, or external: another process's run whose heartbeat is fresh."""
    if state == "error" or own:
        return state
    return "external" if state == "running" and age_s < fresh_s else "stopped" if state == "running" else state


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Engine addition: events by tumbling windows and type, late ones dropped after the watermark. ``ts`` must be a timestamp."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def state_of_run(state: Column, age_s: Column, own: Column, fresh_s: float = 10.0) -> Column:
    """:func:`run_state` for a table of runs."""
    stale = F.when(age_s < fresh_s, "external").otherwise("stopped")
    return F.when((state == "error") | own, state).when(state == "running", stale).otherwise(state)
