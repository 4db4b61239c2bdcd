"""Start, stop and status of a run: a streaming query with a heartbeat that other processes see, and a bounded record of its progress."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import deque
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.workspace import read_text, write_text

IDLE, RUNNING, STOPPED, EXTERNAL, ERROR = "idle", "running", "stopped", "external", "error"
LEAST_INTERVAL = 0.25


class RunControl:
    """One named run in a folder that several processes share. At most one of them runs it.

    While its query is active, the owner writes a heartbeat file every ``interval`` seconds (at least LEAST_INTERVAL): owner, state,
    rows, batch, rate and time. Any other control of the same folder and name reads that file: the run counts as ``external`` while
    the heartbeat is younger than ``fresh_s`` seconds, else as stopped. ``keep`` points of progress are held, older ones go.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str = "ingest", interval: float = 1.0, fresh_s: float = 10.0, keep: int = 120) -> None:
        self.spark, self.path = spark, f"{folder.rstrip('/')}/{name}.json"
        self.interval, self.fresh_s = max(LEAST_INTERVAL, interval), fresh_s
        self.owner = uuid.uuid4().hex
        self.query: StreamingQuery | None = None
        self.points: deque[dict] = deque(maxlen=keep)
        self.rows, self.batch, self.beats = 0, -1, 0
        self.error: str | None = None
        self._ended, self._lock = threading.Event(), threading.Lock()

    def start(self, make: Callable[[], StreamingQuery]) -> dict:
        """Start the query that ``make`` gives, unless the run is active here or elsewhere; the status, either way."""
        with self._lock:
            now = self.status()
            if now["state"] in (RUNNING, EXTERNAL):
                return now | {"started": False}
            self.points.clear()
            self.rows, self.batch, self.beats, self.error = 0, -1, 0, None
            self._ended.clear()
            self.query = make()
            self._beat(RUNNING)
            threading.Thread(target=self._watch, daemon=True).start()
            return self.status() | {"started": True}

    def stop(self, timeout: float = 10.0) -> dict:
        """Ask the query to stop and, if it has not ended after ``timeout`` seconds, cancel its jobs. A run of another process, or none,
        is left alone."""
        query = self.query
        if query is not None and query.isActive:
            asked = threading.Thread(target=query.stop, daemon=True)
            asked.start()
            asked.join(timeout)
            if asked.is_alive():
                self.spark.sparkContext.cancelJobGroup(str(query.runId))
                asked.join(timeout)
        if query is not None:
            self._ended.wait(timeout)
        return self.status()

    def wait(self, seconds: float | None = None) -> dict:
        """The status after the query has ended, or after so many seconds."""
        if self.query is not None:
            self._ended.wait(seconds)
        return self.status()

    def status(self) -> dict:
        """state, rows, batch, rate (rows a second), error and age (seconds since the last heartbeat)."""
        own = {"rows": self.rows, "batch": self.batch, "rate": self.points[-1]["rate"] if self.points else 0.0, "error": self.error, "age": 0.0}
        if self.query is not None and (self.query.isActive or not self._ended.is_set()):
            return own | {"state": RUNNING}
        beat = self._read()
        if beat is None:
            return own | {"state": IDLE}
        age = time.time() - beat["at"]
        said = {k: beat[k] for k in ("rows", "batch", "rate", "error")} | {"age": age}
        if beat["state"] == RUNNING and beat["owner"] != self.owner:
            return said | {"state": EXTERNAL if age < self.fresh_s else STOPPED}
        return said | {"state": STOPPED if beat["state"] == RUNNING else beat["state"]}

    def progress(self) -> list[dict]:
        """The last points (batch, rows, rate), oldest first."""
        return list(self.points)

    def _take(self) -> None:
        """Points of the batches that have ended since. ``recentProgress`` of the query is bounded itself."""
        for p in self.query.recentProgress:
            if p["batchId"] > self.batch:
                self.batch = p["batchId"]
                self.rows += p["numInputRows"]
                self.points.append({"batch": p["batchId"], "rows": p["numInputRows"], "rate": float(p["processedRowsPerSecond"])})

    def _watch(self) -> None:
        while self.query.isActive:
            self._take()
            self._beat(RUNNING)
            self._wait_for_end(self.interval)
        self._take()
        e = self.query.exception()
        self.error = str(e).split("\n")[0] if e else None
        self._beat(ERROR if e else STOPPED)
        self._ended.set()

    def _wait_for_end(self, seconds: float) -> None:
        until = time.monotonic() + seconds
        while self.query.isActive and time.monotonic() < until:
            time.sleep(0.05)

    def _beat(self, state: str) -> None:
        self.beats += 1
        rate = self.points[-1]["rate"] if self.points else 0.0
        write_text(self.spark, self.path, json.dumps({"owner": self.owner, "state": state, "rows": self.rows, "batch": self.batch, "rate": rate, "error": self.error, "at": time.time()}))

    def _read(self) -> dict | None:
        for _ in range(3):  # a file that is being written may be read half
            try:
                text = read_text(self.spark, self.path)
                return json.loads(text) if text is not None else None
            except ValueError:
                time.sleep(0.05)
        return None
