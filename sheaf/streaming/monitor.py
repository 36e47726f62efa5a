"""What a running query says about itself: late rows of its watermarks (2J), and live progress of a job's stages."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

LATE = "query string, run_id string, batch_id bigint, ts string, watermark string, operator int, name string, late_rows bigint, kept_rows bigint"
PROGRESS = "root_id string, stage string, current bigint, total bigint, us bigint"


def late_of(progress: dict) -> list[tuple]:
    """A row for each stateful operator of one progress report, counted from the plan's end."""
    watermark = (progress.get("eventTime") or {}).get("watermark")
    return [(progress.get("name"), progress["runId"], int(progress["batchId"]), progress["timestamp"], watermark, i, op.get("operatorName"),
             int(op["numRowsDroppedByWatermark"]), int(op["numRowsTotal"])) for i, op in enumerate(progress.get("stateOperators") or [])]


def late_rows(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """2J: rows that came after the watermark, of each micro-batch and stateful operator that the query still remembers."""
    return spark.createDataFrame([row for p in query.recentProgress for row in late_of(json.loads(p.json))], LATE)


class LateRows(StreamingQueryListener):
    """The same for all queries of a session and any length of run: rows are kept until :meth:`table` writes them out.

    ``spark.streams.addListener(LateRows(spark, folder))``; ``folder`` is appended to in Parquet, one row an operator and
    micro-batch in which rows came late.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.lock, self.rows = threading.Lock(), []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = [row for row in late_of(json.loads(event.progress.json)) if row[7]]
        with self.lock:
            self.rows += found

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self) -> DataFrame:
        """All late rows so far, those of earlier calls included."""
        with self.lock:
            rows, self.rows = self.rows, []
        self.spark.createDataFrame(rows, LATE).coalesce(1).write.mode("append").parquet(self.folder)
        return self.spark.read.schema(LATE).parquet(self.folder)


class LiveProgress:
    """A job's progress while it runs, as ``root_id, stage, current, total, us`` rows in the order they came.

    Each stage's Spark jobs form a job group; ``current`` and ``total`` are its finished and known tasks.  A row is kept
    (and given to ``report``) when something changed, and one when the stage is done.

        live = LiveProgress(spark, "my-root", report=print)
        with live.stage("scanning"): ...
        with live.stage("reading"): ...
        live.table()
    """

    def __init__(self, spark: SparkSession, root_id: str, report: Callable[[tuple], None] | None = None, every: float = 0.05):
        self.spark, self.root_id, self.report, self.every = spark, root_id, report, every
        self.rows: list[tuple] = []

    def _note(self, stage: str, current: int, total: int) -> None:
        last = self.rows[-1] if self.rows else None
        if last is None or last[1:4] != (stage, current, total):
            self.rows.append((self.root_id, stage, current, total, time.time_ns() // 1000))
            if self.report:
                self.report(self.rows[-1])

    def _counts(self, group: str) -> tuple[int, int]:
        tracker = self.spark.sparkContext.statusTracker()
        done = total = 0
        for job in tracker.getJobIdsForGroup(group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                now = tracker.getStageInfo(stage)
                if now:
                    done, total = done + now.numCompletedTasks, total + now.numTasks
        return done, total

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        """Spark jobs started inside of this block by the calling thread are the stage ``name``."""
        sc = self.spark.sparkContext
        group, over = f"{self.root_id}/{name}/{time.time_ns()}", threading.Event()
        self._note(name, 0, 0)

        def watch() -> None:
            while not over.wait(self.every):
                self._note(name, *self._counts(group))

        watcher = threading.Thread(target=watch, daemon=True)
        sc.setJobGroup(group, f"{name} {self.root_id}")
        watcher.start()
        try:
            yield
        finally:
            over.set()
            watcher.join()
            sc.setLocalProperty("spark.jobGroup.id", None)
        done, total = self._counts(group)
        self._note(name, max(done, total), max(done, total))

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, PROGRESS)
