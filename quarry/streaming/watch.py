"""Indexing as files arrive: what has changed gathers by source until it is quiet, then these files are indexed.

A stateful operator keeps each source's changed paths and a timer, which every change sets anew; when it runs out, the
paths go on as one row. The file source reports new and rewritten files, never removed ones: scan() lists everything and
finds those, and periodic() does so on a timer. A failed batch keeps the last good revision; the stream's checkpoint lies
beside the index, so that a restart goes on where it stood.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener

from quarry.engine import Engine
from quarry.operators.indexing import Busy
from quarry.session import ship

# The time without changes that ends a burst, and waits for another writer's lease.
QUIET_MS, RETRY_FROM, RETRY_TO = 1_500, 0.25, 5.0
FILE = "path string, modificationTime timestamp, length long, content binary"
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
QUIET = "source_id string, paths array<string>"


class Quiet(StatefulProcessor):
    """A source's changed paths, given out once nothing has changed for QUIET_MS."""

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.paths = handle.getMapState("paths", "path string", "n int")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in rows:
            self.paths.updateValue((r.path,), (1,))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + QUIET_MS)
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        paths = sorted(k[0] for k in self.paths.keys())
        self.paths.clear()
        return iter([Row(source_id=key[0], paths=paths)] if paths else [])

    def close(self) -> None:
        pass


def retried(work: Callable[[], dict], attempts: int = 12, wait: float = RETRY_FROM) -> dict:
    """work(), again while another writer holds the lease, with longer waits each time."""
    for _ in range(attempts - 1):
        try:
            return work()
        except Busy:
            time.sleep(wait)
            wait = min(RETRY_TO, wait * 2)
    return work()


def arrivals(spark: SparkSession, engine: Engine) -> DataFrame:
    """(source_id, path) of files as they arrive below the sources in use; contents aren't read."""
    streams = []
    for s in engine.config.sources:
        if s.enabled:
            files = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", True).load(s.root)
            streams.append(files.where(F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).isin(*s.extensions)).select(F.lit(s.id).alias("source_id"), "path"))
    if not streams:
        raise ValueError("no source in use")
    return reduce(DataFrame.unionByName, streams)


def quiet(changes: DataFrame) -> DataFrame:
    """QUIET: the changed paths (source_id, path) of each source, a row a burst."""
    ship(changes.sparkSession)
    return changes.groupBy("source_id").transformWithState(Quiet(), QUIET, "Update", "ProcessingTime")


def watch(spark: SparkSession, engine: Engine, once: bool = False, told: Callable[[dict], None] | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Index what arrives until the query is stopped; with once, only what is there now. told hears of every run."""

    def batch(rows: DataFrame, _: int) -> None:
        # of one burst: the files that the run will read anyway
        paths = {r.source_id: r.paths for r in rows.groupBy("source_id").agg(F.flatten(F.collect_set("paths")).alias("paths")).collect()}
        if paths:
            run = retried(lambda: engine.update(tuple(sorted(paths)), paths=paths))
            if told:
                told(run)

    at = checkpoint or f"{engine.index.root}/watch-{'once' if once else 'quiet'}"
    if once:
        changes = arrivals(spark, engine).select("source_id", F.array("path").alias("paths"))
        return changes.writeStream.foreachBatch(batch).option("checkpointLocation", at).trigger(availableNow=True).start()
    spark.conf.set(*STATE_STORE)
    writer = quiet(arrivals(spark, engine)).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", at)
    return writer.trigger(processingTime="500 milliseconds").start()


def periodic(engine: Engine, stop: threading.Event, told: Callable[[dict], None] | None = None, first: float = 0.75) -> threading.Thread:
    """Whole scans until stop is set: one soon after the start, then one every scan_minutes."""

    def work() -> None:
        wait = first
        while not stop.wait(wait):
            run = scan(engine)
            if told:
                told(run)
            wait = engine.config.scan_minutes * 60

    thread = threading.Thread(target=work, daemon=True)
    thread.start()
    return thread


def scan(engine: Engine) -> dict:
    """A whole listing of all sources, which also finds removed files: at the start, and every scan_minutes after."""
    return retried(engine.update)


class Progress(StreamingQueryListener):
    """Rows and seconds of every micro-batch."""

    def __init__(self, told: Callable[[dict], None]):
        self.told = told

    def onQueryStarted(self, event) -> None:
        self.told({"event": "started", "query": str(event.id)})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.told({"event": "progress", "batch": p.batchId, "files": p.numInputRows, "ms": p.batchDuration})

    def onQueryIdle(self, event) -> None:
        self.told({"event": "idle", "query": str(event.id)})

    def onQueryTerminated(self, event) -> None:
        self.told({"event": "terminated", "failed": event.exception is not None})
