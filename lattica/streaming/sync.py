"""Keeping tables current from streams."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


IDLE, UPDATING, INDEXING, FAILED = "idle", "updating", "indexing", "failed"


class Busy(RuntimeError):
    pass


class Sync:
    """Updates of one engine, one at a time, and what they are doing: idle, updating (the graph), indexing (the vectors) or failed (until the next one succeeds)."""

    def __init__(self, engine):
        self.engine, self.state, self.error, self.runs, self.last = engine, IDLE, None, 0, None
        self._lock = threading.Lock()

    def run(self, force: bool = False) -> dict:
        """Update the graph, then the vectors if they fall behind; Busy if an update is running."""
        if not self._lock.acquire(blocking=False):
            raise Busy(self.state)
        try:
            self.state = UPDATING
            done = self.engine.update(force)
            if self.engine.store.exists("points_code") and self.engine.needs_reindex():
                self.state = INDEXING
                done |= self.engine.index()
            self.state, self.error, self.last = IDLE, None, done
            self.runs += 1
            return done
        except Exception as e:
            self.state, self.error = FAILED, str(e)
            raise
        finally:
            self._lock.release()

    def status(self) -> dict:
        """State, runs, last result and error, and the engine's versions and counts."""
        return {"state": self.state, "runs": self.runs, "last": self.last, "error": self.error, **self.engine.index_status()}


def auto_sync(engine, every: str = "30 seconds", once: bool = False, then: Callable[[dict], None] | None = None, sync: Sync | None = None) -> StreamingQuery:
    """Update an engine's graph and vectors again and again. Files that change in place or go are invisible to a file stream, so each trigger compares snapshots instead. A trigger that finds an update running is left out."""
    ticks = engine.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load() if once else engine.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    own = sync or Sync(engine)

    def run(batch: DataFrame, epoch: int) -> None:
        try:
            done = own.run()
        except Busy:
            return
        if then:
            then(done)

    writer = ticks.writeStream.foreachBatch(run)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def apply_changes(stream: DataFrame, target: Callable[[DataFrame, int], None], key: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Per micro-batch the last row of each key, handed to target with the batch's number, which repeats when a batch is run again."""
    from ..operators.resolve import last_wins

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: target(last_wins(df, key, order), n)).trigger(availableNow=True).start()


def windowed(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, event_type, n, total): counts by event time; batch or stream, late rows are dropped from a stream only."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, session_start, session_end, n): runs of a user's events with no pause as long as gap."""
    grouped = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return grouped.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
