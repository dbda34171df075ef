"""Status feeds for many consumers, and key-value logs as streams."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.dictlog import LOG_SCHEMA, latest


class Feed:
    """An append-only list that any number of consumers read from its beginning (or a given place) until it is closed."""

    def __init__(self):
        self._items: list[Any] = []
        self._closed = False
        self._changed = threading.Condition()

    def send(self, item: Any) -> None:
        with self._changed:
            if self._closed:
                raise ValueError("the feed is closed")
            self._items.append(item)
            self._changed.notify_all()

    def close(self) -> None:
        with self._changed:
            self._closed = True
            self._changed.notify_all()

    def __len__(self) -> int:
        return len(self._items)

    def receive(self, start: int = 0, timeout: float | None = None) -> Iterator[Any]:
        at = start
        while True:
            with self._changed:
                if not self._changed.wait_for(lambda: len(self._items) > at or self._closed, timeout):
                    raise TimeoutError("nothing was sent in time")
                if len(self._items) <= at:
                    return
                item = self._items[at]
            at += 1
            yield item


def progress(spark: SparkSession) -> dict[str, int]:
    """Task numbers of the stages that run now: completed, active, failed, total."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for s in (tracker.getStageInfo(i) for i in tracker.getActiveStageIds()) if s]
    out = {"completed": sum(s.numCompletedTasks for s in stages), "active": sum(s.numActiveTasks for s in stages), "failed": sum(s.numFailedTasks for s in stages)}
    return out | {"total": sum(s.numTasks for s in stages)}


def stream_latest(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Follow a folder of JSON-lines log files: each batch's last values, by key, replace a table of live entries (seq: file time, then place).

    Returns the streaming query; the table is Parquet, one version a folder under out, named by the batch.
    """
    lines = spark.readStream.schema(f"{LOG_SCHEMA}, seq long").json(folder)

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.select("id", "seq", "value", F.coalesce("deleted", F.lit(False)).alias("deleted"))
        if number:
            new = new.unionByName(spark.read.schema("id string, seq long, value string, deleted boolean").parquet(f"{out}/{number - 1}"))
        last = new.groupBy("id").agg(F.max_by(F.struct("value", "deleted"), "seq").alias("e"), F.max("seq").alias("seq"))
        last.select("id", "seq", "e.value", "e.deleted").write.mode("overwrite").parquet(f"{out}/{number}")

    return lines.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live(table: DataFrame) -> DataFrame:
    return latest(table)
