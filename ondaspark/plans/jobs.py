"""Jobs in a bounded pool of threads, with a run log that outlives the process."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import CancelledError, Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from ..sources.dictlog import DictLog
from ..streaming.feeds import Feed

RUN_SCHEMA = "id string, status string, process double, start_time double, end_time double, result string"
#: States from which a run does not go on.
FINAL = ("success", "cancelled", "error", "lost")


@dataclass(frozen=True)
class CallableJob:
    """A function and its arguments."""

    function: Callable
    args: tuple = ()
    kwargs: dict = field(default_factory=dict)

    def run(self) -> Any:
        return self.function(*self.args, **self.kwargs)


@dataclass(frozen=True)
class DataFrameJob:
    """A DataFrame that is evaluated by being written as Parquet."""

    df: DataFrame
    path: str

    def run(self) -> str:
        self.df.write.mode("overwrite").parquet(self.path)
        return self.path


class TaskLike(Protocol):
    id: str

    def wait(self, timeout: float | None = None) -> None: ...
    def metadata(self) -> dict: ...
    def statuses(self): ...
    def result(self, timeout: float | None = None) -> Any: ...


class SchedulerLike(Protocol):
    supported: tuple[type, ...]

    def submit(self, job) -> TaskLike: ...
    def task(self, id: str) -> TaskLike: ...


class Task:
    """A submitted run, or (without a future) one found in the log."""

    def __init__(self, scheduler: Scheduler, id: str, future: Future | None, feed: Feed):
        self.scheduler, self.id, self.future, self.feed = scheduler, id, future, feed

    def metadata(self) -> dict:
        return dict(self.scheduler.log[self.id])

    def status(self) -> str:
        return self.metadata()["status"]

    def statuses(self):
        """Every state of the run, from the first, until it ends."""
        return self.feed.receive()

    def wait(self, timeout: float | None = None) -> None:
        """Until the run ends, in whatever state."""
        if self.future is not None:
            try:
                self.future.exception(timeout)
            except CancelledError:
                pass

    def result(self, timeout: float | None = None) -> Any:
        """The job's value; raises what it raised. A run of an earlier process gives its logged summary."""
        if self.future is not None:
            return self.future.result(timeout)
        if self.status() != "success":
            raise RuntimeError(f"run {self.id} ended as {self.status()}")
        return self.metadata()["result"]

    def cancel(self) -> bool:
        """Stop a run that waits; of one that runs, cancel its Spark jobs."""
        if self.future is None:
            return False
        if self.future.cancel():
            self.scheduler._record(self.id, self.feed, "cancelled", end_time=time.time())
            self.feed.close()
            return True
        if not self.future.done() and self.scheduler.spark is not None:
            self.scheduler._cancelled.add(self.id)
            self.scheduler.spark.sparkContext.cancelJobGroup(self.id)
            return True
        return False


class Scheduler:
    """At most max_running jobs at once, each a Spark job group of its own. Where the application runs with spark.scheduler.mode=FAIR, each also has a pool of its own."""

    supported = (CallableJob, DataFrameJob)

    def __init__(self, log_path: str, spark: SparkSession | None = None, max_running: int = 5):
        import threading

        self.spark = spark
        self.log = DictLog(log_path)
        self.lock = threading.RLock()
        self.pool = ThreadPoolExecutor(max_running)
        self.process = time.time()
        self._feeds: dict[str, Feed] = {}
        self._tasks: dict[str, Task] = {}
        self._cancelled: set[str] = set()
        for id, record in list(self.log.items()):
            if record["status"] not in FINAL:  # its process is gone
                self.log[id] = record | {"status": "lost"}

    def _record(self, id: str, feed: Feed, status: str, **more) -> None:
        with self.lock:
            self.log[id] = self.log.get(id, {}) | {"status": status} | more
        feed.send(status)

    def submit(self, job) -> Task:
        if not isinstance(job, self.supported):
            raise TypeError(f"jobs are {' or '.join(t.__name__ for t in self.supported)}, not {type(job).__name__}")
        id, feed = str(uuid.uuid4()), Feed()
        self._record(id, feed, "submitted", process=self.process, start_time=None, end_time=None, result=None)
        task = Task(self, id, None, feed)
        self._tasks[id] = task
        task.future = self.pool.submit(self._run, id, feed, job)
        return task

    def _run(self, id: str, feed: Feed, job) -> Any:
        self._record(id, feed, "computing", start_time=time.time())
        try:
            if self.spark is not None:
                self.spark.sparkContext.setJobGroup(id, f"run {id}", interruptOnCancel=True)
                self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", id)
            value = job.run()
        except BaseException as e:
            self._record(id, feed, "cancelled" if id in self._cancelled else "error", end_time=time.time(), result=repr(e)[:1000])
            raise
        else:
            self._record(id, feed, "success", end_time=time.time(), result=summary(value))
            return value
        finally:
            feed.close()

    def task(self, id: str) -> Task:
        """A run by its id, of this process or an earlier one."""
        if id in self._tasks:
            return self._tasks[id]
        if id not in self.log:
            raise KeyError(f"no run {id}")
        feed = Feed()
        feed.send(self.log[id]["status"])
        feed.close()
        return Task(self, id, None, feed)

    def runs(self, spark: SparkSession) -> DataFrame:
        """The run log as a table (RUN_SCHEMA)."""
        rows = [(k, r["status"], r["process"], r["start_time"], r["end_time"], json.dumps(r["result"])) for k, r in self.log.items()]
        return spark.createDataFrame(rows, RUN_SCHEMA)

    def close(self) -> None:
        self.pool.shutdown(wait=True)


def summary(value: Any) -> Any:
    """What a log can hold of a value: itself if it is JSON, else its type and a short form."""
    try:
        json.dumps(value)
        return value
    except (TypeError, ValueError):
        return {"type": type(value).__name__, "repr": repr(value)[:200]}
