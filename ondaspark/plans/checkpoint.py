"""Checkpoints of DataFrames: computed once, published whole, loaded lazily or cached."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.logdb import LogDB
from .jobs import CallableJob, Scheduler, Task

CODECS: dict[str, type[Checkpoint]] = {}


def codec(name: str):
    """Register a type of checkpoint by name."""

    def register(cls):
        CODECS[name] = cls
        return cls

    return register


class Store:
    """Files by way of Spark's file systems, so that any store works."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark.sparkContext._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        if not fs.rename(p, self.jvm.org.apache.hadoop.fs.Path(new)):
            raise OSError(f"can't rename {old} to {new}")

    def write_text(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        out.write(bytearray(text.encode()))
        out.close()

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()


class Checkpoint:
    """Published at path when its run ended in success; a failed run leaves its temporary folder and publishes nothing."""

    def __init__(self, spark: SparkSession, path: str, f: Callable[[], DataFrame], scheduler: Scheduler | None = None, known: Callable[[], bool] = lambda: True):
        self.spark, self.path, self.f, self.scheduler, self.known = spark, path, f, scheduler, known
        self.store = Store(spark)
        self.running: Task | None = None

    @property
    def tmp(self) -> str:
        head, _, tail = self.path.rstrip("/").rpartition("/")
        return f"{head}/.tmp{tail}"

    def has_result(self) -> bool:
        return self.store.exists(self.path)

    def load(self) -> DataFrame:
        if not self.has_result():
            raise FileNotFoundError(f"checkpoint {self.path} isn't computed")
        return self.read(self.path)

    def _produce(self) -> None:
        self.store.delete(self.tmp)
        self.write(self.f(), self.tmp)

    def compute(self, recompute: bool = False) -> DataFrame:
        """A hit if it is published and its run is known; else run it, and publish by renaming only after success."""
        if self.running is not None:
            self.running.result()
            return self.load()
        if self.has_result():
            if self.known() and not recompute:
                return self.load()
            self.store.delete(self.path)
        if self.scheduler is None:
            self._produce()
        else:
            self.running = self.scheduler.submit(CallableJob(self._produce))
            try:
                self.running.result()  # raises on error: nothing is published
            finally:
                self.running = None
        self.store.rename(self.tmp, self.path)
        return self.load()

    def write(self, df: DataFrame, path: str) -> None:
        raise NotImplementedError

    def read(self, path: str) -> DataFrame:
        raise NotImplementedError


@codec("parquet")
class ParquetCheckpoint(Checkpoint):
    """Parquet and a JSON sidecar. A table with one value column may be kept as an array of its dimensions; computed tables are cached when loaded."""

    def __init__(self, *args, dims: tuple[str, ...] = (), fs: float | None = None, computed: bool = False, name: str = "data", **kwargs):
        super().__init__(*args, **kwargs)
        self.dims, self.fs, self.computed, self.name = dims, fs, computed, name

    def write(self, df: DataFrame, path: str) -> None:
        values = [c for c in df.columns if c not in self.dims]
        is_array = bool(self.dims) and len(values) == 1
        if is_array:
            df = df.withColumnRenamed(values[0], self.name)
        df.write.parquet(f"{path}/table")
        self.store.write_text(f"{path}/sidecar.json", json.dumps({"dims": self.dims, "fs": self.fs, "is_array": is_array, "computed": self.computed, "was": values[0] if is_array else None}))

    def sidecar(self) -> dict:
        return json.loads(self.store.read_text(f"{self.path}/sidecar.json"))

    def read(self, path: str) -> DataFrame:
        about = json.loads(self.store.read_text(f"{path}/sidecar.json"))
        df = self.spark.read.parquet(f"{path}/table")
        if about["is_array"]:
            values = [c for c in df.columns if c not in about["dims"]]
            if len(values) != 1:
                raise ValueError(f"an array checkpoint holds one variable, not {values}")
            df = df.withColumnRenamed(values[0], about["was"])
        return df.cache() if about["computed"] else df


class Registry:
    """Checkpoints by id under one folder; ids, places and outcomes are kept in a nested log."""

    def __init__(self, spark: SparkSession, folder: str, log_path: str, scheduler: Scheduler | None = None):
        self.spark, self.folder, self.scheduler = spark, folder.rstrip("/"), scheduler
        self.log = LogDB(log_path, {"checkpoints": {}})
        self.created: dict[str, Checkpoint] = {}

    def create(self, kind: str, id: str, f: Callable[[], DataFrame], metadata: dict | None = None, location: str | None = None, **options) -> Checkpoint:
        if id in self.created:
            raise ValueError(f"checkpoint {id!r} exists already")
        path = f"{self.folder}/{location or id}"
        if any(c.path == path for c in self.created.values()):
            raise ValueError(f"two checkpoints can't share {path}")
        entries = self.log.root["checkpoints"]
        if id not in entries:
            entries[id] = {"kind": kind, "path": path, "metadata": metadata or {}, "status": "created"}
        elif entries[id].plain()["path"] != path:
            raise ValueError(f"checkpoint {id!r} lies at {entries[id].plain()['path']}")
        self.created[id] = CODECS[kind](self.spark, path, f, self.scheduler, lambda: entries[id].plain()["status"] == "success", **options)
        return self.created[id]

    def compute(self, id: str, recompute: bool = False) -> DataFrame:
        entry = self.log.root["checkpoints"][id]
        try:
            df = self.created[id].compute(recompute)
        except BaseException:
            entry["status"] = "error"
            raise
        entry["status"] = "success"
        return df

    def status(self) -> DataFrame:
        """(id, kind, path, status, metadata as JSON) of every checkpoint ever created here."""
        rows = [(k, v["kind"], v["path"], v["status"], json.dumps(v["metadata"])) for k, v in self.log.root["checkpoints"].plain().items()]
        return self.spark.createDataFrame(rows, "id string, kind string, path string, status string, metadata string")


def compute_all(checkpoints: Checkpoint | list[Checkpoint]) -> DataFrame | list[DataFrame]:
    """Compute those that are missing, at once where a scheduler is there, then load all; one in, one out."""
    single = isinstance(checkpoints, Checkpoint)
    todo = [checkpoints] if single else list(checkpoints)
    missing = [c for c in todo if not c.has_result()]
    for c in missing:
        if c.scheduler is not None:
            c.running = c.scheduler.submit(CallableJob(c._produce))
    for c in missing:
        if c.running is not None:
            task, c.running = c.running, None
            task.result()
            c.store.rename(c.tmp, c.path)
        else:
            c.compute()
    out = [c.load() for c in todo]
    return out[0] if single else out
