import numpy as np
import pytest

from ondaspark.plans import checkpoint, jobs, tasks
from ondaspark.sources import channels
from ondaspark.streaming.feeds import Feed


def test_runs_are_logged_and_lost_ones_found(spark, tmp_path):
    path = str(tmp_path / "runs.jsonl")
    s = jobs.Scheduler(path, spark)
    good = s.submit(jobs.CallableJob(lambda a: object() if a else None, (1,)))
    bad = s.submit(jobs.CallableJob(lambda: 1 / 0))
    good.wait(), bad.wait()
    assert good.status() == "success" and list(good.statuses()) == ["submitted", "computing", "success"]
    assert good.metadata()["result"]["type"] == "object"
    with pytest.raises(ZeroDivisionError):
        bad.result()
    assert bad.status() == "error"
    with pytest.raises(TypeError):
        s.submit(3)
    s.log["x"] = {"status": "computing", "process": 0.0, "start_time": 0.0, "end_time": None, "result": None}
    s.close()
    again = jobs.Scheduler(path)
    assert again.task("x").status() == "lost"
    assert again.runs(spark).count() == 3
    with pytest.raises(KeyError):
        again.task("none")


def test_checkpoints_publish_only_success(spark, tmp_path):
    reg = checkpoint.Registry(spark, f"file://{tmp_path}/cp", str(tmp_path / "log.jsonl"))
    calls = []

    def make():
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("broken")
        return spark.range(5).selectExpr("id AS channel", "id * 1.0D AS x")

    c = reg.create("parquet", "a", make, dims=("channel",))
    with pytest.raises(FileNotFoundError):
        c.load()
    with pytest.raises(RuntimeError):
        reg.compute("a")
    assert not c.has_result()
    assert reg.compute("a").columns == ["channel", "x"]
    assert reg.compute("a").count() == 5 and len(calls) == 2
    assert reg.compute("a", recompute=True).count() == 5 and len(calls) == 3
    assert c.sidecar()["is_array"]
    with pytest.raises(ValueError):
        reg.create("parquet", "a", make)
    with pytest.raises(ValueError):
        reg.create("parquet", "b", make, location="a")
    assert reg.status().first()["status"] == "success"
    plain = checkpoint.ParquetCheckpoint(spark, f"file://{tmp_path}/plain", lambda: spark.range(3))
    assert checkpoint.compute_all(plain).count() == 3


def test_deferred_graph():
    calls, stored = [], {"/b": 10}
    pair = tasks.defer(lambda x: calls.append(x) or (x, x + 1), ["a", "b"])
    a, b = pair(1)
    total = tasks.defer(lambda x, y: x + y, "sum")(a, y=b)
    assert tasks.compute([total, a]) == [3, 1] and calls == [1]
    persist = {"b": "/b", "a": "/a"}
    assert tasks.status([total], persist, stored.__contains__) == {"sum": "to_compute", "a": "to_compute", "b": "skipped", "__common__a_b": "to_compute"}
    assert tasks.compute([total], persist, stored.__contains__, stored.__getitem__, stored.__setitem__) == [11] and stored["/a"] == 1


def test_feed():
    f = Feed()
    f.send(1), f.send(2), f.close()
    assert list(f.receive()) == [1, 2] == list(f.receive()) and list(f.receive(1)) == [2]
    with pytest.raises(ValueError):
        f.send(3)


def test_channel_guards(spark):
    rows = [("a", "Adc", 0, 1, 10.0, 0.0, 2.0), ("b", "Adc", 0, 2, 10.0, 0.5, 3.0), ("c", "Event", 0, 3, -1.0, 0.0, 1.0), ("d", "Adc", 0, 4, 20.0, 0.0, 1.0)]
    table = spark.createDataFrame(rows, channels.CHANNEL_SCHEMA)
    read = lambda channel, first, count: np.arange(first, first + count) + channel * 100.0
    df, fs = channels.load(spark, table, [1, 2], read, block=4)
    assert fs == 10.0 and df.count() == 2 * 15
    assert df.where("channel = 2 AND i = 7").first()["t"] == pytest.approx(1.2)
    assert channels.load(spark, table, [], read)[1] == channels.EMPTY_FS
    for wrong in ([3], [1, 4], [9], [1, 1], [...]):
        with pytest.raises(ValueError):
            channels.load(spark, table, wrong, read)
    assert {r["chan_num"] for r in channels.choose(table, [..., 4]).collect()} == {1, 2}
