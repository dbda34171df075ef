import json
import random

import pytest

from ondaspark.functions import jsonpatch
from ondaspark.sources import dictlog
from ondaspark.sources.logdb import LogDB, read_operations


def test_dictlog_replay_compaction_and_errors(spark, tmp_path):
    path = str(tmp_path / "kv.jsonl")
    log, want, r = dictlog.DictLog(path), {}, random.Random(1)
    for i in range(200):
        k = f"k{r.randrange(12)}"
        if r.random() < 0.3:
            del log[k]  # a missing key leaves a tombstone, too
            want.pop(k, None)
        else:
            log[k] = want[k] = {"n": i}
    assert dict(dictlog.DictLog(path)) == want
    rows = {x["id"]: json.loads(x["value"]) for x in dictlog.latest(dictlog.read_log(spark, path)).collect()}
    assert rows == want
    log.compact()
    assert dict(dictlog.DictLog(path)) == want and len(open(path).readlines()) == len(want)
    with open(path, "a") as f:
        f.write("{broken\n")
    with pytest.raises(ValueError):
        dictlog.DictLog(path)
    with pytest.warns(UserWarning):
        assert dict(dictlog.DictLog(path, ignore_errors=True)) == want


def test_both_forms_of_a_log_agree(spark, tmp_path):
    path = tmp_path / "deep" / "kv.jsonl"
    log = dictlog.DictLog(str(path))
    log["a"], log["b"], log["c"] = 1, None, {"x": [1]}
    del log["a"]
    del log["missing"]
    log["d"] = "e"
    log["c"] = 2.5
    want = {"b": None, "c": 2.5, "d": "e"}
    spark_form = lambda ignore=False: {r["id"]: json.loads(r["value"]) for r in dictlog.latest(dictlog.read_log(spark, str(path), ignore)).collect()}
    assert spark_form() == dict(dictlog.DictLog(str(path))) == want
    dictlog.compact_log(spark, str(path), str(tmp_path / "out"))
    lines = spark.read.text(str(tmp_path / "out")).collect()
    assert {json.loads(r["value"])["id"]: json.loads(r["value"])["value"] for r in lines} == want and len(lines) == 3
    assert dict(dictlog.DictLog(str(path), compact_log=True)) == want and len(path.read_text().splitlines()) == 3
    path.write_text(path.read_text() + '{"id": "z"}\n')  # neither value nor tombstone
    with pytest.raises(ValueError):
        dictlog.DictLog(str(path))
    with pytest.raises(Exception, match="malformed"):
        spark_form()
    with pytest.warns(UserWarning):
        assert dict(dictlog.DictLog(str(path), ignore_errors=True)) == spark_form(True) == want


def test_log_of_several_files_keeps_its_order(spark, tmp_path):
    rows = spark.range(2000).selectExpr("id AS seq", "id % 7 AS id", "id AS value", "id % 11 = 0 AS deleted").repartition(5)
    dictlog.write_log(rows, str(tmp_path / "log"))
    got = {r["id"]: r["value"] for r in dictlog.latest(dictlog.read_log(spark, str(tmp_path / "log"))).collect()}
    last = {str(i % 7): i for i in range(2000)}
    assert got == {k: str(v) for k, v in last.items() if v % 11}


def test_rawsignal_source(spark, tmp_path):
    import numpy as np

    from ondaspark.sources.blocks import RawSignalSource

    x = np.arange(14.0).reshape(2, 7)
    x.tofile(tmp_path / "raw")
    spark.dataSource.register(RawSignalSource)
    got = spark.read.format("rawsignal").option("path", str(tmp_path / "raw")).option("channels", 2).option("samples", 7).option("block", 3).load().collect()
    assert sorted(map(tuple, got)) == [(c, i, x[c, i]) for c in range(2) for i in range(7)]


def test_logdb_replay_equals_memory(spark, tmp_path):
    path, r = str(tmp_path / "db.jsonl"), random.Random(2)
    db = LogDB(path, {"list": [], "doc": "x"})
    for i in range(150):
        items = db.root["list"]
        c = r.random()
        if c < 0.5 or not len(items):
            items.insert(r.randrange(len(items) + 1), {"i": i, "tags": [i]} if c < 0.3 else i)
        elif c < 0.7:
            del items[r.randrange(len(items))]
        else:
            items[r.randrange(len(items))] = {"new": i}
        db.root[f"k{i % 5}"] = {"deep": {"i": i}}
    del db.root["k0"]
    assert LogDB(path).root.plain() == db.root.plain()
    assert read_operations(spark, path).where("op = 'reset_root'").count() == 1
    child = db.root["k1"]
    with pytest.raises(ValueError):
        db.root["other"] = child


@pytest.mark.parametrize(("a", "b"), [({"x": [1, 2, 3]}, {"x": [1, 4], "y/~": None}), ([], [1, [2]]), ({"a": 1}, [1]), ({"a": {"b": 1}}, {"a": {"b": True}})])
def test_patches(a, b):
    assert jsonpatch.apply(a, jsonpatch.diff(a, b)) == b
