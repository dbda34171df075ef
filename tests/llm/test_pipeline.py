"""Every stage of the pipeline against brute force on its own input, and components against union-find."""

import hashlib
import random
import re
import struct

import pyarrow as pa
import pytest

import corpus_pipeline
from ondaspark.llm import byte_bpe, components, quality_rules

SF = "/root/testdata/sf0.001"


def _components(edges):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            parent[max(x, y)] = min(x, y)
    return {x: top(x) for x in parent}


@pytest.mark.parametrize("edges", [[], [(1, 1), (2, None)], [(i, i + 1) for i in range(40)], [(7, i) for i in range(30)] + [(40, 7), (7, 40)], [(random.Random(i).randrange(60), random.Random(-i - 1).randrange(60)) for i in range(45)]])
def test_components(spark, edges):
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in got} == _components(edges) and len(got) == len({r["node"] for r in got})


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_contraction_keeps_components(block, monkeypatch):
    monkeypatch.setattr(components, "BLOCK_EDGES", block)
    r = random.Random(block)
    edges = [(r.randrange(-90, 90), r.randrange(-90, 90)) for _ in range(120)] + [(i, i - 1) for i in range(200, 300)]
    edges = [e for e in edges if e[0] != e[1]]
    batches = [pa.RecordBatch.from_arrays([pa.array([e[0] for e in part], pa.int64()), pa.array([e[1] for e in part], pa.int64())], names=["a", "b"]) for part in (edges[:50], [], edges[50:])]
    left = [e for x in components._contract(iter(batches)) for e in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)]
    assert _components(left) == _components(edges) and len(left) <= len(edges)
    if block == 1000:  # one block: stars already
        assert {a: b for a, b in left} == {a: b for a, b in _components(edges).items() if a != b}


def _words(text, pattern):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _near_survivors(docs):
    sets = {}
    for r in docs:
        w = _words(r["text"], r"[^\x20\x09-\x0D]+")
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    linked = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    label = _components(linked)
    return {d for d in ids if label.get(d, d) == d}


def _holds_passage(text, windows):
    w = _words(text, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return any(tuple(w[i : i + n]) in windows[n] for n in windows for i in range(len(w) - n + 1))


def test_stages_and_run(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    windows = {}
    for r in benchmark:
        w = _words(r["text"], r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        n = min(13, len(w))
        if n:
            windows.setdefault(n, set()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    docs = given
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.materialise(stage(spark, docs, SF))
        after = {r["doc_id"]: r for r in docs.collect()}
        assert docs.count() == len(after)
        if name != "byte_bpe":
            assert docs.columns == given.columns
        if name == "quality_rules":
            verdicts = quality_rules.judge(given, spark.read.parquet(f"{SF}/labels.parquet")).collect()
            assert set(after) == {r["doc_id"] for r in verdicts if r["kept"]}
            assert all(len(_words(r["text"], r"[^\x20\x09-\x0D]+")) >= 10 for r in after.values())
        elif name == "jaccard_join":
            assert set(after) == _near_survivors(before.values()) and len(after) < len(before)
        elif name == "decontaminate":
            assert set(after) == {d for d, r in before.items() if not _holds_passage(r["text"], windows)}
        elif name == "pii":
            assert set(after) == set(before)
            email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
            for d, r in after.items():
                assert not email.search(r["text"])
                if not re.search("[0-9@]", before[d]["text"]):
                    assert r["text"] == before[d]["text"]
        else:
            import public_tokenizers as P
            import tiktoken

            enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.read_ranks(byte_bpe.vocabulary_path()), special_tokens={})
            assert set(after) == set(before)
            for d, r in before.items():
                ids = enc.encode_ordinary(r["text"])
                assert after[d]["n_tokens"] == len(ids) and after[d]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
                assert after[d]["decoded_sha256"] == hashlib.sha256(r["text"].encode()).hexdigest()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))
