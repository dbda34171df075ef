"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training windows.

Words are runs of letters and digits (ASCII, A-Z lower-cased) and of every
non-ASCII character. A benchmark item gives all its windows of ``width``
words, or one window of all its words if it has fewer. Each document is turned
into benchmark word numbers, every window's hash is looked up in the set, and
every hit is verified word by word. Verified hits mark words; the caller gets
counts, the hit items, and can drop the document or cut the hit spans.

Bounds: the hash set is broadcast only while the benchmark has at most
``MAX_BROADCAST_WORDS`` words; a larger benchmark is cut into item blocks of
that size (a larger item is a block of its own), each read, broadcast, scanned
with and given up before the next, so memory follows the block, not the
benchmark. Results don't depend on the blocks: their hits are united.

Defined cases: null or empty text has no words and no hits; an item without
words matches nothing; repeated items all count as hit; repeated doc_ids are
separate rows; a null doc_id stays null; null item_ids are ignored; an empty
benchmark hits nothing; other columns pass through ``remove`` unchanged and
are ignored by ``scan``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import binary_column, bounded_batches, delete_paths, documents, materialise

WIDTH = 13
#: A document is contaminated when hit words are at least 1 / RATIO of its words.
RATIO = 20
#: Words of benchmark text whose windows are broadcast at once (about 100 bytes each in a worker).
MAX_BROADCAST_WORDS = 1_000_000

#: Lower-cases A-Z, keeps digits, letters and bytes of non-ASCII characters, blanks the rest.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORDISH = np.array([b != 32 for b in _TABLE])

SCAN_SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class WindowSet:
    """The windows of some items: word numbers, hashes by window length, and the exact words behind each hash."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.numbers: dict[bytes, int] = {}
        self.by_length: dict[int, dict[tuple[int, ...], set[str]]] = {}
        for item, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            if ids:
                size = min(width, len(ids))
                found = self.by_length.setdefault(size, {})
                for i in range(len(ids) - size + 1):
                    found.setdefault(tuple(ids[i : i + size]), set()).add(item)
        self.hashes = {size: np.array(sorted({int(self.hash(np.array(w, np.uint64), size)[0]) for w in found}), np.uint64) for size, found in self.by_length.items()}

    @staticmethod
    def hash(ids: np.ndarray, size: int) -> np.ndarray:
        n = len(ids) - size + 1
        out = np.zeros(max(n, 0), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size if n > 0 else 0):
                out = (out ^ ids[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        return out

    def scan(self, ids: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """ids: a document's word numbers, 0 for words of no item. Marks hit words."""
        hit, items = np.zeros(len(ids), bool), set()
        known = ids > 0
        if not known.any():
            return hit, items
        run = np.concatenate([[0], np.cumsum(known)])
        for size, hashes in self.hashes.items():
            if len(ids) < size:
                continue
            whole = np.flatnonzero(run[size:] - run[:-size] == size)
            if not len(whole):
                continue
            h = self.hash(ids, size)[whole]
            at = np.searchsorted(hashes, h)
            at[at == len(hashes)] = 0
            for i in whole[hashes[at] == h]:
                of = self.by_length[size].get(tuple(ids[i : i + size].tolist()))
                if of:
                    hit[i : i + size] = True
                    items |= of
        return hit, items


def _scanner(shared: Broadcast, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        number = windows.numbers.get
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "items", "spans")}
            for value in binary_column(batch, "text"):
                text = value.as_py()
                words = words_of(text)
                ids = np.fromiter((number(w, 0) for w in words), np.uint64, len(words))
                hit, items = windows.scan(ids)
                out["n_words"].append(len(words))
                out["n_hit"].append(int(hit.sum()))
                out["items"].append(sorted(items))
                out["spans"].append(_spans(text, hit) if with_spans and items else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_hit"], pa.int64()), pa.array(out["items"], pa.list_(pa.string())), pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "n_words", "n_hit", "items", "spans"],
            )

    return run


def _spans(text: bytes, hit: np.ndarray) -> list[dict]:
    """Code point spans of the runs of hit words."""
    data = np.frombuffer(text, np.uint8)
    solid = _WORDISH[data]
    starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    ends = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1]]))
    last = np.flatnonzero(hit & ~np.concatenate([hit[1:], [False]]))
    return [{"start": int(points[starts[a]]), "end": int(points[ends[b]])} for a, b in zip(first, last, strict=True)]


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of at most limit words (an item alone may exceed it)."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    for row in rows.toLocalIterator():
        text = bytes(row["text"])
        n = len(words_of(text))
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((row["item"], text))
        size += n
    if block:
        yield block


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, with_spans: bool = False, block_words: int = MAX_BROADCAST_WORDS) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, items (sorted as strings), spans (code points, if asked for; touching runs of one block merged)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    blocks = _blocks(benchmark, block_words)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_scanner(spark.sparkContext.broadcast(WindowSet(first, width)), with_spans), SCAN_SCHEMA)
    # More than one block: hit words must be united, so every block's scan returns word positions by way of spans.
    keyed = materialise(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    source = keyed.select(F.col("row").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    parts = None
    for items in chain((first, second), blocks):
        shared = spark.sparkContext.broadcast(WindowSet(items, width))
        one = materialise(source.mapInArrow(_scanner(shared, True), SCAN_SCHEMA).where("n_hit > 0").select("doc_id", "items", "spans"))
        shared.destroy()
        parts = one if parts is None else parts.unionByName(one)
    per_row = parts.groupBy(F.col("doc_id").alias("row")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    united = keyed.join(per_row, "row", "left").select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")
    return united.mapInArrow(_uniter, SCAN_SCHEMA)


def _uniter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_hit, spans = [], [], []
        for text, found in zip(binary_column(batch, "text"), batch.column("spans").to_pylist(), strict=True):
            n_words.append(len(words_of(text.as_py())))
            data = text.as_py().decode("utf-8", "replace")
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in found or []):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            n_hit.append(sum(len(words_of(data[a:b].encode())) for a, b in merged))
            spans.append([{"start": a, "end": b} for a, b in merged])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), batch.column("items"), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))], names=["doc_id", "n_words", "n_hit", "items", "spans"])


def contaminated() -> F.Column:
    return (F.col("n_hit") > 0) & (F.lit(RATIO) * F.col("n_hit") >= F.col("n_words"))


def remove(docs: DataFrame, benchmark: DataFrame, mode: str = "documents") -> DataFrame:
    """docs (all columns) without contaminated documents, or (mode ``any``) without documents that hold any hit, or (mode ``spans``) with every hit span cut from the text.

    Rows carry their hits, so they need no key and keep their columns. Each
    block of a benchmark but the last adds its hits to those of the blocks
    before; the last one's scan decides and cuts on the hits of all.
    """
    if mode not in ("documents", "any", "spans"):
        raise ValueError(f"no mode {mode!r}")
    spark, schema, marks, scratch, last = docs.sparkSession, docs.schema, "hit", [], None
    while marks in {c.lower() for c in docs.columns}:
        marks = "_" + marks
    bounded_batches(spark)
    for items in _blocks(benchmark, MAX_BROADCAST_WORDS):
        if last is not None:
            before, scratch = scratch, []
            marked = StructType([*schema.fields, StructField(marks, BinaryType())])
            shared = spark.sparkContext.broadcast(WindowSet(last, WIDTH))
            docs = materialise(docs.mapInArrow(_marker(shared, schema.names, marks), marked), scratch)
            shared.destroy()
            delete_paths(spark, before)
        last = items
    return docs if last is None else docs.mapInArrow(_remover(spark.sparkContext.broadcast(WindowSet(last, WIDTH)), schema.names, mode, marks), schema)


def _hits(batch: pa.RecordBatch, windows: WindowSet, marks: str) -> Iterator[tuple[bytes, np.ndarray]]:
    """(text, hit words) of each row, with the hits that it carries."""
    number = windows.numbers.get
    carried = batch.column(marks) if marks in batch.schema.names else [None] * len(batch)
    for value, old in zip(binary_column(batch, "text"), carried, strict=True):
        text = value.as_py()
        words = words_of(text)
        hit, _ = windows.scan(np.fromiter((number(w, 0) for w in words), np.uint64, len(words)))
        if old is not None:
            hit |= np.unpackbits(np.frombuffer(old.as_py(), np.uint8), count=len(hit)).astype(bool)
        yield text, hit


def _marker(shared: Broadcast, names: list[str], marks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([np.packbits(hit).tobytes() for _, hit in _hits(batch, shared.value, marks)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], found], names=[*names, marks])

    return run


def _remover(shared: Broadcast, names: list[str], mode: str, marks: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, texts = [], []
            for text, hit in _hits(batch, shared.value, marks):
                n = int(hit.sum())
                keep.append(mode == "spans" or not n or mode == "documents" and RATIO * n < len(hit))
                if n and mode == "spans":
                    whole = text.decode()
                    for s in reversed(_spans(text, hit)):
                        whole = whole[: s["start"]] + whole[s["end"] :]
                    texts.append(whole)
                else:
                    texts.append(None)
            if mode == "spans" and any(t is not None for t in texts):
                old = batch.column("text").to_pylist()
                new = pa.array([b if a is None else a for a, b in zip(texts, old, strict=True)], pa.string())
                batch = pa.RecordBatch.from_arrays([new if n == "text" else batch.column(n) for n in names], names=names)
            yield batch.select(names).filter(pa.array(keep, pa.bool_()))

    return run


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS gram
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM bw), hits AS (
  SELECT DISTINCT g.doc_id, g.i, g.size, bw.item FROM (
    SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS gram FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i) WHERE len(w) >= size
  ) g JOIN bw ON bw.size = g.size AND bw.gram = g.gram
), n_hit AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), n_item AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_item.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(n_item.items, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AND 20 * coalesce(n_hit.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN n_item USING (doc_id)
"""
