"""Token-id files with a minimal perfect hash index for keyed access.

``write`` sorts documents by key, encodes them, appends the end id and writes
blocks. A block is one row, and one row group, of a Parquet shard (written by
Spark's committing writer, the only writer that reaches every store and
survives lost executors). Its ``payload`` is the raw ids of its documents one
after the other, little-endian unsigned integers of ``id_bytes`` bytes (2 if
all ids fit, else 4). Its index maps a key to its place in constant time: level
bit arrays of a minimal perfect hash function with a rank directory give the
key's slot, ``fingerprints`` holds a 32-bit stored fingerprint for the slot,
``slots_offset`` where its ids start. Blocks hold ``BLOCK_IDS`` ids or a single
longer document, and know their first and last key and the ids before them in
their shard. A manifest has a row for each shard: the ids before it, and its
first and last key.

``read`` looks every key up through the index, verifies fingerprints and
returns the ids; ``lookup`` does so for chosen keys, and opens the blocks
alone whose range of keys holds one of them.

Defined cases: null and empty texts give the end id alone; a null doc_id is a
key of its own that sorts first; repeated doc_ids are told apart by their
ordinal in the block (their order among themselves is that of their texts);
an empty table gives no blocks; other columns are ignored. A key group of any
size is spread over range partitions, since the sort is by key and text hash.
A text that holds the string of an added token is encoded whole, as the
library does, so that string gives the token's id.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import byte_alphabet
from .common import U, bounded_batches, documents, mix, scratch_dir
from .pretokens import PieceTable

#: Ids in a block, at which the next one begins.
BLOCK_IDS = 1 << 19
#: Bits of a level of the hash function for each key that reaches it.
GAMMA = 1.5
#: Bits for each entry of the rank directory.
RANK_BITS = 512
END_ID = 0

BLOCK_SCHEMA = "shard int, block int, n_docs long, n_ids long, before long, has_null boolean, first_key long, last_key long, id_bytes int, keys binary, nulls binary, levels binary, level_bits array<long>, ranks binary, slots_offset binary, slots_length binary, fingerprints binary, payload binary"
MANIFEST_SCHEMA = "shard int, base long, n_ids long, n_docs long, has_null boolean, first_key long, last_key long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_encoders: dict[str, tuple] = {}
#: Pieces of these characters alone, whose classes no version of Unicode has changed, are cut here; others are left to the library.
_PLAIN = re.compile(" [!-~\u00a1-\u024f](?:[\n!-~\u00a1-\u024f]*[!-~\u00a1-\u024f])?")
#: Those of them that are letters after the space are one pre-token.
_WORD = re.compile(" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
#: Fixed value: the library's byte-level pattern.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose ids a worker remembers.
CACHE_TOKENS = 400_000


class PieceEncoder:
    """Packed 32-bit ids of pieces by the tokenizers library: its model on pre-tokens that are met anew, its whole encoder on pieces out of the ordinary."""

    def __init__(self, tokenizer):
        import regex

        self.whole = lambda x: array("I", tokenizer.encode(x, add_special_tokens=False).ids).tobytes()
        self.find, self.tokenize = regex.compile(_BYTE_LEVEL).findall, tokenizer.model.tokenize
        letters = byte_alphabet()
        self.table, self.between = str.maketrans(dict(zip((chr(b) for b in range(256)), letters, strict=True))), letters[0]
        self.seen: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, words, plain = [b""] * len(texts), [], []
        is_word, is_plain = _WORD.fullmatch, _PLAIN.fullmatch
        for i, x in enumerate(texts):
            if is_word(x):
                words.append(i)
            elif is_plain(x):
                plain.append(i)
            elif x:
                out[i] = self.whole(x)
        # every piece begins with the one space that it holds, so it begins a pre-token, too
        tokens = self.find("".join([texts[i] for i in plain]))
        if len(self.seen) > CACHE_TOKENS:
            self.seen.clear()
        self._learn({texts[i] for i in words}.union(tokens).difference(self.seen))
        seen = self.seen
        for i in words:
            out[i] = seen[texts[i]]
        ids = [seen[t] for t in tokens]
        edges = [*(k for k, t in enumerate(tokens) if t[0] == " "), len(tokens)]
        for i, a, b in zip(plain, edges[:-1], edges[1:], strict=True):
            out[i] = b"".join(ids[a:b])
        return out

    def _learn(self, new: set[str]) -> None:
        """Ids of pre-tokens, whose bytes are mapped to the library's characters all at once; none holds a null character."""
        if new:
            order = list(new)
            mapped = "\0".join(order).encode().decode("latin-1").translate(self.table).split(self.between)
            tokenize = self.tokenize
            self.seen.update(zip(order, [array("I", [x.id for x in tokenize(m)]).tobytes() for m in mapped], strict=True))


def encoder(path: str) -> tuple[Callable[[list[str]], list[bytes]], int]:
    """Texts to packed 32-bit ids, as the tokenizers library encodes them without adding special tokens; and the vocabulary's size."""
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        added = [x.content for x in t.get_added_tokens_decoder().values()]
        kind = json.loads(t.to_str())
        pre = kind["pre_tokenizer"] or {}
        # texts are cut for a bare byte-level tokenizer only; another one's are encoded whole
        bare = kind["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"] and not kind["model"].get("dropout")
        pieces = PieceEncoder(t)
        cache = PieceTable(pieces)

        def encode(texts: list[str]) -> list[bytes]:
            cut = [bare and not any(a in x for a in added) for x in texts]
            some = iter(cache.many([x for x, c in zip(texts, cut, strict=True) if c]))
            return [next(some) if c else pieces.whole(x) for x, c in zip(texts, cut, strict=True)]

        _encoders[path] = (encode, t.get_vocab_size())
    return _encoders[path]


# --------------------------------------------------------------------------- minimal perfect hash


def key_hashes(keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each (key, null flag, ordinal among equal neighbours); equal keys stand together."""
    n = len(keys)
    same = np.zeros(n, bool)
    same[1:] = (keys[1:] == keys[:-1]) & (nulls[1:] == nulls[:-1])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
    return mix(mix(keys.astype(np.int64).view(U) + nulls.astype(U) * U(0x632BE59BD9B4E019)) + (np.arange(n) - start).astype(U) * U(0x9E3779B97F4A7C15))


def _level(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(h + U((level + 1) * 0xD1342543DE82EF95 & (1 << 64) - 1)) % U(bits)).astype(np.int64)


def build(h: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """(all level bits, their numbers, slot of each hash). Distinct hashes get the slots 0 to n - 1, each once."""
    arrays, sizes, place = [], [], np.full(len(h), -1, np.int64)
    left, base = np.arange(len(h)), 0
    while len(left):
        bits = max(64, int(GAMMA * len(left)))
        at = _level(h[left], len(sizes), bits)
        count = np.bincount(at, minlength=bits)
        alone = count[at] == 1
        place[left[alone]] = base + at[alone]
        arrays.append(count == 1)
        sizes.append(bits)
        left, base = left[~alone], base + bits
        if len(sizes) > 60:
            raise ValueError("equal 64-bit key hashes in one block")
    bits = np.concatenate(arrays) if arrays else np.zeros(0, bool)
    rank = np.cumsum(bits) - 1
    return bits, sizes, rank[place] if len(h) else place


class Levels:
    """The level bits of a hash function with a rank directory: each key's slot takes a few steps, whatever the number of keys."""

    def __init__(self, packed: bytes, sizes: list[int], ranks: bytes):
        self.bytes, self.sizes, self.ranks = np.frombuffer(packed, np.uint8), sizes, np.frombuffer(ranks, "<u4")

    @staticmethod
    def pack(bits: np.ndarray) -> tuple[bytes, bytes]:
        """(bits, padded to whole runs of RANK_BITS; number of ones before each run)."""
        runs = -(-len(bits) // RANK_BITS)
        padded = np.zeros(runs * RANK_BITS, bool)
        padded[: len(bits)] = bits
        ones = np.cumsum(padded.reshape(runs, RANK_BITS).sum(axis=1))
        return np.packbits(padded).tobytes(), np.concatenate([[0], ones[:-1]])[:runs].astype("<u4").tobytes()

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        run = at // RANK_BITS
        width = RANK_BITS // 8
        own = self.bytes.reshape(-1, width)[run]
        inside = np.unpackbits(own, axis=1)
        return self.ranks[run] + np.where(np.arange(RANK_BITS) < (at % RANK_BITS)[:, None], inside, 0).sum(axis=1)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where no level holds it (an unknown key may still get a slot: compare fingerprints)."""
        out, open_, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            at = base + _level(h[open_], level, size)
            found = (self.bytes[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            for i in range(0, int(found.sum()), 4096):
                part = np.flatnonzero(found)[i : i + 4096]
                out[open_[part]] = self.rank(at[part])
            open_, base = open_[~found], base + size
        return out


def fingerprints(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ U(0xA5A5A5A5F0F0F0F0)) >> U(32)).astype("<u4")


# --------------------------------------------------------------------------- writing


def _block(shard: int, block: int, before: int, keys: list, ids: list[bytes], id_bytes: int) -> dict:
    nulls = np.array([k is None for k in keys], bool)
    values = np.array([0 if k is None else k for k in keys], "<i8")
    h = key_hashes(values, nulls)
    bits, sizes, slot = build(h)
    lengths = np.array([len(x) // 4 for x in ids], "<u4")
    starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.uint64)])[:-1].astype("<u8")
    by_slot = [np.empty(len(h), t) for t in ("<u8", "<u4", "<u4")]
    for out, x in zip(by_slot, (starts, lengths, fingerprints(h)), strict=True):
        out[slot] = x
    payload = np.frombuffer(b"".join(ids), "<u4")
    levels, ranks = Levels.pack(bits)
    real = values[~nulls]
    return {
        "shard": shard, "block": block, "n_docs": len(keys), "n_ids": int(lengths.sum(dtype=np.int64)), "before": before, "has_null": bool(nulls.any()),
        "first_key": int(real[0]) if len(real) else None, "last_key": int(real[-1]) if len(real) else None, "id_bytes": id_bytes,
        "keys": values.tobytes(), "nulls": np.packbits(nulls).tobytes(), "levels": levels, "level_bits": sizes, "ranks": ranks,
        "slots_offset": by_slot[0].tobytes(), "slots_length": by_slot[1].tobytes(), "fingerprints": by_slot[2].tobytes(), "payload": payload.astype(f"<u{id_bytes}").tobytes(),
    }


def arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split(" ") for x in BLOCK_SCHEMA.split(", "))])


def write(docs: DataFrame, out: str, path: str | None = None, partitions: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode docs in ascending doc_id order into block files and a manifest under out. One shuffle, of the texts, by range of key."""
    path = path or tokenizer_path()
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = arrow_schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, vocabulary = encoder(path)
        id_bytes = 2 if vocabulary <= 1 << 16 else 4
        end = array("I", [END_ID]).tobytes()
        shard, block, before, keys, ids, n = TaskContext.get().partitionId(), 0, 0, [], [], 0
        for batch in batches:
            for i, key in enumerate(batch.column("doc_id").to_pylist()):
                if i % 128 == 0:
                    texts = encode([t or "" for t in batch.column("text").slice(i, 128).to_pylist()])
                keys.append(key)
                ids.append(texts[i % 128] + end)
                n += len(ids[-1]) // 4
                if n >= block_ids:
                    yield pa.RecordBatch.from_pylist([_block(shard, block, before, keys, ids, id_bytes)], schema)
                    block, before, keys, ids, n = block + 1, before + n, [], [], 0
        if keys:
            yield pa.RecordBatch.from_pylist([_block(shard, block, before, keys, ids, id_bytes)], schema)

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("text").asc_nulls_first()]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text")).repartitionByRange(n, *order[:2]).sortWithinPartitions(*order)
    ordered.select("doc_id", "text").mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").option("parquet.block.row.count.limit", 1).parquet(f"{out}/blocks")
    # a row for each shard, as many as there are partitions
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{out}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"), F.sum("n_docs").alias("n_docs"), F.max("has_null").alias("has_null"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key")).collect()
    rows, base = [], 0
    for r in sorted(shards, key=lambda r: r["shard"]):
        rows.append((r["shard"], base, r["n_ids"], r["n_docs"], r["has_null"], r["first_key"], r["last_key"]))
        base += r["n_ids"]
    spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.parquet(f"{out}/manifest")


# --------------------------------------------------------------------------- reading


class Block:
    """Constant-time access to the ids of one block's documents."""

    def __init__(self, row: dict):
        self.n = row["n_docs"]
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=self.n).astype(bool)
        self.levels = Levels(row["levels"], row["level_bits"], row["ranks"])
        self.offsets, self.lengths = np.frombuffer(row["slots_offset"], "<u8"), np.frombuffer(row["slots_length"], "<u4")
        self.prints = np.frombuffer(row["fingerprints"], "<u4")
        self.payload = np.frombuffer(row["payload"], f"<u{row['id_bytes']}")

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots of key hashes, -1 where the index or the fingerprint says no."""
        slot = self.levels.slots(h)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == fingerprints(h[ok])
        return np.where(ok, slot, -1)

    def ids(self, slot: int) -> np.ndarray:
        start = int(self.offsets[slot])
        return self.payload[start : start + int(self.lengths[slot])]


READ_SCHEMA = "doc_id long, shard int, block int, start long, ids binary"


def _read(keys: list[int | None] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                block = Block(row)
                if keys is None:
                    values, nulls = block.keys, block.nulls
                else:
                    values, nulls = np.array([k or 0 for k in keys], np.int64), np.array([k is None for k in keys], bool)
                slot = block.find(key_hashes(values, nulls))
                if keys is None and (slot < 0).any():
                    raise ValueError(f"shard {row['shard']}, block {row['block']}: the index doesn't hold all its keys")
                if keys is not None:
                    values, nulls, slot = values[slot >= 0], nulls[slot >= 0], slot[slot >= 0]
                base = row["base"]
                for i in range(0, len(slot), 2000):
                    part = slot[i : i + 2000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if z else int(v) for v, z in zip(values[i : i + 2000], nulls[i : i + 2000], strict=True)], pa.int64()),
                            pa.array([row["shard"]] * len(part), pa.int32()), pa.array([row["block"]] * len(part), pa.int32()),
                            pa.array([base + int(block.offsets[s]) for s in part], pa.int64()), pa.array([block.ids(int(s)).astype("<u4").tobytes() for s in part], pa.binary()),
                        ],
                        names=["doc_id", "shard", "block", "start", "ids"],
                    )

    return run


def _blocks(spark: SparkSession, path: str, chosen: Column | None = None) -> DataFrame:
    """Blocks with the number of ids before them in all files. The manifest, a row for each shard, is broadcast."""
    manifest = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest").select("shard", F.col("base").alias("shard_base"))
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    blocks = blocks if chosen is None else blocks.where(chosen)
    return blocks.join(F.broadcast(manifest), "shard").withColumn("base", F.col("shard_base") + F.col("before")).drop("shard_base")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files through the index: doc_id, shard, block, start (ids before it in all files), ids (32-bit)."""
    return _blocks(spark, path).mapInArrow(_read(None), READ_SCHEMA)


def blocks_of(spark: SparkSession, path: str, keys: list[int | None]) -> DataFrame:
    """The blocks whose range of keys holds one of the keys: shards by the manifest, then row groups by their statistics."""
    real = sorted({k for k in keys if k is not None})
    null = any(k is None for k in keys)
    shards = [
        r["shard"] for r in spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest").toLocalIterator()
        if null and r["has_null"] or r["first_key"] is not None and bisect_left(real, r["first_key"]) < bisect_right(real, r["last_key"])
    ]
    # the filter on keys is cut to ranges, so that its length doesn't follow their number
    step = max(1, -(-len(real) // 64))
    ranges = [(real[i], real[min(i + step, len(real)) - 1]) for i in range(0, len(real), step)]
    hit = F.lit(False)
    for lo, hi in ranges:
        hit = hit | ((F.col("first_key") <= hi) & (F.col("last_key") >= lo))
    hit = hit | F.col("has_null") if null else hit
    return _blocks(spark, path, F.col("shard").isin(shards) & hit)


def lookup(spark: SparkSession, path: str, keys: list[int | None]) -> DataFrame:
    """The chosen documents (first of each key in its block), by their keys."""
    return blocks_of(spark, path, keys).mapInArrow(_read(list(keys)), READ_SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    out = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), out)
    found = read(spark, out)
    return found.select("doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
