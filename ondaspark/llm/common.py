"""What the operators share: scratch tables, Arrow text batches, word and byte hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker expands into 64-bit arrays at once; a longer document is taken alone.
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# --------------------------------------------------------------------------- scratch tables


#: The temporary folder of a local application that names none.
_own_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only for a local session that names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        # the setting can't be changed in a running session
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="ondaspark-")
        base = _own_dirs[app]
    return f"{base.rstrip('/')}/ondaspark"


def materialise(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared scratch folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    """Remove scratch tables that no pending DataFrame reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    paths.clear()


# --------------------------------------------------------------------------- bounded Bloom filter, built by Spark

#: Bits of the filter: 8 MB, whatever the rows.
BLOOM_BITS = 26


def bloom_filter(df: DataFrame, key: str, bits: int = BLOOM_BITS) -> bytes:
    """Which well-mixed 64-bit keys may occur in df: two bits of 2**bits for each, taken from the key itself.

    Built with bitmap aggregates; at most 2**bits / 32768 rows of 4 KB reach
    the driver. A saturated filter lets more rows pass, never fewer, so it is
    only used where an exact join follows.
    """
    mask = (1 << bits) - 1
    spots = F.array(F.col(key).bitwiseAND(mask), F.shiftrightunsigned(F.col(key), 34).bitwiseAND(mask))
    spot = df.select(F.explode(spots).alias("s"))
    # bitmap positions count from 0 within buckets that count from 1
    parts = spot.groupBy(F.bitmap_bucket_number(F.col("s") + 1).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("s") + 1)).alias("m"))
    out = bytearray(1 << (bits - 3))
    # in one job: toLocalIterator() would run one for each partition
    for row in parts.collect():
        at = (row["b"] - 1) * 4096
        out[at : at + 4096] = bytes(row["m"])
    return bytes(out)


def in_bloom(keys: np.ndarray, bloom: bytes, bits: int = BLOOM_BITS) -> np.ndarray:
    """Whether each key may be in the filter."""
    k, seen = keys.astype(np.int64).view(np.uint64), np.frombuffer(bloom, np.uint8)
    mask = np.uint64((1 << bits) - 1)
    out = np.ones(len(k), bool)
    for spot in (k & mask, (k >> np.uint64(34)) & mask):
        out &= (seen[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


# --------------------------------------------------------------------------- Arrow batches


#: Rows and bytes of an Arrow batch at most, so that a batch of whole texts or sets stays at a few MB in the JVM and in Python.
BATCH_ROWS, BATCH_BYTES = 500, 1 << 22


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's limits of an Arrow batch to rows and BATCH_BYTES; lower ones stay."""
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, most, number in (("maxRecordsPerBatch", rows, int), ("maxBytesPerBatch", BATCH_BYTES, size)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < number(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


# --------------------------------------------------------------------------- what a worker keeps between tasks

_kept: dict[str, Callable[[], None]] = {}


def keeps(owner: str, drop: Callable[[], None]) -> None:
    """Note that the operator owner keeps tables in this worker beyond its task, which drop frees."""
    _kept[owner] = drop


def begin(owner: str) -> None:
    """As a worker begins a task of owner: free what other operators keep, and give memory that is free back to the system."""
    for other in [x for x in _kept if x != owner]:
        _kept.pop(other)()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(_libc, "malloc_trim", None)) is not None:
        trim(0)


_libc = ctypes.CDLL(None)


def binary_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A binary column without nulls (null becomes empty)."""
    col = batch.column(name)
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    return col.fill_null(b"") if col.null_count else col


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (from 0) of a binary array, without copying the bytes."""
    wide = pa.types.is_large_binary(col.type)
    buffers = col.buffers()
    if len(col) == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offs[0] : offs[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(col: pa.Array, budget: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about budget bytes; a longer row comes alone."""
    data, offs = raw(col)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + budget, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


# --------------------------------------------------------------------------- hashes

U = np.uint64
# Hash arithmetic wraps modulo 2**64, also on scalars.
np.seterr(over="ignore")
_P = 0x9E3779B97F4A7C15
_PINV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words (xor-shift, multiply, twice)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(_P))
_powers = {"p": np.ones(1, U), "inv": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i up to n, modulo 2**64."""
    if len(_powers["p"]) <= n:
        size = max(n + 1, CHUNK_BYTES + 4096)
        with np.errstate(over="ignore"):
            for name, base in (("p", _P), ("inv", _PINV)):
                a = np.full(size, base, U)
                a[0] = 1
                _powers[name] = np.multiply.accumulate(a)
    return _powers["p"], _powers["inv"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = the hash of data[i:j] times P**i."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U)
    np.cumsum(BYTE_VALUES[data] * p[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hashes of the spans [lo, hi)."""
    _, inv = powers(len(prefix))
    return mix((prefix[hi] - prefix[lo]) * inv[lo] + (hi - lo).astype(U) * U(0xD6E8FEB86659FD93))


#: Bytes that separate words: tab, line feed, vertical tab, form feed, carriage return, space.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LOWER = np.frombuffer(LOWER, np.uint8)


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and for each row the number of its first word (one more entry at the end)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (edge[:n] | ~before))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (edge[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end of each word; number of each row's first word)."""
    starts, ends, first = word_spans(data, offs)
    return span_hash(prefix_hash(data), starts, ends), starts, ends, first


_A = [U(x | 1) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD1B54A32D192ED03)]


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of size words (the caller leaves out runs that cross rows)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(size):
        out = mix(out * _A[0] + words[j : j + n] * _A[1 + j % 4])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
