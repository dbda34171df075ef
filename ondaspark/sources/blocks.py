"""Lazy N-dimensional sources from a function of block slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def blocks(shape: tuple[int, ...], chunks: tuple[int, ...]) -> list[tuple[slice, ...]]:
    """Slices of all blocks in row-major order, the last of each dimension clipped."""
    if len(shape) != len(chunks) or any(c < 1 for c in chunks):
        raise ValueError("chunks need a positive size for each dimension")
    counts = [-(-n // c) for n, c in zip(shape, chunks, strict=True)]
    return [tuple(slice(i * c, min((i + 1) * c, n)) for i, c, n in zip(at, chunks, shape, strict=True)) for at in np.ndindex(*counts)]


def block_table(spark: SparkSession, shape: tuple[int, ...], chunks: tuple[int, ...]) -> DataFrame:
    """A row for each block: block, lo and hi (arrays)."""
    counts = [-(-n // c) for n, c in zip(shape, chunks, strict=True)]
    total = int(np.prod(counts, dtype=np.int64))
    rest, at = F.col("id"), []
    for n in reversed(counts):
        at.append(rest % F.lit(max(n, 1)))
        rest = F.floor(rest / F.lit(max(n, 1)))
    lo = [a * F.lit(c) for a, c in zip(reversed(at), chunks, strict=True)]
    hi = [F.least(x + F.lit(c), F.lit(n)) for x, c, n in zip(lo, chunks, shape, strict=True)]
    return spark.range(total, numPartitions=max(1, min(total, 10_000))).select(F.col("id").alias("block"), F.array(*lo).cast("array<long>").alias("lo"), F.array(*hi).cast("array<long>").alias("hi"))


def read_blocks(spark: SparkSession, function: Callable, shape: tuple[int, ...], chunks: tuple[int, ...]) -> DataFrame:
    """(i0, i1, ..., x): function(slices) is called once for each block, on an executor, and returns an array of the block's shape."""
    import pandas as pd

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            for lo, hi in zip(pdf["lo"], pdf["hi"], strict=True):
                got = np.asarray(function(tuple(slice(int(a), int(b)) for a, b in zip(lo, hi, strict=True))), float)
                if got.shape != tuple(int(b - a) for a, b in zip(lo, hi, strict=True)):
                    raise ValueError(f"a block has shape {got.shape}, not that of {list(lo)} to {list(hi)}")
                flat = got.ravel()
                for at in range(0, len(flat), 1 << 20):
                    index = np.unravel_index(np.arange(at, min(at + (1 << 20), len(flat))), got.shape)
                    yield pd.DataFrame({f"i{d}": index[d] + int(lo[d]) for d in range(len(lo))} | {"x": flat[at : at + (1 << 20)]})

    return block_table(spark, shape, chunks).mapInPandas(run, ", ".join(f"i{d} long" for d in range(len(shape))) + ", x double")


class BlockPartition(InputPartition):
    def __init__(self, channel: int, lo: int, hi: int):
        super().__init__((channel, lo, hi))
        self.channel, self.lo, self.hi = channel, lo, hi


class _BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.channels, self.samples, self.block = options["path"], int(options["channels"]), int(options["samples"]), int(options.get("block", 1_000_000))

    def partitions(self):
        return [BlockPartition(c, lo, min(lo + self.block, self.samples)) for c in range(self.channels) for lo in range(0, self.samples, self.block)]

    def read(self, partition: BlockPartition):
        x = np.memmap(self.path, "<f8", "r", shape=(self.channels, self.samples))[partition.channel, partition.lo : partition.hi]
        if len(x) != partition.hi - partition.lo:
            raise ValueError("smaller block than asked for")
        for at in range(0, len(x), 1 << 16):
            part = np.array(x[at : at + (1 << 16)])
            lo = partition.lo + at
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), partition.channel)), pa.array(np.arange(lo, lo + len(part))), pa.array(part)], names=["channel", "i", "x"])


class RawSignalSource(DataSource):
    """Format ``rawsignal``: a file of doubles, channels one after the other, on a path that executors can open; a partition for each block of a channel."""

    @classmethod
    def name(cls) -> str:
        return "rawsignal"

    def schema(self) -> str:
        return "channel long, i long, x double"

    def reader(self, schema) -> DataSourceReader:
        return _BlockReader(self.options)
