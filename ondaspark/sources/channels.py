"""Channel tables and the signals chosen from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.signal import Signal
from .blocks import blocks, read_blocks

CHANNEL_SCHEMA = "chan_name string, chan_type string, physical_channel int, chan_num int, fs double, start_t double, end_t double"
#: Sampling rate of a selection without channels.
EMPTY_FS = 1000.0
#: Samples in a block that is read at once.
BLOCK_SAMPLES = 10_000_000


def channel_table(raw: DataFrame) -> DataFrame:
    """Metadata rows to the channel table: no channels that are off, no type prefix, a rate of -1 unless sampled.

    raw: chan_name, chan_type, physical_channel, chan_num, divide, time_base, first_time, max_time (ticks).
    """
    kind = F.regexp_replace("chan_type", r"^DataType\.", "")
    return raw.where(kind != "Off").select(
        "chan_name", kind.alias("chan_type"), F.col("physical_channel").cast("int").alias("physical_channel"), F.col("chan_num").cast("int").alias("chan_num"),
        F.when(kind == "Adc", 1.0 / (F.col("divide") * F.col("time_base"))).otherwise(F.lit(-1.0)).alias("fs"),
        (F.col("first_time") * F.col("time_base")).alias("start_t"), (F.col("max_time") * F.col("time_base")).alias("end_t"),
    )


def choose(table: DataFrame, channels: list) -> DataFrame:
    """The chosen rows; with an ellipsis in the list, every sampled channel but those listed."""
    named = [c for c in channels if c is not ...]
    if ... in channels:
        return table.where((F.col("chan_type") == "Adc") & ~F.col("chan_num").isin(named))
    return table.where(F.col("chan_num").isin(named))


@dataclass(frozen=True)
class Axis:
    """The shared time axis of chosen channels."""

    fs: float
    start: float
    samples: int


def shared_axis(chosen: DataFrame) -> Axis | None:
    """The interval that all chosen channels cover; raises for other than sampled channels and for differing rates; None for no channel."""
    r = chosen.agg(F.count("*").alias("n"), F.bool_or(F.col("chan_type") != "Adc").alias("other"), F.min("fs").alias("fs"), F.max("fs").alias("fs2"), F.max("start_t").alias("a"), F.min("end_t").alias("b")).first()
    if not r["n"]:
        return None
    if r["other"]:
        raise ValueError("only sampled (Adc) channels can be read as signals")
    if r["fs"] != r["fs2"]:
        raise ValueError(f"channels have different rates: {r['fs']} to {r['fs2']}")
    return Axis(r["fs"], r["a"], max(0, round((r["b"] - r["a"]) * r["fs"])))


def start_tick(first: int, start: float, time_base: float, divide: int) -> int:
    """The tick of sample first of a time axis that begins at start, for a channel sampled every divide ticks of time_base seconds."""
    return divide * first + round(start / time_base)


def load(spark: SparkSession, table: DataFrame, channels: list, read, block: int = BLOCK_SAMPLES, time_base: float | None = None) -> tuple[DataFrame, float]:
    """(channel, i, t, x) rows of chosen channels and their rate.

    read(channel, first, count) returns count samples, called on executors for
    each block of each channel; a wrong count raises. With a time_base, first
    is the tick of the first sample, else its number. Unknown and repeated
    channel numbers raise.
    """
    named = [c for c in channels if c is not ...]
    chosen = choose(table, channels)
    numbers = [r["chan_num"] for r in chosen.select("chan_num").collect()]  # a row for each channel of a recording
    if ... not in channels and sorted(numbers) != sorted(named):
        raise ValueError(f"unknown or repeated channels: asked for {sorted(named)}, found {sorted(numbers)}")
    axis = shared_axis(chosen)
    if axis is None:
        return spark.createDataFrame([], "channel long, i long, t double, x double"), EMPTY_FS

    def chunk(slices):
        import numpy as np

        number, first = numbers[slices[0].start], slices[1].start
        if time_base is not None:
            first = start_tick(first, axis.start, time_base, round(1 / (axis.fs * time_base)))
        x = np.asarray(read(number, first, slices[1].stop - slices[1].start), float)
        if len(x) != slices[1].stop - slices[1].start:
            raise ValueError(f"channel {number}: {'smaller' if len(x) < slices[1].stop - slices[1].start else 'bigger'} block than asked for")
        return x[None, :]

    cells = read_blocks(spark, chunk, (len(numbers), axis.samples), (1, block))
    names = F.array(*[F.lit(int(n)).cast("long") for n in numbers])
    return cells.select(F.get(names, F.col("i0").cast("int")).alias("channel"), F.col("i1").alias("i"), (F.col("i1") / F.lit(axis.fs) + F.lit(axis.start)).alias("t"), F.col("x")), axis.fs


def packed_arrays(spark: SparkSession, path: str, channel: str, x: str, fs: float, t0: float = 0.0) -> Signal:
    """Channels stored as one array a row; only the two columns are read."""
    return Signal.from_arrays(spark.read.parquet(path).select(channel, x), channel, x, fs, t0)


def regular_counts(events: DataFrame, channel: str, ts: str, value: str, seconds: int, start, hours: int) -> DataFrame:
    """(channel, i, x): sums of an irregular event table on a regular grid of steps, with 0 where a channel has none."""
    begin = F.lit(start).cast("timestamp")
    step = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(begin)) / F.lit(seconds * 1_000_000)).cast("long")
    found = events.where((step >= 0) & (step < hours)).groupBy(F.col(channel).alias("channel"), step.alias("i")).agg(F.sum(value).alias("x"))
    cells = events.select(F.col(channel).alias("channel")).distinct().select("channel", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(hours - 1).cast("long"))).alias("i"))
    return cells.join(found, ["channel", "i"], "left").select("channel", "i", F.coalesce("x", F.lit(0.0)).alias("x"))


__all__ = ["CHANNEL_SCHEMA", "Axis", "blocks", "channel_table", "choose", "load", "packed_arrays", "regular_counts", "shared_axis", "start_tick"]
