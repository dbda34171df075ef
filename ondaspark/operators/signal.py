"""Signals as DataFrames: long rows (channel, i, t, x) and packed rows (channel, t0, fs, x array)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Signal:
    """Packed channels: channel, t0 (time of the first sample), x (array of doubles). fs is shared, as is the time axis."""

    df: DataFrame
    fs: float

    @classmethod
    def from_arrays(cls, df: DataFrame, channel: str, x: str, fs: float, t0: float = 0.0) -> Signal:
        return cls(df.select(F.col(channel).alias("channel"), F.lit(float(t0)).alias("t0"), F.col(x).cast("array<double>").alias("x")), float(fs))

    @classmethod
    def from_long(cls, df: DataFrame, fs: float) -> Signal:
        """Pack long rows: one shuffle by channel; samples are put in order of i, whatever the rows' order."""
        packed = df.groupBy("channel").agg(F.min_by("t", "i").alias("t0"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
        return cls(packed.select("channel", "t0", F.transform("s", lambda s: s["x"].cast("double")).alias("x")), float(fs))

    def long(self) -> DataFrame:
        rows = self.df.select("channel", "t0", F.posexplode("x").alias("i", "x"))
        return rows.select("channel", F.col("i").cast("long").alias("i"), (F.col("t0") + F.col("i") / F.lit(self.fs)).alias("t"), "x")

    def select(self, channels: list) -> Signal:
        return Signal(self.df.where(F.col("channel").isin(channels)), self.fs)

    def bounds(self) -> tuple[float, float] | None:
        """First and last time over all channels; None if there is no sample."""
        end = F.col("t0") + (F.size("x") - 1) / F.lit(self.fs)
        r = self.df.where(F.size("x") > 0).agg(F.min("t0").alias("a"), F.max(end).alias("b")).first()
        return None if r["a"] is None else (r["a"], r["b"])


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def let(value: Column, use) -> Column:
    """use(value), with value computed once a row: a plain column that a lambda reads is put into its body, and computed again for each element."""
    return F.transform(F.array(value), use)[0]


def mean_of(x: Column) -> Column:
    """Mean of an array's numbers, NaN and null left out; null if none is left."""
    good = F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v))
    return let(good, lambda g: F.try_divide(F.aggregate(g, F.lit(0.0), lambda a, v: a + v), F.size(g).cast("double")))


def zscore(signal: Signal) -> Signal:
    """Each channel less its mean, over its population deviation; null where the deviation is 0."""

    def scaled(x: Column) -> Column:
        return let(F.sqrt(mean_of(F.transform(x, lambda v: v * v))), lambda s: F.transform(x, lambda v: F.try_divide(v, s)))

    centred = let(F.col("x"), lambda x: let(mean_of(x), lambda m: F.transform(x, lambda v: v - m)))
    return Signal(signal.df.withColumn("x", let(centred, scaled)), signal.fs)


def zscore_long(df: DataFrame) -> DataFrame:
    """The same on long rows, without packing."""
    w = Window.partitionBy("channel")
    x = nan_to_null(F.col("x"))
    return df.withColumn("x", F.try_divide(F.col("x") - F.avg(x).over(w), F.stddev_pop(x).over(w)))
