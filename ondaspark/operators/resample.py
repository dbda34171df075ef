"""Linear resampling onto absolute multiples of the output period, with distrusted edges left out."""

from __future__ import annotations

from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import Filter, zero_phase
from .signal import Signal


def grid(lo: float, hi: float, out_freq: float, distrust: float) -> tuple[int, int]:
    """First and last k of the output times k / out_freq (first > last: none)."""
    return ceil((lo + distrust) * out_freq), floor((hi - distrust) * out_freq)


def resample(signal: Signal, out_freq: float, distrust: float = 0.0, bounds: tuple[float, float] | None = None) -> Signal:
    """Packed resampling: every channel stays in its row, so nothing is shuffled but the two bounds (found here unless they are given)."""
    bounds = bounds or signal.bounds()
    first, last = grid(*bounds, out_freq, distrust) if bounds else (0, -1)
    ks = F.sequence(F.lit(first), F.lit(last)) if last >= first else F.array().cast("array<int>")
    top = F.size("x") - 2

    def at(k):
        spot = (k / F.lit(float(out_freq)) - F.col("t0")) * F.lit(signal.fs)
        low = F.greatest(F.lit(0), F.least(F.floor(spot).cast("int"), top))
        a, b = F.get("x", low), F.get("x", low + 1)
        outside = (spot < -1e-9) | (spot > F.size("x") - 1 + 1e-9)
        return F.when(outside, None).otherwise(F.when(b.isNull(), a).otherwise(a + (b - a) * (spot - low)))

    # two steps: in one, the name t0 inside the lambda would mean the new column
    points = signal.df.select("channel", F.transform(ks, at).alias("x"))
    return Signal(points.select("channel", F.lit(first / float(out_freq)).alias("t0"), "x"), float(out_freq))


def resample_long(df: DataFrame, out_freq: float, distrust: float = 0.0) -> DataFrame:
    """Long rows: each sample brackets the grid points up to the next sample, so no range join is needed."""
    out = float(out_freq)
    edge = df.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))  # one row, broadcast
    w = Window.partitionBy("channel").orderBy("i")
    pairs = df.withColumn("t1", F.lead("t").over(w)).withColumn("x1", F.lead("x").over(w)).crossJoin(F.broadcast(edge))
    k0 = F.greatest(F.ceil(F.col("t") * out), F.ceil((F.col("lo") + distrust) * out))
    k1 = F.least(F.when(F.col("t1").isNull(), F.floor(F.col("t") * out)).otherwise(F.ceil(F.col("t1") * out) - 1), F.floor((F.col("hi") - distrust) * out))
    points = pairs.withColumn("k0", k0).withColumn("k1", k1).where("k0 <= k1").withColumn("k", F.explode(F.sequence("k0", "k1")))
    x = F.when(F.col("t1").isNull(), F.col("x")).otherwise(F.col("x") + (F.col("x1") - F.col("x")) * (F.col("k") / out - F.col("t")) / (F.col("t1") - F.col("t")))
    return points.select("channel", "k", (F.col("k") / out).alias("t"), x.alias("x"))


def kernel(signal: Signal, function) -> Signal:
    """function (rows, samples) -> same shape, on Arrow batches of packed channels; channels of one length go together."""

    def run(batches):
        for pdf in batches:
            out = [None] * len(pdf)
            by_size: dict[int, list[int]] = {}
            for i, x in enumerate(pdf["x"]):
                by_size.setdefault(len(x), []).append(i)
            for rows in by_size.values():
                for i, y in zip(rows, function(np.stack([np.asarray(pdf["x"].iloc[i], float) for i in rows])), strict=True):
                    out[i] = y
            yield pd.DataFrame({"channel": pdf["channel"], "t0": pdf["t0"], "x": out})

    return Signal(signal.df.select("channel", "t0", "x").mapInPandas(run, signal.df.select("channel", "t0", "x").schema), signal.fs)


def process(signal: Signal, function, out_freq: float, distrust: float) -> Signal:
    """A kernel on whole channels, then resampling with the distrusted edges left out. The kernel keeps times, so bounds are those of its input, for which it need not run."""
    return resample(kernel(signal, function), out_freq, distrust, signal.bounds())


def filtered(signal: Signal, design: Filter) -> Signal:
    sections = design.sections(signal.fs)
    return kernel(signal, lambda x: zero_phase(sections, x))


def filtered_by_fold(signal: Signal, design: Filter) -> Signal:
    """Zero-phase filtering in DataFrame expressions alone, for short channels: each section is a fold over the array."""
    from ..functions.filters import _steady, pad_length

    sections = design.sections(signal.fs)
    pad, steady = pad_length(sections), _steady(sections)

    def fold(x, i):
        b0, b1, b2, _, a1, a2 = map(float, sections[i])

        def step(acc, v):
            y = b0 * v + acc["z1"]
            return F.struct(F.concat(acc["y"], F.array(y)).alias("y"), (b1 * v - a1 * y + acc["z2"]).alias("z1"), (b2 * v - a2 * y).alias("z2"))

        start = F.struct(F.array().cast("array<double>").alias("y"), (F.col("first") * float(steady[i][0])).alias("z1"), (F.col("first") * float(steady[i][1])).alias("z2"))
        return F.aggregate(x, start, step, lambda acc: acc["y"])

    n = F.size("x")
    head = F.transform(F.reverse(F.slice("x", 2, pad)), lambda v: 2 * F.get("x", F.lit(0)) - v)
    tail = F.transform(F.reverse(F.slice("x", n - pad, F.lit(pad))), lambda v: 2 * F.get("x", n - 1) - v)
    df = signal.df.withColumn("x", F.concat(head, F.col("x"), tail))
    for _ in range(2):
        df = df.withColumn("first", F.get("x", F.lit(0)))
        for i in range(len(sections)):
            df = df.withColumn("x", fold(F.col("x"), i))
        df = df.withColumn("x", F.reverse("x")).drop("first")
    return Signal(df.withColumn("x", F.slice("x", F.lit(pad + 1), F.size("x") - 2 * pad)), signal.fs)
