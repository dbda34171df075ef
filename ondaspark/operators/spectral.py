"""Overlapping-segment spectra, cross-spectra, power and coherence.

Two equal forms: DataFrame expressions on packed segments (a row for each
segment and frequency, no sample rows, no shuffle before the averages), and an
Arrow kernel with a batched fast transform for long segments.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tapers import taper
from .signal import Signal, zscore

#: Segment length times frequencies from which the kernel form is chosen.
KERNEL_FROM = 100_000


@dataclass(frozen=True)
class Plan:
    """Resolved parameters of a segmented transform."""

    fs: float
    nperseg: int
    step: int
    nfft: int
    window: np.ndarray
    detrend: str | None
    onesided: bool
    scale: float = 1.0

    @property
    def freqs(self) -> np.ndarray:
        return np.fft.rfftfreq(self.nfft, 1 / self.fs) if self.onesided else np.fft.fftfreq(self.nfft, 1 / self.fs)

    def doubling(self) -> np.ndarray:
        """Factors of a one-sided spectrum: root two but at 0 Hz and, for an even length, at the top."""
        f = np.ones(len(self.freqs))
        if self.onesided:
            f[1 : -1 if self.nfft % 2 == 0 else None] = np.sqrt(2)
        return f


def plan(fs: float, window: str = "hann", nperseg: int = 256, noverlap: int | None = None, nfft: int | None = None, detrend: str | None = "constant", onesided: bool = True, scale: float = 1.0) -> Plan:
    noverlap = nperseg // 2 if noverlap is None else noverlap
    if nperseg < 1 or nperseg - noverlap < 1:
        raise ValueError("segments need at least one sample, and a step of at least one")
    if detrend not in (None, "constant", "linear"):
        raise ValueError(f"unknown detrend {detrend!r}")
    return Plan(float(fs), nperseg, nperseg - noverlap, nperseg if nfft is None else nfft, taper(window, nperseg), detrend, onesided, scale)


def scaled_plan(fs: float, percent_overlap: float = 0.5, scaling: str = "density", approx_window_duration: float = 0.2, approx_freq_fs: float = 1.0, detrend: str | None = "linear", window: str = "hann", onesided: bool = True) -> Plan:
    """Durations to sample numbers by truncation; both scalings divide by the window's power, ``density`` also by fs."""
    if scaling not in ("density", "spectrum"):
        raise ValueError(f"unknown scaling {scaling!r}")
    p = plan(fs, window, int(approx_window_duration * fs), int(approx_window_duration * fs * percent_overlap), int(approx_freq_fs * fs), detrend, onesided)
    power = float((p.window**2).sum()) * (fs if scaling == "density" else 1.0)
    return Plan(**{**p.__dict__, "scale": float(np.sqrt(1 / power))})


def segments(signal: Signal, p: Plan) -> DataFrame:
    """(channel, k, t, seg): centres W, W + step, ... below n - W; seg holds the W samples around a centre, t is the centre's time."""
    w = p.nperseg
    n = F.size("x")
    centres = F.when(n - w > w, F.sequence(F.lit(w), n - w - 1, F.lit(p.step))).otherwise(F.array().cast("array<int>"))
    rows = signal.df.select("channel", "t0", "x", F.posexplode(centres).alias("k", "c"))
    return rows.select("channel", "k", (F.col("t0") + F.col("c") / F.lit(p.fs)).alias("t"), F.slice("x", F.col("c") - w // 2 + 1, F.lit(w)).alias("seg"))


def _sum(x):
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def _literal(values) -> F.Column:
    return F.array(*[F.lit(float(v)) for v in values])


def detrended(rows: DataFrame, p: Plan) -> DataFrame:
    if p.detrend:
        rows = rows.withColumn("m", _sum(F.col("seg")) / float(p.nperseg)).withColumn("seg", F.transform("seg", lambda v: v - F.col("m"))).drop("m")
    if p.detrend == "linear":
        j = np.arange(p.nperseg) - (p.nperseg - 1) / 2
        rows = rows.withColumn("b", _sum(F.zip_with("seg", _literal(j), lambda v, c: v * c)) / float(max((j**2).sum(), 1e-300)))
        rows = rows.withColumn("seg", F.zip_with("seg", _literal(j), lambda v, c: v - F.col("b") * c)).drop("b")
    return rows


def windowed(rows: DataFrame, p: Plan) -> DataFrame:
    return rows.withColumn("seg", F.zip_with("seg", _literal(p.window), lambda v, c: v * c))


def spectra(signal: Signal, p: Plan, kernel: bool | None = None) -> DataFrame:
    """(channel, k, t, f, freq, re, im) of every segment and frequency."""
    rows = segments(signal, p)
    if kernel is None:
        kernel = p.nperseg * len(p.freqs) > KERNEL_FROM
    if kernel:
        return _spectra_kernel(rows, p)
    used = min(p.nperseg, p.nfft)  # a shorter transform sees only the segment's beginning
    angle = -2 * np.pi * np.outer(np.arange(len(p.freqs)), np.arange(used)) / p.nfft
    gain = (p.doubling() * p.scale)[:, None]
    table = F.array(*[F.struct(F.lit(float(fr)).alias("freq"), _literal(c).alias("cos"), _literal(s).alias("sin")) for fr, c, s in zip(p.freqs, np.cos(angle) * gain, np.sin(angle) * gain, strict=True)])
    rows = windowed(detrended(rows, p), p).withColumn("seg", F.slice("seg", 1, used))
    rows = rows.select("channel", "k", "t", "seg", F.posexplode(table).alias("f", "w"))
    dot = lambda c: _sum(F.zip_with("seg", F.col(c), lambda v, u: v * u))
    return rows.select("channel", "k", "t", "f", F.col("w.freq").alias("freq"), dot("w.cos").alias("re"), dot("w.sin").alias("im"))


def _spectra_kernel(rows: DataFrame, p: Plan) -> DataFrame:
    channel = rows.schema["channel"].dataType.simpleString()

    def run(batches):
        j = np.arange(p.nperseg) - (p.nperseg - 1) / 2
        transform = np.fft.rfft if p.onesided else np.fft.fft
        for pdf in batches:
            for lo in range(0, len(pdf), 512):
                part = pdf.iloc[lo : lo + 512]
                x = np.stack([np.asarray(s, float) for s in part["seg"]])
                if p.detrend:
                    x = x - x.mean(axis=1, keepdims=True)
                if p.detrend == "linear":
                    x = x - np.outer(x @ j / (j**2).sum(), j)
                y = transform(x * p.window, n=p.nfft, axis=1) * p.doubling() * p.scale
                n = len(p.freqs)
                yield pd.DataFrame({"channel": np.repeat(part["channel"].to_numpy(), n), "k": np.repeat(part["k"].to_numpy(), n), "t": np.repeat(part["t"].to_numpy(), n), "f": np.tile(np.arange(n), len(part)), "freq": np.tile(p.freqs, len(part)), "re": y.real.ravel(), "im": y.imag.ravel()})

    return rows.mapInPandas(run, f"channel {channel}, k int, t double, f int, freq double, re double, im double")


def scaled_fft(signal: Signal, normalise: bool = True, kernel: bool | None = None, **options) -> DataFrame:
    """Spectra of z-scored channels, scaled to density or spectrum."""
    return spectra(zscore(signal) if normalise else signal, scaled_plan(signal.fs, **options), kernel)


def cross_spectrum(ffts: DataFrame) -> DataFrame:
    """(channel, channel_2, f, freq, re, im): the mean over segments of F1 * conj(F2).

    Half of the pairs are joined, by segment and frequency; the others are
    their conjugates. The number of pairs is the square of the number of
    channels, as is the result: choose channels first.
    """
    a = ffts.select("k", "f", "freq", "channel", F.col("re").alias("re1"), F.col("im").alias("im1"))
    b = ffts.select("k", "f", F.col("channel").alias("channel_2"), F.col("re").alias("re2"), F.col("im").alias("im2"))
    half = a.join(b, ["k", "f"]).where("channel <= channel_2").groupBy("channel", "channel_2", "f", "freq").agg(
        F.avg(F.col("re1") * F.col("re2") + F.col("im1") * F.col("im2")).alias("re"), F.avg(F.col("im1") * F.col("re2") - F.col("re1") * F.col("im2")).alias("im"),
    )
    both = F.array(F.struct("channel", "channel_2", "im"), F.struct(F.col("channel_2").alias("channel"), F.col("channel").alias("channel_2"), (-F.col("im")).alias("im")))
    sides = F.when(F.col("channel") == F.col("channel_2"), F.slice(both, 1, 1)).otherwise(both)
    return half.select("f", "freq", "re", F.explode(sides).alias("s")).select("s.channel", "s.channel_2", "f", "freq", "re", "s.im")


def check_square(psd: DataFrame) -> None:
    """Raise unless the two channel columns hold the same channels."""
    a, b = psd.select("channel").distinct(), psd.select(F.col("channel_2").alias("channel")).distinct()
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ValueError("channel and channel_2 hold different channels")


def welch(psd: DataFrame, check: bool = True) -> DataFrame:
    """(channel, f, freq, power): the diagonal of a cross-spectrum."""
    if check:
        check_square(psd)
    return psd.where("channel = channel_2").select("channel", "f", "freq", F.col("re").alias("power"))


def welch_power(ffts: DataFrame) -> DataFrame:
    """The same from spectra at once, without a join: one aggregate combined before its shuffle."""
    return ffts.groupBy("channel", "f", "freq").agg(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def coherence(psd: DataFrame) -> DataFrame:
    """(channel, channel_2, f, freq, coherence, coherence_phase): squared magnitude over the product of powers (null where that is 0), and phase."""
    power = welch(psd, check=False)
    w1, w2 = power.select("channel", "f", F.col("power").alias("w1")), power.select(F.col("channel").alias("channel_2"), "f", F.col("power").alias("w2"))
    im = F.round("im", 12) + F.lit(0.0)  # real bins have no sign of rounding, which would turn the phase by half a circle
    joined = psd.join(w1, ["channel", "f"]).join(w2, ["channel_2", "f"])
    return joined.select("channel", "channel_2", "f", "freq", F.try_divide(F.col("re") * F.col("re") + F.col("im") * F.col("im"), F.col("w1") * F.col("w2")).alias("coherence"), F.atan2(im, F.col("re")).alias("coherence_phase"))
