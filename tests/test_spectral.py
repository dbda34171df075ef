import re

import numpy as np
import pytest

from ondaspark.functions.filters import Bandpass, Lowpass, zero_phase
from ondaspark.operators import lfp, resample, spectral
from ondaspark.operators.signal import Signal, zscore, zscore_long


def make(spark, rows, fs, t0=0.0):
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rows)], "channel long, x array<double>")
    return Signal.from_arrays(df, "channel", "x", fs, t0)


def arrays(signal):
    return {r["channel"]: np.array([np.nan if v is None else v for v in r["x"]]) for r in signal.df.collect()}


def test_long_and_packed_round_trip(spark):
    s = make(spark, np.random.default_rng(0).normal(size=(3, 50)), 10.0, 2.5)
    back = Signal.from_long(s.long().repartition(3), 10.0)
    assert {k: v.tolist() for k, v in arrays(back).items()} == {k: v.tolist() for k, v in arrays(s).items()}
    assert s.bounds() == (2.5, 2.5 + 4.9)


def test_zscore_of_constant_is_null_and_nan_is_left_out(spark):
    s = make(spark, [[1.0] * 4, [1.0, 2.0, float("nan"), 3.0]], 1.0)
    got = arrays(zscore(s))
    assert np.isnan(got[0]).all()
    assert np.allclose(got[1][[0, 1, 3]], np.array([-1, 0, 1]) / np.sqrt(2 / 3))
    long = {(r["channel"], r["i"]): r["x"] for r in zscore_long(s.long()).collect()}
    assert long[1, 0] == pytest.approx(got[1][0])


def test_zscore_takes_means_once_a_channel(spark):
    x = np.random.default_rng(1).normal(size=(3, 1000))
    rows = zscore(make(spark, x, 1.0)).long()
    # a mean within the lambda of an element takes the square of the samples, and the next one its square again
    assert not re.search(r"lambda x_\d+#\d+ [-/] (\(aggregate|SQRT)", rows._jdf.queryExecution().optimizedPlan().toString())
    got = {(r["channel"], r["i"]): r["x"] for r in rows.collect()}
    want = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True)
    assert np.allclose([[got[c, i] for i in range(1000)] for c in range(3)], want)


def test_zscore_of_null_and_of_nothing(spark):
    df = spark.createDataFrame([(0, 0.0, None), (1, 0.0, []), (2, 0.0, [None, 1.0, 3.0])], "channel long, t0 double, x array<double>")
    assert {r["channel"]: r["x"] for r in zscore(Signal(df, 1.0)).df.collect()} == {0: None, 1: [], 2: [None, -1.0, 1.0]}


@pytest.mark.parametrize("n", [31, 32, 33, 40, 41, 64])
def test_number_of_segments(spark, n):
    p = spectral.plan(8.0, nperseg=16)
    rows = spectral.segments(make(spark, [np.arange(n)], 8.0), p).collect()
    assert len(rows) == max(0, -(-(n - 32) // 8))
    for r in rows:
        assert r["seg"] == list(range(16 + 8 * r["k"] - 8, 16 + 8 * r["k"] + 8))
        assert r["t"] == (16 + 8 * r["k"]) / 8


@pytest.mark.parametrize("options", [{}, {"nfft": 32}, {"nfft": 10}, {"nfft": 21, "detrend": "linear"}, {"detrend": None, "onesided": False}])
def test_expression_and_kernel_forms_agree(spark, options):
    x = np.random.default_rng(2).normal(size=(2, 80))
    p = spectral.plan(64.0, nperseg=16, **options)
    s = make(spark, x, 64.0)
    key = lambda r: (r["channel"], r["k"], r["f"])
    a, b = ({key(r): (r["t"], r["freq"], r["re"], r["im"]) for r in spectral.spectra(s, p, kernel=k).collect()} for k in (False, True))
    assert a.keys() == b.keys()
    assert np.allclose(list(a.values()), [b[k] for k in a], atol=1e-12)


def test_lag_gives_phase_and_coherence(spark):
    fs, f = 256.0, 32.0
    t = np.arange(4096) / fs
    r = np.random.default_rng(3)
    x = np.sin(2 * np.pi * f * t) + 0.05 * r.normal(size=len(t))
    y = np.sin(2 * np.pi * f * (t - 0.005)) + 0.05 * r.normal(size=len(t))
    psd = spectral.cross_spectrum(spectral.scaled_fft(make(spark, [x, y], fs)))
    got = {(r["channel"], r["channel_2"], r["freq"]): r for r in spectral.coherence(psd).collect()}
    assert got[0, 1, f]["coherence"] > 0.99
    assert got[0, 1, f]["coherence_phase"] == pytest.approx(2 * np.pi * f * 0.005, abs=0.05)
    assert got[1, 0, f]["coherence_phase"] == pytest.approx(-got[0, 1, f]["coherence_phase"])
    assert all(-1e-9 <= r["coherence"] <= 1 + 1e-9 for r in got.values())
    power = {(r["channel"], r["f"]): r["power"] for r in spectral.welch(psd).collect()}
    direct = {(r["channel"], r["f"]): r["power"] for r in spectral.welch_power(spectral.scaled_fft(make(spark, [x, y], fs))).collect()}
    assert power.keys() == direct.keys() and all(power[k] == pytest.approx(direct[k]) for k in power)


def test_guards(spark):
    with pytest.raises(ValueError):
        spectral.plan(1.0, nperseg=8, noverlap=8)
    with pytest.raises(ValueError):
        spectral.scaled_plan(64.0, scaling="none")
    psd = spark.createDataFrame([(1, 2, 0, 0.0, 1.0, 0.0)], "channel long, channel_2 long, f int, freq double, re double, im double")
    with pytest.raises(ValueError):
        spectral.welch(psd)


@pytest.mark.parametrize(("out", "t0", "d"), [(50.0, 0.0, 0.0), (40.0, 0.013, 0.1), (64.0, 0.5, 0.0)])
def test_resampling_grid(spark, out, t0, d):
    x = np.random.default_rng(4).normal(size=(2, 64))
    s = make(spark, x, 64.0, t0)
    t = t0 + np.arange(64) / 64
    first, last = resample.grid(t[0], t[-1], out, d)
    want = np.interp(np.arange(first, last + 1) / out, t, x[1])
    assert np.allclose(arrays(resample.resample(s, out, d))[1], want)
    long = sorted((r["k"], r["x"]) for r in resample.resample_long(s.long(), out, d).where("channel = 1").collect())
    assert [k for k, _ in long] == list(range(first, last + 1)) and np.allclose([v for _, v in long], want)


def test_too_short_for_distrust_is_empty(spark):
    s = make(spark, [np.arange(64.0)], 64.0)
    assert arrays(resample.resample(s, 64.0, 0.6))[0].size == 0


def test_fold_equals_kernel(spark):
    s = make(spark, np.random.default_rng(5).normal(size=(2, 64)), 64.0)
    for design in (Lowpass(10.0), Bandpass(5.0, 12.0)):
        a, b = arrays(resample.filtered(s, design)), arrays(resample.filtered_by_fold(s, design))
        assert all(np.allclose(a[k], b[k]) for k in a)


def test_bua_follows_envelope(spark):
    fs = 25000.0
    t = np.arange(int(fs)) / fs
    envelope = 1 + 0.5 * np.sin(2 * np.pi * 4 * t)
    got = lfp.bua(make(spark, [envelope * np.sin(2 * np.pi * 1500 * t)], fs))
    y = arrays(got)[0]
    times = got.df.first()["t0"] + np.arange(len(y)) / 1000
    want = np.interp(times, t, envelope) * 2 / np.pi
    assert got.fs == 1000.0 and np.abs(y[100:-100] - want[100:-100]).max() < 0.02


def test_lfp_and_bandpass(spark):
    s = make(spark, [np.sin(2 * np.pi * 20 * np.arange(8000) / 2000)], 2000.0)
    low = lfp.lfp(s, Lowpass(100.0), 500.0)
    assert low.fs == 500.0 and low.bounds()[0] >= 0.1
    band = lfp.bandpass(s, Bandpass(10.0, 40.0))
    assert band.fs == 2000.0
    assert np.allclose(zero_phase(Bandpass(10.0, 40.0).sections(2000.0), np.array([arrays(s)[0]]))[0][2000], arrays(band)[0][2000 - int(band.bounds()[0] * 2000)], atol=1e-6)
