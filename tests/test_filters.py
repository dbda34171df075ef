import numpy as np
import pytest

from ondaspark.functions.filters import Bandpass, Lowpass, butterworth, operator, pad_length, zero_phase
from ondaspark.functions.tapers import taper


def gain(sections, f, fs):
    z = np.exp(-2j * np.pi * f / fs * np.arange(3))
    return abs(np.prod((sections[:, :3] @ z) / (sections[:, 3:] @ z)))


def test_half_nyquist_second_order():
    s = butterworth(2, (250.0,), 1000.0)
    assert np.allclose(s, [[0.29289322, 0.58578644, 0.29289322, 1, 0, 0.17157288]])


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_gain_at_cutoffs(order):
    assert gain(butterworth(order, (300.0,), 25000.0), 300.0, 25000.0) == pytest.approx(0.5**0.5)
    band = butterworth(order, (300.0, 6000.0), 25000.0)
    assert gain(band, 300.0, 25000.0) == pytest.approx(0.5**0.5)
    assert gain(band, 6000.0, 25000.0) == pytest.approx(0.5**0.5)


@pytest.mark.parametrize("cut", [(0.0,), (500.0,), (100.0, 500.0), (200.0, 100.0)])
def test_cutoffs_must_lie_below_nyquist(cut):
    with pytest.raises(ValueError):
        butterworth(4, cut, 1000.0)


@pytest.mark.parametrize(("design", "pad"), [(Lowpass(100.0), 15), (Bandpass(50.0, 100.0), 27)])
def test_signal_must_exceed_padding(design, pad):
    s = design.sections(1000.0)
    assert pad_length(s) == pad
    with pytest.raises(ValueError):
        zero_phase(s, np.ones((1, pad)))
    assert zero_phase(s, np.ones((1, pad + 1))).shape == (1, pad + 1)


def test_constant_passes_low_pass_and_section_order_is_free():
    s = Lowpass(50.0).sections(1000.0)
    x = np.random.default_rng(1).normal(size=(2, 200))
    assert np.allclose(zero_phase(s, np.full((1, 100), 3.0)), 3.0)
    assert np.allclose(zero_phase(s, x), zero_phase(s[::-1], x))
    assert np.allclose(zero_phase(s, x), x @ operator(s, 200).T)


def test_keeps_slow_and_removes_fast_without_delay():
    t = np.arange(2000) / 1000
    slow = np.sin(2 * np.pi * 5 * t)
    y = zero_phase(Lowpass(50.0).sections(1000.0), (slow + np.sin(2 * np.pi * 200 * t))[None, :])[0]
    assert np.abs(y - slow)[300:-300].max() < 1e-3


def test_tapers():
    assert np.allclose(taper("hann", 4), [0, 0.5, 1, 0.5])
    with pytest.raises(ValueError):
        taper("none", 4)


def test_all_tapers():
    from ondaspark.functions.tapers import COSINE_SUMS, INNER_SHAPES, SHAPES

    for name in (*COSINE_SUMS, *SHAPES, *INNER_SHAPES, "parzen", ("kaiser", 5.0), ("tukey", 0.3), ("gaussian", 4.0), ("general_gaussian", 1.5, 4.0), ("general_hamming", 0.6), ("general_cosine", (0.4, 0.5, 0.1)), 8.0):
        for n in (15, 16):
            w = taper(name, n)
            assert len(w) == n and w.max() <= 1 + 1e-8 and w[1:] == pytest.approx(w[1:][::-1])  # periodic: symmetric but for the first value
    assert taper("bartlett", 8) == pytest.approx(np.bartlett(9)[:-1]) and taper(("kaiser", 5.0), 9) == pytest.approx(np.kaiser(10, 5.0)[:-1])
    assert taper("triang", 4) == pytest.approx([1 / 3, 2 / 3, 1, 2 / 3]) and taper("cosine", 3) == pytest.approx(np.sin(np.pi / 4 * (np.arange(3) + 0.5)))
    with pytest.raises(ValueError):
        taper("no such window", 4)
