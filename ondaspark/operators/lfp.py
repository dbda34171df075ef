"""Local field potential, background activity and band-pass signals."""

from __future__ import annotations

import numpy as np

from ..functions.filters import Bandpass, Lowpass, zero_phase
from .resample import process
from .signal import Signal


def lfp(signal: Signal, lowpass: Lowpass = Lowpass(300.0), out_freq: float = 1000.0) -> Signal:
    low = lowpass.sections(signal.fs)
    return process(signal, lambda x: zero_phase(low, x), out_freq, lowpass.distrust_time())


def bua(signal: Signal, band: Bandpass = Bandpass(300.0, 6000.0), lowpass: Lowpass = Lowpass(300.0), out_freq: float = 1000.0) -> Signal:
    """The envelope of a band: band-pass, rectify, low-pass."""
    mid, low = band.sections(signal.fs), lowpass.sections(signal.fs)
    return process(signal, lambda x: zero_phase(low, np.abs(zero_phase(mid, x))), out_freq, max(band.distrust_time(), lowpass.distrust_time()))


def bandpass(signal: Signal, band: Bandpass = Bandpass(300.0, 6000.0)) -> Signal:
    mid = band.sections(signal.fs)
    return process(signal, lambda x: zero_phase(mid, x), signal.fs, band.distrust_time())
