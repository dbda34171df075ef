"""Butterworth filters as second-order sections, and zero-phase filtering. Design runs on the driver; kernels are plain numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class Filter:
    """A filter design: sections for a sampling rate, and how long after an edge its output is not to be trusted."""

    def sections(self, fs: float) -> np.ndarray:
        raise NotImplementedError

    def distrust_time(self) -> float:
        raise NotImplementedError


@dataclass(frozen=True)
class Lowpass(Filter):
    freq: float
    order: int = 4

    def sections(self, fs: float) -> np.ndarray:
        return butterworth(self.order, (self.freq,), fs)

    def distrust_time(self) -> float:
        return 10 / self.freq


@dataclass(frozen=True)
class Bandpass(Filter):
    low_freq: float
    high_freq: float
    order: int = 4

    def sections(self, fs: float) -> np.ndarray:
        return butterworth(self.order, (self.low_freq, self.high_freq), fs)

    def distrust_time(self) -> float:
        return 10 / self.low_freq


def butterworth(order: int, cutoffs: tuple[float, ...], fs: float) -> np.ndarray:
    """Sections (b0, b1, b2, 1, a1, a2) of a digital Butterworth low-pass (one cut-off) or band-pass (two)."""
    if order < 1:
        raise ValueError("the order must be at least 1")
    if not all(0 < c < fs / 2 for c in cutoffs) or list(cutoffs) != sorted(set(cutoffs)):
        raise ValueError(f"cut-offs must rise within 0 and {fs / 2}")
    angles = np.pi * np.arange(-order + 1, order, 2) / (2 * order)
    prototype = -np.exp(1j * angles)
    warped = 4 * np.tan(np.pi * np.asarray(cutoffs) / fs)
    if len(cutoffs) == 1:
        poles, zeros = prototype * warped[0], np.full(order, -1.0)
    else:
        half = prototype * (warped[1] - warped[0]) / 2
        root = np.sqrt(half**2 - warped[0] * warped[1] + 0j)
        poles, zeros = np.concatenate([half + root, half - root]), np.repeat([-1.0, 1.0], order)
    poles = (4 + poles) / (4 - poles)
    sections = []
    upper = sorted((p for p in poles if p.imag > 1e-12), key=abs)
    real = sorted((p.real for p in poles if abs(p.imag) <= 1e-12), key=abs)
    pairs = [(1.0, -2 * p.real, abs(p) ** 2) for p in upper]
    pairs += [(1.0, -a - b, a * b) for a, b in zip(real[::2], real[1::2], strict=False)]
    if len(real) % 2:
        pairs.append((1.0, -real[-1], 0.0))
    left = list(zeros)
    for a in pairs:
        if a[2] == 0 and len(left) == 1:
            b = (1.0, -left.pop(), 0.0)
        elif len(cutoffs) == 2:
            left.remove(-1.0), left.remove(1.0)
            b = (1.0, 0.0, -1.0)
        else:
            left.pop(), left.pop()
            b = (1.0, 2.0, 1.0)
        sections.append((*b, *a))
    out = np.array(sections)
    # unit gain at 0 Hz, or at the geometric centre of the band on the warped axis
    centre = 0.0 if len(cutoffs) == 1 else 2 * np.arctan(np.sqrt(warped[0] * warped[1]) / 4)
    z = np.exp(-1j * centre * np.arange(3))
    out[0, :3] /= abs(np.prod((out[:, :3] @ z) / (out[:, 3:] @ z)))
    return out


def pad_length(sections: np.ndarray) -> int:
    """Samples by which zero-phase filtering extends a signal at either end."""
    return 3 * (2 * len(sections) + 1 - min(int((sections[:, 2] == 0).sum()), int((sections[:, 5] == 0).sum())))


def _steady(sections: np.ndarray) -> np.ndarray:
    """State of each section for a constant input of 1 to the first."""
    state, level = np.zeros((len(sections), 2)), 1.0
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        state[i] = level * (gain - b0), level * (b2 - a2 * gain)
        level *= gain
    return state


def _run(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Filter the last axis from the steady state for each row's first sample; rows go together."""
    y = np.array(x, float)
    first = y[:, :1].copy()
    for (b0, b1, b2, _, a1, a2), (s1, s2) in zip(sections, _steady(sections), strict=True):
        z1, z2 = first[:, 0] * s1, first[:, 0] * s2
        for i in range(y.shape[1]):
            v = y[:, i]
            out = b0 * v + z1
            z1, z2 = b1 * v - a1 * out + z2, b2 * v - a2 * out
            y[:, i] = out
    return y


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering of the last axis of (rows, samples), with odd extension at both ends."""
    pad = pad_length(sections)
    if x.shape[-1] <= pad:
        raise ValueError(f"a signal must be longer than {pad} samples")
    x = np.asarray(x, float)
    head, tail = 2 * x[:, :1] - x[:, pad:0:-1], 2 * x[:, -1:] - x[:, -2 : -pad - 2 : -1]
    y = _run(sections, np.concatenate([head, x, tail], axis=1))
    return _run(sections, y[:, ::-1])[:, ::-1][:, pad:-pad]


def operator(sections: np.ndarray, n: int) -> np.ndarray:
    """The matrix H with zero_phase(x) = H x for signals of n samples."""
    return zero_phase(sections, np.eye(n)).T
