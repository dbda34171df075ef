"""Periodic window functions, computed on the driver."""

from __future__ import annotations

import numpy as np

#: Coefficients of cosine sums, in natural order.
COSINE_SUMS = {
    "boxcar": (1.0,),
    "hann": (0.5, 0.5),
    "hamming": (0.54, 0.46),
    "blackman": (0.42, 0.5, 0.08),
    "nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411),
    "blackmanharris": (0.35875, 0.48829, 0.14128, 0.01168),
    "flattop": (0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368),
}


#: Windows as functions of the distance from the middle, -1 to 1 at the ends of a symmetric window.
SHAPES = {
    "bartlett": lambda u: 1 - np.abs(u),
    "bohman": lambda u: (1 - np.abs(u)) * np.cos(np.pi * np.abs(u)) + np.sin(np.pi * np.abs(u)) / np.pi,
    "barthann": lambda u: 0.62 - 0.48 * np.abs(u / 2) + 0.38 * np.cos(np.pi * u),
}
#: The same on a grid that stops half a step short of the ends.
INNER_SHAPES = {"triang": lambda u: 1 - np.abs(u), "cosine": lambda u: np.cos(np.pi * u / 2)}


def _kaiser(u: np.ndarray, beta: float) -> np.ndarray:
    return np.i0(beta * np.sqrt(np.maximum(0, 1 - u**2))) / np.i0(beta)


def _tukey(u: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    edge = np.maximum(0, np.abs(u) - (1 - alpha))
    return np.where(edge > 0, 0.5 * (1 + np.cos(np.pi * edge / max(alpha, 1e-300))), 1.0)


PARAMETRIC = ("kaiser", "tukey", "gaussian", "general_gaussian", "general_hamming", "general_cosine")
NAMES = (*COSINE_SUMS, *SHAPES, *INNER_SHAPES, "parzen", *PARAMETRIC)


def taper(name: str | tuple, n: int) -> np.ndarray:
    """The periodic window of n values: a name, or a name and its parameters; a number is a Kaiser window's beta."""
    if isinstance(name, (int, float)):
        name = ("kaiser", float(name))
    kind, *args = (name,) if isinstance(name, str) else name
    if n == 1:
        return np.ones(1)
    j = np.arange(n)
    u = 2 * j / n - 1  # the first n of the n + 1 points of a symmetric window
    if kind in ("general_cosine", "general_hamming") and args:
        sums = args[0] if kind == "general_cosine" else (args[0], 1 - args[0])
    else:
        sums = COSINE_SUMS.get(kind)
    if sums is not None:
        return sum((-1) ** k * a * np.cos(2 * np.pi * k * j / n) for k, a in enumerate(sums)) * np.ones(n)
    if kind in SHAPES:
        return SHAPES[kind](u)
    if kind == "triang":  # its slope depends on whether the points are odd in number
        m = n + 1
        return 1 - np.abs(2 * j - n) / (m + m % 2)
    if kind == "parzen":
        v = np.abs(2 * j - n) / (n + 1)
        return np.where(np.abs(2 * j - n) <= n / 2, 1 - 6 * v**2 * (1 - v), 2 * (1 - v) ** 3)
    if kind in INNER_SHAPES:
        return INNER_SHAPES[kind](u * n / (n + 1))
    if kind == "kaiser" and args:
        return _kaiser(u, args[0])
    if kind == "tukey":
        return _tukey(u, *args)
    if kind == "gaussian" and args:
        return np.exp(-0.5 * ((j - n / 2) / args[0]) ** 2)
    if kind == "general_gaussian" and len(args) == 2:
        return np.exp(-0.5 * np.abs((j - n / 2) / args[1]) ** (2 * args[0]))
    raise ValueError(f"unknown window {name!r}, or parameters missing; known: {', '.join(NAMES)}")
