"""Discrete wavelet transforms as matrices, so that a batch of windows is one matrix product.

Daubechies taps are built from their defining polynomial; the coiflet and the biorthogonal pair are tabulated.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

# Low-pass analysis taps of coif2, and both analysis filters of bior2.2.
COIF2_LOW = [-0.0007205494453645122, -0.0018232088707029932, 0.0056114348193944995, 0.023680171946334084, -0.0594344186464569, -0.0764885990783064,
             0.41700518442169254, 0.8127236354455423, 0.3861100668211622, -0.06737255472196302, -0.04146493678175915, 0.016387336463522112]
BIOR22_LOW = [0.0, -0.1767766952966369, 0.3535533905932738, 1.0606601717798214, 0.3535533905932738, -0.1767766952966369]
BIOR22_HIGH = [0.0, 0.3535533905932738, -0.7071067811865476, 0.3535533905932738, 0.0, 0.0]
WAVELETS = ["db4", "haar", "db8", "coif2", "bior2.2"]


def daubechies(moments: int) -> np.ndarray:
    """Minimum-phase scaling filter with the given number of vanishing moments (2 * moments taps)."""
    halfband = [math.comb(moments - 1 + k, k) for k in range(moments)][::-1]
    taps = np.array([1.0])
    for y in np.roots(halfband) if moments > 1 else []:
        pair = np.roots([1.0, 4 * y - 2.0, 1.0])  # y = (2 - z - 1/z) / 4
        taps = np.convolve(taps, [1.0, -pair[np.argmin(np.abs(pair))]])
    for _ in range(moments):
        taps = np.convolve(taps, [1.0, 1.0])
    taps = np.real(taps)
    return taps * math.sqrt(2.0) / taps.sum()


@lru_cache
def analysis_filters(name: str) -> tuple[np.ndarray, np.ndarray]:
    if name == "bior2.2":
        return np.array(BIOR22_LOW), np.array(BIOR22_HIGH)
    low = np.array(COIF2_LOW) if name == "coif2" else daubechies(1 if name == "haar" else int(name[2:]))[::-1]
    signs = np.where(np.arange(len(low)) % 2 == 0, -1.0, 1.0)
    return low, signs * low[::-1]


def _one_level(size: int, taps: np.ndarray) -> np.ndarray:
    """Matrix of filtering and downsampling under half-point symmetric extension."""
    n = len(taps)
    out = (size + n - 1) // 2
    m = np.zeros((size, out))
    for k in range(out):
        for j in range(n):
            at = 2 * k + 1 - j
            while not 0 <= at < size:
                at = -1 - at if at < 0 else 2 * size - 1 - at
            m[at, k] += taps[j]
    return m


@lru_cache
def decomposition(name: str, size: int, levels: int) -> tuple[np.ndarray, tuple[int, ...]]:
    """``window @ matrix`` gives all coefficients: approximation first, then details from the coarsest level on.

    The second value holds the length of each part.
    """
    low, high = analysis_filters(name)
    approx, details = np.eye(size), []
    for _ in range(levels):
        width = approx.shape[1]
        details.append(approx @ _one_level(width, high))
        approx = approx @ _one_level(width, low)
    parts = [approx, *details[::-1]]
    return np.concatenate(parts, axis=1), tuple(p.shape[1] for p in parts)
