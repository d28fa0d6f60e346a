"""Hilbert codes of two coordinates."""

from __future__ import annotations

import numpy as np


def hilbert_codes(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """Positions of the points (x, y) on the Hilbert curve over a square of 2^bits cells a side; x, y from 0 below 2^bits."""
    side = 1 << bits
    x, y, code = x.astype(np.int64), y.astype(np.int64), np.zeros(len(x), np.int64)
    for half in (1 << k for k in reversed(range(bits))):
        right, upper = (x & half > 0).astype(np.int64), (y & half > 0).astype(np.int64)
        code += half * half * ((3 * right) ^ upper)
        turn, flip = upper == 0, (upper == 0) & (right == 1)
        a, b = np.where(flip, side - 1 - x, x), np.where(flip, side - 1 - y, y)
        x, y = np.where(turn, b, a), np.where(turn, a, b)
    return code
