"""Vectorised rolling and word hashes over byte arrays (numpy)."""

from __future__ import annotations

import numpy as np


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser); arrays only, their arithmetic wraps around."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One random 64-bit number a byte, from the mixer.
GEAR = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_GEAR16 = (GEAR >> np.uint64(48)).astype(np.uint16)


def gear16(raw: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash ``h = (h << 1) + gear[byte]`` at every byte; it depends on the last 16 bytes only.

    The shift drops a byte's influence after 16 steps, so the recurrence is a sum over 16 terms, doubled in four steps.
    """
    h = _GEAR16[raw]
    for step in (1, 2, 4, 8):
        shifted = np.zeros_like(h)
        shifted[step:] = h[:-step] << np.uint16(step) if len(h) > step else 0
        h = h + shifted
    return h
