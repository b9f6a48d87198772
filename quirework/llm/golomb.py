"""Golomb-Rice coding of sorted integer lists, with the unary and the remainder halves in planes of their own."""

from __future__ import annotations

import numpy as np


def parameter(universe: int, n: int) -> int:
    """The Rice exponent for n values spread over a universe: log2 of ln(2) times the mean gap."""
    return max(0, int(np.floor(np.log2(max(1.0, 0.69 * universe / max(1, n))))))


def encode(values: np.ndarray, k: int) -> tuple[bytes, bytes]:
    """(unary plane, remainder plane) of a sorted list of distinct non-negative int64 values."""
    if not len(values):
        return b"", b""
    gaps = np.diff(values, prepend=0)
    ends = np.cumsum((gaps >> k) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    low = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    return np.packbits(unary).tobytes(), np.packbits(low.ravel()).tobytes()


def decode(unary: bytes, low: bytes, n: int, k: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.int64) << k
    if k:
        bits = np.unpackbits(np.frombuffer(low, np.uint8), count=n * k).reshape(n, k).astype(np.int64)
        gaps |= bits @ (np.int64(1) << np.arange(k, dtype=np.int64))
    return np.cumsum(gaps)
