"""Golomb coding of sorted numbers: quotients of the gaps in unary, remainders in a fixed number of bits."""

from __future__ import annotations

import numpy as np


def parameter(universe: int, n: int) -> int:
    """Bits of the remainder that suit ``n`` numbers spread over ``universe``: about 0.69 of the mean gap."""
    return max(0, int(0.69 * universe / max(n, 1)).bit_length() - 1)


def encode(values: np.ndarray, bits: int) -> bytes:
    """``values``: ascending uint64. First all remainders, then all quotients."""
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    ends = np.cumsum((gaps >> np.uint64(bits)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    shifts = np.arange(bits, dtype=np.uint64)
    rest = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
    return np.packbits(rest.ravel()).tobytes() + np.packbits(unary).tobytes()


def decode(data: bytes, n: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    head = (n * bits + 7) // 8
    rest = np.unpackbits(raw[:head], count=n * bits).reshape(n, bits).astype(np.uint64)
    ends = np.flatnonzero(np.unpackbits(raw[head:]))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    gaps = (quotients.astype(np.uint64) << np.uint64(bits)) + (rest << np.arange(bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return np.cumsum(gaps, dtype=np.uint64)
