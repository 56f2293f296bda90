"""Rolling hashes over byte strings, in numpy.

A window's hash depends on its bytes alone, not on where it stands, so equal
windows of different documents and different tasks hash alike.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, base: int, n: int) -> np.ndarray:
    have = _POWERS.get(kind)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[kind] = have
    return have[:n]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (their order becomes arbitrary)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(_MIX[0])
    h ^= h >> np.uint64(33)
    h *= np.uint64(_MIX[1])
    h ^= h >> np.uint64(33)
    return h


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of `width` values; empty if there are fewer values."""
    n = len(values)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _powers("up", _BASE, n), out=sums[1:])
    h = sums[width:] - sums[:-width]
    h *= _powers("down", _BASE_INV, n)[: n - width + 1]
    return mix64(h)


def sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over each window of `width` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def minimizers(hashes: np.ndarray, span: int) -> np.ndarray:
    """Mask of the positions that hold the least hash of some `span` neighbours in a row."""
    if len(hashes) < span:
        return np.zeros(len(hashes), dtype=bool)
    low = sliding(hashes, span, np.minimum)
    edge = np.zeros(span - 1, dtype=np.uint64)
    return sliding(np.concatenate([edge, low, edge]), span, np.maximum) == hashes
