"""Hashed byte n-grams of texts, and logistic models over them."""

from __future__ import annotations

import numpy as np

from memloom.llm.rolling import window_hashes


def gram_counts(text: str, bits: int, widths: tuple[int, ...] = (1, 2, 3), block: int = 1_000_000) -> np.ndarray:
    """Counts of the byte n-grams of the lower-cased text, hashed to 2 ** bits; any length of text."""
    data = np.frombuffer(text.lower().encode("utf-8", errors="surrogatepass"), dtype=np.uint8)
    out = np.zeros(1 << bits)
    for width in widths:
        for at in range(0, len(data), block):
            part = data[at : at + block + width - 1]
            if len(part) < width:
                break
            if width <= 3:  # small enough to be its own number; a multiplication spreads it
                ids = np.zeros(len(part) - width + 1, dtype=np.uint32)
                for k in range(width):
                    ids = (ids << np.uint32(8)) | part[k : len(part) - width + 1 + k]
                ids = (ids + np.uint32(width << 24)) * np.uint32(0x9E3779B1)
                ids >>= np.uint32(32 - bits)
            else:
                ids = (window_hashes(part, width) >> np.uint64(64 - bits)).astype(np.int64)
            out += np.bincount(ids, minlength=1 << bits)
    return out


def normed(counts: np.ndarray) -> np.ndarray:
    """Square roots scaled to length 1: long and short texts weigh alike."""
    root = np.sqrt(counts)
    size = np.linalg.norm(root, axis=-1, keepdims=True)
    return root / np.maximum(size, 1e-12)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-4, rounds: int = 150, rate: float = 0.5):
    """(weights, constant) per column of y (rows x outputs), by Adam on the whole of a bounded sample."""
    y = y.reshape(len(x), -1).astype(float)
    weight = np.ones(len(x)) if weight is None else weight / weight.mean()
    w, c = np.zeros((x.shape[1], y.shape[1])), np.zeros(y.shape[1])
    mw, vw, mc, vc = np.zeros_like(w), np.zeros_like(w), np.zeros_like(c), np.zeros_like(c)
    for step in range(1, rounds + 1):
        # products in the type of x: a mixed product would copy x each time
        error = (sigmoid(x @ w.astype(x.dtype) + c) - y) * weight[:, None] / len(x)
        gw, gc = (error.astype(x.dtype).T @ x).T + ridge * w, error.sum(axis=0)
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2
        mc, vc = 0.9 * mc + 0.1 * gc, 0.99 * vc + 0.01 * gc**2
        up = 1 - 0.9**step
        down = np.sqrt(1 - 0.99**step)
        w -= rate * (mw / up) / (np.sqrt(vw) / down + 1e-9)
        c -= rate * (mc / up) / (np.sqrt(vc) / down + 1e-9)
    return w, c
