"""Vectorised word splitting and 64-bit hashing over UTF-8 bytes (numpy only)."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER_AZ = np.arange(256, dtype=np.uint8)
LOWER_AZ[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on uint64 (a bijection); works on a copy."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def salts(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random words for a seed."""
    start = (seed * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & MASK
    return mix(np.arange(1, n + 1, dtype=U64) * U64(_BASE) + U64(start))


_BYTE = salts(256, 11)
_BYTE_LOWER = _BYTE[LOWER_AZ]


class _Powers:
    """Powers of the polynomial base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def __reduce__(self) -> tuple:
        return _Powers, ()

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 15)
            if size > 1 << 22:
                size = n
            step = np.full(size, _BASE, U64)
            step[0] = 1
            up = np.cumprod(step, dtype=U64)
            step[1:] = U64(_BASE_INVERSE)
            down = np.cumprod(step, dtype=U64)
            if size > 1 << 22:  # not kept: one very long text must not stay in memory
                return up, down
            self.up, self.down = up, down
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def utf8(text: str | None) -> np.ndarray:
    """The text's bytes; null counts as empty, lone surrogates are kept."""
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of each run of True."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate(([0], edge))
    if inside[-1]:
        edge = np.concatenate((edge, [len(inside)]))
    return edge[0::2], edge[1::2]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of data[start:end] for every span, in O(bytes)."""
    if not len(starts):
        return np.zeros(0, U64)
    up, down = _POWERS.of(len(data))
    table = _BYTE_LOWER if lower else _BYTE
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum(table[data] * up, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U64))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the words ``[^\\x20\\x09-\\x0D]+``."""
    return spans(~IS_SPACE[data])


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text, A-Z lower-cased.

    With fewer than k words the whole sequence is the only shingle; a text without
    words, empty or null, has none.
    """
    data = utf8(text)
    starts, ends = words(data)
    h = hash_spans(data, starts, ends, lower=True)
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), U64)
    for j in range(min(k, len(h))):
        out = mix(out * U64(0xD6E8FEB86659FD93) + h[j : j + n])
    return np.unique(out)
