"""Word shingles of whole texts as 64-bit hashes, by vectorised arithmetic on UTF-8 bytes."""

from __future__ import annotations

import hashlib

import numpy as np

SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 20
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    up = _powers(_BASE, 1 << 12)
    down = _powers(_INVERSE, 1 << 12)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            cls.up, cls.down = _powers(_BASE, size), _powers(_INVERSE, size)
        return cls.up, cls.down


def word_places(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte past the end of every word."""
    edge = np.diff(np.concatenate(([0], (~_WHITE[raw]).view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word ([^\\x20\\x09-\\x0D]+ after A-Z to a-z), in order."""
    return byte_word_hashes(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8))


def byte_word_hashes(raw: np.ndarray) -> np.ndarray:
    """`word_hashes` of UTF-8 bytes."""
    out, lo = [np.zeros(0, dtype=np.uint64)], 0
    while lo < len(raw):
        hi = min(len(raw), lo + _CHUNK)
        while hi < len(raw) and not _WHITE[raw[hi]]:  # a chunk ends between words
            hi += 1
        a = _LOWER[raw[lo:hi]]
        start, end = word_places(a)
        up, down = Powers.of(len(a) + 1)
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[a] * up[: len(a)], dtype=np.uint64)))
        out.append(mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)))
        lo = hi
    return np.concatenate(out)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the `size`-word shingles; fewer words make one, none make none."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(size, len(w))
    h = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for j in range(k):
        h = mix64(h * np.uint64(_BASE) + w[j : j + len(h)] + np.uint64(k))
    return np.unique(h)


def set_digest(values: np.ndarray) -> str:
    """128 bits of a sorted set, in hex."""
    return hashlib.blake2b(values.tobytes(), digest_size=16).hexdigest()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
