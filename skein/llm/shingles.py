"""Sets of hashed word shingles, for many texts at once with numpy.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. A word's hash is a polynomial of its bytes modulo 2**64, taken from
prefix sums over the whole slice, then mixed; a shingle's is one of its words' hashes. Two different shingles of a pair of
texts have the same hash with a probability of some 2**-64 for each pair of shingles, which is the only way a size or an
overlap can differ from that of the words themselves.
"""

from __future__ import annotations

import functools

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD1B54A32D192ED03 | 1
_MASK = (1 << 64) - 1
#: Bytes of text taken at once.
SLICE = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    steps = [np.full(n + 1, x, np.uint64) for x in (_BASE, inverse)]
    for x in steps:
        x[0] = 1
    return np.cumprod(steps[0]), np.cumprod(steps[1])


def _slice_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    up, down = _powers(1 << max(16, int(len(raw)).bit_length()))
    lower = raw + (np.uint8(32) * ((raw >= 65) & (raw <= 90)).astype(np.uint8))
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.diff(inside.astype(np.int8), prepend=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    words = mix((sums[last] - sums[first]) * down[first])
    grams = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for i in range(k):
        grams = grams * np.uint64(_STEP) + words[i : i + len(grams)]
    grams = mix(grams)
    ends = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(first, ends, side="left")
    out, start = [], 0
    for end in upto.tolist():
        if end - start >= k:
            out.append(np.unique(grams[start : end - k + 1]))
        elif end > start:
            whole = functools.reduce(lambda h, w: (h * _STEP + int(w)) & _MASK, words[start:end].tolist(), end - start)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        start = end
    return out


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of fewer than k words the whole sequence is one shingle, of none there is none."""
    out: list[np.ndarray] = []
    now: list[bytes] = []
    size = 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass")
        if now and size + len(data) > SLICE:
            out += _slice_sets(now, k)
            now, size = [], 0
        now.append(data)
        size += len(data) + 1
    return out + (_slice_sets(now, k) if now else [])
