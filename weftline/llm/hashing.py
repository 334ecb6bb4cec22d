"""Hashes of words and word shingles, whole batches of texts at a time."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(0x5EED)
#: A random odd number for each byte value, ASCII capitals as their small letters.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWER, _STEP, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _STEP
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` of all texts in turn, A-Z as a-z, and where each text's words begin and end."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    a = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    space = _SPACE[a]
    first = np.nonzero(space[:-1] & ~space[1:])[0] + 1
    # where in `a` each text begins; its words are those that begin before the next text does
    begins = np.cumsum([1, *(len(x) + 1 for x in raw)])
    ends = np.searchsorted(first, begins)
    if not len(first):
        return np.empty(0, dtype=np.uint64), ends
    at = np.nonzero(~space)[0]
    head = np.searchsorted(at, first)
    length = np.diff([*head, len(at)])
    place = np.arange(len(at)) - np.repeat(head, length)
    powers = np.cumprod(np.full(int(length.max()), _POWER, dtype=np.uint64))
    return mixed(np.add.reduceat(_BYTE[a[at]] * powers[place], head)), ends


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `words` words; of fewer words, one of all; of none, empty."""
    h, ends = word_hashes(texts)
    seed = lambda n: np.uint64(n * 0x1000193 + 7)
    if len(h) >= words:
        full = np.full(len(h) - words + 1, seed(words), dtype=np.uint64)
        for j in range(words):
            full = mixed(full * _STEP + h[j : len(h) - words + 1 + j])
    out = []
    for a, b in zip(ends, ends[1:]):
        if b - a >= words:
            out.append(np.unique(full[a : b - words + 1]))
        elif b > a:
            one = np.array([seed(b - a)], dtype=np.uint64)
            for j in range(a, b):
                one = mixed(one * _STEP + h[j : j + 1])
            out.append(one)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out
