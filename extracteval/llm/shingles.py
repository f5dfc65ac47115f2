"""Word shingles and minima of hashed shingle sets, for batches of whole texts.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Both follow from bytes methods, which
touch ASCII only: ``bytes.lower`` and ``bytes.split``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import xxhash

WORD_CACHE = 1 << 18  # words a worker remembers the hash of; forgetting changes no result
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _WordHashes()


def words(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def shingle_set(tokens: Sequence[bytes], size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words; of the whole sequence, if it
    is shorter; nothing without words."""
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, tokens), np.uint64, n)
    k = min(size, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):  # a polynomial of the words' hashes, so order matters
        out = out * _STEP + h[i : n - k + 1 + i]
    return np.unique(mix(out))


def permutations(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, count, np.uint64) | np.uint64(1), rng.integers(0, 2**64, count, np.uint64)


def minima(sets: Sequence[np.ndarray], count: int, chunk: int = 1 << 15) -> np.ndarray:
    """For each non-empty set the minima under ``count`` permutations, as rows. Sets are worked
    on in chunks that stay in the processor's cache; a longer set is one chunk."""
    a, b = permutations(count)
    out = np.empty((len(sets), count), np.uint64)
    for lo, hi in _chunks([len(s) for s in sets], chunk):
        values = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0, *(len(s) for s in sets[lo : hi - 1])])
        for k in range(count):
            out[lo:hi, k] = np.minimum.reduceat(values * a[k] + b[k], starts)
    return out


def _chunks(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    lo, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)
