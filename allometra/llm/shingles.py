"""Word shingles of texts as 64-bit hashes, in numpy."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import xxhash

_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * _MULTIPLIERS[1]
    x = (x ^ (x >> np.uint64(27))) * _MULTIPLIERS[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of the words of a text in UTF-8, A-Z lower-cased; bytes.split knows just the six ASCII white-space characters."""
    words = raw.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; all words as one run if there are fewer, nothing without words."""
    if len(words) == 0:
        return words
    run = min(size, len(words))
    hashed = np.full(len(words) - run + 1, run, dtype=np.uint64)
    for k in range(run):
        hashed = mix(hashed * _MULTIPLIERS[0] + words[k : len(words) - run + 1 + k])
    return np.unique(hashed)


def shingle_sets(words: np.ndarray, sizes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sets of many texts at once, all of ``size`` or more words: hashes, one set after the other, and where each begins.

    ``words`` are the texts' word hashes, ``sizes`` how many each text has.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    n = len(words) - size + 1
    if len(sizes) == 0 or n < 1:
        return words[:0], np.zeros(len(sizes), dtype=np.int64)
    hashed = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        hashed = mix(hashed * _MULTIPLIERS[0] + words[k : n + k])
    whole = owner[:n] == owner[size - 1 :]
    hashed, owner = hashed[whole], owner[:n][whole]
    order = np.lexsort((hashed, owner))
    hashed, owner = hashed[order], owner[order]
    new = np.append(True, (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1]))
    hashed, owner = hashed[new], owner[new]
    return hashed, np.searchsorted(owner, np.arange(len(sizes)))


def digest(hashes: np.ndarray) -> bytes:
    return blake2b(hashes.tobytes(), digest_size=16).digest()
