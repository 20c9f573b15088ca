"""Words of many texts as small integers, inside Arrow tasks."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash

from allometra.llm.shingles import mix

#: Bytes of a text that are cut into words at once; longer texts go in stretches that end at a separator.
STRETCH = 1 << 22


def byte_table(changes: dict[bytes, bytes], lower: bool = True) -> bytes:
    """Table for ``bytes.translate``: every byte of a key becomes the value, A-Z become a-z if ``lower``."""
    table = bytearray(range(256))
    if lower:
        table[0x41:0x5B] = range(0x61, 0x7B)
    for old, new in changes.items():
        for byte in old:
            table[byte] = new[0]
    return bytes(table)


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, nothing for null."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def stretches(raw: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """The bytes in stretches cut at blanks."""
    at = 0
    while len(raw) - at > size:
        end = raw.rfind(b" ", at, at + size)
        if end < 0 and (end := raw.find(b" ", at + size)) < 0:
            break
        yield raw[at:end]
        at = end + 1
    yield raw[at:]


class Vocabulary(defaultdict):
    """Words met so far, each with its number."""

    def __init__(self, *first: bytes):
        super().__init__()
        self.default_factory = self.__len__
        for word in first:
            self[word]

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))


class WordHashes:
    """64-bit hashes of the words of a vocabulary, by number, as they are met; one family for each salt."""

    def __init__(self, salt: str):
        self.salt, self.known = np.uint64(xxhash.xxh3_64_intdigest(salt.encode())), np.zeros(0, dtype=np.uint64)

    def of(self, vocabulary: Vocabulary) -> np.ndarray:
        new = list(islice(vocabulary, len(self.known), None))
        if new:
            hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, new), dtype=np.uint64, count=len(new))
            self.known = np.concatenate([self.known, mix(hashed ^ self.salt)])
        return self.known


def tally(codes: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each occurs, or the sum of its weights."""
    if weights is None:
        codes = np.sort(codes)
        first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, dtype=np.int64)
        return codes[first], np.diff(np.append(first, len(codes)))
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, dtype=np.int64)
    return codes[first], np.add.reduceat(weights[order], first) if len(first) else weights[:0]
