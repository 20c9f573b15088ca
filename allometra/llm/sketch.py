"""Count-min sketches of a corpus: filled in tasks, merged block by block, read as bitmaps of the cells that reach a threshold.

A cell never holds less than the count of any key that falls on it, so a key with one cell under the threshold can be
discarded before anything is shuffled. Cells stop at the threshold, as more does not matter, and so fit a byte up to 255.

Size: ``DEPTH`` rows of at most ``MAX_WIDTH`` cells. A task holds a byte a cell (128 MB at most, more for thresholds above
255); the driver and each executor hold a bit a cell (16 MB at most). Beyond that many cells the sketch fills up and
discards less: results stay the same, and the exact count that follows has more rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allometra.llm.shingles import mix

DEPTH = 2
MIN_WIDTH, MAX_WIDTH = 1 << 16, 1 << 26
#: Cells that travel in one row.
BLOCK = 1 << 18
_FAMILIES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_HALF = np.uint64(32)
_SCHEMA = pa.schema([("block", pa.int32()), ("cells", pa.binary())])


def width_for(documents: DataFrame, bytes_per_cell: int) -> int:
    """Cells of a row for the texts of ``documents``, one for so many bytes, in whole blocks."""
    size = documents.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    wanted = min(MAX_WIDTH, max(MIN_WIDTH, size // bytes_per_cell))
    return wanted if wanted < BLOCK else -(-wanted // BLOCK) * BLOCK


def places(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """Cells of 64-bit hashes in one row."""
    return ((mix(hashes * _FAMILIES[row]) >> _HALF) * np.uint64(width) >> _HALF).astype(np.uint32)


class Cells:
    """Counts of one task."""

    def __init__(self, width: int, least: int):
        self.width, self.least = width, least
        self.cells = np.zeros((DEPTH, width), dtype=np.min_scalar_type(least))

    def add(self, hashes: np.ndarray) -> None:
        """Count each hash once more."""
        for row in range(DEPTH):
            at = np.sort(places(hashes, row, self.width))
            if len(at):
                first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                where, n = at[first], np.diff(np.append(first, len(at)))
                self.cells[row][where] = np.minimum(self.cells[row][where] + n, self.least)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The blocks that are not empty, compressed."""
        codec, flat = pa.Codec("zstd"), self.cells.reshape(-1)
        for block in range(-(-len(flat) // BLOCK)):
            part = flat[block * BLOCK : (block + 1) * BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([codec.compress(part.tobytes(), asbytes=True)], pa.binary())], schema=_SCHEMA)


class Survivors:
    """Which keys can have reached the threshold, as a bit for each cell."""

    def __init__(self, width: int, bits: np.ndarray):
        self.width, self.bits = width, bits

    def may(self, hashes: np.ndarray) -> np.ndarray:
        """False where a key has certainly been counted less often than the threshold."""
        kept = np.ones(len(hashes), dtype=bool)
        for row in range(DEPTH):
            at = places(hashes, row, self.width).astype(np.int64) + row * self.width
            kept &= (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return kept


def merge(partial: DataFrame, width: int, least: int) -> Survivors:
    """Add up the tasks' blocks, each block in one stream, and fetch their bits.

    ``partial`` has the rows of ``Cells.batches``. A task holds the sums of its blocks, never the blocks of all tasks.
    """
    total, kind = DEPTH * width, np.min_scalar_type(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sums = pa.Codec("zstd"), {}
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = min(BLOCK, total - block * BLOCK)
                part = np.frombuffer(codec.decompress(cells, size * kind.itemsize), dtype=kind)
                held = sums.get(block)
                sums[block] = part if held is None else np.minimum(held.astype(np.int64) + part, least).astype(kind)
        for block, cells in sums.items():
            bits = np.packbits(cells >= least).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([codec.compress(bits, asbytes=True)], pa.binary())], schema=_SCHEMA)

    bits, codec = np.zeros(-(-total // 8), dtype=np.uint8), pa.Codec("zstd")
    for r in partial.repartition("block").mapInArrow(run, "block int, cells binary").collect():
        size = -(-min(BLOCK, total - r.block * BLOCK) // 8)
        at = r.block * BLOCK // 8
        bits[at : at + size] = np.frombuffer(codec.decompress(bytes(r.cells), size), dtype=np.uint8)
    return Survivors(width, bits)
