"""Token ids packed into fixed-length sequences.

Texts are tokenised with a public vocabulary, each document ends with an end token, and documents longer
than a sequence are split without loss. Within groups of bounded size, best-fit-decreasing packing puts
each piece into the fullest sequence that still has room; a segment tree over free space finds it.

A group is a stretch of one input partition, so nothing is shuffled and a lost task is simply run again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokeniser pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_TOKEN = 50256
LENGTH = 2048
GROUP_TOKENS = 4_000_000

_encodings: dict[str, object] = {}


def encoding(path: str = VOCABULARY):
    """The tokenizer of a vocabulary file; a worker process loads it once."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _encodings[path] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


class FreeSpace:
    """Open sequences by their free space: a segment tree of counts finds the least space of at least some size."""

    def __init__(self, length: int):
        self.leaves = 1
        while self.leaves <= length:
            self.leaves *= 2
        self.counts = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, space: int, change: int) -> None:
        node = space + self.leaves
        while node:
            self.counts[node] += change
            node //= 2

    def put(self, space: int, sequence: int) -> None:
        self.open[space].append(sequence)
        self._add(space, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The sequence with the least free space that still holds ``size``, and that space; it is no longer open."""
        node = size + self.leaves
        if not self.counts[node]:
            while node > 1 and (node % 2 or not self.counts[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        space = node - self.leaves
        self._add(space, -1)
        return self.open[space].pop(), space


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Numbers of the pieces in each sequence; equal sizes keep their order."""
    free = FreeSpace(length)
    sequences: list[list[int]] = []
    for piece in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fit = free.take(sizes[piece])
        if fit is None:
            sequence, space = len(sequences), length
            sequences.append([])
        else:
            sequence, space = fit
        sequences[sequence].append(piece)
        if space > sizes[piece]:
            free.put(space - sizes[piece], sequence)
    return sequences


def _rows(pieces: list[tuple], first: int, task: int, length: int, kind: np.dtype, end: int, id_type: pa.DataType) -> pa.RecordBatch:
    packs = best_fit_decreasing([len(p[3]) for p in pieces], length)
    ids, lengths, resets, docs, parts, begins = [], [], [], [], [], []
    for pack in packs:
        row = np.full(length, end, dtype=kind)
        bounds = [0]
        for i in pack:
            row[bounds[-1] : bounds[-1] + len(pieces[i][3])] = pieces[i][3]
            bounds.append(bounds[-1] + len(pieces[i][3]))
        ids.append(row.tobytes())
        lengths.append(bounds)
        resets.append(bounds if bounds[-1] < length else bounds[:-1])
        docs.append([pieces[i][0] for i in pack])
        parts.append([pieces[i][1] for i in pack])
        begins.append([pieces[i][2] for i in pack])
    names = [f"{task:06d}-{first + k:08d}" for k in range(len(packs))]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names, pa.string()),
            pa.array(docs, pa.list_(id_type)),
            pa.array(parts, pa.list_(pa.int32())),
            pa.array(begins, pa.list_(pa.int64())),
            pa.array(lengths, pa.list_(pa.int32())),
            pa.array(resets, pa.list_(pa.int32())),
            pa.array([b[-1] for b in lengths], pa.int32()),
            pa.array(ids, pa.binary()),
        ],
        ["pack_id", "doc_ids", "parts", "token_begins", "cu_seqlens", "position_resets", "n_tokens", "input_ids"],
    )


def pack(
    documents: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, end_token: int = END_TOKEN, group_tokens: int = GROUP_TOKENS
) -> DataFrame:
    """Packed sequences, one row each: the rows of the id matrix and where its segments lie.

    pack_id; doc_ids, parts and token_begins (of each segment: its document, the number of the part and the token
    of the document it begins with); cu_seqlens (cumulative segment lengths, from 0); position_resets (where
    positions start again from 0; the padding, if any, is the last such stretch); n_tokens (without padding);
    input_ids: ``length`` little-endian ids of 16 bits, or of 32 where the vocabulary needs them, padded with the end token.

    A null text counts as empty; an empty text gives just its end token. Very long texts become several parts.
    Repeated rows are packed as often as they stand; an empty table gives an empty result; other columns are ignored.
    """
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        ids = np.dtype("<u2" if end_token < 1 << 16 and encoding(vocabulary).n_vocab <= 1 << 16 else "<u4")
        task, first, held, pieces = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            names, texts = batch.column("doc_id"), batch.column("text")
            for i in range(batch.num_rows):
                tokens = encode(texts[i].as_py() or "")
                tokens.append(end_token)
                tokens, name = np.array(tokens, dtype=ids), names[i].as_py()
                for part, begin in enumerate(range(0, len(tokens), length)):
                    pieces.append((name, part, begin, tokens[begin : begin + length]))
                held += len(tokens)
                if held >= group_tokens:
                    out = _rows(pieces, first, task, length, ids, end_token, names.type)
                    first, held, pieces = first + out.num_rows, 0, []
                    yield out
        if pieces:
            yield _rows(pieces, first, task, length, ids, end_token, names.type)

    schema = f"pack_id string, doc_ids array<{kind}>, parts array<int>, token_begins array<bigint>, cu_seqlens array<int>, position_resets array<int>, n_tokens int, input_ids binary"
    return rows.mapInArrow(run, schema)


def position_ids(position_resets: list[int], length: int = LENGTH) -> np.ndarray:
    """Positions of one packed row, from the places where they start again."""
    starts = np.zeros(length, dtype=np.int64)
    starts[position_resets] = position_resets
    return np.arange(length) - np.maximum.accumulate(starts)
