"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as sequences of words (lower case, letters and digits only). A test item of m words may
differ in k = m * rate word edits; cut into k + 1 pieces, at least one piece stands unedited in any passage
within that budget. One automaton finds all exact pieces; Myers' bit-parallel distance then verifies the
words around each hit.

The benchmark is sent to the executors in blocks of bounded size; the documents stay where they are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

ERROR_RATE = 0.15
#: Most bytes of item text that one block holds, as a driver and a Python worker have to hold it.
BLOCK_BYTES = 8 << 20

_WORD = re.compile(r"\w+")


def normal_words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def error_budget(n_words: int, rate: float = ERROR_RATE) -> int:
    return int(n_words * rate)


def pieces(n_words: int, budget: int) -> list[tuple[int, int]]:
    """Begin and end of budget + 1 pieces of nearly equal length that cover all words."""
    n = min(budget + 1, n_words)
    return [(n_words * i // n, n_words * (i + 1) // n) for i in range(n)]


def myers_search(pattern: list[str], text: list[str], budget: int) -> tuple[int, int] | None:
    """Least edit distance of ``pattern`` to any stretch of ``text`` and the end of the first such stretch; None above ``budget``."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, word in enumerate(pattern):
        masks[word] = masks.get(word, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, best_end = min(m, budget + 1), 0
    for end, word in enumerate(text, 1):
        eq = masks.get(word, 0)
        vertical = eq | minus
        diagonal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(diagonal | plus))
        down = plus & diagonal
        score += bool(up & top) - bool(down & top)
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, best_end = score, end
    return (best, best_end) if best <= budget else None


@dataclass(frozen=True)
class Item:
    item_id: object
    words: list[str]
    budget: int


class Matcher:
    """All items of one block behind one automaton over their pieces."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        import ahocorasick

        self.items = [Item(i, w, error_budget(len(w), rate)) for i, text in items if (w := normal_words(text))]
        found: dict[str, list[tuple[int, int, int]]] = {}
        for number, item in enumerate(self.items):
            for begin, end in pieces(len(item.words), item.budget):
                found.setdefault(f" {' '.join(item.words[begin:end])} ", []).append((number, begin, end - begin))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, places)
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def search(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """Best match of each item in the text: item_id, distance, begin and end in words."""
        words = normal_words(text)
        if self.empty or not words:
            return []
        line = f" {' '.join(words)} "
        starts: dict[int, set[int]] = {}
        at = counted = 0
        for end, places in self.automaton.iter(line):
            # Words that end before the last blank of the piece.
            counted += line.count(" ", at, end)
            at = end
            for number, begin, size in places:
                starts.setdefault(number, set()).add(counted - size - begin)
        out = []
        for number, origins in starts.items():
            item = self.items[number]
            best = None
            for low, high in _joined(sorted(origins), len(item.words), item.budget):
                low, high = max(0, low), min(len(words), high)
                if hit := myers_search(item.words, words[low:high], item.budget):
                    best = min(best or (hit[0], low + hit[1]), (hit[0], low + hit[1]))
            if best:
                distance, end = best
                low = max(0, end - len(item.words) - item.budget)
                back = myers_search(item.words[::-1], words[low:end][::-1], item.budget)
                out.append((item.item_id, distance, end - (back[1] if back else end - low), end))
        return out


def _joined(origins: list[int], size: int, budget: int) -> list[tuple[int, int]]:
    """Stretches to verify around the places where an item would begin; overlapping ones are searched as one."""
    out: list[list[int]] = []
    for origin in origins:
        low, high = origin - budget, origin + size + budget
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(low, high) for low, high in out]


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of at most about ``block_bytes``; the driver holds one block at a time."""
    rows = benchmark.select("item_id", "text").where("text IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = int(total // block_bytes) + 1
    for k in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, r.text) for r in block.collect()]


def find_leaks(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document row and item whose words occur in it within the error budget.

    Returns doc_id, item_id, distance (word edits of the best stretch), begin and end (its words).

    Null or empty texts and items never match. Whole texts are searched. Repeated rows and repeated items each
    give their rows; of several stretches the nearest counts, then the first. Empty tables give an empty result.
    Other columns of the inputs are ignored.
    """
    rows = documents.select("doc_id", "text")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, distance int, begin int, end int"
    ids = to_arrow_type(benchmark.schema["item_id"].dataType)
    found = []
    for items in item_blocks(benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate)
            for batch in batches:
                hits = [(i, *hit) for i, text in enumerate(batch.column("text")) for hit in matcher.search(text.as_py())]
                if hits:
                    places, *columns = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(places)), pa.array(columns[0], ids), *(pa.array(c, pa.int32()) for c in columns[1:])],
                        ["doc_id", "item_id", "distance", "begin", "end"],
                    )

        found.append(rows.mapInArrow(run, schema))
    return reduce(DataFrame.union, found)


def drop_leaks(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``documents`` in which no item occurs within the error budget, with their columns as they came.

    Null and empty texts stay, repeated rows stay or go together; an empty benchmark drops nothing.
    """
    names, place = documents.columns, documents.columns.index("text")
    # By number, as mapInArrow takes no names with a dot in them.
    kept = documents.toDF(*[f"c{k}" for k in range(len(names))])
    for items in item_blocks(benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.search(text.as_py()) for text in batch.column(place)], pa.bool_()))

        kept = kept.mapInArrow(run, kept.schema)
    return kept.toDF(*names)
