"""Phrase collocation mining: frequent phrases of a language, scored by how much they exceed chance.

Runs of one to ``LONGEST`` words go into merged count-min sketches, which overestimate, in passes of growing size: a run
enters only if no run within it is certainly rarer than ``least``. Last pass: a run is counted exactly if that holds for
itself, too; nothing frequent is lost, as a phrase is at most as frequent as its parts. Counts are added up by word
numbers within a batch, so no hash decides a result. Then phrases are scored by their worst cut, and those that a longer
phrase explains are dropped.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allometra.llm.common import materialise
from allometra.llm.shingles import mix
from allometra.llm.sketch import Cells, Survivors, merge, width_for
from allometra.llm.tokens import Vocabulary, WordHashes, byte_table, raw_texts, stretches, tally

LEAST = 100
LONGEST = 5
TOP_PHRASES = 2000
SCALE = 1000
#: A longer phrase with this many hundredths of a phrase's occurrences explains it.
SHARE = 100
#: Sizes of runs that are sketched in one pass. Most pairs of words are common enough to tell nothing, longer runs are few once those
#: with a rare run in them are left out.
PASSES = ((1, 2), (3, 4, 5))
#: Bytes of text for each cell of a row of a sketch and each occurrence asked for: up to ``MAX_WIDTH`` a cell gets a sixth of ``least`` in pairs of words.
BYTES_PER_CELL = 1.25
LEAST_WIDTH = 1 << 22
#: Phrases that a task adds up before it hands them on, and the blocks, by hash, in which it does.
HELD = 1 << 20
BLOCKS = 1024

#: Characters that end a piece become full stops, tabs become blanks.
_TABLE = byte_table({b",;:!?\n\x0b\x0c\r": b".", b"\t": b" "})
_BREAK = b"."
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64())])
_PACKED = pa.schema([("lang", pa.string()), ("block", pa.int32()), ("phrases", pa.binary()), ("a", pa.list_(pa.int64()))])
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _runs(texts: list[bytes], vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, int]]:
    """Word numbers of many texts, 0 between pieces, in parts of a few million; how many at the start were in the part before."""
    waiting, size, carried = [], 0, np.zeros(0, dtype=np.int32)
    for raw in texts:
        for piece in stretches(raw.translate(_TABLE)):
            waiting.append(vocabulary.ids(piece.replace(_BREAK, b" . ").split()))
            size += len(waiting[-1])
            if size > 1 << 20:
                part = np.concatenate([carried, *waiting])
                yield part, len(carried)
                waiting, size, carried = [], 0, part[-(LONGEST - 1) :]
        waiting.append(np.zeros(1, dtype=np.int32))
    yield np.concatenate([carried, *waiting]), len(carried)


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    groups: dict[str, list[bytes]] = {}
    for lang, raw in zip(batch.column("lang").to_pylist(), raw_texts(batch.column("text"))):
        groups.setdefault(lang, []).append(raw)
    yield from groups.items()


def _longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of runs with one more word."""
    return mix(hashes * _STEP + words)


def _possible(ids: np.ndarray, words: np.ndarray, survivors: dict[int, Survivors], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size up to ``longest``: size, the hash of the run that begins at each place, and whether it can be frequent, by the sketches so far."""
    alive, run_hash = ids != 0, words
    for size in range(1, longest + 1):
        if size > 1:
            n = max(0, len(ids) - size + 1)
            alive, run_hash = alive[:n] & alive[1 : n + 1], _longer(run_hash[:n], words[size - 1 :])
        if size in survivors:
            at = np.flatnonzero(alive)
            at = at[survivors[size].may(run_hash[at])]
            alive = np.zeros(len(alive), dtype=bool)
            alive[at] = True
        yield size, run_hash, alive


def _sketched(rows: DataFrame, width: int, least: int, sizes: tuple[int, ...], survivors: dict[int, Survivors]) -> DataFrame:
    """Each task's sketch of the runs of ``sizes`` words that the sketches of shorter runs leave possible."""
    shared = rows.sparkSession.sparkContext.broadcast(survivors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(width, least)
        for batch in batches:
            for lang, texts in _by_language(batch):
                vocabulary, hashes = Vocabulary(_BREAK), WordHashes(lang)
                for ids, old in _runs(texts, vocabulary):
                    for size, run_hash, alive in _possible(ids, hashes.of(vocabulary)[ids], shared.value, max(sizes)):
                        if size in sizes:
                            fresh = max(0, old - size + 1)  # runs before this place ended in the part before
                            cells.add(run_hash[fresh:][alive[fresh:]])
        yield from cells.batches()

    return rows.mapInArrow(run, "block int, cells binary")


def _counted(rows: DataFrame, survivors: dict[int, Survivors]) -> DataFrame:
    """lang, block, phrases, a: occurrences of the surviving runs, and under the phrase '' of all words, added up by task.

    One row has the phrases of a block, between line ends, which no phrase contains.
    """
    shared = rows.sparkSession.sparkContext.broadcast(survivors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, texts in _by_language(batch):
                vocabulary, hashes = Vocabulary(_BREAK), WordHashes(lang)
                for ids, old in _runs(texts, vocabulary):
                    counts = held.setdefault(lang, Counter())
                    for phrase, n in _part(ids, old, hashes.of(vocabulary)[ids], list(vocabulary), shared.value):
                        counts[phrase] += n
                    if sum(map(len, held.values())) > HELD:
                        yield from _packed(held)
                        held = {}
        yield from _packed(held)

    return rows.mapInArrow(run, "lang string, block int, phrases binary, a array<long>")


def _packed(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, counts in held.items():
        blocks = defaultdict(list)
        for phrase in counts:
            blocks[xxhash.xxh3_64_intdigest(phrase) % BLOCKS].append(phrase)
        columns = [[lang] * len(blocks), list(blocks), [b"\n".join(p) for p in blocks.values()], [[counts[x] for x in p] for p in blocks.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKED)], schema=_PACKED)


def _added(packed: DataFrame) -> DataFrame:
    """lang, phrase, a: the blocks of all tasks added up, a phrase in more than one row only beyond ``HELD`` phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, phrases, a in zip(*(batch.column(n).to_pylist() for n in ("lang", "phrases", "a"))):
                counts = held.setdefault(lang, Counter())
                for phrase, n in zip(phrases.split(b"\n"), a):
                    counts[phrase] += n
            if sum(map(len, held.values())) > HELD:
                yield from _rows(held)
                held = {}
        yield from _rows(held)

    return packed.repartition("block").mapInArrow(run, "lang string, phrase string, a long")


def _rows(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, counts in held.items():
        phrases = [p.decode("utf-8") for p in counts]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(list(counts.values()), pa.int64())], schema=_COUNTS)


def _part(ids: np.ndarray, old: int, words: np.ndarray, names: list[bytes], survivors: dict[int, Survivors]) -> Iterator[tuple[bytes, int]]:
    """The surviving runs that end after the first ``old`` words, and how often they occur."""
    yield b"", int(np.count_nonzero(ids[old:]))
    number = ids.astype(np.int64)
    for size, _, alive in _possible(ids, words, survivors, LONGEST):
        if size > 1:
            number = number[: len(alive)] << 32 | ids[size - 1 :]
        at = np.flatnonzero(alive)
        distinct, first, inverse = np.unique(number[at], return_index=True, return_inverse=True)
        number = np.zeros(len(alive), dtype=np.int64)
        number[at] = inverse
        fresh, n_fresh = tally(inverse[at + size > old])
        for k, n in zip(at[first[fresh]].tolist(), n_fresh.tolist()):
            yield b" ".join([names[w] for w in ids[k : k + size].tolist()]), n


def phrase_counts(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, phrase, a of every run of one to ``LONGEST`` words with ``least`` occurrences or more; phrase '' has the number of all words."""
    rows = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
    width, survivors = max(LEAST_WIDTH, width_for(rows, math.ceil(BYTES_PER_CELL * least))), {}
    for sizes in PASSES:
        own = merge(_sketched(rows, width, least, sizes, survivors), width, least)
        survivors = survivors | dict.fromkeys(sizes, own)
    return _added(_counted(rows, survivors)).groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where((F.col("a") >= least) | (F.col("phrase") == ""))


def _whole(value: Column) -> Column:
    return value.cast("decimal(17,0)")


def collocations(documents: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP_PHRASES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of two words or more.

    A = occurrences, overlaps included; l and r = those of the two parts of the cut with the least score, the first such
    cut; n = words of the language; score = floor(1000 a n / (l r)). A phrase inside a longer candidate that has ``share``
    hundredths of its occurrences or more is dropped. Ties by occurrences, then by phrase.

    Null texts have no words, a null lang is ``und``; A-Z count as lower case. Each row counts, repeated or not. Languages
    without a candidate have no row; an empty table gives an empty result; other columns are ignored.
    """
    counts = materialise(phrase_counts(documents, least))
    words = F.split("phrase", " ")
    candidates = counts.where("phrase <> ''").withColumn("words", words).where(F.size("words") > 1)
    totals = counts.where("phrase = ''").select("lang", F.col("a").alias("n"))
    known = counts.where("phrase <> ''")

    def part(begin: Column, size: Column) -> Column:
        return F.array_join(F.slice("words", begin, size), " ")

    n_words = F.size("words")
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), n_words - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("before"), part(F.col("k") + 1, n_words - F.col("k")).alias("after"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("before"), F.col("a").alias("l")), ["lang", "before"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("after"), F.col("a").alias("r")), ["lang", "after"]).join(totals, "lang")
    above, below = _whole(F.col("a")) * _whole(F.col("n")) * F.lit(SCALE).cast("decimal(4,0)"), _whole(F.col("l")) * _whole(F.col("r"))
    cuts = cuts.withColumn("score", F.call_function("div", above, below))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), n_words - 1), lambda size: F.transform(F.sequence(F.lit(1), n_words - size + 1), lambda at: part(at, size))))
    inside = candidates.where(n_words > 2).select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(inner)).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(inside, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
