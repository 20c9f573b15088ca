"""Runs of ``PASSAGE`` or more words that recur word for word, wherever lines break.

Every window of that many words is a unit. Of the shorter runs of ``SEED`` words that begin in a window, the one with
the least hash is its seed; equal windows have equal seeds. So only windows whose seed recurs are written, and of these
each is held against the first of its equals. Windows that follow each other, as their firsts do, make one run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allometra.llm.common import materialise
from allometra.llm.shingles import mix, word_hashes
from allometra.llm.similarity import Bitmap

PASSAGE = 50
SEED = 20
#: A bitmap of 16 MB.
SEED_BITS = 27
#: Windows of a stretch are numbered in so many bits; a longer one goes on in the next row. Rows are numbered in the other 43.
_PLACE_BITS = 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _rolled(words: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """Hashes of the runs of each size, by differences of one running sum."""
    n = len(words)
    up, down = (np.cumprod(np.append(np.uint64(1), np.full(n, base, dtype=np.uint64))) for base in (_BASE, _INVERSE))
    sums = np.append(np.uint64(0), np.cumsum(words * up[:n]))
    return [mix((sums[size:] - sums[: n + 1 - size]) * down[: n + 1 - size]) for size in sizes]


def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` hashes in a row."""
    held = 1
    while 2 * held <= width:
        hashes, held = np.minimum(hashes[:-held], hashes[held:]), 2 * held
    return np.minimum(hashes[: len(hashes) - (width - held)], hashes[width - held :]) if width > held else hashes


def _words(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, int, bytes, np.ndarray]]:
    for batch in batches:
        for i, text in enumerate(batch.column("text").cast(pa.binary())):
            raw = text.as_py() or b""
            words = word_hashes(raw) if len(raw) >= 2 * size - 1 else ()
            if len(words) >= size:
                yield batch, i, raw, words


def _seeds(documents: DataFrame, size: int, seed: int) -> DataFrame:
    """Seeds of each text, one row for each stretch of windows that has it; twice if it occurs twice in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, dtype=np.uint64)]
            for *_, words in _words([batch], size):
                (hashes,) = _rolled(words, seed)
                least = _least(hashes, size - seed + 1)
                own = least[np.append(True, least[1:] != least[:-1])]
                hashes = np.sort(hashes)
                again = hashes[1:][hashes[1:] == hashes[:-1]]
                found += [own, own[np.isin(own, again)]] if len(again) else [own]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["seed"])

    return documents.select("text").mapInArrow(run, "seed long")


def _stretches(documents: DataFrame, size: int, seed: int) -> DataFrame:
    """Windows whose seed recurs, one row for each stretch of them: doc_id, text_id, first_word, paragraph, breaks (words at which further lines begin), keys."""
    mask = (1 << SEED_BITS) - 1
    again = _seeds(documents, size, seed).groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    asked = Bitmap(again.select(F.col("seed").bitwiseAND(mask).alias("place")), SEED_BITS)
    most = (1 << _PLACE_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, rows = [], []
            for _, i, raw, words in _words([batch], size):
                hashes, keys = _rolled(words, seed, size)
                keep = asked.holds((_least(hashes, size - seed + 1) & np.uint64(mask)).astype(np.int64))
                if not keep.any():
                    continue
                begins = np.cumsum([0, *(len(line.split()) for line in raw.split(b"\n"))])[:-1]
                ends = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8))).reshape(-1, 2)
                for a, b in ends.tolist():
                    for at in range(a, b, most):
                        to = min(b, at + most)
                        line = int(np.searchsorted(begins, at, "right")) - 1
                        owners.append(i)
                        rows.append((at, line, begins[line + 1 : np.searchsorted(begins, to, "left")], keys[at:to].view(np.int64)))
            if owners:
                kinds = (pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(owners, pa.int32())) for c in ("doc_id", "text_id")), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))],
                    ["doc_id", "text_id", "first_word", "paragraph", "breaks", "keys"],
                )

    rows = documents.select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text_id long, first_word int, paragraph int, breaks array<int>, keys array<long>")


def _with_firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, code) in order, to (code, first code of the key) of keys with two rows or more."""
    last, first, alone = None, None, False
    for batch in batches:
        keys, codes = (batch.column(i).to_numpy() for i in range(2))
        if not len(keys):
            continue
        new = np.append(last is None or keys[0] != last, keys[1:] != keys[:-1])
        begins = np.flatnonzero(new)
        which = np.cumsum(new) - 1
        firsts = np.where(which < 0, first if first is not None else 0, codes[begins[which]] if len(begins) else 0)
        follows = ~new
        keep = follows.copy()
        keep[:-1] |= follows[1:]
        codes_out, firsts_out = codes[keep], firsts[keep]
        if alone and not new[0]:  # the first of the key was the last row of an earlier batch
            codes_out, firsts_out = np.append(first, codes_out), np.append(first, firsts_out)
        last, first, alone = keys[-1], firsts[-1], bool(new[-1])
        yield pa.RecordBatch.from_arrays([pa.array(codes_out.astype(np.int64)), pa.array(firsts_out.astype(np.int64))], ["code", "first"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (code, first) in order, to runs in which both go up by one: code, first, windows."""
    open_run = np.zeros((0, 3), dtype=np.int64)
    for batch in batches:
        code, first = (batch.column(i).to_numpy() for i in range(2))
        if not len(code):
            continue
        new = np.append(True, (code[1:] != code[:-1] + 1) | (first[1:] != first[:-1] + 1))
        begins = np.flatnonzero(new)
        rows = np.stack([code[begins], first[begins], np.diff(np.append(begins, len(code)))], axis=1)
        if len(open_run) and (open_run[0, :2] + open_run[0, 2] == rows[0, :2]).all():
            rows[0] = [*open_run[0, :2], open_run[0, 2] + rows[0, 2]]
        else:
            rows = np.concatenate([open_run, rows])
        open_run = rows[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows[:-1].T], ["code", "first", "windows"])
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in open_run.T], ["code", "first", "windows"])


def _periods(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs that follow each other with the same first, as a text with a short period has them, as one."""
    held = np.zeros((0, 3), dtype=np.int64)
    for batch in _runs(batches):
        rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
        if not len(rows):
            continue
        code, first, windows = rows.T
        # A first itself, which has its own place, stays a run of its own.
        begins = np.flatnonzero(np.append(True, (code[1:] != code[:-1] + windows[:-1]) | (first[1:] != first[:-1]) | (code[:-1] == first[:-1])))
        rows = np.stack([code[begins], first[begins], np.add.reduceat(windows, begins)], axis=1)
        held = rows[-1:]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows[:-1].T], ["code", "first", "windows"])
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in held.T], ["code", "first", "windows"])


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` written in their order, with ``row``, their number in it; the driver sees one count a partition."""
    rows = materialise(rows.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    before, total = [], 0
    for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():
        before.append((r["_part"], total))
        total += r["n"]
    offsets = rows.sparkSession.createDataFrame(before, "_part int, _before long")
    return rows.join(F.broadcast(offsets), "_part").withColumn("row", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def repeated_passages(documents: DataFrame, size: int = PASSAGE, seed: int = SEED) -> DataFrame:
    """One row for each run of words whose windows of ``size`` words all recur, with the place of their first occurrence.

    Returns doc_id, text_id (hash of the text), paragraph (line in which it begins), first_word (from 0), n_words,
    component_doc, component_paragraph, component_word and removed (false where it is the first itself). The first is
    that of the least doc_id, null ids last. All runs of ``size`` words or more that recur are found, also within one
    text; words are compared in lower case, and white space of any kind parts them. A run that goes on from its own first, as
    in a text with a short period, is one row and begins where the first ends.
    """
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_id"), F.col("first_word")]
    # Written first: ordering reads its input twice, once to find the ranges. The windows stay out of it.
    found = materialise(_stretches(documents, size, seed).withColumn("_id", F.monotonically_increasing_id()))
    places = _numbered(found.drop("keys").orderBy(*order))
    windows = found.select("_id", "keys").join(places.select("_id", "row"), "_id").select("row", F.posexplode("keys").alias("pos", "key")).select("key", F.shiftleft("row", _PLACE_BITS).bitwiseOR(F.col("pos").cast("long")).alias("code"))
    firsts = windows.repartition("key").sortWithinPartitions("key", "code").mapInArrow(_with_firsts, "code long, first long")
    firsts = firsts.repartition(F.shiftright("code", _PLACE_BITS)).sortWithinPartitions("code")
    runs = firsts.mapInArrow(_periods, "code long, first long, windows long")
    places = places.drop("_id")

    def placed(df: DataFrame, code: str, names: dict[str, str]) -> DataFrame:
        word = F.col("first_word") + F.col(code).bitwiseAND((1 << _PLACE_BITS) - 1).cast("int")
        df = df.withColumn("row", F.shiftright(code, _PLACE_BITS)).join(places, "row").withColumn("_word", word)
        df = df.withColumn("paragraph", F.col("paragraph") + F.size(F.filter("breaks", lambda x: x <= F.col("_word")))).drop("row", "first_word", "breaks")
        return df.withColumnsRenamed(names)

    # What overlaps its own first, in the same stretch, begins after it: a first has as many windows as it is ahead, or all of the run.
    ahead = F.col("code") - F.col("first")
    near = (F.shiftright("code", _PLACE_BITS) == F.shiftright("first", _PLACE_BITS)) & (ahead > 0)
    cut = F.when(near, F.greatest(F.lit(0), F.least(ahead, F.col("windows")) + (size - 1) - ahead)).otherwise(0)
    runs = runs.withColumn("words", F.col("windows") + (size - 1) - cut).withColumn("code", F.col("code") + cut).drop("windows").where("words > 0")
    out = placed(runs, "first", {"doc_id": "component_doc", "text_id": "_text", "paragraph": "component_paragraph", "_word": "component_word"})
    out = placed(out, "code", {"_word": "first_word"})
    same = F.col("doc_id").eqNullSafe(F.col("component_doc")) & (F.col("text_id") == F.col("_text")) & (F.col("first_word") == F.col("component_word"))
    n_words = F.col("words").cast("int").alias("n_words")
    return out.select("doc_id", "text_id", "paragraph", "first_word", n_words, "component_doc", "component_paragraph", "component_word", (~same).alias("removed"))


def without(text: str, lines: list[int] | None, runs: list | None) -> str:
    """``text`` without the lines and the runs (first word, number of words); a line of which no word is left goes too."""
    raw, gone = text.encode(), set(lines or ())
    covered = np.zeros(len(_WORD.findall(raw)) + 1, dtype=np.int64)
    for at, n in runs or ():
        covered[at] += 1
        covered[at + n] -= 1
    covered, at, out = np.cumsum(covered) > 0, 0, []
    for number, line in enumerate(raw.split(b"\n")):
        words = [m.start() for m in _WORD.finditer(line)]
        cut = covered[at : at + len(words)]
        at += len(words)
        if number in gone or (len(words) and cut.all()):
            continue
        if cut.any():
            words.append(len(line))
            line = (line[: words[0]] + b"".join(line[words[k] : words[k + 1]] for k in np.flatnonzero(~cut))).rstrip()
        out.append(line)
    return b"\n".join(out).decode()
