"""Source divergence audit: how far the word use of each source lies from the other sources of its language.

Document frequencies go into merged count-min sketches first; terms that cannot reach ``least`` documents are discarded
before anything is shuffled. The others are counted exactly by language, source and term, and only those counts that
are not 0 are held. Sources are compared by a join on terms that both have; what a source lacks has one rate a source,
so sums over all terms follow from each source's own rates and the terms in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allometra.llm.common import materialise
from allometra.llm.sketch import Cells, Survivors, merge, width_for
from allometra.llm.tokens import Vocabulary, WordHashes, byte_table, raw_texts, stretches, tally

#: A term has to stand in so many documents of its language.
MIN_DOCUMENTS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Bytes of text for each cell of the sketch; the given tables have a new term every 300 bytes or so.
BYTES_PER_CELL = 64
#: Words whose postings are made at once, besides those of one text.
PART = 1 << 19

#: ASCII other than letters separates terms.
_TABLE = byte_table({bytes([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]): b" "})
_COUNTS = "lang string, source string, term string, n_docs long, n long"
_COUNTS_ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n_docs", pa.int64()), ("n", pa.int64())])


def _postings(texts: list[bytes], vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text number, word number and count of the distinct words of each text, for some whole texts at a time."""
    codes, counts, waiting, size, began = [], [], [], 0, 0

    def squeeze() -> None:
        code, n = tally(np.concatenate([np.zeros(0, dtype=np.int64), *waiting]))
        codes.append(code)
        counts.append(n)
        waiting.clear()

    for k, raw in enumerate(texts):
        for piece in stretches(raw.translate(_TABLE)):
            waiting.append(vocabulary.ids(piece.split()).astype(np.int64) | k << 32)
            size += len(waiting[-1])
            if size - began > PART:
                squeeze()
                began = size
        if size > PART or k == len(texts) - 1:
            squeeze()
            code, n = tally(np.concatenate(codes), np.concatenate(counts)) if len(codes) > 1 else (codes[0], counts[0])
            yield code >> 32, code & 0xFFFFFFFF, n
            codes, counts, size, began = [], [], 0, 0


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str], list[bytes]]]:
    """Each language of a batch with the sources and bytes of its texts."""
    groups: dict[str, tuple[list[str], list[bytes]]] = {}
    for lang, source, raw in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), raw_texts(batch.column("text"))):
        sources, texts = groups.setdefault(lang, ([], []))
        sources.append(source)
        texts.append(raw)
    for lang, (sources, texts) in groups.items():
        yield lang, sources, texts


def _sketched(rows: DataFrame, width: int, least: int) -> DataFrame:
    """Each task's sketch of document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(width, least)
        for batch in batches:
            for lang, _, texts in _by_language(batch):
                vocabulary, hashes = Vocabulary(), WordHashes(lang)
                for _, word, _ in _postings(texts, vocabulary):
                    cells.add(hashes.of(vocabulary)[word])
        yield from cells.batches()

    return rows.mapInArrow(run, "block int, cells binary")


def _counted(rows: DataFrame, survivors: Survivors) -> DataFrame:
    """Documents and occurrences of the surviving terms by language and source, added up a batch."""
    shared = rows.sparkSession.sparkContext.broadcast(survivors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, sources, texts in _by_language(batch):
                vocabulary, source_ids, hashes, parts = Vocabulary(), Vocabulary(), WordHashes(lang), []
                own = source_ids.ids(sources).astype(np.int64)
                for text, word, n in _postings(texts, vocabulary):
                    kept = shared.value.may(hashes.of(vocabulary))[word]
                    code = own[text[kept]] << 32 | word[kept]
                    parts.append((*tally(code), tally(code, n[kept])[1]))
                code, docs_in, times = (np.concatenate(c) for c in zip(*parts))
                (keys, n_docs), (_, total) = tally(code, docs_in), tally(code, times)
                words, names = list(vocabulary), list(source_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(keys), pa.string()),
                        pa.array(names, pa.string()).take(pa.array(keys >> 32)) if names else pa.array([], pa.string()),
                        pa.array([words[k].decode("utf-8") for k in (keys & 0xFFFFFFFF).tolist()], pa.string()),
                        pa.array(n_docs, pa.int64()),
                        pa.array(total, pa.int64()),
                    ],
                    schema=_COUNTS_ARROW,
                )

    return rows.mapInArrow(run, _COUNTS)


def _rate(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), without rounding at any size."""
    above = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", above, (total + terms).cast("decimal(20,0)")) + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(documents: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, source, term, n, total (of the language), first (in one row of each term) of terms in at least ``least`` documents of their language."""
    rows = documents.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text").where("text IS NOT NULL")
    width = width_for(rows, BYTES_PER_CELL)
    survivors = merge(_sketched(rows, width, least), width, least)
    counts = _counted(rows, survivors).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))
    term = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"in_docs": F.sum("n_docs").over(term), "total": F.sum("n").over(term), "first": (F.min("source").over(term) == F.col("source")).cast("long")})
    return counts.where(F.col("in_docs") >= least).select("lang", "source", "term", "n", "total", "first")


def audit(documents: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank of every group of language and source.

    With p of a group and q of what it is compared with, in billionths and smoothed by one occurrence a term, a term's
    value is floor((p - q)^2 / q). Part ``pair``: each other source of the language, values summed over all kept terms.
    Part ``term``: the ``top`` terms that the group has and uses more than its language does.

    Null text, lang and source count as ''. A group without terms still has its pairs; a language without kept terms has
    pairs of value 0; a source alone in its language has none. Each row counts as a document, repeated or not. An empty
    table gives an empty result; other columns are ignored. Pairs are as many as the result has, sources squared by language.
    """
    counts = materialise(term_counts(documents, least))
    groups = documents.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("has"), F.sum("first").alias("firsts"))
    groups = groups.join(own, ["lang", "source"], "left").fillna(0, ["size", "has", "firsts"])
    of_lang = groups.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.sum("firsts").alias("terms"))
    groups = groups.join(of_lang, "lang").drop("firsts")
    groups = groups.withColumn("base", F.when(F.col("terms") > 0, _rate(F.lit(0), F.col("size"), F.greatest("terms", F.lit(1)))).otherwise(1))
    groups = materialise(groups)

    rated = counts.join(groups, ["lang", "source"]).withColumn("p", _rate(F.col("n"), F.col("size"), F.col("terms")))
    named = rated.withColumn("q", _rate(F.col("total"), F.col("lang_size"), F.col("terms"))).where("p > q")
    named = named.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value"))

    left, right = (rated.select("lang", "term", *[F.col(c).alias(f"{c}_{side}") for c in ("source", "p", "base")]) for side in "ab")
    both = left.join(right, ["lang", "term"]).where("source_a < source_b")
    pa_, pb, a0, b0 = (F.col(c) for c in ("p_a", "p_b", "base_a", "base_b"))
    both = both.groupBy("lang", "source_a", "source_b").agg(
        F.sum(_gap(pa_, pb) - _gap(pa_, b0) - _gap(a0, pb) + _gap(a0, b0)).alias("ab"),
        F.sum(_gap(pb, pa_) - _gap(pb, a0) - _gap(b0, pa_) + _gap(b0, a0)).alias("ba"),
    )
    both = both.select("lang", F.stack(F.lit(2), "source_a", "source_b", "ab", "source_b", "source_a", "ba").alias("source", "item", "common"))

    # What one source has against the other's rate of absent terms, equal rates at once.
    alike = rated.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("q"))
    alone = alike.join(others, "lang").where("source <> item").groupBy("lang", "source", "item")
    alone = alone.agg(F.sum(F.col("m") * _gap(F.col("p"), F.col("q"))).alias("here"), F.sum(F.col("m") * _gap(F.col("q"), F.col("p"))).alias("there"))

    ends = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("item_base"), F.col("has").alias("item_has"))
    pairs = groups.join(ends, "lang").where("source <> item")
    pairs = pairs.join(both, ["lang", "source", "item"], "left").join(alone.drop("there"), ["lang", "source", "item"], "left")
    back = alone.select("lang", F.col("source").alias("item"), F.col("item").alias("source"), "there")
    pairs = pairs.join(back, ["lang", "source", "item"], "left")
    neither = (F.col("terms") - F.col("has") - F.col("item_has")) * _gap(F.col("base"), F.col("item_base"))
    value = neither + sum(F.coalesce(c, F.lit(0)) for c in ("common", "here", "there"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    named = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return named.unionByName(pairs.withColumn("rank", F.row_number().over(order)))
