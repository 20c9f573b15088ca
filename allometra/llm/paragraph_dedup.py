"""Repeated paragraphs by MinHash banding, verified by exact Jaccard similarity, and passages repeated word for word.

Passages (``passages``) are found wherever lines break. Paragraphs are lines. Equal ones collapse into a class first. Bands of minimal hashes over word shingles make
similar classes collide; every collision that matters is verified on the exact sets, and the components of the
verified pairs say which paragraphs repeat. The first of each component stays, the others are removals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allometra.llm.common import materialise, packed
from allometra.llm.passages import repeated_passages, without
from allometra.llm.shingles import digest, mix, shingle_sets, word_hashes
from allometra.llm.similarity import PARITY, SIGNATURE, Bitmap, digest_place, digest_places, id_place, linked_components, meet

SHINGLE = 5
SIMILARITY = (8, 10)
RECALL = 0.99
#: Shorter lines (titles, list items, single sentences) are no paragraphs; a passage of 50 words may lie over many.
MIN_WORDS = 20
MAX_BANDS = 64


def tune_bands(similarity: float, recall: float = RECALL, most: int = MAX_BANDS) -> tuple[int, int]:
    """Bands and rows a band: as many rows as leave at most 8 bands needed for the recall at the similarity.

    A pair of similarity s collides with probability 1 - (1 - s**rows)**bands. More rows sift better, more bands cost more.
    """
    best = (most, 1)
    for rows in range(1, 9):
        bands = next((b for b in range(1, most + 1) if 1 - (1 - similarity**rows) ** b >= recall), None)
        if bands is not None and bands <= 8:
            best = (bands, rows)
    return best


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def band_keys(hashes: np.ndarray, begins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """For each set a row with one hash a band of the band's minima; permutations are odd multiplications and a shift-xor."""
    least = []
    for seed in _seeds(bands * rows):
        mixed = hashes * seed
        least.append(np.minimum.reduceat(mixed ^ (mixed >> np.uint64(32)), begins))
    least = np.stack(least).reshape(bands, rows, len(begins))
    out = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[:, None], len(begins), axis=1)
    for k in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
    return np.ascontiguousarray(out.T).view(np.int64)


class Paragraphs:
    """The lines with ``min_words`` or more words of some texts, and their shingle sets one after the other."""

    def __init__(self, texts: pa.Array, min_words: int, size: int):
        self.owners, self.numbers, sizes, words = [], [], [], []
        for i, text in enumerate(texts.cast(pa.binary())):
            for number, line in enumerate((text.as_py() or b"").split(b"\n")):
                own = word_hashes(line) if len(line) >= 2 * min_words - 1 else ()
                if len(own) >= min_words:
                    self.owners.append(i)
                    self.numbers.append(number)
                    sizes.append(len(own))
                    words.append(own)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.hashes, self.begins = shingle_sets(np.concatenate(words) if words else np.zeros(0, dtype=np.uint64), self.sizes, size)
        self.counts = np.diff(np.append(self.begins, len(self.hashes)))
        self.digests = [digest(s) for s in self.sets()]

    def sets(self) -> list[np.ndarray]:
        return [self.hashes[b : b + n] for b, n in zip(self.begins, self.counts, strict=True)]

    def bucket_counts(self, buckets: int, shift: int = 0) -> np.ndarray:
        owner = np.repeat(np.arange(len(self.counts)), self.counts)
        place = ((self.hashes >> np.uint64(shift)) & np.uint64(buckets - 1)).astype(np.int64)
        return np.bincount(owner * buckets + place, minlength=buckets * len(self.counts)).reshape(-1, buckets)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in parts whose arrays stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield batch.slice(at, 256)


def _signed(documents: DataFrame, min_words: int, size: int, bands: int, rows: int) -> DataFrame:
    own = documents.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _texts(batches):
            found = Paragraphs(batch.column("text"), min_words, size)
            if not found.numbers:
                continue
            signatures = np.minimum(found.bucket_counts(SIGNATURE), 255).astype(np.uint8)
            odd = np.packbits((found.bucket_counts(256, 8) & 1).astype(np.uint8), axis=1).view(np.int64)
            keys = band_keys(found.hashes, found.begins, bands, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(found.owners, pa.int32())),
                    pa.array(found.numbers, pa.int32()),
                    pa.array(found.sizes, pa.int32()),
                    pa.array(found.counts, pa.int64()),
                    pa.array(found.digests, pa.binary()),
                    pa.array([s.tobytes() for s in signatures], pa.binary()),
                    pa.array(list(keys), pa.list_(pa.int64())),
                    *(pa.array(np.ascontiguousarray(c)) for c in odd.T),
                ],
                ["doc_id", "paragraph", "n_words", "n", "set_digest", "sig", "keys", *PARITY],
            )

    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, paragraph int, n_words int, n long, set_digest binary, sig binary, keys array<long>, " + ", ".join(f"{s} long" for s in PARITY))


def repeated_paragraphs(
    documents: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, min_words: int = MIN_WORDS, recall: float = RECALL
) -> DataFrame:
    """Repeated lines, and repeated passages however they are wrapped: a row for each of both kinds.

    Rows of passages are those of ``repeated_passages``; first_word and component_word are null in rows of lines.
    """
    lines = _repeated_lines(documents, size, similarity, min_words, recall)
    names = [*lines.columns, "first_word", "component_word"]
    return lines.unionByName(repeated_passages(documents).select(*names), allowMissingColumns=True)


def _repeated_lines(documents: DataFrame, size: int, similarity: tuple[int, int], min_words: int, recall: float) -> DataFrame:
    """One row for each paragraph that has an equal or similar one: where it is, which group it is in and whether it goes.

    Returns doc_id, paragraph (line number from 0), n_words, component_doc and component_paragraph (the first
    paragraph, by doc_id and number, that links lead to) and removed (false just for that one). Links are pairs of
    sets of ``size``-word shingles with the given Jaccard similarity or more; equal sets always link, others are
    found with at least the given recall.

    Null and empty texts have no paragraphs. Whole texts are read. Repeated rows repeat their paragraphs; if they
    share a doc_id, equal paragraphs of theirs are told apart just by their rows, and all but the first id and number
    are removed. An empty table gives an empty result; other columns of the input are ignored.
    """
    num, den = similarity
    bands, rows = tune_bands(num / den, recall)
    signed = materialise(_signed(documents, min_words, size, bands, rows))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "paragraph")
    classes = signed.groupBy("set_digest").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("n", "sig", "keys", *PARITY)])
    classes = materialise(classes.withColumns({"id": F.monotonically_increasing_id(), "grp": F.lit(None).cast("binary"), "hub_rank": 127 - F.least("copies", F.lit(127))}))

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = meet(classes, ids, "id").select("id", "set_digest", F.col("place.doc_id").alias("first_id"))
        asked, needed = Bitmap(wanted.select(id_place("first_id"))), Bitmap(wanted.select(digest_place("set_digest")))
        texts = documents.select("text", id_place("doc_id"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _texts(batches):
                own = batch.filter(pa.array(asked.holds(batch.column("place").to_numpy())))
                found = Paragraphs(own.column("text"), min_words, size)
                if found.numbers:
                    taken = np.flatnonzero(needed.holds(digest_places(found.digests)))
                    sets = found.sets()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([found.digests[i] for i in taken], pa.binary()), pa.array([sets[i].tobytes() for i in taken], pa.binary())], ["set_digest", "grams"]
                    )

        found = texts.mapInArrow(run, "set_digest binary, grams binary")
        return meet(found, wanted.select("id", "set_digest"), "set_digest").groupBy("id").agg(F.first("grams").alias("grams"))

    labels = linked_components(classes, fetch, num, den, ordered=False, hold=materialise)
    named = classes.select("id", "set_digest", "place", "copies").join(labels, "id", "left").where("component IS NOT NULL OR copies > 1")
    named = named.withColumn("component", F.coalesce("component", "id"))
    least = materialise(named.groupBy("component").agg(F.min("place").alias("_first")))
    named = named.join(least, "component").select("set_digest", "_first")
    out = signed.select("doc_id", "paragraph", "n_words", "set_digest").join(named, "set_digest")
    first = F.col("doc_id").eqNullSafe(F.col("_first.doc_id")) & (F.col("paragraph") == F.col("_first.paragraph"))
    return out.select(
        "doc_id", "paragraph", "n_words", F.col("_first.doc_id").alias("component_doc"), F.col("_first.paragraph").alias("component_paragraph"), (~first).alias("removed")
    )


def remove_repeats(
    documents: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, min_words: int = MIN_WORDS, recall: float = RECALL
) -> DataFrame:
    """``documents`` with the removals cut out of their texts; all other columns and rows stay as they are.

    A null text stays null; a text of which nothing is left becomes empty. Repeated rows, or rows that share a doc_id,
    lose the same lines; an empty table gives an empty result. Other columns may have any names.
    """
    gone = _repeated_lines(documents, size, similarity, min_words, recall).where("removed").groupBy("doc_id").agg(F.collect_set("paragraph").alias("_lines"))
    gone = gone.select(F.col("doc_id").alias("_id"), "_lines")
    runs = repeated_passages(documents).where("removed").groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("first_word", "n_words")).alias("_runs"))
    runs = runs.select(F.col("doc_id").alias("_own"), F.col("text_id").alias("_text"), "_runs")
    rows = documents.select(packed(documents), "doc_id", "text")
    both = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    both = both.join(runs, F.col("doc_id").eqNullSafe(F.col("_own")) & (F.xxhash64("text") == F.col("_text")), "left")
    rest = F.udf(lambda text, lines, runs: None if text is None else without(text, lines, runs), "string")
    text = F.when(F.col("_lines").isNull() & F.col("_runs").isNull(), F.col("text")).otherwise(rest("text", "_lines", "_runs"))
    return both.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in documents.columns])
