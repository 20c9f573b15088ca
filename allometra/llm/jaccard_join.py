"""Near-duplicate documents by a grouped prefix join on word shingles.

Shingles are ordered by how common they are, rare ones first, and two sets that reach the similarity share a
shingle in their prefixes. Documents with equal shingle sets collapse into one; of those with equal prefixes and
sizes one leader goes into the join, and groups are expanded for verification.

How common a shingle is comes from counts over all documents in a table of fixed size; any order is right, a
good one makes prefixes selective. Three passes over the texts hold less than one pass that keeps every set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allometra.llm.common import materialise, packed
from allometra.llm.shingles import digest, shingle_set, word_hashes
from allometra.llm.similarity import PARITY, Bitmap, id_place, linked_components, meet, parity, signature

SHINGLE = 5
SIMILARITY = (8, 10)
#: The table of counts has 2**COUNT_BITS places, 16 MB as a broadcast, for any corpus.
COUNT_BITS = 24
#: A task counts no further in a place: between batches, so that two bytes hold what a batch adds.
_MOST = 32767
_BLOCK_BITS = 14
#: Most ids that go to the executors as a broadcast, at 24 bytes each with the hash of the text.
BROADCAST_IDS = 500_000


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[np.ndarray]:
    for text in batch.column("text").cast(pa.binary()):
        yield shingle_set(word_hashes(text.as_py() or b""), size)


def commonness(documents: DataFrame, size: int, bits: int = COUNT_BITS) -> np.ndarray:
    """For each bucket of shingle hashes, the logarithm of how many documents' shingles fall in it: 2**bits bytes.

    Tasks send blocks of counts, sparse or dense, whichever is shorter; the blocks are summed where they meet.
    """
    width = 1 << _BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, dtype="<u2")
        for batch in batches:
            for hashes in _sets(batch, size):
                np.add.at(counts, (hashes >> np.uint64(64 - bits)).astype(np.int64), np.uint16(1))
            np.minimum(counts, _MOST, out=counts)
        blocks, places, values = [], [], []
        for k, block in enumerate(counts.reshape(-1, width)):
            used = np.flatnonzero(block).astype("<u2")
            if len(used):
                sparse = 4 * len(used) < 2 * width
                blocks.append(k)
                places.append(used.tobytes() if sparse else None)
                values.append((block[used] if sparse else block).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["block", "places", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, places, values in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = sums.setdefault(k, np.zeros(width, dtype=np.int64))
                values = np.frombuffer(values, dtype="<u2")
                if places is None:
                    own += values
                else:
                    own[np.frombuffer(places, dtype="<u2")] += values
        levels = [np.ceil(np.log2(own + 1)).astype(np.uint8).tobytes() for own in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array(levels, pa.binary())], ["block", "levels"])

    parts = documents.select("text").mapInArrow(count, "block int, places binary, counts binary")
    out = np.zeros((1 << (bits - _BLOCK_BITS), width), dtype=np.uint8)
    for row in parts.repartition("block").mapInArrow(add, "block int, levels binary").collect():
        out[row.block] = np.frombuffer(row.levels, dtype=np.uint8)
    return out.ravel()


def prefix_size(n: int, num: int, den: int) -> int:
    """Elements of a set of ``n`` among which any set similar enough and no larger shares one."""
    return n - -(-num * n // den) + 1


def signed(documents: DataFrame, size: int, num: int, den: int, levels: np.ndarray) -> DataFrame:
    """n, set_digest, sig, grp (digest of the prefix), keys (the prefix) and parity bits of every row, after all columns but text."""
    held = documents.sparkSession.sparkContext.broadcast(levels)
    bits = len(levels).bit_length() - 1
    own = [c for c in documents.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for hashes in _sets(batch, size):
                level = held.value[(hashes >> np.uint64(64 - bits)).astype(np.int64)]
                prefix = hashes[np.argsort(level, kind="stable")[: prefix_size(len(hashes), num, den)]] if len(hashes) else hashes
                rows.append((len(hashes), digest(hashes), signature(hashes), digest(prefix), prefix.view(np.int64), *parity(hashes).tolist()))
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * len(PARITY))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 9, kinds, strict=True))],
                [*own, "n", "set_digest", "sig", "grp", "keys", *PARITY],
            )

    kinds = dict(documents.dtypes)
    return documents.mapInArrow(run, "".join(f"{c} {kinds[c]}, " for c in own) + "n long, set_digest binary, sig binary, grp binary, keys array<long>, " + ", ".join(f"{s} long" for s in PARITY))


def _linked(documents: DataFrame, size: int, similarity: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """The signed rows; and id, set_digest, first_id and component of every class of equal sets."""
    num, den = similarity
    rows = materialise(signed(documents, size, num, den, commonness(documents, size)))
    classes = rows.where("n > 0").groupBy("set_digest").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("n", "sig", "grp", "keys", *PARITY)])
    classes = materialise(classes.withColumns({"id": F.monotonically_increasing_id(), "hub_rank": F.lit(0)}))

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = meet(classes.select("id", "first_id", "set_digest"), ids, "id")
        asked = Bitmap(wanted.select(id_place("first_id")))
        texts = documents.select("text", id_place("doc_id"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets = list(_sets(batch.filter(pa.array(asked.holds(batch.column("place").to_numpy()))), size))
                yield pa.RecordBatch.from_arrays([pa.array(map(digest, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["set_digest", "grams"])

        found = texts.mapInArrow(run, "set_digest binary, grams binary")
        return meet(found, wanted.select("id", "set_digest"), "set_digest").groupBy("id").agg(F.first("grams").alias("grams"))

    labels = linked_components(classes, fetch, num, den, ordered=True, hold=materialise)
    named = meet(classes.select("id", "set_digest", "first_id"), labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return rows, named


def duplicate_components(documents: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id that links lead to, itself included) of every row.

    Two rows link when the Jaccard similarity of their sets of ``size``-word shingles is ``similarity`` (a fraction)
    or more. A text with fewer words is one shingle. Null, empty and blank texts have no shingle, link with nothing
    and are their own component. Rows with one doc_id and different texts each have their own links. A null doc_id
    takes part; it is the component only where no other id is. An empty table gives an empty result; other columns
    of the input are ignored. Whole texts are read.
    """
    rows, named = _linked(documents.select("doc_id", "text"), size, similarity)
    # Held, so that the joins read plain tables, whose large keys Spark can split.
    least = materialise(named.groupBy("component").agg(F.min("first_id").alias("component_id")))
    named = materialise(meet(named, least, "component").select("set_digest", "component_id"))
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "set_digest")
    some = meet(out.where("n_shingles > 0"), named, "set_digest").select("doc_id", "n_shingles", "component_id")
    # Rows without a shingle all have one digest and link with nothing: they stay out of the join.
    return some.unionByName(out.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def keep_first(documents: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row of ``documents`` of each component, with its columns as they came; all rows without a shingle stay.

    That is the row with the least doc_id, a null one last; among rows of one doc_id the set and then the text decide.
    Of rows with equal doc_id and text one stays; without a shingle, only if the doc_id is not null.
    """
    text_id = F.xxhash64("text").alias("_text_id")
    rows, named = _linked(documents.select("doc_id", text_id, "text"), size, similarity)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "set_digest", "_text_id")
    some = rows.where("n > 0")
    first = some.groupBy("set_digest").agg(F.min(place).alias("_place"))
    first = meet(first, named.select("set_digest", "component"), "set_digest")
    first = first.groupBy("component").agg(F.min("_place").alias("_place")).select(F.col("_place.doc_id").alias("_doc"), F.col("_place._text_id").alias("_text"))
    own = lambda a, b: F.col("doc_id").eqNullSafe(F.col(a)) & (F.col("_text_id") == F.col(b))
    going = some.select("doc_id", "_text_id").distinct().join(first, own("_doc", "_text"), "left_anti")
    going = materialise(going.select(F.col("doc_id").alias("_gone"), F.col("_text_id").alias("_gone_text")))
    twice = rows.where("n > 0 OR doc_id IS NOT NULL").groupBy("doc_id", "_text_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    twice = twice.join(going, own("_gone", "_gone_text"), "left_anti")
    twice = materialise(twice.select(F.col("doc_id").alias("_twice"), F.col("_text_id").alias("_twice_text")))
    # Ids are longs, so that a broadcast of the least number stays small; beyond it, texts are shuffled once.
    on = lambda ids: F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    kept = documents.select(packed(documents), "doc_id", text_id).join(on(going), own("_gone", "_gone_text"), "left_anti")
    if not twice.isEmpty():
        once = kept.join(on(twice), own("_twice", "_twice_text"), "left_anti")
        again = kept.join(on(twice), own("_twice", "_twice_text"), "left_semi")
        kept = once.unionByName(again.withColumn("text", F.col("_row.text")).dropDuplicates(["doc_id", "text"]).drop("text"))
    return kept.select("_row.*")
