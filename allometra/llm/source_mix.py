"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents are shuffled and laid end to end as a line of words, cut into blocks of equal
length. Golden-ratio points, mapped through the cumulative shares of the sources, say which source gives
the next block; the n-th slot of a source takes its n-th block, starting over after the last one. The
schedule closes with the few slots that the points still owe a source, and the last slot of a source is
trimmed where its target ends. Slots and blocks then meet in a join: what a document gives to the mix and
where its copies stand in it comes from the slots of its blocks.

Shuffle keys are uniform hashes, so ranges of them hold about as many rows of a source each. A running total is
one window in such a range and one over the sums of the ranges; ranks of slots go the same way by stretches of slots.
"""

from __future__ import annotations

from decimal import Decimal, getcontext

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from allometra.llm.common import WORD_PATTERN, materialise, packed

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
BLOCK_WORDS = 2048
SEED = 17

#: Slots whose ranks one window numbers; buckets of u that a slot is matched in; rows of a range of shuffle keys.
SLOT_CHUNK = 1 << 16
POINT_BUCKETS = 4096
ROWS_PER_RANGE = 1 << 10
#: Equal rows that one row stands for are dealt out in such lots.
COPIES_PER_LOT = 4096

_SOURCE = ("_no_source", "_source")
_BEFORE = (Window.unboundedPreceding, -1)


def golden(power: int) -> float:
    """The fraction of 2**power times the golden ratio's fraction, without loss."""
    getcontext().prec = 60
    return float((Decimal(5).sqrt() - 1) / 2 * 2**power % 1)


def _n_words():
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("long")


def sized(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source parts, size in words and the shuffle key of each row."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return documents.select(
        "doc_id", F.col("source").isNull().alias("_no_source"), F.coalesce("source", F.lit("")).alias("_source"), _n_words().alias("size"), key.alias("_key")
    )


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row a source: source_size, target, and how its slots divide.

    Shares go by weight; no target exceeds ``max_epochs`` times its source, and what is cut off goes to the others
    by weight again. In order of capacity for its weight, a source is full as long as the level (words per weight)
    of those not yet full covers it; the first level that does not is final.
    The windows here run over one row per source.
    """
    everything = Window.partitionBy()
    name = Window.orderBy(*_SOURCE)
    by_ratio = Window.orderBy("_ratio", *_SOURCE)
    before = by_ratio.rowsBetween(*_BEFORE)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    df = sizes.groupBy(*_SOURCE).agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(name) - 1) % len(weights) + 1)
    df = df.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * max_epochs)
    df = df.withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    df = df.withColumn("_level", left / F.sum("_weight").over(rest))
    df = df.withColumn("_final", F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(everything))
    df = df.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_weight") * F.coalesce("_final", F.lit(0.0))))
    return df.select(*_SOURCE, "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("quota"))


def _with_slots(sources: DataFrame, block: int) -> DataFrame:
    """Blocks a pass over the source has, whole passes, words of the last pass, slots in all, and the source's range of u."""
    size, quota = F.col("source_size"), F.col("quota")
    up = lambda x: F.floor((x + block - 1) / block).cast("long")
    passes = F.when(size > 0, F.expr("quota div source_size")).otherwise(0).cast("long")
    df = sources.withColumns({"_blocks": up(size), "_passes": passes})
    df = df.withColumn("_rest", quota - F.col("_passes") * size)
    df = df.withColumn("_slots", F.col("_passes") * F.col("_blocks") + up(F.col("_rest")))
    order = Window.orderBy(*_SOURCE)
    so_far = F.sum("_slots").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("_hi", so_far / F.greatest(F.sum("_slots").over(Window.partitionBy()), F.lit(1)))
    return df.withColumn("_lo", F.coalesce(F.lag("_hi").over(order), F.lit(0.0))).where("_slots > 0")


def schedule(sources: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """One row a slot: slot, source, rank of the slot in its source, block and the words [begin, end) of the source's line."""
    shares = materialise(_with_slots(sources, block))
    total = int(shares.agg(F.sum("_slots")).first()[0] or 0)
    high, low = F.expr("id div 1048576"), F.expr("id % 1048576")
    point = F.pmod(high * F.lit(golden(20)) + (low + 0.5) * F.lit(golden(0)), F.lit(1.0))
    points = sources.sparkSession.range(total).select(F.col("id").alias("slot"), point.alias("_u"))
    points = points.withColumn("_bucket", F.floor(F.col("_u") * POINT_BUCKETS).cast("int"))
    spans = F.sequence(F.floor(F.col("_lo") * POINT_BUCKETS).cast("int"), F.floor(F.col("_hi") * POINT_BUCKETS).cast("int"))
    ranges = shares.select(*_SOURCE, "_lo", "_hi", F.explode(spans).alias("_bucket"))
    drawn = points.join(ranges, "_bucket").where("_lo <= _u AND _u < _hi").select("slot", *_SOURCE, F.expr(f"slot div {SLOT_CHUNK}").alias("_chunk"))

    chunks = drawn.groupBy(*_SOURCE, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*_SOURCE)
    chunks = materialise(chunks.select(*_SOURCE, "_chunk", F.coalesce(F.sum("_n").over(own.orderBy("_chunk").rowsBetween(*_BEFORE)), F.lit(0)).alias("_first"), F.sum("_n").over(own).alias("_had")))
    inside = F.row_number().over(Window.partitionBy(*_SOURCE, "_chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("_in", inside).join(chunks, [*_SOURCE, "_chunk"])
    ranked = ranked.select("slot", *_SOURCE, (F.col("_first") + F.col("_in")).alias("rank"))

    owed = shares.join(chunks.select(*_SOURCE, "_had").distinct(), list(_SOURCE), "left").where("coalesce(_had, 0) < _slots")
    owed = owed.select(*_SOURCE, F.explode(F.expr("sequence(coalesce(_had, 0L), _slots - 1)")).alias("rank"))
    owed = owed.select((F.lit(total) + F.col("rank")).alias("slot"), *_SOURCE, "rank")

    slots = ranked.unionByName(owed).join(shares.drop("_lo", "_hi", "target"), list(_SOURCE)).where("rank < _slots")
    slots = slots.withColumns({"block": F.expr("rank % _blocks"), "_pass": F.expr("rank div _blocks")})
    end = F.least((F.col("block") + 1) * block, F.when(F.col("_pass") < F.col("_passes"), F.col("source_size")).otherwise(F.col("_rest")))
    return slots.select("slot", *_SOURCE, "rank", "block", (F.col("block") * block).alias("begin"), end.alias("end"))


def lines(rows: DataFrame) -> DataFrame:
    """Each row of ``sized`` with words and ``begin``, its first word on the line of its source; equal rows follow each other.

    Equal rows are counted first, so that however many share a key they are one row of a window.
    """
    n_ranges = max(1, rows.count() // ROWS_PER_RANGE)
    at = F.expr(f"(cast(conv(substring(_key, 1, 8), 16, 10) as bigint) * {n_ranges}) div 4294967296").alias("_range")
    once = rows.where("size > 0").groupBy("doc_id", *_SOURCE, "size", "_key").agg(F.count(F.lit(1)).alias("_copies")).select("*", at)
    words = F.col("size") * F.col("_copies")
    inner = Window.partitionBy(*_SOURCE, "_range").orderBy("_key", "size").rowsBetween(*_BEFORE)
    placed = once.withColumn("_inside", F.coalesce(F.sum(words).over(inner), F.lit(0)))
    sums = once.groupBy(*_SOURCE, "_range").agg(F.sum(words).alias("_sum"))
    ranges = Window.partitionBy(*_SOURCE).orderBy("_range").rowsBetween(*_BEFORE)
    sums = sums.select(*_SOURCE, "_range", F.coalesce(F.sum("_sum").over(ranges), F.lit(0)).alias("_offset"))
    placed = placed.join(sums, [*_SOURCE, "_range"]).select("doc_id", *_SOURCE, "size", "_copies", (F.col("_offset") + F.col("_inside")).alias("begin"))
    placed = materialise(placed)
    # Rows that stand for many are dealt to all tasks before they become many.
    lots = placed.where("_copies > 1").withColumn("_lot", F.explode(F.expr(f"sequence(0L, (_copies - 1) div {COPIES_PER_LOT})"))).repartition("begin", "_lot")
    nth = F.explode(F.expr(f"sequence(_lot * {COPIES_PER_LOT}, least(_copies, (_lot + 1) * {COPIES_PER_LOT}) - 1)"))
    many = lots.select("doc_id", *_SOURCE, "size", "begin", nth.alias("_nth")).select("doc_id", *_SOURCE, "size", (F.col("begin") + F.col("_nth") * F.col("size")).alias("begin"))
    return placed.where("_copies = 1").drop("_copies").unionByName(many)


def _mixed(documents: DataFrame, weights, max_epochs: int, block: int, seed: int) -> DataFrame:
    """The rows of ``mix`` and starts: the slots, in order, in which copies of the row begin, one for each pass at most."""
    rows = materialise(sized(documents, seed))
    sources = materialise(targets(rows, weights, max_epochs))
    first, last = F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}")
    parts = lines(rows).select("doc_id", *_SOURCE, "size", F.col("begin").alias("_at"), F.explode(F.sequence(first, last)).alias("block"))
    met = parts.join(schedule(sources, block), [*_SOURCE, "block"], "left")
    words = F.greatest(F.lit(0), F.least("end", F.col("_at") + F.col("size")) - F.greatest("begin", "_at"))
    met = met.withColumn("_words", F.when(F.col("slot").isNotNull(), words).otherwise(0))
    begins = F.when((F.col("_words") > 0) & (F.col("begin") <= F.col("_at")), F.col("slot"))
    # A document's first block has max_epochs + 1 slots at most.
    taken = met.groupBy("doc_id", *_SOURCE, "size", "_at").agg(F.sum("_words").cast("long").alias("taken"), F.sort_array(F.collect_list(begins)).alias("starts"))
    none = rows.where("size = 0").select("doc_id", *_SOURCE, "size", F.lit(0).cast("long").alias("taken"), F.array().cast("array<long>").alias("starts"))
    out = taken.drop("_at").unionByName(none).join(sources, list(_SOURCE))
    source = F.when(~F.col("_no_source"), F.col("_source")).alias("source")
    return out.select("doc_id", source, "size", "source_size", "target", "taken", "starts")


def mix(documents: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, taken (words, repeats counted), first_slot.

    first_slot is the slot of the schedule in which the document's first copy begins, null if none does. A null text
    has size 0; a document of size 0 is never taken. Null sources form one source, ordered last.
    The order within a source goes by the digest of seed and doc_id, so reruns agree; rows that share a doc_id
    go by size. Repeated rows count as often as they stand. An empty table gives an empty result. Other columns
    of the input are ignored.
    """
    return _mixed(documents, weights, max_epochs, block, seed).withColumn("first_slot", F.get("starts", F.lit(0))).drop("starts")


def take(documents: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, block: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The mixed corpus: the columns of ``documents``, each row as often as the mix takes it, in the order of the schedule.

    A copy stands at the slot in which it begins: partitions are ranges of slots, in order. Where the mix ends inside a
    document, the last copy holds just the words taken, joined by single spaces (and ``n_chars``, if there is one, their
    length). Rows alike in doc_id, source and size share their words evenly and their slots. A null doc_id or source
    matches itself; rows of size 0 are never taken; an empty table gives an empty result.
    """
    shares = _mixed(documents, weights, max_epochs, block, seed).where("taken > 0").groupBy("doc_id", "source", "size")
    shares = shares.agg(F.expr("sum(taken) div count(1)").alias("_taken"), F.min("starts").alias("_starts"))
    left = documents.select(packed(documents), "doc_id", "source", _n_words().alias("_size")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d._size") == F.col("s.size")) & F.col("d.source").eqNullSafe(F.col("s.source"))
    both = left.join(shares.alias("s"), same)
    whole = F.expr("s._taken div d._size")
    copies = both.select("d._row", "d.doc_id", (F.col("s._taken") - whole * F.col("d._size")).alias("_part"), F.explode(F.sequence(F.lit(0).cast("long"), whole)).alias("_copy"), whole.alias("_whole"), "s._starts")
    copies = copies.where("_copy < _whole OR _part > 0")
    last = F.element_at("_starts", -1)
    copies = copies.withColumn("_slot", F.coalesce(F.get("_starts", F.col("_copy").cast("int")), last)).drop("_starts")
    entire, own = F.col("_copy") < F.col("_whole"), F.col("_row.text")
    first = F.array_join(F.slice(F.regexp_extract_all(own, F.lit(WORD_PATTERN), F.lit(0)), 1, F.col("_part").cast("int")), " ")
    text = F.when(entire, own).otherwise(first)
    changed = {"text": text}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(entire, F.col("_row.n_chars")).otherwise(F.length(text)).cast(documents.schema["n_chars"].dataType)
    ordered = copies.repartitionByRange("_slot", "doc_id").sortWithinPartitions("_slot", "doc_id")
    return ordered.select(*[changed.get(c, F.col("_row")[c]).alias(c) for c in documents.columns])
