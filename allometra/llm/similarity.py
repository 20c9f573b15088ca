"""Similarity links among many items without all pairs of a group: hubs, components, then what is left.

Items that share a key are candidates. Emitting every pair of a large group would grow with its square, and what
is wanted are the groups that links connect. So every item is first compared with its key's hub (one of the key's
items), which is linear. Links found that way connect most of what belongs together. Then only pairs of items
that are still in different components are compared, which loses no link between two components.

A count signature rules out most candidates before any set of shingles is moved; the rest is verified exactly.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allometra.llm.common import cut

#: How an intermediate result is written to the shared folder, where it no longer depends on executors.
Hold = Callable[[DataFrame], DataFrame]

SIGNATURE = 64
#: Long columns of parity bits.
PARITY = ("s0", "s1", "s2", "s3")
#: A bitmap of 2 MB.
FILTER_BITS = 24


def least_overlap(sizes: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least intersection at which two sets with ``sizes`` elements in all have Jaccard similarity num / den or more."""
    return -(-num * sizes // (num + den))


def signature(hashes: np.ndarray) -> bytes:
    """How many elements fall in each of ``SIGNATURE`` buckets, at most 255; differences bound the set difference from below."""
    counts = np.bincount((hashes & np.uint64(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def parity(hashes: np.ndarray) -> np.ndarray:
    """Whether the number of elements in each of 256 buckets is odd, as four longs: each differing element flips one bit."""
    counts = np.bincount(((hashes >> np.uint64(8)) & np.uint64(255)).astype(np.int64), minlength=256)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that shuffles both sides, whatever Spark takes them for: what is exploded, or encoded well, is many times what Spark
    reckons, and as a broadcast it would lie whole on the driver."""
    return left.join(right.hint("merge"), on, how)


def components(edges: DataFrame, hold: Hold = cut) -> DataFrame:
    """id and component (its least id) of every end of the undirected ``edges`` (a, b).

    Each round hooks every node to its least neighbour, follows these pointers to their roots and contracts the
    edges, which leaves at most half of the nodes that still have an edge.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = hold(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        parents = hold(both(edges).groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("parent")))
        moved = True
        while moved:
            up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("_up"))
            parents = hold(meet(parents, up, "parent").select("id", F.col("_up").alias("parent"), (F.col("_up") != F.col("parent")).alias("_moved")))
            moved = not parents.where("_moved").isEmpty()
            parents = parents.select("id", "parent")
        if labels is None:
            labels = parents.withColumnRenamed("parent", "component")
        else:
            to = parents.select(F.col("id").alias("component"), "parent")
            labels = hold(meet(labels, to, "component", "left").select("id", F.coalesce("parent", "component").alias("component")))
        a = parents.select(F.col("id").alias("a"), F.col("parent").alias("_a"))
        b = parents.select(F.col("id").alias("b"), F.col("parent").alias("_b"))
        edges = meet(meet(edges, a, "a"), b, "b").where("_a <> _b")
        edges = hold(edges.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    return labels if labels is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("component"))


class Bitmap:
    """Which of 2**filter_bits places are taken: what it lets through besides what was asked for is dropped by a later join.

    Its size is the same for any number of ids. ``places`` has the one column ``place``.
    """

    def __init__(self, places: DataFrame, filter_bits: int = FILTER_BITS):
        bits = places.select(F.expr("shiftright(place, 6)").alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
        words = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        taken = np.zeros(1 << (filter_bits - 6), dtype=np.int64)
        taken[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        self.held = places.sparkSession.sparkContext.broadcast(taken)

    def holds(self, places: np.ndarray) -> np.ndarray:
        return (self.held.value[places >> 6] >> (places & 63)) & 1 == 1


def id_place(value: str) -> Column:
    return F.xxhash64(value).bitwiseAND((1 << FILTER_BITS) - 1).alias("place")


def digest_place(value: str) -> Column:
    return F.conv(F.hex(F.substring(value, 1, 4)), 16, 10).cast("long").bitwiseAND((1 << FILTER_BITS) - 1).alias("place")


def digest_places(digests: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(d[:4]) for d in digests], dtype=np.int64) & ((1 << FILTER_BITS) - 1)


def _similar_signatures(pairs: DataFrame, items: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs that sizes and signatures do not rule out."""
    left = items.select(F.col("id").alias("a"), F.col("n").alias("_n"), F.col("sig").alias("_sig"))
    right = items.select(F.col("id").alias("b"), F.col("n").alias("_m"), F.col("sig").alias("_gis"))
    sizes = F.least("_n", "_m") * den >= F.greatest("_n", "_m") * num
    both = meet(meet(pairs, left, "a"), right, "b").where(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, SIGNATURE).astype(np.int16)  # noqa: B023, E731
            apart = np.abs(read("_sig") - read("_gis")).sum(axis=1, dtype=np.int64)
            total = batch.column("_n").to_numpy().astype(np.int64) + batch.column("_m").to_numpy()
            yield batch.filter(pa.array(total - apart >= 2 * least_overlap(total, num, den))).select(["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, items: DataFrame, fetch: Callable[[DataFrame], DataFrame], num: int, den: int, hold: Hold = cut) -> DataFrame:
    """The pairs (a, b) whose sets have Jaccard similarity num / den or more. ``fetch`` gives (id, grams) of the ids asked for."""
    pairs = hold(_similar_signatures(pairs, items, num, den))
    asked = hold(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
    # Held, so that the joins read a plain table and Spark can split a large hub.
    sets = hold(fetch(asked))
    both = meet(pairs, sets.select(F.col("id").alias("a"), F.col("grams").alias("_a")), "a")
    both = meet(both, sets.select(F.col("id").alias("b"), F.col("grams").alias("_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("_a"), batch.column("_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common * (num + den) >= num * (len(x) + len(y)))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def linked_components(items: DataFrame, fetch: Callable[[DataFrame], DataFrame], num: int, den: int, ordered: bool, hold: Hold = cut) -> DataFrame:
    """id and component of every item with a link; links are pairs that share a key and reach similarity num / den.

    ``items``: id, n (size of its set), sig and s0 to s3 (its signature and parity bits), grp (items of one group
    stand for each other as candidates; null: alone), keys (array of long) and hub_rank (0 to 127, low for good hubs).
    It should be written before, as it is read often. ``hold`` writes the intermediate results: checkpoints by default; Parquet
    (``materialise``) makes fewer tasks of many small ones. ``ordered`` says that keys are the items' prefixes in one common
    order, which allows filters by place and makes the item with the earliest place of a key its hub.

    Groups: one member, the leader, carries the group's keys. Members are candidates of their own leader, leaders
    of their key's hub; in the second round pairs of groups are expanded to pairs of members.
    """
    grouped = items.where("grp IS NOT NULL").groupBy("grp", "n").agg(F.min("id").alias("gid"), F.count(F.lit(1)).alias("gsize"))
    members = meet(items.select("id", "grp", "n"), grouped.where("gsize > 1"), ["grp", "n"])
    members = hold(members.select("id", "gid", "gsize"))
    # Only the ids, written as they are, can become a broadcast here, so Spark may choose; else items and their keys are shuffled.
    leaders = items.join(members.where("id <> gid").select("id"), "id", "left_anti")
    postings = leaders.select("id", "hub_rank", F.posexplode("keys").alias("pos", "key"))
    rank = F.least("pos", F.lit(127)) if ordered else F.col("hub_rank")
    code = F.shiftleft(rank.cast("long"), 56).bitwiseOR(F.col("id"))
    hubs = postings.groupBy("key").agg(F.min(code).alias("_code"), F.count(F.lit(1)).alias("_count")).where("_count > 1")
    hubs = hubs.select("key", F.col("_code").bitwiseAND((1 << 56) - 1).alias("hub"), "_count")
    shared = hold(meet(postings.select("key", "id", "pos"), hubs, "key"))
    pairs = shared.where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    pairs = hold(pairs.union(members.where("id <> gid").select(F.col("id").alias("a"), F.col("gid").alias("b"))).distinct())
    first = hold(verify(pairs, items, fetch, num, den, hold))
    labels = components(first, hold)

    own = F.coalesce("component", "id")
    spread = meet(members, labels, "id", "left").groupBy("gid").agg(F.min(own).alias("_low"), F.max(own).alias("_high"), F.max("gsize").alias("_size"))
    spread = hold(spread.select(F.col("gid").alias("id"), "_low", "_high", "_size"))
    placed = meet(meet(leaders.select("id", "n", *PARITY), labels, "id", "left"), spread, "id", "left")
    placed = placed.select("id", "n", *PARITY, F.coalesce("_low", "component", "id").alias("low"), F.coalesce("_high", "component", "id").alias("high"), F.coalesce("_size", F.lit(1)).alias("size"))
    # Keys whose items are all in one component, or whose two items were all that there was to compare, are done.
    left = meet(shared, placed.select("id", "low", "high", "size"), "id")
    sums = left.groupBy("key").agg(F.min("low").alias("_low"), F.max("high").alias("_high"), F.max("size").alias("_size"), F.max("_count").alias("_n"))
    open_keys = hold(sums.where("_low < _high AND (_n > 2 OR _size > 1)").select("key"))
    left = hold(meet(meet(shared, open_keys, "key").select("key", "hub", "id", "pos"), placed, "id"))
    # Of two sets that are similar enough, the larger lies in the smaller one's bin of size or in the next; a key's items meet by bin.
    width = math.log(den / num) * 1.001
    bins = F.floor(F.log(F.col("n")) / width)
    a = left.withColumn("bin", bins).alias("a")
    b = left.withColumn("bin", F.explode(F.array(bins, bins + 1))).alias("b")
    col = lambda name: (F.col(f"a.{name}"), F.col(f"b.{name}"))
    done = (F.col("a.size") == 1) & (F.col("b.size") == 1) & ((F.col("a.id") == F.col("a.hub")) | (F.col("b.id") == F.col("b.hub")))
    apart = (F.col("a.low") != F.col("b.low")) | (F.col("a.low") != F.col("a.high")) | (F.col("b.low") != F.col("b.high"))
    total = F.col("a.n") + F.col("b.n")
    least = F.expr(f"(({num}L * (a.n + b.n) + {num + den - 1}) div {num + den})")
    near = F.least(*col("n")) * den >= F.greatest(*col("n")) * num
    if ordered:
        # The common key is early enough in both, and what can stand before and after it suffices.
        near = near & (F.col("a.pos") <= F.col("a.n") - least) & (F.col("b.pos") <= F.col("b.n") - least)
        near = near & (F.least(*col("pos")) + F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) >= least)
    flips = sum(F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in PARITY)
    # Members of a group have parity bits of their own.
    near = near & ((F.col("a.size") > 1) | (F.col("b.size") > 1) | (flips <= total - 2 * least))
    crossing = meet(a, b, (F.col("a.key") == F.col("b.key")) & (F.col("a.bin") == F.col("b.bin")) & (F.struct("a.n", "a.id") > F.struct("b.n", "b.id")) & ~done & apart & near)
    crossing = crossing.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    inside = spread.where("_low < _high").select(F.col("id").alias("a"), F.col("id").alias("b"))
    group_pairs = hold(crossing.union(inside).distinct())

    own_bits = meet(items.select("id", "n", *PARITY), labels, "id", "left").select("id", "n", *PARITY, own.alias("own"))
    of = members.select("gid", F.col("id").alias("_member"))

    def expand(df: DataFrame, end: str) -> DataFrame:
        wide = meet(df, of.withColumnRenamed("gid", end), end, "left").withColumn(end, F.coalesce("_member", end)).drop("_member")
        return meet(wide, own_bits.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("n", "own", *PARITY)]), end)

    flips = sum(F.bit_count(F.col(f"a_{s}").bitwiseXOR(F.col(f"b_{s}"))) for s in PARITY)
    total = F.col("a_n") + F.col("b_n")
    found = expand(expand(group_pairs, "a"), "b").where((F.col("a") != F.col("b")) & (F.col("a_own") != F.col("b_own")))
    found = found.where(flips <= total - 2 * F.expr(f"(({num}L * (a_n + b_n) + {num + den - 1}) div {num + den})"))
    found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = verify(meet(found, tried, ["a", "b"], "left_anti"), items, fetch, num, den, hold)
    return components(first.union(second), hold)
