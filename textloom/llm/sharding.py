"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has RING positions. Every shard owns virtual nodes at hashed positions, and a
document belongs to the first virtual node at or after the position its doc_id hashes to.
A shard takes at most its load bound (rows / shards, rounded so that the bounds sum up to
all rows); keys that meet a full shard continue clockwise to the next node whose shard
has room. With bounds that tight every shard ends full: counts are at most one apart,
whichever keys are hot, and only overflowing keys leave their own arc.

Only counts by ring position (RING of them, a constant) reach the driver; there the walk
is decided for whole runs of a position's keys, and each row finds its run by its rank
in its position. Slots are prefix sums over those runs, so no shard is sorted as a whole.
Rows alike in all that the result shows are counted first and travel as one row with a number of copies.
A position that equal or null doc_ids make hot is ranked in slices of a hash of the content, and copies
are dealt out in parts of PART rows before they become rows again, so no task meets a third of all rows.

Defined results: the null doc_id is a key like any other; equal doc_ids hash alike and are
ranked by size and crc; null texts have size 1 and the crc of the empty text; an empty
table gives an empty result. Columns other than doc_id and text are not read by placed().
"""

from __future__ import annotations

import bisect

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 8
VIRTUAL_NODES = 128
#: Positions on the ring; a power of two, as a position is the top bits of a hash.
RING_BITS = 16
RING = 1 << RING_BITS
#: Rows of a position, on average, that one task ranks: a position of more is cut into slices.
SLICE_ROWS = 1 << 16
#: Copies of a row that one row stands for when they are dealt out.
PART = 1 << 12


def ring(shards: int = SHARDS, nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(position, shard) of every virtual node, clockwise; equal positions in order of the shard."""
    return sorted((xxhash.xxh64_intdigest(f"shard-{s}/node-{v}") >> (64 - RING_BITS), s) for s in range(shards) for v in range(nodes))


def planned(counts: dict[int, int], shards: int = SHARDS, nodes: int = VIRTUAL_NODES) -> list[tuple[int, int, int, int, int]]:
    """(position, first rank, end rank, shard, first slot): where each run of a position's keys goes.

    counts: keys at each position. Own keys are placed first, clockwise, up to the bounds;
    then what overflowed walks on clockwise.
    """
    points = ring(shards, nodes)
    at = [p for p, _ in points]
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    slot = [0] * shards
    plan, over = [], []

    def take(pos: int, first: int, n: int, shard: int) -> int:
        got = min(n, room[shard])
        if got:
            plan.append((pos, first, first + got, shard, slot[shard]))
            room[shard] -= got
            slot[shard] += got
        return got

    for pos in sorted(counts):
        node = bisect.bisect_left(at, pos) % len(points)
        got = take(pos, 0, counts[pos], points[node][1])
        if got < counts[pos]:
            over.append((pos, got, counts[pos] - got, node))
    for pos, first, left, node in over:
        while left:
            node = (node + 1) % len(points)
            got = take(pos, first, left, points[node][1])
            first, left = first + got, left - got
    return plan


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the hash and the ring position of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    df = df.withColumn("_hash", F.xxhash64("doc_id", F.lit(7)))
    return df.withColumn("_pos", F.shiftrightunsigned("_hash", 64 - RING_BITS).cast("int"))


def placed(docs: DataFrame, shards: int = SHARDS, nodes: int = VIRTUAL_NODES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is ``rows``) of every row."""
    spark = docs.sparkSession
    row = ["doc_id", "size", "text_crc32"]
    df = written(keyed(docs).groupBy("_pos", "_hash", *row).agg(F.count("*").alias("_n")), "keys")
    counts = {r["_pos"]: r["n"] for r in df.groupBy("_pos").agg(F.sum("_n").alias("n")).collect()}  # at most RING rows
    # both small tables are bounded whatever the input: at most RING rows, and RING + shards * nodes
    hot = [(p, (n // SLICE_ROWS).bit_length()) for p, n in counts.items() if n > SLICE_ROWS]
    hot = F.broadcast(spark.createDataFrame(hot, "_pos int, _bits int"))
    plan = F.broadcast(spark.createDataFrame(planned(counts, shards, nodes) or [(-1, 0, 0, 0, 0)], "_pos int, _first long, _end long, shard int, _from long"))
    # the content's hash orders a position's rows and cuts it into slices
    bits = F.coalesce("_bits", F.lit(0))
    df = df.join(hot, "_pos", "left").withColumn("_h", F.xxhash64(*row, F.lit(11)))
    df = df.withColumn("_slice", F.when(bits > 0, F.expr("shiftrightunsigned(_h, 64 - coalesce(_bits, 1))")).otherwise(F.lit(0)).cast("int")).drop("_bits")
    within = Window.partitionBy("_pos", "_slice").orderBy("_hash", "_h", *row).rowsBetween(Window.unboundedPreceding, -1)
    ranked = df.withColumn("_rank", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    slices = df.where("_slice >= 0").groupBy("_pos", "_slice").agg(F.sum("_n").alias("_all")).join(hot, "_pos", "left_semi")
    earlier = Window.partitionBy("_pos").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a position has few slices: rows / SLICE_ROWS
    slices = slices.select("_pos", "_slice", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_base"))
    ranked = ranked.join(slices, ["_pos", "_slice"], "left").withColumn("_rank", F.col("_rank") + F.coalesce("_base", F.lit(0)))
    # the copies of a row may lie in several runs
    found = ranked.join(plan, "_pos").where("_rank < _end and _rank + _n > _first")
    low, high = F.greatest("_rank", "_first"), F.least(F.col("_rank") + F.col("_n"), F.col("_end"))
    found = found.select(*row, "shard", (F.col("_from") + low - F.col("_first")).alias("_slot"), (high - low).alias("_n"))
    parts = found.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(PART)))).repartition("doc_id", "shard", "_slot", "_at")
    slot = F.explode(F.sequence(F.col("_slot") + F.col("_at"), F.col("_slot") + F.least(F.col("_at") + PART, "_n") - 1))
    return parts.select(*row, F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
