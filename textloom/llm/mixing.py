"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. A source's target is its share of the
whole, by weight, capped at MAX_REPEAT times its size with the excess shared anew. Whole
passes over a source come first; what is left of the target is fitted on the counts:
each length gives its proportional part, the lengths of largest remainder one document more while
the rest exceeds what the knapsack holds, and a bounded knapsack over all lengths that have documents
left, solved by dynamic programming over sums, closes the rest exactly wherever sums can reach it.
The chosen number of documents of each length is then drawn by a seeded hash, so reruns agree.

Ranks of sources, sums and the rounds of the cap are aggregations: no task or driver holds all sources.
A histogram has one row for each length of a source; it grows with the longest text, not
with the corpus, and is fitted by one task for each source. Drawing ranks documents within slices of
the hash, whose number grows with the corpus, so one hot length is spread over many tasks.

Defined results: the null source is a source, ordered last; null and empty texts have
size 0 and are never taken; an empty table gives an empty result; equal rows are drawn
independently, ties going by doc_id, then by the text's hash. Extra columns are not read by mixed().
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from .common import partitions, word_array, written

WEIGHTS = (1.0, 2.0, 3.0)
SHARE = 1.0
MAX_REPEAT = 3
SEED = 20240607
#: Rows of one source and length that a slice of the hash holds, on average, at most.
SLICE_ROWS = 1 << 20
MIN_SLICE_BITS = 6
#: Words that the knapsack fits, or four times the longest text if that is more.
KNAPSACK_WORDS = 1 << 17


def targets(sizes: Sequence[float], weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = MAX_REPEAT) -> list[float]:
    """The words to take of each source: share of all by weight, none above cap times its size."""
    n = len(sizes)
    weight = [weights[i % len(weights)] for i in range(n)]
    left, free, out = share * sum(sizes), set(range(n)), [0.0] * n
    while free:
        total = sum(weight[i] for i in free)
        full = {i for i in free if left * weight[i] / total >= cap * sizes[i]}
        if not full:
            for i in free:
                out[i] = left * weight[i] / total
            break
        for i in full:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in full)
        free -= full
        if left <= 0:
            break
    return out


def knapsack(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum is as near to budget from below as can be.

    Sums that can be reached are the bits of an integer; a count is split into powers of two. The item that
    reaches a sum first is kept, so that a choice is read back from the last sum; no sum is left out.
    """
    reach, mask = 1, (1 << (budget + 1)) - 1
    first = np.full(budget + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i, (size, count) in enumerate(zip(lengths, counts, strict=True)):
        step, count = 1, min(count, budget // size if size else 0)
        while count > 0:
            take = min(step, count)
            fresh = (reach << (size * take)) & mask & ~reach
            if fresh:
                low = (fresh & -fresh).bit_length() - 1
                bits = np.frombuffer((fresh >> low).to_bytes((fresh.bit_length() - low + 7) // 8, "little"), np.uint8)
                first[low + np.flatnonzero(np.unpackbits(bits, bitorder="little"))] = len(items)
                items.append((i, take))
                reach |= fresh
            count, step = count - take, step * 2
        if reach >> budget & 1:
            break
    best, chosen = reach.bit_length() - 1, [0] * len(lengths)
    while best:
        i, take = items[first[best]]
        chosen[i] += take
        best -= lengths[i] * take
    return chosen


def fitted(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED, words: int = KNAPSACK_WORDS) -> np.ndarray:
    """How many documents of each length to take for a budget of at most their whole size: never more than it."""
    picks = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or total <= 0:
        return picks
    if budget >= total:
        return np.where(lengths > 0, counts, 0)
    # whole numbers: counts * budget may exceed 64 bits, so quotient and remainder are taken apart
    exact = [divmod(int(c) * budget, total) if n > 0 else (0, 0) for n, c in zip(lengths.tolist(), counts.tolist(), strict=True)]
    picks = np.array([q for q, _ in exact], np.int64)  # rounded down: never above budget
    left = budget - int((picks * lengths).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))  # among equals no length comes first by its size
    held = max(words, 4 * int(lengths.max()))
    for i in sorted(order.tolist(), key=lambda i: -exact[i][1]):
        if left <= held:
            break
        if counts[i] > picks[i] and 0 < lengths[i] <= left:
            picks[i] += 1
            left -= int(lengths[i])
    spare = order[(lengths[order] > 0) & (counts[order] > picks[order]) & (lengths[order] <= left)]
    if len(spare):
        picks[spare] += knapsack([int(x) for x in lengths[spare]], [int(x) for x in (counts - picks)[spare]], left)
    return picks


def n_words(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def _text_id(text: Column) -> Column:
    return F.xxhash64(text)


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and copies (taken = copies * size) of every row."""
    # texts are read once
    df = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _text_id(F.col("text")).alias("text_id")), "sizes")
    return drawn(df, weights, share, cap, seed).select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _hashable(kind) -> bool:
    if isinstance(kind, StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return _hashable(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, MapType | VariantType)


def taken(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = MAX_REPEAT, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns they came with.

    Documents are drawn from a table without texts; texts are shuffled once, to meet what was drawn. Rows alike in doc_id,
    source and text are told apart by a hash of all their columns (but maps and variants).
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    key = F.xxhash64("doc_id", "source", "size", "text_id").alias("_key")
    every = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if _hashable(f.dataType)]).alias("_every")
    df = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _text_id(F.col("text")).alias("text_id"), whole.alias("_row"), every)
    sizes = written(df.select("doc_id", "source", "size", "text_id"), "sizes")
    # rows that share a key, such as repeated ones, differ by one copy at most: so many of them get one more than the rest
    made = drawn(sizes, weights, share, cap, seed).select(key, "copies").groupBy("_key").agg(F.min("copies").alias("_least"), (F.sum("copies") - F.min("copies") * F.count("*")).alias("_more"))
    # numbered in the partitioning of the join: texts are shuffled once
    df = df.select(key, "_row", "_every").withColumn("_i", F.row_number().over(Window.partitionBy("_key").orderBy("_every")))
    out = df.join(made.where("_least + _more > 0").hint("merge"), "_key").withColumn("_n", F.col("_least") + F.when(F.col("_i") <= F.col("_more"), 1).otherwise(0)).where("_n > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1), "_n")).alias("_copy")).select("_row.*")


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """source and source_size with rank: its place, from 0, by code points, null last.

    Sources are range-partitioned and sorted; only the rows of each partition are counted on the driver.
    """
    spark = sizes.sparkSession
    order = [F.col("source").asc_nulls_last()]
    # an id holds the partition in its upper bits and the place in the partition in the lower 33
    put = written(sizes.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "sources")
    counts = put.groupBy(F.shiftright("_at", 33).cast("int").alias("part")).count().collect()  # a row for each partition
    bases, base = [(-1, 0)], 0
    for part, n in sorted((r["part"], r["count"]) for r in counts):
        bases.append((part, base))
        base += n
    bases = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("base")
    return put.join(bases, F.shiftright("_at", 33).cast("int") == F.col("part")).select("source", "source_size", place.alias("rank"))


def aims(sizes: DataFrame, weights: Sequence[float], share: float, cap: int) -> DataFrame:
    """source, source_size and target: targets() of every source, by one aggregation for each round of the cap."""
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    df = written(ranked_sources(sizes).select("source", "source_size", F.get(kinds, F.pmod("rank", F.lit(len(weights))).cast("int")).alias("weight")), "aims")
    whole = df.agg(F.sum("source_size")).first()[0] or 0
    level, full, n_full = 0.0, F.lit(False), 0
    while True:
        # what is left is shared by weight among the sources below their cap
        held = df.agg(F.sum(F.when(full, F.col("source_size"))).alias("size"), F.sum(F.when(~full, F.col("weight"))).alias("weight"), F.count(F.when(full, 1)).alias("n")).first()
        if not held["weight"] or level and held["n"] == n_full:
            break
        n_full = held["n"]
        level = max(0.0, share * whole - cap * (held["size"] or 0)) / held["weight"]
        full = F.lit(level) * F.col("weight") >= cap * F.col("source_size")
        if not level:
            break
    target = F.when(full, (cap * F.col("source_size")).cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return df.select("source", "source_size", target.alias("target"))


def drawn(df: DataFrame, weights: Sequence[float], share: float, cap: int, seed: int) -> DataFrame:
    """df (doc_id, source, size and text_id) with source_size, target and copies."""
    hist = df.groupBy("source", "size").agg(F.count("*").alias("_docs"))
    by_source = hist.groupBy("source").agg(F.sum(F.col("size") * F.col("_docs")).cast("long").alias("source_size"))
    aim = aims(by_source, tuple(weights), share, cap)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size")
        whole, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = min(cap, int(target // whole)) if whole else 0
        rest = 0 if passes >= cap else round(target - passes * whole)
        picks = fitted(pdf["size"].to_numpy(np.int64), pdf["_docs"].to_numpy(np.int64), rest, seed)
        return pd.DataFrame({"_source": pdf["source"], "_size": pdf["size"], "source_size": whole, "target": target, "_passes": passes, "_picks": picks})

    grown = hist.join(aim.withColumnRenamed("source", "_source"), F.expr("source <=> _source")).drop("_source")
    plan = written(grown.groupBy("source").applyInPandas(fit, "_source string, _size long, source_size long, target double, _passes int, _picks long"), "picks")

    # the k documents of smallest hash, ranked within slices of it
    bits = max(MIN_SLICE_BITS, (df.count() // SLICE_ROWS).bit_length())
    df = df.withColumn("_hash", F.xxhash64("doc_id", "text_id", F.lit(seed))).withColumn("_slice", F.shiftrightunsigned("_hash", 64 - bits).cast("int"))
    slices = df.groupBy("source", "size", "_slice").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source", "size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    slices = slices.join(plan, F.expr("source <=> _source and size = _size"))
    cuts = slices.select("_source", "_size", F.col("_slice").alias("_of"), "source_size", "target", "_passes", (F.col("_picks") - F.col("_before")).alias("_left"))
    order = Window.partitionBy("source", "size", "_slice").orderBy("_hash", "doc_id", "text_id")
    df = df.withColumn("_rank", F.row_number().over(order))
    on = F.expr("source <=> _source and size = _size and _slice = _of")
    copies = F.col("_passes") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)
    df = df.join(cuts.hint("merge"), on).withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(0).cast("int"))
    return df.drop("_source", "_size", "_of", "_left", "_passes", "_rank", "_hash", "_slice")
