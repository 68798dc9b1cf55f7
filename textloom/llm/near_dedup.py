"""MinHash near-dedup with bottom-k sketches.

One hash function maps a document's word shingles to 64 bits; the SKETCH smallest values are its
sketch. Documents of equal shingle sets fall together first, so groups of exact copies cost one
row. Retained values form inverted lists, within which overlaps of sketches are counted and the
similarity is estimated on the sketch of the union; pairs within six standard deviations of
the threshold join documents into candidate clusters. Such a pair shares at least m values of its
sketches, so under any one order of all values it shares one of each sketch's first SKETCH - m + 1: these alone
are listed, and the order puts frequent values (MAX_HOT of them at most) last. Lists lose no pair
the estimate would pass. Clusters, not pairs, leave a list, so what is passed on is linear
in the postings. Each cluster's documents then meet once with their whole sets, and exact
Jaccard on whole numbers decides every link that could join two components. With ``exact`` the estimate
is not asked and the lists hold the prefix of the whole set that no pair at the threshold can miss.

A list that is still long is first cut by set size, as linked sets are of nearly equal size. Lists
and clusters beyond a block are dealt out by blocks, each joined with a few bridging
documents of the whole; what that joins needs no second look, so only documents outside
the largest part then meet the others, block by block. No pair is lost, a family of copies costs
its own length, and no value, passage or group that a third of all rows share meets in one task.

Defined results: a text without words, or null, has no shingles and links with nothing; one with
fewer words than a shingle is one shingle; rows with a null doc_id link with nothing
and are kept. Every row is judged by its own text: rows that repeat a doc_id with other texts are
documents of their own that show the same doc_id, and rows that repeat one with equal shingles are kept
or go together. An empty table gives an empty result. Extra columns are not read by classes().
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, groups, partitions, written
from .components import components

#: The default for near-duplicate stages: five words, 80 %.
WORDS, PERCENT = 5, 80
SKETCH = 32
#: Documents of a list, and shingles of a cluster, that one block may hold.
LIST_BLOCK = 2048
CLUSTER_BLOCK = 500_000
#: Frequent values that tasks are told of, at most: 8 MB.
MAX_HOT = 1 << 20
#: Documents of a list or cluster that join its blocks, about.
BRIDGES = 16
#: Bits a text is told by before it is shuffled: for each text sought, and at most (8 MB, broadcast).
TOLD_BITS, MAX_TOLD = 16, 1 << 26
#: Words a task remembers.
MAX_WORDS = 400_000
PAD = np.uint64(2**64 - 1)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = x = xxhash.xxh3_64_intdigest(word)
        return x


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def shingles(text: bytes | None, width: int, known=None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles; A-Z count as a-z."""
    known = WordHashes() if known is None else known
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    span = min(width, len(h))
    n = len(h) - span + 1
    with np.errstate(over="ignore"):
        out = np.full(n, span, np.uint64)
        for k in range(span):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
        out = np.unique(_mixed(out))
    return out[out != PAD] if len(out) > 1 else out


def needed(percent: int, k: int = SKETCH) -> float:
    """The least estimate that is passed on: six standard deviations under the threshold."""
    j = percent / 100
    return j - 6 * (j * (1 - j) / k) ** 0.5


def prefix(n: int, share: float) -> int:
    """How many of n values to list, if a pair shares this share of the larger set at least."""
    return n - max(1, math.ceil(share * n - 1e-9)) + 1 if n else 0


def sketches(docs: DataFrame, width: int, exact_percent: int | None = None) -> DataFrame:
    """doc_id, text_id, n_shingles, digest (of the whole set) and sketch of every row; with exact_percent, the sketch is as long as that threshold needs."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, n, digest, sketch = WordHashes(), [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            s = shingles(text, width, known)
            n.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sketch.append(s[: SKETCH if exact_percent is None else prefix(len(s), exact_percent / 100)].view(np.int64))
        cols = [batch.column("doc_id"), batch.column("text_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))]
        return pa.record_batch(cols, ["doc_id", "text_id", "n_shingles", "digest", "sketch"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    return rows.mapInArrow(arrow_map(each), "doc_id long, text_id long, n_shingles long, digest binary, sketch array<long>")


def union_estimates(one: np.ndarray, many: np.ndarray, k: int = SKETCH) -> np.ndarray:
    """Similarity of a sketch with each of many, on the bottom-k sketch of the union. Sketches are padded with PAD."""
    both = np.sort(np.concatenate([np.broadcast_to(one, many.shape), many], axis=1), axis=1)
    fresh = np.ones(both.shape, bool)
    fresh[:, 1:] = both[:, 1:] != both[:, :-1]
    real = both != PAD
    rank = np.cumsum(fresh & real, axis=1)
    size = np.minimum(rank[:, -1], k)
    shared = (~fresh & real & (rank <= k)).sum(axis=1)
    return shared / np.maximum(size, 1)


class Overlaps:
    """Counts, by an inverted index, of the values that one of several sets shares with each other."""

    def __init__(self, sets: list[np.ndarray]):
        lengths = [len(s) for s in sets]
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), lengths)
        order = np.argsort(flat, kind="stable")
        self.owners = owner[order]
        ordered = flat[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(ordered))
        group = np.repeat(np.arange(len(starts)), ends - starts)
        place = np.empty(len(flat), np.int64)
        place[order] = group
        self.starts, self.ends, self.n = starts, ends, len(sets)
        self.of = np.split(place, np.cumsum(lengths)[:-1]) if sets else []

    def __call__(self, i: int) -> np.ndarray:
        mine = self.of[i]
        a, b = self.starts[mine], self.ends[mine]
        more = b - a > 1
        a, b = a[more], b[more]
        if not len(a):
            return np.zeros(self.n, np.int64)
        n = b - a
        at = np.arange(n.sum()) + np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return np.bincount(self.owners[at], minlength=self.n)


def joined(sets: list[np.ndarray], accept: Callable[[int, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Component labels of the sets; accept(i, js, overlaps) says which of js link with i.

    Only sets that are not joined yet are asked about: the first of each component, then, while several are left, all others.
    """
    label = np.arange(len(sets))
    count, firsts = None, [0]

    def link(i: int, js: np.ndarray) -> None:
        for x in np.unique(label[js]):
            label[label == x] = label[i]

    for i in range(1, len(sets)):
        if len(firsts) <= 4:
            js = np.array(firsts)
            link(i, js[accept(i, js, np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in firsts]))])
        if (label[:i] != label[i]).any():
            count = count or Overlaps(sets)
            c = count(i)[:i]
            js = np.flatnonzero((c > 0) & (label[:i] != label[i]))
            if len(js):
                link(i, js[accept(i, js, c[js])])
        left = [j for j in firsts if label[j] != label[i]]
        firsts = [*left, firsts[0] if len(left) < len(firsts) and firsts[0] not in left else i]
    return label


def _edges(ids: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, smallest document of its component) where they differ."""
    order = np.lexsort((ids, label))
    ids, label = ids[order], label[order]
    first = np.concatenate([[True], label[1:] != label[:-1]])
    top = ids[np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))]
    return ids[ids != top], top[ids != top]


_EDGES = "a long, b long"


def _batches(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if a:
        yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def _meet(rows: DataFrame, keys: list[str], block: int, edges: Callable[[DataFrame, list[str]], DataFrame]) -> DataFrame:
    """The edges (a, b) that join the components of every group of rows.

    rows: the keys of a group, node and weight. edges(rows, keys) gives the edges within groups that fit one task.
    """
    spark = rows.sparkSession
    sums = rows.groupBy(*keys).agg(F.sum("weight").alias("_w"), F.count("*").alias("_n")).where("_n > 1")
    sums = sums.withColumn("_blocks", F.ceil(F.col("_w") / block).cast("int"))
    rows = written(rows.join(sums, keys), "meet")
    hash = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), F.col("node")), n).cast("int")
    every = F.sequence(F.lit(0), F.col("_blocks") - 1)
    many = F.col("_blocks") > 1
    bridge = many & (hash(4, F.ceil(F.col("_n") / BRIDGES)) == 0)
    at = F.when(bridge, every).when(many, F.array(hash(3, F.col("_blocks")))).otherwise(F.array(F.lit(0)))
    block_keys = [*keys, "_x", "_y"]
    first = edges(rows.select(*keys, "node", F.explode(at).alias("_x"), F.lit(-1).alias("_y")), block_keys)
    large = rows.where(many)
    if large.isEmpty():
        return first
    first = written(first, "edges")
    # of each large group, the part that is joined already, and the rest
    label = components(first)
    large = written(large.join(label.withColumnRenamed("component", "_label"), "node", "left").withColumn("_label", F.coalesce("_label", "node")), "large")
    discard(label)
    parts = large.groupBy(*keys, "_label").agg(F.sum("weight").alias("_w"))
    most = parts.groupBy(*keys).agg(F.max("_w").alias("_top"), F.sum("_w").alias("_all"), F.max_by("_label", F.struct("_w", "_label")).alias("_main")).where("_top < _all")
    most = most.withColumns({"_of_main": F.ceil(F.col("_top") / block).cast("int"), "_of_rest": F.ceil((F.col("_all") - F.col("_top")) / block).cast("int")})
    # blocks of the main part are numbered from 1, those of the rest from -1 down; a pair of blocks holds one of the rest
    at = large.drop("_w", "_n", "_blocks").join(most, keys)
    main = F.col("_label") == F.col("_main")
    at = at.withColumn("_b", F.when(main, 1 + hash(3, F.col("_of_main"))).otherwise(-1 - hash(3, F.col("_of_rest"))))
    rest, all_main = F.sequence(-F.col("_of_rest"), F.lit(-1)), F.sequence(F.lit(1), F.col("_of_main"))
    at = at.withColumn("_o", F.explode(F.when(main, rest).otherwise(F.concat(rest, all_main))))
    pairs = at.select(*keys, "node", F.least("_b", "_o").alias("_x"), F.greatest("_b", "_o").alias("_y"))
    return first.unionByName(edges(pairs, block_keys))


def hot_values(sets: DataFrame) -> np.ndarray:
    """The most frequent retained values, sorted: those of long lists, but MAX_HOT at most."""
    found = written(sets.select(F.explode("sketch").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LIST_BLOCK), "hot")
    by_size = found.groupBy(F.log2("n").cast("int").alias("bits")).count().collect()  # a row for each power of two
    if not by_size:
        return np.zeros(0, np.uint64)
    total, least = 0, 64
    for bits, n in sorted(((r["bits"], r["count"]) for r in by_size), reverse=True):
        total += n
        if total > MAX_HOT:
            break
        least = bits
    values = found.where(F.log2("n").cast("int") >= least).select("key").toArrow().column("key").to_numpy()
    discard(found)
    return np.sort(values.astype(np.int64).view(np.uint64))


def postings(sets: DataFrame, percent: int, exact: bool) -> DataFrame:
    """node, n_shingles and key: the values of each sketch that are listed."""
    shared = sets.sparkSession.sparkContext.broadcast(hot_values(sets)) if not exact else None  # MAX_HOT values at most
    share = needed(percent)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        sketch = batch.column("sketch")
        if not exact:
            flat, lengths = sketch.flatten().to_numpy().view(np.uint64), np.diff(sketch.offsets.to_numpy())
            hot = np.isin(flat, shared.value)
            row = np.repeat(np.arange(len(lengths)), lengths)
            order = np.lexsort((flat, hot, row))  # frequent values last, else by value
            place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            keep = place < np.array([prefix(n, share) for n in range(SKETCH + 1)])[np.repeat(lengths, lengths)]
            row, flat = row[keep], flat[order][keep]
        else:
            row, flat = np.repeat(np.arange(batch.num_rows), np.diff(sketch.offsets.to_numpy())), sketch.flatten().to_numpy().view(np.uint64)
        row = pa.array(row)
        return pa.record_batch([batch.column("node").take(row), batch.column("n_shingles").take(row), pa.array(flat.view(np.int64))], ["node", "n_shingles", "key"])

    return sets.select("node", "n_shingles", "sketch").mapInArrow(arrow_map(each), "node long, n_shingles long, key long")


def candidate_edges(sets: DataFrame, percent: int, exact: bool = False) -> DataFrame:
    """Edges that join the candidate clusters. sets: node, n_shingles, sketch."""
    spark = sets.sparkSession
    least = needed(percent)
    listed = written(postings(sets, percent, exact), "postings")
    lists = listed.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1")
    # sets that link differ by one class of size at most; a long list is cut into classes, each with the next larger one
    cls = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(math.log(100 / percent) * (1 + 1e-9))).cast("int")
    size = F.when(F.col("_n") > LIST_BLOCK, F.array(cls, cls - 1)).otherwise(F.array(F.lit(-9)))
    rows = listed.join(lists, "key").select("key", F.explode(size).alias("cls"), "node", F.lit(1).alias("weight"))

    def edges(dealt: DataFrame, keys: list[str]) -> DataFrame:
        inner = dealt.join(sets.select("node", "n_shingles", "sketch"), "node")
        inner = inner.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a, b, held = [], [], 0
            for _, rows in groups(batches, *keys):
                if rows.num_rows < 2:
                    continue
                ids, n = rows.column("node").to_numpy(), rows.column("n_shingles").to_numpy()
                lists = [np.asarray(x, np.int64).view(np.uint64) for x in rows.column("sketch").to_pylist()]
                padded = np.full((len(lists), SKETCH), PAD)
                for i, x in enumerate(lists):
                    padded[i, : len(x)] = x[:SKETCH]

                def accept(i, js, _, n=n, padded=padded):
                    ok = 100 * np.minimum(n[i], n[js]) >= percent * np.maximum(n[i], n[js])
                    if not exact:
                        ok[ok] = union_estimates(padded[i], padded[js[ok]]) >= least
                    return ok

                x, y = _edges(ids, joined(lists, accept))
                if len(x):
                    a.append(x)
                    b.append(y)
                    held += len(x)
                    if held > 50_000:
                        yield from _batches(a, b)
                        a, b, held = [], [], 0
            yield from _batches(a, b)

        return inner.mapInArrow(each, _EDGES).distinct()

    return _meet(rows, ["key", "cls"], LIST_BLOCK, edges)


def sought(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts whose doc_id and text_id are in rows and, by chance, one in TOLD_BITS of the others, so that few are shuffled for nothing.

    Bitmaps of hashed keys are broadcast. Beyond MAX_TOLD bits more of the others pass; none of those sought is ever held back.
    """
    bits = min(MAX_TOLD, max(1 << 15, 1 << (TOLD_BITS * rows.count() - 1).bit_length()))  # bitmaps are of 1 << 15 each
    at = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id"), F.col("text_id")), F.lit(bits))
    maps = rows.select(at.alias("_at")).groupBy(F.shiftright("_at", 15).alias("_map")).agg(F.bitmap_construct_agg(F.col("_at").bitwiseAND((1 << 15) - 1)).alias("_bits"))
    told = texts.withColumn("_at", at).withColumn("_map", F.shiftright("_at", 15)).join(F.broadcast(maps), "_map")
    bit = F.col("_at").bitwiseAND((1 << 15) - 1).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(bit, 3) + 1, 1)), 16, 10).cast("int")
    return told.where(F.getbit(byte, bit.bitwiseAND(7)) == 1).select(texts.columns)


def confirmed_edges(docs: DataFrame, clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """Edges of the components that exact links make. clusters: node, cluster, n_shingles and the doc_id and text_id of a row."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text")

    def edges(dealt: DataFrame, keys: list[str]) -> DataFrame:
        rows = written(dealt.join(clusters.select("node", "doc_id", "text_id"), "node"), "dealt")
        inner = sought(texts, rows).join(rows.hint("merge"), ["doc_id", "text_id"]).select(*keys, "node", "text")
        inner = inner.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "node")

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for _, rows in groups(batches, *keys):
                ids, first = np.unique(rows.column("node").to_numpy(), return_index=True)
                sets = [shingles(rows.column("text")[int(i)].cast(pa.binary()).as_py(), width, known) for i in first]
                n = np.array([len(s) for s in sets])

                def accept(i, js, overlap, n=n):
                    return 100 * overlap >= percent * (n[i] + n[js] - overlap)

                x, y = _edges(ids, joined(sets, accept))
                yield from _batches([x], [y])

        return inner.mapInArrow(each, _EDGES)

    return _meet(clusters.select("cluster", "node", F.col("n_shingles").alias("weight")), ["cluster"], CLUSTER_BLOCK, edges)


def _classes(docs: DataFrame, width: int, percent: int, exact: bool) -> DataFrame:
    """doc_id, text_id, n_shingles, component_id and kept of every row."""
    made = written(sketches(docs, width, percent if exact else None), "sketches")
    some = made.where("doc_id is not null and n_shingles > 0")
    # one row for each distinct set, with the smallest doc_id that has it
    sets = some.groupBy("digest", "n_shingles", "sketch").agg(F.min("doc_id").alias("doc_id"), F.min_by("text_id", "doc_id").alias("text_id"))
    sets = written(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    near = components(candidate_edges(sets, percent, exact))
    clusters = near.withColumnRenamed("component", "cluster").join(sets.select("node", "n_shingles", "doc_id", "text_id"), "node")
    clusters = written(clusters, "clusters")
    discard(near)
    links = components(confirmed_edges(docs, clusters, width, percent)).join(sets.select("node", "digest", "doc_id"), "node")
    tops = links.groupBy("component").agg(F.min("doc_id").alias("_top"))
    found = links.join(tops, "component").select("digest", "_top")
    found = written(sets.select("digest", "doc_id").join(found, "digest", "left").select("digest", F.coalesce("_top", "doc_id").alias("_component")), "classes")
    discard(sets, clusters)
    out = made.drop("sketch").join(found, "digest", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")))
    return out.select("doc_id", "text_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def classes(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id) and kept of every row."""
    return _classes(docs, width, percent, exact).drop("text_id")


def deduplicated(docs: DataFrame, width: int = WORDS, percent: int = PERCENT, exact: bool = False) -> DataFrame:
    """The rows of docs that are kept, with the columns they came with."""
    gone = _classes(docs, width, percent, exact).where(~F.col("kept")).select(F.col("doc_id").alias("_d"), F.col("text_id").alias("_t")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t"))
    return rows.join(gone.hint("merge"), ["_d", "_t"], "left_anti").select("_row.*")
