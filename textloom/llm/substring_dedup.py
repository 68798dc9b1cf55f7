"""Substring dedup by prefix-partitioned suffix trees over words.

The suffixes of a collection's documents form a suffix tree; its internal nodes of WINDOW words or more
are the passages that repeat, and those that nothing longer contains on their left the maximal repeats.
The tree is never built whole:

1. Texts are packed into chunks of bounded size, written once. Each lists its seeds: in every window, the
   SEED consecutive words of least hash. Equal windows have equal seeds, so a suffix whose seed occurs in one
   chunk only can't reach a deep node of another chunk's suffixes. It also lists which of its windows repeat within it.
2. Seeds are counted over all chunks.
3. Surviving suffixes are partitioned by prefix, in rotated order (from the seed to the right, then to the left),
   so that a group's suffixes share their first SEED words. Prefixes of many chunks, or of many
   windows of one chunk, are too large for one group and are extended to the whole window: prefix lengths vary with
   the counts. Groups of prefixes are sized for memory. A chunk sends each distinct suffix once, with its smallest
   document, as far as its neighbours go to the same group, so a passage in a third of all documents arrives once a chunk.
4. Each group builds its subtree from the top: suffixes are named by their first WINDOW words, by doubling, and nodes
   are split by the next word as long as a smaller document goes along. The deepest node that a smaller document shares
   gives the repeat that starts at a suffix; those that the suffix before doesn't contain are the maximal ones and are told to
   the chunk. Extended prefixes of more than FAN chunks meet in buckets, of which only the smallest document's
   suffix goes on to meet those of other buckets, so a group's size doesn't grow with the number of chunks.
5. Each chunk marks the words that its repeats cover.

Words are compared by 64-bit hashes within a chunk and as bytes between chunks.

Defined results: null and empty texts have no words; texts shorter than a window lose nothing; rows
with a null doc_id lose nothing and count for nothing; rows that repeat a doc_id, with equal or other texts, are
each given their own row, and nothing in them is a copy of a smaller document by another of them; an
empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, written
from .near_dedup import WordHashes, _mixed

WINDOW = 13
SEED = 7
#: Bytes of text in a chunk.
CHUNK_BYTES = 4 << 20
#: Words of the corpus for each group of prefixes.
GROUP_WORDS = 4_000_000
#: Prefixes in more chunks than this, or of more windows of a chunk, are extended.
LONG_CHUNKS = 64
LONG_WINDOWS = 4096
#: Windows of neighbouring suffixes that travel as one run: a subtree is at most this deep, plus a window.
MAX_RUN = 64
#: Chunks of one extended prefix that meet in a bucket, and buckets of one that do so next.
FAN = 4096


def _squeezed(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def _restored(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers of one length as compressed byte planes of their steps, which are mostly small."""
    steps = np.diff(np.stack(arrays).astype("<i8"), axis=1, prepend=0)
    planes = np.ascontiguousarray(steps).view(np.uint8).reshape(len(arrays), -1, 8).transpose(0, 2, 1)
    return _squeezed(struct.pack("<q", steps.shape[1]) + planes.tobytes())


def _unpacked(blob: bytes, k: int) -> np.ndarray:
    """The k arrays of _packed()."""
    data = _restored(blob)
    (n,) = struct.unpack_from("<q", data)
    planes = np.frombuffer(data, np.uint8, 8 * k * n, 8).reshape(k, 8, n)
    return np.cumsum(np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<i8").reshape(k, n), axis=1)


# 1. chunks


class Chunk:
    """The words of a chunk end to end: documents by id, those without one first."""

    def __init__(self, ids: list[int | None], texts: list[bytes | None]):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0))
        self.n_null = sum(i is None for i in ids)
        self.ids = np.array([ids[i] or 0 for i in order], np.int64)
        self.texts = [texts[i] or b"" for i in order]
        self.words = [t.split() for t in self.texts]
        counts = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        self.doc = np.repeat(np.arange(len(counts)), counts)

    def packed(self) -> bytes:
        sizes = np.array([len(t) for t in self.texts], "<i8")
        return struct.pack("<qq", len(self.ids), self.n_null) + _squeezed(self.ids.astype("<i8").tobytes() + sizes.tobytes() + b"".join(self.texts), 3)  # written and shuffled: worth a closer look

    @classmethod
    def unpacked(cls, blob: bytes) -> Chunk:
        n, n_null = struct.unpack_from("<qq", blob)
        data = _restored(memoryview(blob)[16:])
        ids, sizes = np.frombuffer(data, "<i8", n).tolist(), np.frombuffer(data, "<i8", n, 8 * n).tolist()
        texts, at = [], 16 * n
        for size in sizes:
            texts.append(data[at : at + size])
            at += size
        return cls([None] * n_null + ids[n_null:], texts)

    def windows(self, window: int) -> np.ndarray:
        """Places of all windows: each lies in one document that has an id."""
        n = max(0, int(self.starts[-1]) - window + 1)
        return np.flatnonzero((self.doc[:n] == self.doc[window - 1 :][:n]) & (self.doc[:n] >= self.n_null))

    def hashes(self) -> np.ndarray:
        known = WordHashes().__getitem__
        return np.fromiter(map(known, chain.from_iterable(self.words)), np.uint64, int(self.starts[-1]))


def _window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(h) - width + 1)
    out = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += h[k : k + n]
    return _mixed(out)


def _seeds(h: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Of each window, the least hash of its runs of so many words."""
    grams, n = _window_hashes(h, seed), max(0, len(h) - window + 1)
    least = grams[:n].copy()
    for k in range(1, window - seed + 1):
        np.minimum(least, grams[k : k + n], out=least)
    return least


def _repeated(full: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Places of windows that occur before in the chunk, and the places where they first do: that of the smallest document."""
    _, first, which = np.unique(full, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[which] != np.arange(len(full)))
    return np.stack([at[again], at[first[which[again]]]])


def _deltas(sorted_values: np.ndarray) -> bytes:
    """Sorted integers as compressed byte planes of their differences."""
    d = np.diff(sorted_values, prepend=np.uint64(0)).astype("<u8")
    planes = d.view(np.uint8).reshape(-1, 8).T
    return _squeezed(struct.pack("<q", len(d)) + planes.tobytes())


def _values(blob: bytes) -> np.ndarray:
    data = _restored(blob)
    (n,) = struct.unpack_from("<q", data)
    planes = np.frombuffer(data, np.uint8, 8 * n, 8).reshape(8, n)
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def chunked(docs: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """chunk, n_words, blob (all rows of docs, packed where they lie), seeds, heavy (those of many windows) and again (repeats within)."""
    limit, many = CHUNK_BYTES, LONG_WINDOWS

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId() << 24, 0
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            chunk = Chunk(ids, texts)
            h, at = chunk.hashes(), chunk.windows(window)
            again = _repeated(_window_hashes(h, window)[at], at)
            seeds, count = np.unique(_seeds(h, window, seed)[at], return_counts=True)
            blobs = [chunk.packed(), _deltas(seeds), seeds[count > many].astype("<u8").tobytes(), _packed(again[0], again[0] - again[1])]
            return pa.record_batch([pa.array([part + n]), pa.array([len(h)]), *(pa.array([x], pa.binary()) for x in blobs)], ["chunk", "n_words", "blob", "seeds", "heavy", "again"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                ids.append(doc)
                texts.append(text)
                size += len(text or b"") + 16
                if size >= limit:
                    yield row()
                    n, ids, texts, size = n + 1, [], [], 0
        if ids:
            yield row()

    return docs.select("doc_id", "text").mapInArrow(each, "chunk long, n_words long, blob binary, seeds binary, heavy binary, again binary")


# 2. seeds


def _group(values: np.ndarray, n: int) -> np.ndarray:
    """The group of a hash: its high bits, scaled."""
    return ((values >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _seed_blocks(n_groups: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob, heavy in zip(batch.column("chunk").to_pylist(), batch.column("seeds"), batch.column("heavy"), strict=True):
                seeds, heavy = _values(blob.as_py()), np.frombuffer(heavy.as_py(), "<u8")
                names, blobs, large = [], [], []
                edges, of = np.searchsorted(_group(seeds, n_groups), np.arange(n_groups + 1)), _group(heavy, n_groups)
                for g in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
                    names.append(g)
                    blobs.append(_deltas(seeds[edges[g] : edges[g + 1]]))
                    large.append(heavy[of == g].tobytes())
                yield pa.record_batch([pa.array(names, pa.int64()), pa.array([name] * len(names), pa.int64()), pa.array(blobs, pa.binary()), pa.array(large, pa.binary())], ["grp", "chunk", "seeds", "heavy"])

    return each


def _shared_seeds(long_chunks: int):
    """Of a group's seed lists: to each chunk, its seeds that other chunks have too, and whether to extend them."""

    def each(rows: pa.Table) -> pa.Table:
        lists = [_values(x.as_py()) for x in rows.column("seeds")]
        values, count = np.unique(np.concatenate(lists), return_counts=True)
        heavy = np.frombuffer(b"".join(rows.column("heavy").to_pylist()), "<u8")
        many = (count > long_chunks) | np.isin(values, heavy)
        values, many = values[count > 1], many[count > 1]
        chunks, blobs = [], []
        for name, mine in zip(rows.column("chunk").to_pylist(), lists, strict=True):
            at = np.searchsorted(values, mine)
            at[at == len(values)] = 0
            hit = values[at] == mine if len(values) else np.zeros(len(mine), bool)
            if hit.any():
                chunks.append(name)
                blobs.append(struct.pack("<q", hit.sum()) + mine[hit].tobytes() + np.packbits(many[at[hit]]).tobytes())
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "shared": pa.array(blobs, pa.binary())})

    return each


def _shared(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted seeds and whether their prefixes are extended."""
    seeds, flags = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for b in blobs:
        (n,) = struct.unpack_from("<q", b)
        seeds.append(np.frombuffer(b, "<u8", n, 8))
        flags.append(np.unpackbits(np.frombuffer(b, np.uint8, offset=8 + 8 * n), count=n).astype(bool))
    seeds, flags = np.concatenate(seeds), np.concatenate(flags)
    order = np.argsort(seeds)
    return seeds[order], flags[order]


# 3. suffixes by prefix


class Runs:
    """Suffixes as runs of words: place, number of suffixes and document of each run, and the words of all."""

    def __init__(self, place: np.ndarray, count: np.ndarray, doc: np.ndarray, text: bytes):
        self.place, self.count, self.doc, self.text = place, count, doc, text

    def packed(self) -> bytes:
        head = _packed(self.place, self.count, self.doc)
        return struct.pack("<q", len(head)) + head + _squeezed(self.text)

    @classmethod
    def unpacked(cls, blob: bytes) -> Runs:
        (n,) = struct.unpack_from("<q", blob)
        return cls(*_unpacked(blob[8 : 8 + n], 3), _restored(blob[8 + n :]))


def _suffix_blocks(n_groups: int, n_buckets: int, window: int, seed: int):
    most = MAX_RUN

    def of_chunk(name: int, blob: bytes, again: bytes, replies: list[bytes]) -> pa.RecordBatch | None:
        seeds, extend = _shared(replies)
        chunk = Chunk.unpacked(blob)
        h, at = chunk.hashes(), chunk.windows(window)
        alone = np.ones(len(h), bool)
        alone[_unpacked(again, 2)[0]] = False
        at = at[alone[at]]  # distinct windows, each once
        mine = _seeds(h, window, seed)[at]
        hit = np.searchsorted(seeds, mine)
        hit[hit == len(seeds)] = 0
        some = seeds[hit] == mine
        place, prefix, long = at[some], mine[some], extend[hit[some]]
        if not len(place):
            return None
        if long.any():
            prefix[long] = _window_hashes(h, window)[place[long]]
        of = _group(_mixed(prefix), n_groups)
        bucket = np.where(long, _mixed(np.array([name], np.uint64))[0] % np.uint64(n_buckets), -1).astype(np.int64)
        words = list(chain.from_iterable(chunk.words))
        # neighbouring suffixes of one group become one run of words
        order = np.lexsort((place, bucket, of))
        of, bucket, place = of[order], bucket[order], place[order]
        other = np.concatenate([[True], (of[1:] != of[:-1]) | (bucket[1:] != bucket[:-1])])
        new = other | np.concatenate([[True], place[1:] != place[:-1] + 1])
        since = np.arange(len(place)) - np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
        starts = np.flatnonzero(new | (since % most == 0))
        lengths = np.diff(np.append(starts, len(place)))
        names, buckets, blobs = [], [], []
        edges = np.append(np.flatnonzero(other[starts]), len(starts))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            p, n = place[starts[a:b]], lengths[a:b]
            text = b" ".join([b" ".join(words[i : i + k + window - 1]) for i, k in zip(p.tolist(), n.tolist(), strict=True)])
            names.append(int(of[starts[a]]))
            buckets.append(int(bucket[starts[a]]))
            blobs.append(Runs(p, n, chunk.ids[chunk.doc[p]], text).packed())
        return pa.record_batch([pa.array(names, pa.int64()), pa.array(buckets, pa.int64()), pa.array([name] * len(names), pa.int64()), pa.array(blobs, pa.binary())], ["grp", "bucket", "chunk", "suffixes"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob, again, replies in zip(*(batch.column(c) for c in ("chunk", "blob", "again", "shared")), strict=True):
                made = of_chunk(name.as_py(), blob.as_py(), again.as_py(), replies.as_py())
                if made is not None:
                    yield made

    return each


# 4. subtrees


def _named(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers from 0 for the distinct values, in their order, and how many there are."""
    order = np.argsort(values)
    ranked = values[order]
    fresh = np.empty(len(values), bool)
    fresh[:1] = True
    np.not_equal(ranked[1:], ranked[:-1], out=fresh[1:])
    del ranked
    number = np.cumsum(fresh, dtype=np.int32) - np.int32(1)
    out = np.empty(len(values), np.int32)
    out[order] = number
    return out, int(number[-1]) + 1 if len(number) else 0


def _extremes(node: np.ndarray, n: int, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each node, its smallest and its largest document."""
    least, most = np.full(n, np.iinfo(doc.dtype).max, doc.dtype), np.full(n, np.iinfo(doc.dtype).min, doc.dtype)
    np.minimum.at(least, node, doc)
    np.maximum.at(most, node, doc)
    return least, most


def subtree(words: np.ndarray, base: np.ndarray, room: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each suffix, the depth of its deepest node that a smaller document shares (0: none of window words); its node at
    the depth of a window; and the smallest document of those nodes.

    A suffix starts at base in words, has room words and lies in doc. Suffixes have a window's words at least.
    """
    # names of ever longer prefixes: two of half the length, at last two that overlap
    name, width = words, 1
    while width < window:
        step = min(width, window - width)
        if len(name) > step:
            name, _ = _named(name[:-step].astype(np.int64) * (int(name.max()) + 1) + name[step:])
        width += step
    node, n = _named(name[base])
    del name
    least, most = _extremes(node, n, doc)
    top, roots = node, least
    depth = np.where(least[node] < doc, np.int32(window), np.int32(0))
    at = np.flatnonzero((least < most)[node])
    node, level = node[at], window
    n_words = int(words.max()) + 1 if len(words) else 1
    while len(at):
        longer = room[at] > level
        at, node = at[longer], node[longer]
        if not len(at):
            break
        node, n = _named(node.astype(np.int64) * n_words + words[base[at] + level])
        level += 1
        least, most = _extremes(node, n, doc[at])
        depth[at[least[node] < doc[at]]] = level
        alive = (least < most)[node]
        at, node = at[alive], node[alive]
    return depth, top, roots


_FOUND = "chunk long, hits binary, grp long, bucket long, suffixes binary"


def _subtrees(window: int, last: bool):
    """Of a group's suffixes: to each chunk, place and length of the maximal repeats that a smaller document shares.
    Unless this is the last step, also the suffixes of the smallest document of each node of an extended prefix, for the next."""
    fan = FAN

    def each(rows: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        number, ids, starts, counts, docs, places, owners, at = known.setdefault, [], [], [], [], [], [], 0
        for owner, blob in enumerate(rows.column("suffixes")):
            runs = Runs.unpacked(blob.as_py())
            words = runs.text.split()
            ids.append(np.fromiter((number(w, len(known)) for w in words), np.int32, len(words)))
            spans = runs.count + window - 1
            starts.append(at + np.cumsum(spans) - spans)
            at += len(words)
            counts.append(runs.count)
            docs.append(runs.doc)
            places.append(runs.place)
            owners.append(np.full(len(spans), owner, np.int32))
        del runs, words
        ids, starts, counts, docs, places, owners = (np.concatenate(x) for x in (ids, starts, counts, docs, places, owners))
        # of each suffix: its run, its number in the run, its start and its document's rank
        run = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        inside = (np.arange(len(run)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        base, doc = starts[run] + inside, _named(docs)[0][run]
        depth, node, least = subtree(ids, base, counts.astype(np.int32)[run] - inside + np.int32(window - 1), doc, window)
        # a repeat that starts a word after one that reaches as far is not maximal
        maximal = depth > 0
        maximal[1:] &= ~((inside[1:] > 0) & (depth[:-1] > depth[1:]))
        hit = np.flatnonzero(maximal)
        chunks = rows.column("chunk").to_pylist()
        names, blobs = [], []
        edges = np.searchsorted(owners[run[hit]], np.arange(len(chunks) + 1))
        for i, name in enumerate(chunks):
            h = hit[edges[i] : edges[i + 1]]
            if len(h):
                names.append(name)
                blobs.append(_packed(places[run[h]] + inside[h], depth[h]))
        cols = [names, blobs, *([None] * len(names) for _ in range(3))]
        bucket = rows.column("bucket")[0].as_py()
        if not last and bucket >= 0:
            smallest = np.flatnonzero(least[node] == doc)  # one of each node, or several of one repeated doc_id
            spell, grp = list(known), rows.column("grp")[0].as_py()
            edges = np.searchsorted(owners[run[smallest]], np.arange(len(chunks) + 1))
            for i, name in enumerate(chunks):
                s = smallest[edges[i] : edges[i + 1]]
                if len(s):
                    text = b" ".join(spell[w] for b in base[s].tolist() for w in ids[b : b + window].tolist())
                    row = name, None, grp, bucket // fan, Runs(places[run[s]] + inside[s], np.ones(len(s), np.int64), docs[run[s]], text).packed()
                    for col, x in zip(cols, row, strict=True):
                        col.append(x)
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=["chunk", "hits", "grp", "bucket", "suffixes"])

    return each


# 5. marks


def marked(chunk: Chunk, window: int, again: bytes, replies: list[bytes]) -> np.ndarray:
    """Of each word of a chunk, whether it goes."""
    total = int(chunk.starts[-1])

    def covered(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, ends, -1)
        return np.cumsum(edge)[:-1] > 0

    found = np.concatenate([np.zeros((2, 0), np.int64), *(_unpacked(b, 2) for b in replies)], axis=1)
    place, length = found
    foreign = covered(place, place + length - window + 1)  # windows that a smaller document of another chunk has
    later, back = _unpacked(again, 2)
    first = later - back
    here = foreign[first] | (chunk.ids[chunk.doc[first]] < chunk.ids[chunk.doc[later]])
    gone = np.concatenate([np.flatnonzero(foreign), later[here]])
    return covered(gone, gone + window)


def _results(window: int, digest: bool):
    last = "kept_sha256" if digest else "kept_text"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, again, replies in zip(batch.column("blob"), batch.column("again"), batch.column("hits").to_pylist(), strict=True):
                chunk = Chunk.unpacked(blob.as_py())
                gone = marked(chunk, window, again.as_py(), replies or [])
                removed, kept, spans = [], [], []
                for i, words in enumerate(chunk.words):
                    g = gone[chunk.starts[i] : chunk.starts[i + 1]]
                    n = int(g.sum())
                    removed.append(n)
                    stays = b" ".join(words if not n else [w for w, x in zip(words, g.tolist(), strict=True) if not x])
                    kept.append(hashlib.sha256(stays).hexdigest() if digest else stays.decode("utf-8", "replace"))
                    if not digest:
                        edges = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8))).reshape(-1, 2) if n else ()
                        spans.append([{"start": int(a), "end": int(b)} for a, b in edges])
                ids = pa.array(chunk.ids, mask=np.arange(len(chunk.ids)) < chunk.n_null)
                cols = [ids, pa.array(np.diff(chunk.starts)), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
                names = ["doc_id", "n_words", "n_removed", last]
                if not digest:
                    cols.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                    names.append("spans")
                yield pa.record_batch(cols, names)

    return each


def deduplicated(docs: DataFrame, window: int = WINDOW, seed: int = SEED, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and spans (removed word ranges) of every row; with digest, kept_sha256 for the last two."""
    spark = docs.sparkSession
    chunks = written(chunked(docs, window, seed), "chunks")
    total, n_chunks = chunks.agg(F.sum("n_words"), F.count("*")).first()
    n_groups = max(partitions(spark), -(-(total or 0) // GROUP_WORDS))
    n_buckets = max(1, -(-n_chunks // FAN))
    lists = chunks.select("chunk", "seeds", "heavy").mapInArrow(_seed_blocks(n_groups), "grp long, chunk long, seeds binary, heavy binary")
    shared = lists.groupBy("grp").applyInArrow(_shared_seeds(LONG_CHUNKS), "chunk long, shared binary")
    shared = shared.groupBy("chunk").agg(F.collect_list("shared").alias("shared"))  # one from each group at most
    asked = chunks.select("chunk", "blob", "again").join(shared.hint("merge"), "chunk")
    left = asked.mapInArrow(_suffix_blocks(n_groups, n_buckets, window, seed), "grp long, bucket long, chunk long, suffixes binary")
    hits = None
    while True:
        found = written(left.groupBy("grp", "bucket").applyInArrow(_subtrees(window, n_buckets == 1), _FOUND), "hits")
        some = found.where("hits is not null").select("chunk", "hits")
        hits = some if hits is None else hits.unionByName(some)
        if n_buckets == 1:
            break
        left, n_buckets = found.where("suffixes is not null").select("grp", "bucket", "chunk", "suffixes"), -(-n_buckets // FAN)
    hits = hits.groupBy("chunk").agg(F.collect_list("hits").alias("hits"))
    last = "kept_sha256 string" if digest else "kept_text string, spans array<struct<start: long, end: long>>"
    rows = chunks.select("chunk", "blob", "again").join(hits.hint("merge"), "chunk", "left").select("blob", "again", "hits")
    return rows.mapInArrow(_results(window, digest), f"doc_id long, n_words long, n_removed long, {last}")
