"""Benchmark decontamination by greedy string tiling.

Tokens are white-space words, lower-cased and stripped of punctuation. Windows of SEED tokens of
the benchmark's items form an index by rolling hash, sorted; each document's distinct window hashes
are joined with it. Only items whose tokens such shared seeds can cover to THRESHOLD are tiled: running
Karp-Rabin over what the seeds cover finds the greatest length at which unmarked windows of both sides
agree, by bisection; every such match is marked in order of the document unless it overlaps a marked one;
then shorter lengths follow, until none has MIN_MATCH tokens. A document whose tiles cover at
least THRESHOLD of an item's tokens is contaminated, whatever the order of the pieces. Places of equal
windows are never multiplied, so repetitive texts cost no more than others.

Tasks hold one block of the benchmark, of about BLOCK_BYTES of text, at a time. A larger benchmark takes more
passes over the documents, each written before the next begins, not more memory on the driver or in a
task. Documents are mapped where they lie: with one block nothing is shuffled, so a passage that
a third of the documents share is no hot key; with more, clean() joins once, on hashes of contaminated texts.

Defined results: null or empty texts match nothing, nor do items without tokens; items shorter
than SEED tokens match where all their tokens occur in a row; rows that repeat a document are
reported alike. Empty tables give an empty result. Extra columns are not read by leaks().
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, worker_memo, written

SEED = 4
MIN_MATCH = 4
THRESHOLD = 0.5
BLOCK_BYTES = 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: What is stripped at both ends of a word.
_PUNCT = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»“”„‘’‚…–—¡¿·•"
#: Words a task remembers.
MAX_WORDS = 400_000


def token(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(_PUNCT)


def rolling(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of so many tokens."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _BASE + ids[k : k + n]
    return out


class Index:
    """The tokens of a block of items, and the places of its seeds sorted by hash."""

    def __init__(self, items: Iterable[tuple[int, str]], seed: int = SEED, threshold: float = THRESHOLD):
        self.vocab: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            words = [w for w in map(token, (text or "").encode().split()) if w]
            if words:
                self.items.append((item_id, np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.uint64)))
        self.need = np.array([math.ceil(threshold * len(x) - 1e-9) for _, x in self.items], np.int64)
        self.width = np.array([min(seed, len(x)) for _, x in self.items], np.int64)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # by width: hashes, items, places
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            hashes = [rolling(self.items[i][1], w) for i in own.tolist()]
            item = np.repeat(own, [len(h) for h in hashes])
            place = np.concatenate([np.arange(len(h)) for h in hashes])
            flat = np.concatenate(hashes)
            order = np.argsort(flat, kind="stable")
            self.seeds[w] = flat[order], item[order], place[order]

    def candidates(self, ids: np.ndarray) -> list[int]:
        """Items whose tokens are covered enough by seeds that occur in ids too."""
        out: list[int] = []
        for w, (known, items, places) in self.seeds.items():
            mine = np.unique(rolling(ids, w))
            low = np.searchsorted(known, mine)
            mine, low = mine[low < len(known)], low[low < len(known)]
            hit = known[low] == mine
            if not hit.any():
                continue
            low, high = low[hit], np.searchsorted(known, mine[hit], "right")
            n = high - low
            at = np.arange(n.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            item, place = items[at], places[at]
            order = np.lexsort((place, item))
            item, place = item[order], place[order]
            adds = np.full(len(item), w)
            same = item[1:] == item[:-1]
            adds[:-1][same] = np.minimum(w, np.diff(place)[same])
            which, first = np.unique(item, return_index=True)
            out += which[np.add.reduceat(adds, first) >= self.need[which]].tolist()
        return sorted(out)


class Side:
    """Tokens of one side of a tiling; hashes of windows of any length come from one running sum."""

    def __init__(self, ids: np.ndarray, places: np.ndarray, powers: np.ndarray):
        n = len(ids)
        self.ids, self.places, self.free = ids, places, np.ones(n, bool)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((ids + np.uint64(1)) * powers[:n], dtype=np.uint64)])
        self.lift = powers[len(powers) - 1 - np.arange(n)] if n else powers[:0]

    def room(self) -> np.ndarray:
        """How many unmarked tokens stand in a row from each on."""
        n = len(self.ids)
        stop = ~self.free
        ends = np.where(stop, np.arange(n), n)
        breaks = np.flatnonzero(self.places[1:] != self.places[:-1] + 1) + 1
        ends[breaks - 1] = np.minimum(ends[breaks - 1], breaks)  # a window ends before the next stretch
        return np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n)

    def windows(self, length: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of so many unmarked tokens."""
        at = np.flatnonzero(room >= length)
        with np.errstate(over="ignore"):
            return at, (self.sums[at + length] - self.sums[at]) * self.lift[at]


def tiles(a: Side, b: Side, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiling: (length, place in a, place in b) of the marked matches, longest first, then in order of a, then of b."""
    out: list[tuple[int, int, int]] = []
    top = None
    while True:
        room_a, room_b = a.room(), b.room()
        high = min(int(room_a.max(initial=0)), int(room_b.max(initial=0)), len(b.ids) if top is None else top)

        def shared(length: int, room_a=room_a, room_b=room_b) -> bool:
            return bool(np.isin(a.windows(length, room_a)[1], b.windows(length, room_b)[1]).any())

        if high < least or not shared(least):
            return out
        low = least  # the greatest length that is shared, by bisection; the greatest possible is asked first
        probe = high
        while low < high:
            if shared(probe):
                low = probe
            else:
                high = probe - 1
            probe = (low + high + 1) // 2
        at_b, hash_b = b.windows(low, room_b)
        at_a, hash_a = a.windows(low, room_a)
        open_b: dict[int, list[int]] = {}
        for j, h in zip(at_b[::-1].tolist(), hash_b[::-1].tolist(), strict=True):
            open_b.setdefault(h, []).append(j)
        hit = np.isin(hash_a, hash_b)
        for i, h in zip(at_a[hit].tolist(), hash_a[hit].tolist(), strict=True):
            js = open_b[h]
            if not js or not a.free[i : i + low].all():
                continue
            while js:
                j = js.pop()  # one that is marked stays so
                if b.free[j : j + low].all() and (a.ids[i : i + low] == b.ids[j : j + low]).all():
                    out.append((low, int(a.places[i]), int(b.places[j])))
                    a.free[i : i + low] = b.free[j : j + low] = False
                    break
        if not b.free.any():
            return out
        top = low - 1


def matches(ids: np.ndarray, index: Index, least: int = MIN_MATCH) -> list[tuple[int, int, int, int]]:
    """(item, its tokens, tokens covered, first token in the document) for every item covered enough."""
    out = []
    for i in index.candidates(ids):
        item_id, other = index.items[i]
        w, n = int(index.width[i]), len(other)
        covered = np.zeros(len(ids), bool)  # what seeds of this item cover of the document
        for at in (np.flatnonzero(np.isin(rolling(ids, w), rolling(other, w))) + k for k in range(w)):
            covered[at] = True
        places = np.flatnonzero(covered)
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(len(places), n), _BASE)]), dtype=np.uint64)
        found = tiles(Side(ids[places], places, powers), Side(other, np.arange(n), powers), min(least, n))
        total = sum(x[0] for x in found)
        if found and total >= index.need[i]:
            out.append((item_id, n, total, min(x[1] for x in found)))
    return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterable[list[tuple[int, str]]]:
    """The benchmark's items in lists of about bounded size; one list at a time is on the driver."""
    bench = benchmark.select("item_id", "text").where("text is not null")
    size = bench.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, math.ceil(2 * size / block_bytes)) if size > block_bytes else 1
    for i in range(n):
        part = bench if n == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


class Known(dict):
    """Ids of words as they stand in a text: 0 outside the benchmark, -1 for punctuation alone."""

    def __init__(self, vocab: dict[str, int]):
        self.vocab = vocab

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        t = token(word)
        self[word] = x = self.vocab.get(t, 0) if t else -1
        return x


def _judge(docs: DataFrame, items: list[tuple[int, str]], threshold: float, seed: int, least: int) -> Callable[[pa.Array], Iterable[list[tuple[int, int, int, int]]]]:
    """matches() of the texts of a column. The block goes to the workers once; each makes its index once and holds that of one block."""
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def each(texts: pa.Array) -> Iterable[list[tuple[int, int, int, int]]]:
        memo = worker_memo("decontamination index", dict)
        if name not in memo:
            memo.clear()
            index = Index(shared.value, seed, threshold)
            memo[name] = index, Known(index.vocab)
        index, known = memo[name]
        for text in texts.cast(pa.binary()).to_pylist():
            words = (text or b"").split()
            ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            ids = ids[ids >= 0].astype(np.uint64)
            yield matches(ids, index, least) if ids.any() else []

    return each


def _passes(benchmark: DataFrame, one: Callable[[list[tuple[int, str]]], DataFrame]) -> DataFrame:
    """one() of each block; with more than one, each result is written before the next block is read."""
    held, out = None, None
    for items in blocks(benchmark):
        if held is not None:
            part = written(one(held), "leaks")
            out = part if out is None else out.unionByName(part)
        held = items
    return one(held) if out is None else out.unionByName(written(one(held), "leaks"))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED, least: int = MIN_MATCH) -> DataFrame:
    """doc_id, item_id, n_item_tokens, n_covered and at (first matched token) for each contaminated document and item."""

    def one(items: list[tuple[int, str]]) -> DataFrame:
        judge = _judge(docs, items, threshold, seed, least)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(doc, *m) for doc, found in zip(batch.column("doc_id").to_pylist(), judge(batch.column("text")), strict=True) for m in found]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            return pa.record_batch([pa.array(c, pa.int64()) for c in cols], ["doc_id", "item_id", "n_item_tokens", "n_covered", "at"])

        return docs.select("doc_id", "text").mapInArrow(arrow_map(each), "doc_id long, item_id long, n_item_tokens long, n_covered long, at long")

    return _passes(benchmark, one)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED, least: int = MIN_MATCH) -> DataFrame:
    """The rows of docs that no item contaminates, with the columns they came with.

    With one block of items rows are dropped where they lie; with more, the hashes (128 bits) of contaminated texts are gathered block by block.
    """
    lists = iter(blocks(benchmark))
    first = next(lists)
    second = next(lists, None)
    if second is None:
        at, judge = docs.columns.index("text"), _judge(docs, first, threshold, seed, least)

        def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([not found for found in judge(batch.column(at))], pa.bool_()))

        return docs.mapInArrow(arrow_map(whole), docs.schema)
    keys = [F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit(1), "text").alias("_t2")]

    def one(items: list[tuple[int, str]]) -> DataFrame:
        judge = _judge(docs, items, threshold, seed, least)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([bool(found) for found in judge(batch.column("text"))], pa.bool_())).select(["_t1", "_t2"])

        return docs.select("text", *keys).mapInArrow(arrow_map(each), "_t1 long, _t2 long").distinct()

    gone = _passes(benchmark, one).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *keys)
    return rows.join(gone.hint("merge"), ["_t1", "_t2"], "left_anti").select("_row.*")
