"""Line dedup: range-partitioned line hashes, streamed in order, returned as bitmaps.

Lines long enough to count become 128-bit hashes with their document and position. They are
range-partitioned by hash and descending document and sorted within partitions by hash, document
from the kept end, text and position; a stream over a partition then sees each key's lines together,
the keeping document first. It holds a key's lines only until the documents that decide are
seen, then lets the rest pass, all but the keeper's. A partition border may cut the run of a
hot key between documents; the pieces of cut runs, at most two runs a partition, are told
their count and keeper by a second, small step, so no task ever needs all lines of a key.

The result is a compressed keep bitmap for each text that loses lines. Line hashes are all that is
sorted; to apply the bitmaps, deduplicated() joins them with the texts, which are shuffled once for it.

Defined results: a null or empty text is one empty line; lines whose key is shorter than
min_chars are never dropped; rows with a null doc_id count for no key and lose nothing;
rows that repeat a doc_id, with equal or different texts, count once for a key and each gets
its own row and bitmap. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, arrow_map, discard, partitions, written

MIN_CHARS = 40
MIN_DOCS = 5
_LINES = "h1 long, h2 long, doc_id long, text_id long, pos int, n_lines int"
#: Lines that a stream hands on at a time.
PIECE = 8192


def line_key(line: bytes) -> bytes:
    """UTF-8 of the line, stripped and with A-Z lower-cased."""
    return line.strip(SPACE_BYTES).lower()


def _long_enough(key: bytes, least: int) -> bool:
    n = len(key)
    return n >= least and (n >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, text_id (its hash tells apart the texts of one doc_id) and text."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text")


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2 (a 128-bit hash), doc_id, text_id, pos and n_lines of every line that counts."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        h1, h2, row, at, of = [], [], [], [], []
        for i, text in enumerate(batch.column("text").cast(pa.binary())):
            lines = (text.as_py() or b"").split(b"\n")
            for pos, line in enumerate(lines):
                if len(line) >= min_chars and _long_enough(key := line_key(line), min_chars):
                    x = xxhash.xxh3_128_digest(key)
                    h1.append(int.from_bytes(x[:8], "big", signed=True))
                    h2.append(int.from_bytes(x[8:], "big", signed=True))
                    row.append(i)
                    at.append(pos)
                    of.append(len(lines))
        row = pa.array(row, pa.int64())
        cols = [pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), batch.column("doc_id").take(row), batch.column("text_id").take(row), pa.array(at, pa.int32()), pa.array(of, pa.int32())]
        return pa.record_batch(cols, ["h1", "h2", "doc_id", "text_id", "pos", "n_lines"])

    return _texts(docs.where("doc_id is not null")).mapInArrow(arrow_map(each), _LINES)


class Runs:
    """The lines of one sorted partition, run by run: those sure to go, and those of runs that a border may cut."""

    def __init__(self, min_docs: int):
        self.min_docs, self.key, self.first = min_docs, None, True
        self.out: list[tuple] = []
        self.n_out = 0
        self._start(None)

    def _start(self, key) -> None:
        self.key, self.held, self.n_docs, self.top, self.last, self.sure = key, [], 0, None, None, False

    def _emit(self, lines: tuple[np.ndarray, ...], counted: int) -> None:
        """counted: documents of an undecided run that these lines add; below zero: the lines go."""
        n = len(lines[0])
        counts = np.full(n, min(counted, 0))
        if n:
            counts[0] = counted
            self.out.append((np.full(n, self.key[0]), np.full(n, self.key[1]), counts, np.full(n, self.top), *lines))
            self.n_out += n

    def add(self, key: tuple[int, int], lines: tuple[np.ndarray, ...]) -> None:
        """Lines (doc_id, text_id, pos, n_lines) of a key, the largest document first."""
        if key != self.key:
            if self.key is not None:
                self.first = False
            self._start(key)
        doc = lines[0]
        more = int((doc[1:] != doc[:-1]).sum()) + int(doc[0] != self.last or self.top is None)
        self.top = int(doc[0]) if self.top is None else self.top
        self.n_docs, self.last = self.n_docs + more, int(doc[-1])
        if self.first:  # it may have begun in the partition before
            self._emit(lines, more)
            return
        self.held.append(lines)
        if self.sure or self.n_docs >= self.min_docs:
            self.sure = True
            for part in self.held:
                goes = part[0] != self.top
                self._emit(tuple(x[goes] for x in part), -1)
            self.held = []

    def end(self) -> None:
        """The last run may go on in the next partition."""
        if self.key is None or self.first:
            return
        if self.sure:  # a row that only counts: its line is none
            none = np.array([self.top]), np.zeros(1, np.int64), np.full(1, -1, np.int32), np.zeros(1, np.int32)
            self._emit(none, self.n_docs)
        elif self.held:
            self._emit(tuple(np.concatenate(x) for x in zip(*self.held, strict=True)), self.n_docs)

    def rows(self) -> pa.RecordBatch:
        cols = [np.concatenate(x) for x in zip(*self.out, strict=True)]
        self.out, self.n_out = [], 0
        kinds = [pa.int64()] * 6 + [pa.int32()] * 2
        return pa.record_batch([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["h1", "h2", "n_docs", "top", "doc_id", "text_id", "pos", "n_lines"])


def _streamed(min_docs: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(min_docs)
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, *lines = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            edges = [0, *(np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1).tolist(), len(h1)]
            for a, b in zip(edges, edges[1:], strict=False):
                runs.add((int(h1[a]), int(h2[a])), tuple(x[a:b] for x in lines))
                if runs.n_out >= PIECE:
                    yield runs.rows()
        runs.end()
        if runs.out:
            yield runs.rows()

    return stream


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_id, pos and n_lines of every line to drop."""
    spark = docs.sparkSession
    lines = written(hashed_lines(docs, min_chars), "lines")  # the range partitioner reads it twice
    dealt = lines.repartitionByRange(partitions(spark), "h1", "h2", F.desc("doc_id")).sortWithinPartitions("h1", "h2", F.desc("doc_id"), "text_id", "pos")
    found = written(dealt.mapInArrow(_streamed(min_docs), "h1 long, h2 long, n_docs long, top long, doc_id long, text_id long, pos int, n_lines int"), "runs")
    discard(lines)
    line = ["doc_id", "text_id", "pos", "n_lines"]
    cut = found.where("n_docs >= 0")
    # at most two runs of a partition are cut, so this holds at most two rows for each; documents are never split between their pieces
    whole = cut.groupBy("h1", "h2").agg(F.sum("n_docs").alias("_docs"), F.max("top").alias("_keeper")).where(F.col("_docs") >= min_docs)
    more = cut.where("pos >= 0").join(F.broadcast(whole), ["h1", "h2"]).where("doc_id != _keeper")
    return found.where("n_docs < 0").select(line).unionByName(more.select(line))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_id, n_lines, n_dropped and keep (a zlib-compressed bitmap, first line first) of every text that loses lines."""
    lost = dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "text_id").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("pos"))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        maps = []
        for n, at in zip(batch.column("n_lines").to_pylist(), batch.column("pos").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[at] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        gone = [len(x) for x in batch.column("pos").to_pylist()]
        cols = [batch.column("doc_id"), batch.column("text_id"), batch.column("n_lines").cast(pa.int64()), pa.array(gone, pa.int64()), pa.array(maps, pa.binary())]
        return pa.record_batch(cols, ["doc_id", "text_id", "n_lines", "n_dropped", "keep"])

    return lost.mapInArrow(arrow_map(each), "doc_id long, text_id long, n_lines long, n_dropped long, keep binary")


def kept_lines(text: bytes | None, keep: bytes | None) -> tuple[int, int, bytes]:
    """Number of lines, of dropped lines, and the text that stays."""
    lines = (text or b"").split(b"\n")
    if keep is None:
        return len(lines), 0, b"\n".join(lines)
    stays = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines)).astype(bool)
    kept = [x for x, y in zip(lines, stays.tolist(), strict=True) if y]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, digest: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped and the kept text, or its SHA-256 with digest, of every row."""
    maps = keep_bitmaps(docs, min_chars, min_docs).select("doc_id", "text_id", "keep")
    # the same plan at every size; with the text's hash among the keys, no doc_id is a hot one
    df = _texts(docs).join(maps.hint("merge"), ["doc_id", "text_id"], "left")
    last = "kept_sha256" if digest else "kept_text"

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [kept_lines(t.as_py(), k) for t, k in zip(batch.column("text").cast(pa.binary()), batch.column("keep").to_pylist(), strict=True)]
        kept = [hashlib.sha256(x[2]).hexdigest() if digest else x[2].decode() for x in out]
        return pa.record_batch([batch.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", last])

    return df.select("doc_id", "text", "keep").mapInArrow(arrow_map(each), f"doc_id long, n_lines long, n_dropped long, {last} string")
