"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read by memory map.

Documents are range-partitioned and sorted by doc_id. Each partition is tokenized into one
pair of files in the shared folder: ``<part>.bin`` holds the ids of its documents end to end, as
little-endian unsigned integers of the least width that holds the vocabulary, and ``<part>.idx``
holds, after a header, its documents' ids and one offset more than it has documents, as 64-bit
integers counting token ids from the partition's start. Null ids stand first; the header counts them. A prefix sum over the partitions' totals
gives each its base, so all offsets are global without a pass over the data.

A task writes to names of its own attempt and returns them; only names that a
successful task returned are ever read, so lost executors and second attempts leave no
trace in the result. Where a tokenizer's own settings say that it folds case and that no
token spans white space (by_words), a word's ids are looked up once and kept, up to a bounded
number of words; any other tokenizer encodes whole texts.

Defined results: a null or empty text is the end id alone; rows that repeat a doc_id follow each
other, ordered by text; a null doc_id comes first. An empty table writes no files. Extra columns
are not read.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import partitions, scratch_path, worker_memo, written

END_ID = 1
MAGIC = b"TLTOKENS"
VERSION = 2
#: magic, version, bytes of an id, documents, of those without doc_id, ids
HEADER = "<8sIIqqq"
#: Words whose ids a worker keeps at most.
MAX_WORDS = 1_000_000
#: Words that tell whether a tokenizer's model may be asked directly.
PROBES = ("a", "the", "qzx", "internationalization", "zzzzqqqqxxxx")
#: The normalizer and the splitter under which texts may be lower-cased and encoded a word at a time.
FOLDING = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTING = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(settings: dict) -> bool:
    """Whether a tokenizer gives a text the ids of its lower-cased words, by its normalizer, splitter, model and added tokens.

    Added tokens are found in the text as it came, so they must be words like ``<|this|>``, which Encoder leaves alone.
    """

    def plain(token: dict) -> bool:
        name = token["content"]
        return name.startswith("<|") and name.endswith("|>") and not any(c.isspace() for c in name) and not any(token.get(x) for x in ("single_word", "lstrip", "rstrip", "normalized"))

    return (
        settings.get("normalizer") == FOLDING
        and settings.get("pre_tokenizer") == SPLITTING
        and not settings.get("truncation")
        and not settings.get("padding")
        and settings["model"].get("type") == "BPE"
        and not settings["model"].get("dropout")
        and all(map(plain, settings.get("added_tokens") or ()))
    )


def filesystem(folder: str):
    """A pyarrow file system and path for a folder of the shared store."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


class Words(dict):
    """Packed ids by word. Two generations of at most MAX_WORDS / 2 words: what is used again survives."""

    def __init__(self, tokenizer, kind: np.dtype):
        self.tokenizer, self.kind, self.old = tokenizer, kind, {}
        # a word of lower-case letters passes the normalizer and the splitter as it is: the model alone gives its ids
        self.split = tokenizer.model.tokenize
        self.direct = all([t.id for t in self.split(w)] == tokenizer.encode(w, add_special_tokens=False).ids for w in PROBES)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.made(word)
            if len(word) > 256:
                return ids
        if len(self) >= MAX_WORDS // 2:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def made(self, word: bytes) -> bytes:
        if self.direct and word.isalpha() and word.islower():
            return np.array([t.id for t in self.split(word.decode())], self.kind).tobytes()
        # the tokenizer lower-cases, and splits between a letter and a stop: variants share one lookup
        if len(word) > 2 and word[-1:] in (b",", b".") and word[-2:-1].isalpha():
            return self[word[:-1]] + self[word[-1:]]
        if word.isascii() and b"<|" not in word and (low := word.lower()) != word:
            return self[low]
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, self.kind).tobytes()


class Encoder:
    """Token ids of whole texts as packed integers, a word at a time where the tokenizer allows it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.width = 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.tokenizer = tokenizer
        with open(path, encoding="utf-8") as file:
            self.words = Words(tokenizer, self.kind) if by_words(json.load(file)) else None
        self.end = np.array([END_ID], self.kind).tobytes()

    def __call__(self, text: bytes) -> bytes:
        if self.words is None:
            return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, self.kind).tobytes() + self.end
        # A-Z can be lowered first unless a combining mark (lead bytes CC and CD) or a special token follows
        if b"\xcc" not in text and b"\xcd" not in text and b"<|" not in text:
            text = text.lower()
        return b"".join(map(self.words.__getitem__, text.split())) + self.end


def write(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Write the files into folder; returns part, name, n_docs, n_tokens and base of every file pair, in order."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = name = stream = None
        ids: list[int] = []
        ends, n_null = [0], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if encode is None:
                encode = worker_memo(f"tokens of {tokenizer}", lambda: Encoder(tokenizer))
                name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}"
                store, root = filesystem(folder)
                store.create_dir(root, recursive=True)
                stream = store.open_output_stream(f"{root}/{name}.bin")
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                packed = encode(text.as_py() or b"")
                stream.write(packed)
                n_null += doc is None  # these sort first
                ids.append(doc or 0)
                ends.append(ends[-1] + len(packed) // encode.width)
        if encode is None:
            return
        stream.close()
        with store.open_output_stream(f"{root}/{name}.idx") as index:
            index.write(struct.pack(HEADER, MAGIC, VERSION, encode.width, len(ids), n_null, ends[-1]))
            index.write(np.array(ids, "<i8").tobytes())
            index.write(np.array(ends, "<i8").tobytes())
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([len(ids)], pa.int64()), pa.array([ends[-1]], pa.int64())], ["part", "name", "n_docs", "n_tokens"])

    spark = docs.sparkSession
    ordered = docs.select("doc_id", "text").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    made = written(ordered.mapInArrow(save, "part int, name string, n_docs long, n_tokens long"), "token-files")
    rows = sorted(made.collect(), key=lambda r: r["part"])  # a row for each file
    base, out = 0, []
    for r in rows:
        out.append((r["part"], r["name"], r["n_docs"], r["n_tokens"], base))
        base += r["n_tokens"]
    return spark.createDataFrame(out, "part int, name string, n_docs long, n_tokens long, base long")


class Reader:
    """Documents of one file pair: a memory map where the store is a local folder, ranged reads elsewhere."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        store, root = filesystem(folder)
        with store.open_input_stream(f"{root}/{name}.idx") as index:
            magic, version, self.width, n_docs, self.n_null, self.n_tokens = struct.unpack(HEADER, index.read(struct.calcsize(HEADER)))
            if magic != MAGIC or version != VERSION:
                raise ValueError(f"{name} is no token file")
            self.doc_ids = np.frombuffer(index.read(8 * n_docs), "<i8")
            self.offsets = np.frombuffer(index.read(8 * (n_docs + 1)), "<i8")
        kind = np.dtype(f"<u{self.width}")
        path = f"{root}/{name}.bin"
        self.map = self.file = None
        if self.n_tokens and isinstance(store, fs.LocalFileSystem):
            self.map = np.memmap(path, kind, "r")
        else:
            self.file, self.kind = store.open_input_file(path), kind

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        if self.map is not None:
            return self.map[a:b]
        self.file.seek(a * self.width)
        return np.frombuffer(self.file.read((b - a) * self.width), self.kind)


def read(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files, from the files."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                found = Reader(folder, name)
                crcs = np.fromiter((zlib.crc32(found[i].astype("<u4").tobytes()) for i in range(len(found))), np.int64, len(found))
                ids = pa.array(found.doc_ids, mask=np.arange(len(found)) < found.n_null)
                whole = pa.record_batch([ids, pa.array(found.offsets[:-1] + base), pa.array(np.diff(found.offsets)), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])
                for i in range(0, whole.num_rows, 10_000):
                    yield whole.slice(i, 10_000)

    n = max(1, files.count())
    return files.repartition(n).mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write docs as token files in the shared folder and return what they say of each document."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read(write(docs, tokenizer, folder), folder)
