"""Token ids of a corpus in bit-packed files, in order of doc_id.

A file holds ids of a fixed width, the least number of bits that the vocabulary needs:

    magic | blocks | doc_id (int64) | without id (uint8) | end of each document (int64) | block offsets (int64) | footer (8 x int64)

A block is BLOCK ids from a whole byte on, so an id range is read by its blocks alone. Eight ids of w
bits fill w bytes; numpy packs and unpacks them all at once, lane by lane.

``in_order`` deals the texts by ranges of doc_id and sorts each range; the data source ``packed_ids``
turns a range into ids, writes a file for it, and reads files back. Every attempt of a task writes under
a name of its own, and only the names that Spark commits get into the manifest, so a lost executor
leaves at most a file that nobody reads. The driver handles one short line per file.

Words are looked up: a text is cut at spaces, tabs and line ends, which the tokenizer drops and across
which it never joins, and before closing signs, where it never joins either; each distinct word goes
through the tokenizer once, and a worker process remembers a bounded number of them. The ids are those
of the whole text (tested); a tokenizer for which this doesn't hold takes ``by_words=False``.

Defined cases: a null or empty text has the end id alone; very long texts are encoded whole; rows
without doc_id come first; rows of one doc_id stay apart, in order of a digest of their texts; extra
columns, whatever their names, don't matter; an empty table gives no documents.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .common import checkpoint_dir

MAGIC = b"PACKIDS1"
BLOCK = 4096
END = 1
#: Ids that a task of the reader gets, and that it hands on at once.
READ_IDS, STEP_IDS = 8_000_000, 1_000_000
#: Words whose ids a task remembers, and bytes of text that it encodes at once.
MEMORY, STEP_BYTES = 400_000, 4_000_000
#: Where a word may be cut: the tokenizer begins a new part at a sign after an ASCII letter or digit.
_CLOSING = "([0-9A-Za-z])([.,;:!?)])"


# ---- packing ---------------------------------------------------------------------------------


def width_of(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` at ``bits`` each, little end first; the last group of eight is filled up with zeros."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    groups = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    groups.ravel()[: len(ids)] = ids
    out = np.zeros((len(groups), bits), np.uint8)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        moved = groups[:, lane] << np.uint64(shift)
        for i in range(-(-(shift + bits) // 8)):
            out[:, byte + i] |= (moved >> np.uint64(8 * i)).astype(np.uint8)
    return out.tobytes()


def unpack(data: bytes | np.ndarray, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of packed ``data``, as uint32."""
    groups = np.frombuffer(data, np.uint8)[: -(-count // 8) * bits].reshape(-1, bits)
    out = np.empty((len(groups), 8), np.uint32)
    for lane in range(8):
        byte, shift = divmod(lane * bits, 8)
        both = np.zeros(len(groups), np.uint64)
        for i in range(-(-(shift + bits) // 8)):
            both |= groups[:, byte + i].astype(np.uint64) << np.uint64(8 * i)
        out[:, lane] = both >> np.uint64(shift) & np.uint64((1 << bits) - 1)
    return out.ravel()[:count]


# ---- files -----------------------------------------------------------------------------------


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


class FileWriter:
    """Packs ids block by block; holds no more than a block and the index of its documents."""

    def __init__(self, sink: pa.NativeFile, bits: int):
        self.sink, self.bits, self.at = sink, bits, len(MAGIC)
        self.rest, self.ids = np.array([], np.uint32), 0
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.blocks: list[np.ndarray] = []
        sink.write(MAGIC)

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        n = -(-len(ids) // BLOCK)
        self.blocks.append(self.at + np.arange(n, dtype=np.int64) * (BLOCK // 8 * self.bits))
        self.at += len(data)
        self.sink.write(data)

    def add(self, docs: np.ndarray, nulls: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.docs.append(docs.astype(np.int64))
        self.nulls.append(nulls.astype(np.uint8))
        self.ends.append(self.ids + np.cumsum(lengths, dtype=np.int64))
        self.ids += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        for i in range(0, whole, 64 * BLOCK):
            self._put(ids[i : min(whole, i + 64 * BLOCK)])
        self.rest = ids[whole:]

    def close(self) -> None:
        if len(self.rest):
            self._put(self.rest)
        docs, nulls, ends, blocks = (np.concatenate([np.array([], t), *x]).astype(t) for x, t in ((self.docs, np.int64), (self.nulls, np.uint8), (self.ends, np.int64), (self.blocks, np.int64)))
        for part in (docs, nulls, ends, blocks):
            self.sink.write(part.tobytes())
        self.sink.write(np.array([self.at, len(docs), self.ids, len(blocks), self.bits, BLOCK, 0, 1], np.int64).tobytes())
        self.sink.close()


class PackedFile:
    """Reads the index once and any range of ids or documents by its blocks."""

    def __init__(self, path: str):
        files, name = _filesystem(path)
        self.source = files.open_input_file(name)
        self.source.seek(0)
        if self.source.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path} is no file of packed ids")
        self.source.seek(self.source.size() - 64)
        at, self.n_docs, self.n_ids, n_blocks, self.bits, self.block, _, _ = np.frombuffer(self.source.read(64), np.int64).tolist()
        self.source.seek(at)
        read = lambda n, t: np.frombuffer(self.source.read(n * np.dtype(t).itemsize), t)
        self.doc_ids, self.nulls, self.ends, self.offsets = read(self.n_docs, np.int64), read(self.n_docs, np.uint8), read(self.n_docs, np.int64), read(n_blocks, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]) if self.n_docs else self.ends

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` (exclusive) of the file."""
        if start >= end:
            return np.array([], np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        self.source.seek(int(self.offsets[first]))
        bound = first * self.block
        data = self.source.read(int(self.offsets[last] - self.offsets[first]) + self.block // 8 * self.bits)
        return unpack(data, self.bits, end - bound)[start - bound :]

    def document(self, i: int) -> np.ndarray:
        """Ids of the file's i-th document."""
        return self.ids(int(self.starts[i]), int(self.ends[i]))

    def close(self) -> None:
        self.source.close()


# ---- the data source -------------------------------------------------------------------------

SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


@dataclass
class _Written(WriterCommitMessage):
    shard: int
    name: str | None
    n_docs: int
    n_ids: int


@dataclass
class _Piece(InputPartition):
    name: str
    before: int  # ids of all files before
    first: int
    last: int  # documents of the file


class _Writer(DataSourceArrowWriter):
    """Writes (doc_id, ids), or (doc_id, text) if it has a tokenizer."""

    def __init__(self, path: str, bits: int, tokenizer: str | None, end: int, by_words: bool):
        self.path, self.bits, self.tokenizer, self.end, self.by_words = path, bits, tokenizer, end, by_words

    def _parts(self, batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(doc_ids, all ids, ids per document) of a batch, a bounded part at a time."""
        if self.tokenizer is not None:
            encoder = Encoder.of(self.tokenizer)
            for b in by_bytes(batch.select(["doc_id", "text"]), 1, STEP_BYTES):
                yield b.column(0), *encoder(b.column(1), self.end, self.by_words)
            return
        for b in by_bytes(batch.select(["doc_id", "ids"]), 1, STEP_BYTES):
            ids = b.column(1)
            joined = b"".join(x.as_buffer() if x.is_valid else b"" for x in ids)
            yield b.column(0), np.frombuffer(joined, "<u4"), pc.fill_null(pc.binary_length(ids), 0).to_numpy().astype(np.int64) // 4

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        shard, out, name, n_docs = TaskContext.get().partitionId(), None, None, 0
        for batch in iterator:
            for docs, ids, lengths in self._parts(batch):
                if out is None:
                    files, folder = _filesystem(self.path)
                    files.create_dir(folder, recursive=True)
                    name = f"part-{shard:06d}-{uuid.uuid4().hex}.ids"
                    out = FileWriter(files.open_output_stream(f"{folder}/{name}"), self.bits)
                out.add(pc.fill_null(docs, 0).to_numpy(), docs.is_null().to_numpy(zero_copy_only=False), ids, lengths)
                n_docs += len(lengths)
        if out is not None:
            out.close()
        return _Written(shard, name, n_docs, out.ids if out else 0)

    def commit(self, messages: list) -> None:
        files, folder = _filesystem(self.path)
        files.create_dir(folder, recursive=True)
        lines = [json.dumps({"name": m.name, "docs": m.n_docs, "ids": m.n_ids}) for m in sorted(filter(None, messages), key=lambda m: m.shard) if m.name]
        own = f"{folder}/_manifest-{uuid.uuid4().hex}"
        with files.open_output_stream(own) as f:
            f.write("\n".join(lines).encode())
        files.move(own, f"{folder}/_manifest")

    def abort(self, messages: list) -> None:
        files, folder = _filesystem(self.path)
        for m in messages:
            if m is not None and m.name:
                files.delete_file(f"{folder}/{m.name}")


class _Reader(DataSourceReader):
    def __init__(self, path: str, ids_per_task: int):
        self.path, self.ids_per_task = path, ids_per_task

    def partitions(self) -> list[InputPartition]:
        """A task for each ``ids_per_task`` or so of every file; documents aren't split."""
        files, folder = _filesystem(self.path)
        with files.open_input_stream(f"{folder}/_manifest") as f:
            lines = [json.loads(x) for x in f.read().decode().splitlines()]
        out, before = [], 0
        for x in lines:
            step = max(1, x["docs"] * self.ids_per_task // max(1, x["ids"]))
            out += [_Piece(x["name"], before, i, min(x["docs"], i + step)) for i in range(0, x["docs"], step)]
            before += x["ids"]
        return out

    def read(self, partition: _Piece) -> Iterator[pa.RecordBatch]:
        if partition is None or not hasattr(partition, "name"):
            return
        file, i = PackedFile(f"{self.path}/{partition.name}"), partition.first
        while i < partition.last:
            start = int(file.starts[i])
            end = min(partition.last, max(i + 1, int(np.searchsorted(file.ends, start + STEP_IDS, side="right"))))
            ids = file.ids(start, int(file.ends[end - 1])).astype("<u4")
            at = (np.append(file.starts[i:end], file.ends[end - 1]) - start) * 4
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(file.doc_ids[i:end], mask=file.nulls[i:end].astype(bool)), pa.array(file.starts[i:end] + partition.before),
                    pa.array((file.ends - file.starts)[i:end]), pa.Array.from_buffers(pa.binary(), end - i, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids)]),
                ],
                ["doc_id", "start", "n_tokens", "ids"],
            )
            i = end
        file.close()


class PackedIds(DataSource):
    """``spark.read.format("packed_ids").load(path)``; written by ``write_token_files``."""

    @classmethod
    def name(cls) -> str:
        return "packed_ids"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("ids_per_task", READ_IDS)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        o = self.options
        return _Writer(o["path"], int(o["bits"]), o.get("tokenizer"), int(o.get("end", END)), o.get("by_words", "true") == "true")


# ---- encoding --------------------------------------------------------------------------------


_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")


def _letter_table(tokenizer) -> dict[int, str] | None:
    """What the tokenizer's byte alphabet makes of Latin letters; None unless all that it does to a word of
    letters before its model is to lower it and to write its bytes in that alphabet."""
    parts = json.loads(tokenizer.to_str())
    steps = lambda x, name: (x or {}).get(name) or [x or {}]
    lower = [x.get("type") for x in steps(parts["normalizer"], "normalizers")]
    cuts = steps(parts["pre_tokenizer"], "pretokenizers")
    if lower != ["NFC", "Replace", "Lowercase"] or [x.get("type") for x in cuts] != ["Split", "ByteLevel"]:
        return None
    split, alphabet = cuts
    whole = split["behavior"] == "Removed" and split["invert"] and r"[\p{L}]+" in split["pattern"].get("Regex", "")
    if not whole or alphabet["add_prefix_space"] or alphabet["use_regex"]:
        return None
    from tokenizers import pre_tokenizers

    written = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    letters = [chr(c) for c in range(256) if _LETTERS.fullmatch(chr(c)) and chr(c).islower()]
    return {ord(c): written.pre_tokenize_str(c)[0][0] for c in letters}


class Encoder:
    """A tokenizer with the ids of words that it has met, in two generations of at most MEMORY words each."""

    _kept: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        """The encoder that this worker process has for a file; words that earlier tasks met are known."""
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _letter_table(self.tokenizer)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32. A word of letters alone goes to the tokenizer's model as it is."""
        simple = [_LETTERS.fullmatch(t) is not None for t in texts] if self.letters else [False] * len(texts)
        other = iter(self._encoded([t for t, s in zip(texts, simple, strict=True) if not s]))
        split, letters = self.model.tokenize, self.letters
        ids = [[x.id for x in split(t.lower() if t.isascii() else t.lower().translate(letters))] if s else next(other) for t, s in zip(texts, simple, strict=True)]
        flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        return [flat[4 * a : 4 * b] for a, b in pairwise(accumulate(map(len, ids), initial=0))]

    def _encoded(self, texts: list[str]) -> Iterator[list[int]]:
        for i in range(0, len(texts), 5_000):
            yield from (e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 5_000], add_special_tokens=False))

    def _words(self, words: list[str]) -> list[bytes]:
        young, old = self.young, self.old
        if new := [w for w in words if w not in young]:
            if len(young) + len(new) > MEMORY:
                self.old, self.young = young, {}
                young, old, new = self.young, young, words
            young.update((w, old[w]) for w in new if w in old)
            fresh = [w for w in new if w not in old]
            young.update(zip(fresh, self._ids(fresh), strict=True))
        return [young[w] for w in words]

    def __call__(self, texts: pa.Array, end: int = END, by_words: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each with the end id, and their number by text."""
        texts = pc.fill_null(texts, "")
        if by_words:
            for c in "\t\n\r":
                texts = pc.replace_substring(texts, c, " ")
            lists = pc.split_pattern(pc.replace_substring_regex(texts, _CLOSING, r"\1 \2"), " ")
            of_text, words = np.diff(lists.offsets.to_numpy()), lists.flatten().dictionary_encode()
            parts = self._words(words.dictionary.to_pylist())
        else:
            of_text, words = np.ones(len(texts), np.int64), texts.dictionary_encode()
            parts = self._ids(words.dictionary.to_pylist())
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, first = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size
        code = words.indices.to_numpy().astype(np.int64)
        of_word = size[code]
        last = np.cumsum(of_word)
        source = np.arange(last[-1] if len(last) else 0) + np.repeat(first[code] - last + of_word, of_word)
        upto = np.concatenate([[0], last])[np.concatenate([[0], np.cumsum(of_text)])]
        lengths = np.diff(upto) + 1
        out = np.full(int(lengths.sum()), end, np.uint32)
        out[np.arange(len(source)) + np.repeat(np.arange(len(texts)), lengths - 1)] = flat[source]
        return out, lengths


def by_bytes(batch: pa.RecordBatch, column: int, step: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``step`` bytes in a column (a longer row is a part of its own)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i = 0
    while i < batch.num_rows:
        before = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, before + step, side="right")))
        yield batch.slice(i, j - i)
        i = j


def in_order(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text) dealt by ranges of doc_id and sorted in each."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    # equal doc_ids are told apart by digest and row, so that no number of them makes a range that can't be split
    keyed = own.select("doc_id", F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("row"), "text")
    order = ["doc_id", "digest", "row"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")


def write_token_files(rows: DataFrame, path: str, vocabulary: int, tokenizer: str | None = None, end: int = END, by_words: bool = True) -> None:
    """A packed file for every partition of ``rows``, in the partitions' order, and the manifest.

    ``rows`` are (doc_id, ids), ids as little-endian uint32, or with a ``tokenizer`` (doc_id, text).
    """
    rows.sparkSession.dataSource.register(PackedIds)
    options = {"bits": str(width_of(vocabulary)), "end": str(end), "by_words": str(by_words).lower()} | ({"tokenizer": tokenizer} if tokenizer else {})
    rows.write.format("packed_ids").options(**options).mode("append").save(path)


def read_token_files(spark: SparkSession, path: str, ids_per_task: int = READ_IDS) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; start counts the ids of all documents before."""
    spark.dataSource.register(PackedIds)
    return spark.read.format("packed_ids").option("ids_per_task", str(ids_per_task)).load(path)


def vocabulary_of(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, text: str = "text", end: int = END, by_words: bool = True) -> DataFrame:
    """Encodes, writes and reads back: one row per document, from the files."""
    spark = docs.sparkSession
    path = path or f"{checkpoint_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_token_files(in_order(docs, text), path, max(end + 1, vocabulary_of(tokenizer)), tokenizer, end, by_words)
    return read_token_files(spark, path)
