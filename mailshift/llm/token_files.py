"""Token ids of documents in binary files, and back (operator 10).

Method: ids are replaced by their rank by frequency, the commonest first, and the
ranks are written in a byte-aligned variable-length coding: one to four bytes
each, with the lengths of four ranks at a time in a control byte, kept apart from
the data.  The reader expands control bytes and ranks by numpy table look-ups.

Documents are sorted by id over the cluster, tokenized once where they land, and
encoded there in blocks of about ``block_ids`` ids, so a task holds one block
whatever the size of its share.  A block counts all of its own ids, ranks them and
carries that table, so every file can be read alone and no second pass over the
corpus is needed for the ranks.  Files are written and read by a Spark data
source (``token_ids``): each attempt of a task writes a file of a new name, and
only what the commit lists in the manifest counts, so lost executors and repeated
attempts do no harm.  The manifest has one line for each file.

Layout of a block, all little-endian: magic ``TIDS``; unsigned 32-bit numbers of
documents, ids and ranks, and of data bytes; crc32 of what follows; doc ids
(int64), whether each is null (uint8), and ids of each (uint32); the id at each
rank (uint32); control bytes; data bytes.

Defined results: a null text counts as empty and gives the end id alone; null
document ids come first; equal rows are written each for itself; an empty table
gives an empty manifest and no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from . import bpe

_HEAD = struct.Struct("<4sIIIII")
_MAGIC = b"TIDS"
#: Lengths of the four ranks that a control byte stands for.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype("uint8") + np.uint8(1)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    size = (1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype("uint8")
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype="uint8")
    codes[:len(ranks)] = size - 1
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    octets = ranks.astype("<u4", copy=False).view("uint8").reshape(-1, 4)
    return control.tobytes(), octets[np.arange(4, dtype="uint8") < size[:, None]].tobytes()


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks back from their control and data bytes."""
    size = _LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(size, dtype="int64")
    starts = ends - size
    out = data[starts].astype("<u4")
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= data[starts[longer] + k].astype("<u4") << np.uint32(8 * k)
    return out


def write_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    counts = np.bincount(ids) if len(ids) else np.zeros(0, dtype="int64")
    table = np.argsort(-counts, kind="stable")[:np.count_nonzero(counts)].astype("<u4")
    rank_of = np.zeros(len(counts), dtype="<u4")
    rank_of[table] = np.arange(len(table), dtype="<u4")
    control, data = encode_ranks(rank_of[ids])
    body = b"".join([
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), np.array([d is None for d in doc_ids], dtype="uint8").tobytes(),
        np.array(lengths, dtype="<u4").tobytes(), table.tobytes(), control, data])
    return _HEAD.pack(_MAGIC, len(doc_ids), len(ids), len(table), len(data), zlib.crc32(body)) + body


def read_block(head: bytes, stream) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Doc ids, ids of each and all ids of the block that begins with ``head``."""
    magic, docs, n, ranks, octets, crc = _HEAD.unpack(head)
    groups = -(-n // 4)
    body = stream.read(13 * docs + 4 * ranks + groups + octets)
    if magic != _MAGIC or zlib.crc32(body) != crc:
        raise ValueError("damaged block")
    at = 0

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(body, dtype=kind, count=count, offset=at)
        at += found.nbytes
        return found

    doc_ids, null, lengths, table = take("<i8", docs), take("u1", docs), take("<u4", docs), take("<u4", ranks)
    control, data = take("u1", groups), take("u1", octets)
    return pa.array(doc_ids, mask=null.astype(bool)), lengths, table[decode_ranks(control, data, n)]


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    shard: int
    name: str
    docs: int
    ids: int


@dataclass
class FileOf(InputPartition):
    name: str
    start: int


class TokenIdWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, rows: Iterator) -> Written:
        shard = TaskContext.get().partitionId()
        fs, folder = _filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        name, docs, ids = f"part-{shard:06d}-{uuid.uuid4().hex}.tids", 0, 0
        with fs.open_output_stream(f"{folder}/{name}") as out:
            for row in rows:
                out.write(row.block)
                docs, ids = docs + row.docs, ids + row.ids
        return Written(shard, name, docs, ids)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = _filesystem(self.path)
        fs.create_dir(folder, recursive=True)
        found = sorted((m for m in messages if m is not None), key=lambda m: m.shard)
        with fs.open_output_stream(f"{folder}/manifest.jsonl") as out:
            for m in found:
                out.write(json.dumps({"name": m.name, "docs": m.docs, "ids": m.ids}).encode() + b"\n")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = _filesystem(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{folder}/{m.name}")


class TokenIdReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[FileOf]:
        fs, folder = _filesystem(self.path)
        start, found = 0, []
        with fs.open_input_stream(f"{folder}/manifest.jsonl") as f:
            for line in f.read().splitlines():
                told = json.loads(line)
                if told["docs"]:
                    found.append(FileOf(told["name"], start))
                start += told["ids"]
        return found or [FileOf("", 0)]

    def read(self, partition: FileOf) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, folder = _filesystem(self.path)
        start = partition.start
        with fs.open_input_stream(f"{folder}/{partition.name}") as f:
            while head := f.read(_HEAD.size):
                doc_ids, lengths, ids = read_block(head, f)
                lengths = lengths.astype("int64")
                ends = np.cumsum(lengths)
                # Byte offsets of an Arrow binary array are the ends of the documents: no copy for each.
                offsets = pa.py_buffer(np.append(0, 4 * ends).astype("int32").tobytes())
                octets = pa.Array.from_buffers(pa.binary(), len(lengths), [None, offsets, pa.py_buffer(ids.astype("<u4", copy=False).tobytes())])
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start + ends - lengths), pa.array(lengths), octets],
                                                 names=["doc_id", "start", "n_tokens", "ids"])
                start += int(ends[-1])


class TokenIds(DataSource):
    """``token_ids``: writes encoded blocks, reads doc_id, start, n_tokens and ids (unsigned 32-bit, little-endian)."""

    @classmethod
    def name(cls) -> str:
        return "token_ids"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, n_tokens bigint, ids binary"

    def writer(self, schema, overwrite: bool) -> TokenIdWriter:
        return TokenIdWriter(self.options["path"])

    def reader(self, schema) -> TokenIdReader:
        return TokenIdReader(self.options["path"])


def encoded_blocks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
                   end_id: int = 2, block_ids: int = 1 << 21) -> DataFrame:
    """Blocks of the documents in ascending order of their ids: the columns block, docs and ids (both numbers)."""
    path = vocabulary or bpe.default_path()
    docs = (docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
            .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = bpe.encoder(path), np.array([end_id], dtype="<u4")
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(parts) if parts else np.empty(0, dtype="<u4")
            made = pa.RecordBatch.from_arrays(
                [pa.array([write_block(doc_ids, lengths, ids)], pa.binary()), pa.array([len(doc_ids)], pa.int64()), pa.array([len(ids)], pa.int64())],
                names=["block", "docs", "ids"])
            doc_ids.clear(), lengths.clear(), parts.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py() or "")
                doc_ids.append(doc_id)
                lengths.append(len(ids) + 1)
                parts += [ids, end]
                held += len(ids) + 1
                if held >= block_ids:
                    yield block()
                    held = 0
        if doc_ids:
            yield block()

    return docs.mapInArrow(encode, "block binary, docs bigint, ids bigint")


def write_token_files(docs: DataFrame, path: str, **how) -> None:
    """Encode documents and write them below path, which must be storage that all executors share."""
    docs.sparkSession.dataSource.register(TokenIds)
    encoded_blocks(docs, **how).write.format("token_ids").mode("append").save(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of each document in the files."""
    spark.dataSource.register(TokenIds)
    return spark.read.format("token_ids").load(path)
