"""Packing of documents into fixed-length sequences (operator 1).

Method: first-fit decreasing with a tournament tree of bin capacities, run
independently in randomised groups of documents.  Every document is tokenized
once, where it is read; its ids are cut at multiples of the sequence length, so
that only the last piece of a document can be short.  A piece is then a row of a
few numbers; these rows (never the texts) are shuffled by a hash into groups, and
each group packs its own pieces.  A group holds about ``docs_per_group``
documents and at most ``BLOCK`` pieces of each, whatever the input, so no task
grows with the data; the price is one part-filled sequence or so for each group.

Defined results: a null text counts as empty and gives the end id alone; equal
rows are packed each for itself; null document ids are kept; an empty table gives
no pieces; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe

#: Pieces of one document that may share a group.
BLOCK = 64
#: Sequence ids are group * 2**SHIFT + bin.
SHIFT = 24

PIECES = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class CapacityTree:
    """A tournament tree over bins: each inner node holds the largest free room below it."""

    def __init__(self, bins: int, room: int) -> None:
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = room
        self.free = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """The first bin with room for size, and the offset in it."""
        free, k = self.free, 1
        while k < self.leaves:
            k *= 2
            if free[k] < size:
                k += 1
        found, offset = k - self.leaves, self.room - free[k]
        free[k] -= size
        while k > 1:
            k //= 2
            free[k] = max(free[2 * k], free[2 * k + 1])
        return found, offset


def first_fit_decreasing(sizes: list[int], room: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, for sizes from large to small, none above room."""
    if not sizes:
        return [], []
    tree = CapacityTree(len(sizes), room)
    bins, offsets = zip(*(tree.place(s) for s in sizes))
    return list(bins), list(offsets)


def cut_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
               seq_len: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Tokenize whole texts, put the end id behind each, and cut at multiples of seq_len: a row for each piece."""
    path = vocabulary or bpe.default_path()
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(path)
        for batch in batches:
            row, start, length, crc, total, parts = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                ids = np.append(encoder.encode(text.as_py() or ""), np.array([end_id], dtype="<u4")).astype("<u4", copy=False)
                for a in range(0, len(ids), seq_len):
                    part = ids[a:a + seq_len]
                    row.append(k)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    total.append(len(ids))
                    if with_ids:
                        parts.append(part.tobytes())
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns, names = [*columns, pa.array(parts, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(pieces, PIECES.format(id=kind) + (", ids binary" if with_ids else ""))


def pack_pieces(pieces: DataFrame, groups: int, *, seq_len: int = 1024, seed: int = 20) -> DataFrame:
    """Add sequence_id and offset to rows of doc_id, start, length, ids_crc32 (others are carried along).

    groups: into how many random groups the documents are dealt.
    """
    group = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32"), F.lit(groups)) + F.lit(groups) * F.floor(F.col("start") / (BLOCK * seq_len))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop(columns="packing_group").sort_values(
            ["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), seq_len)
        return pdf.assign(sequence_id=(int(key[0]) << SHIFT) + np.array(bins, dtype="int64"), offset=np.array(offsets, dtype="int64"))

    return pieces.withColumn("packing_group", group).groupBy("packing_group").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, seq_len: int = 1024,
                   end_id: int = 0, docs_per_group: int = 1024, seed: int = 20, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its place: doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset."""
    groups = max(1, -(-docs.count() // docs_per_group))
    pieces = cut_pieces(docs, id_col=id_col, text_col=text_col, vocabulary=vocabulary, seq_len=seq_len, end_id=end_id, with_ids=with_ids)
    return pack_pieces(pieces, groups, seq_len=seq_len, seed=seed)


def sequences(packed: DataFrame, *, seq_len: int = 1024, pad_id: int = 0) -> DataFrame:
    """The sequences themselves, from pieces packed with_ids: sequence_id, n_tokens, ids (padded), doc_lengths.

    A sequence whose length is a power of two stays as it is; others are padded to seq_len.
    """
    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset", kind="stable")
        ids = np.frombuffer(b"".join(pdf["ids"]), dtype="<u4")
        n = len(ids)
        padded = ids if n & (n - 1) == 0 else np.append(ids, np.full(seq_len - n, pad_id, dtype="<u4"))
        return pd.DataFrame({"sequence_id": [key[0]], "n_tokens": [n], "ids": [padded.astype("int64")], "lengths": [pdf["length"].to_numpy()]})

    return packed.groupBy("sequence_id").applyInPandas(build, "sequence_id bigint, n_tokens bigint, ids array<bigint>, lengths array<bigint>")
