"""Packing of documents into training sequences by first-fit decreasing.

Texts are encoded, closed with an end id and cut into pieces of at most one sequence. Documents are dealt into groups at
random, all pieces of one together, and each group is packed by itself: pieces in order of falling length go into the
first open sequence with room, found by walking down a tournament tree of free space.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import in_slices, text_bytes
from newsloom.llm.pretoken import library_words

#: deal is a number for each row of documents, by which its pieces are dealt; pack() drops it.
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset there of each piece. Ties go to the earlier piece and the earlier bin.

    tree[1] is the root; a node holds the most free space below it, so the first bin with room is found in as many
    steps as the tree has levels.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.lexsort((np.arange(n), -lengths)).tolist():
        need, node = int(lengths[i]), 1
        if need > capacity:
            raise ValueError("a piece is longer than a sequence")
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets


def pieces(docs: DataFrame, tokenizer_path: str, sequence: int = 2048, end_id: int = 1, style: str = "word", with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids and end_id, cut into pieces of ``sequence`` and a rest; with_ids adds them as bytes (4 each, little-endian).

    A null or empty text gives one piece that holds only end_id. Ids of rows may be null or repeated. An empty table gives no pieces.
    """
    schema = PIECE + (", ids binary" if with_ids else "")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = library_words(tokenizer_path, style)
        deal = TaskContext.get().partitionId() << 40  # rows of one input partition are numbered, so that repeated rows part
        for batch in in_slices(batches, 2 << 20, text):
            ids, bounds = words.encode(*text_bytes(batch.column(1)))
            rows = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                for at in range(0, len(own), sequence):
                    data = own[at : at + sequence].tobytes()
                    rows.append((key, at, len(data) // 4, zlib.crc32(data), len(own), deal, *([data] if with_ids else [])))
                deal += 1
            kinds = [pa.int64()] * 6 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select(F.col(doc_id).cast("long").alias(doc_id), text).mapInArrow(made, schema)


def pack(cut: DataFrame, documents: int, sequence: int = 2048, group: int = 4096) -> DataFrame:
    """cut with sequence_id and offset: each sequence holds at most ``sequence`` ids, gapless from offset 0.

    ``documents`` is about how many rows there are: groups have about ``group`` of them each, however many there are,
    which bounds a task's memory, whatever the rows hold. sequence_id is the group's number times 2**32 plus the sequence's
    number in its group. An empty table gives no rows.
    """
    groups = max(1, -(-documents // group))
    keyed = cut.withColumn("_group", F.pmod(F.xxhash64(F.lit("packing"), "deal"), F.lit(groups))).drop("deal")

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(table.column("length").to_numpy(), sequence)
        first = table.column("_group").to_numpy() << 32
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(first + bins)).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name != "deal") + ", sequence_id long, offset long"
    return keyed.groupBy("_group").applyInArrow(packed, schema)


def sequences(packed: DataFrame, sequence: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id and its ids as bytes, padded to ``sequence`` unless it ends at a power of two; from packed pieces with ids."""

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        data = b"".join(table.column("ids").to_pylist())
        n = len(data) // 4
        if n & (n - 1):
            data += np.full(sequence - n, pad_id, "<u4").tobytes()
        return pa.table({"sequence_id": table.column("sequence_id").slice(0, 1), "ids": pa.array([data], pa.binary())})

    return packed.select("sequence_id", "offset", "ids").groupBy("sequence_id").applyInArrow(joined, "sequence_id long, ids binary")
