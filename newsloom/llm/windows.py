"""Words and word windows of whole batches of text as 64-bit hashes, and which of them occur more than once.

Documents are first dealt by a hash into many small packs of about 4 MB of text; a pack is the unit that asks and gets
answers. Each pack sends, for each range of hashes in which it has any, a sketch of the windows it holds: sorted 32-bit cells and a count for each. The
owner of the range adds the sketches of all packs up (a count-min sketch of one row, 2**32 cells wide for each
range), which can only overestimate a window's count, and sends each pack those of its cells that count 2 or more.
A pack sends a cell once however often it holds it, so a very common window costs one entry a pack. Packs and ranges
follow the bytes of text. They exchange one message for each pair that shares windows, so never more than there are windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import in_slices, partitions, share_count, text_bytes, text_size
from newsloom.llm.pretoken import mixed, span_hashes

#: Bytes of text read at once, of a pack, and of a range.
SLICE, PACK, RANGE = 4 << 20, 4 << 20, 16 << 20


def word_spans(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and row of each word: a run of bytes other than 0x20 and 0x09-0x0D, within a row."""
    n = len(raw)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    ink = ~((raw == 0x20) | ((raw >= 9) & (raw <= 13)))
    head = np.zeros(n + 1, bool)
    head[starts] = True
    begin = ink.copy()
    begin[1:] &= ~ink[:-1] | head[1:n]
    end = np.ones(n, bool)
    end[:-1] = ~ink[1:] | head[1:n]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end & ink) + 1
    return begins, ends, np.searchsorted(starts, begins, side="right") - 1


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    return raw + (((raw >= 65) & (raw <= 90)) * np.uint8(32)).astype(np.uint8)


def word_hashes(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Each word's hash and row, and the words' spans. Hashed in slices of whole rows, which bounds memory."""
    begins, ends, rows = word_spans(raw, starts)
    out = np.empty(len(begins), np.uint64)
    at = 0
    while at < len(begins):
        stop = int(np.searchsorted(begins, begins[at] + (2 << 20)))
        low, high = begins[at], ends[stop - 1]
        out[at:stop] = span_hashes(raw[low:high], begins[at:stop] - low, ends[at:stop] - low)
        at = stop
    return out, rows, (begins, ends)


def chained(words: list[np.ndarray]) -> np.ndarray:
    """The hash of each sequence of words' hashes; every step scrambles, so that sequences meet by chance only."""
    total = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + w
    return mixed(total)


def window_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each run of ``size`` words of one row, and the number of its first word."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(rows[: len(rows) - size + 1] == rows[size - 1 :])
    return chained([words[k : k + n] for k in range(size)])[first], first


def packed(docs: DataFrame, range_bytes: int = RANGE) -> tuple[DataFrame, int]:
    """doc_id, text, _pack and row_hash, dealt by _pack: the exchange that all passes share; and into how many ranges to deal hashes.

    Rows alike in id and text are dealt by their input partition too, so that many of them don't meet in one pack.
    """
    spark = docs.sparkSession
    size = text_size(docs)
    packs = share_count(size, PACK, spark, PACK >> 4)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("row_hash", row_hash())
    dealt = keyed.select("doc_id", "text", F.pmod(F.xxhash64("row_hash", F.spark_partition_id()), F.lit(packs)).cast("int").alias("_pack"), "row_hash")
    return dealt.repartition(partitions(spark), "_pack"), share_count(size, range_bytes, spark)


def row_hash() -> Column:
    """A hash of a document's id and text, by which results can be joined to documents again."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def planes(numbers: np.ndarray) -> bytes:
    """Unsigned numbers byte by byte: first all low bytes, then the next; runs of zero bytes then compress away."""
    width = numbers.dtype.itemsize
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, width).T).tobytes()


def from_planes(data: bytes, dtype) -> np.ndarray:
    """The numbers of planes()."""
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def deltas(sorted_numbers: np.ndarray) -> bytes:
    """Rising numbers as planes of their steps."""
    return planes(np.diff(sorted_numbers, prepend=sorted_numbers.dtype.type(0)))


def from_deltas(data: bytes, dtype) -> np.ndarray:
    """The numbers of deltas()."""
    return np.cumsum(from_planes(data, dtype), dtype=dtype)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Which of the equal ranges of all hashes each lies in."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def cell_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """A window's cell in the sketch: its range in the upper half, 32 bits of its hash in the lower."""
    return (bucket_of(hashes, buckets) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how many of each, or the sum of their weights."""
    if weights is None:
        return np.unique(keys, return_counts=True)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    at = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)
    return ordered[at], np.add.reduceat(weights[order], at) if len(at) else np.zeros(0, np.int64)


def occurrences(raw: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every window of ``size`` words: hash and row."""
    words, rows, _ = word_hashes(raw, starts)
    found, first = window_hashes(words, rows, size)
    return found, rows[first]


def sketches(packs: DataFrame, windows, buckets: int) -> DataFrame:
    """(bucket, pack, cells, counts): each pack's share of the sketch. windows: from a text column's bytes and starts to (hash, row)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, SLICE):
            raw, starts = text_bytes(batch.column(1))
            pack = batch.column(2).to_numpy(zero_copy_only=False)
            hashes, rows = windows(raw, starts)
            owner = pack[rows]
            out = ([], [], [], [])
            for one in np.unique(owner).tolist():
                cells, counts = counted(cell_of(hashes[owner == one], buckets))
                bucket = (cells >> np.uint64(32)).astype(np.int64)
                edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
                for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    out[0].append(int(bucket[low]))
                    out[1].append(one)
                    out[2].append(deltas(cells[low:high].astype(np.uint32)))
                    out[3].append(planes(np.minimum(counts[low:high], 0xFFFF).astype(np.uint16)))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["bucket", "_pack", "cells", "counts"])

    return packs.mapInArrow(made, "bucket int, _pack int, cells binary, counts binary")


def repeated(shares: DataFrame) -> DataFrame:
    """(_pack, bucket, cells, counts): for each pack its cells that count 2 or more in the sum of all sketches, with that sum."""

    def merged(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        cells = [from_deltas(c, np.uint32) for c in table.column("cells").to_pylist()]
        sizes = np.array([len(c) for c in cells])
        flat = np.concatenate(cells)
        del cells
        counts = np.concatenate([from_planes(c, np.uint16) for c in table.column("counts").to_pylist()]).astype(np.int64)
        keys, sums = counted(flat, counts)
        more = keys[sums >= 2]
        sums = np.minimum(sums[sums >= 2], 0xFFFFFFFF).astype(np.uint32)
        out = ([], [], [])
        packs = np.repeat(table.column("_pack").to_numpy(), sizes)
        at = np.searchsorted(more, flat)
        hit = np.flatnonzero((at < len(more)) & (more[np.minimum(at, max(0, len(more) - 1))] == flat)) if len(more) else np.zeros(0, np.int64)
        pair = np.unique((packs[hit].astype(np.uint64) << np.uint64(32)) | at[hit].astype(np.uint64))
        owner, at = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            out[0].append(int(owner[low]))
            out[1].append(deltas(more[at[low:high]]))
            out[2].append(planes(sums[at[low:high]]))
        return pa.table({"_pack": pa.array(out[0], pa.int32()), "bucket": pa.array([bucket] * len(out[0]), pa.int32()), "cells": pa.array(out[1], pa.binary()), "counts": pa.array(out[2], pa.binary())})

    return shares.groupBy("bucket").applyInArrow(merged, "_pack int, bucket int, cells binary, counts binary")


def answers(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """A pack's repeated cells in order, with their counts."""
    cells, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
    for bucket, c, n in zip(*(table.column(x).to_pylist() for x in ("bucket", "cells", "counts")), strict=True):
        cells.append(from_deltas(c, np.uint32).astype(np.uint64) | np.uint64(bucket << 32))
        counts.append(from_planes(n, np.uint32))
    cells, counts = np.concatenate(cells), np.concatenate(counts)
    order = np.argsort(cells)
    return cells[order], counts[order]


def looked_up(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted number is among sorted keys, and whether it is there."""
    if len(keys) == 0:
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted
