"""Token sequences in length-delimited binary record files with an offset index.

A record file is a run of frames. A frame is: the payload's length (8 bytes, little-endian), the masked checksum of
those 8 bytes, the payload, the masked checksum of the payload. A payload is: the document's id (8 bytes, signed;
the lowest number for none), a byte that tells how wide an id is (2 or 4 bytes), 7 zero bytes, the ids. The index
file beside it has 16 bytes for each record: where its frame starts and the payload's length. With the index,
records can be read in any order.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import checkpoint_dir, in_slices, located, partitions, text_bytes
from newsloom.llm.pretoken import library_words

NO_ID = -(1 << 63)
HEAD = struct.Struct("<QI")


def masked(data: bytes) -> int:
    """crc32 rotated right by 15 bits plus a constant, so that a checksum of data that holds checksums stays sound."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A payload with its lengths and checksums."""
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframe(data: bytes | memoryview, at: int = 0) -> tuple[bytes, int]:
    """The payload of the frame at a place, and where the next begins; ValueError if a checksum is wrong."""
    if len(data) - at < HEAD.size:
        raise ValueError("a record is cut off")
    length, check = HEAD.unpack_from(data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError("a record's length is damaged")
    begin, end = at + HEAD.size, at + HEAD.size + length
    payload = bytes(data[begin:end])
    if len(data) < end + 4 or masked(payload) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError("a record is damaged")
    return payload, end + 4


def to_payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    """A document's ids, each in 2 bytes if all of them fit, else in 4."""
    wide = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
    return struct.pack("<qB7x", NO_ID if doc_id is None else doc_id, wide) + ids.astype(f"<u{wide}").tobytes()


def from_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    """The document's id and its ids as little-endian unsigned 32-bit integers."""
    doc_id, wide = struct.unpack_from("<qB", payload)
    return (None if doc_id == NO_ID else doc_id), np.frombuffer(payload, f"<u{wide}", offset=16).astype("<u4")


def write(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text, append end_id, and write records in ascending order of ids into a new folder.

    Returns a row for each file: part, path, rows, tokens. Files are numbered in the order of the ids they hold, nulls
    first, equal ids by text; a null text has only end_id. The folder is in the shared checkpoint folder unless given.
    A task writes under a name of its own and renames at the end, so a repeated task leaves whole files.
    """
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"
    few = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_tie"))
    ordered = few.repartitionByRange(partitions(spark), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        words = library_words(tokenizer_path, "byte")
        fs, base = located(folder)
        fs.create_dir(base, recursive=True)
        own = f"{base}/.{part:06d}-{uuid.uuid4().hex}"
        rows = tokens = at = 0
        with fs.open_output_stream(f"{own}.rec") as out, fs.open_output_stream(f"{own}.idx") as index:
            for batch in in_slices(batches, 2 << 20):
                ids, bounds = words.encode(*text_bytes(batch.column(1)))
                for i, key in enumerate(batch.column(0).to_pylist()):
                    payload = to_payload(key, np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)))
                    data = frame(payload)
                    out.write(data)
                    index.write(struct.pack("<QQ", at, len(payload)))
                    at += len(data)
                rows += batch.num_rows
                tokens += len(ids) + batch.num_rows
        if rows == 0:
            fs.delete_file(f"{own}.rec")
            fs.delete_file(f"{own}.idx")
            return
        path = f"{base}/part-{part:06d}"
        fs.move(f"{own}.rec", f"{path}.rec")
        fs.move(f"{own}.idx", f"{path}.idx")
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/part-{part:06d}"], "rows": pa.array([rows], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    return ordered.mapInArrow(made, "part int, path string, rows long, tokens long")


def read_file(path: str, order: np.ndarray | None = None) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of one file by its index, in file order or any other; checks every frame."""
    fs, base = located(path)
    with fs.open_input_stream(f"{base}.idx") as f:
        index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
    with fs.open_input_file(f"{base}.rec") as f:
        for at, length in (index if order is None else index[order]).tolist():
            f.seek(at)
            payload, _ = unframe(f.read(length + HEAD.size + 4))
            if len(payload) != length:
                raise ValueError("the index does not fit the records")
            yield from_payload(payload)


def sequences(spark, files: list[tuple[str, int]]) -> DataFrame:
    """The records of files, each given with the number of tokens in all files before it: doc_id, start, ids as bytes (little-endian unsigned 32-bit)."""
    listed = spark.createDataFrame(files, "path string, start long").repartition(max(1, len(files)))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, starts, data, held = [], [], [], 0
                for key, ids in read_file(path):
                    keys.append(key)
                    starts.append(start)
                    data.append(ids.tobytes())
                    start += len(ids)
                    held += len(ids)
                    if held > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "start", "ids"])
                        keys, starts, data, held = [], [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "start", "ids"])

    return listed.mapInArrow(made, "doc_id long, start long, ids binary")


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents as records, read the files back, and return doc_id, start, n_tokens, ids_crc32 for each record.

    Only the list of files comes to the driver: one row for each partition. An empty table gives no files and no rows.
    """
    listed = sorted(write(docs, tokenizer_path, None, end_id, doc_id, text).collect(), key=lambda r: r["part"])
    files, start = [], 0
    for r in listed:
        files.append((r["path"], start))
        start += r["tokens"]
    read = sequences(docs.sparkSession, files)
    return read.select("doc_id", "start", F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def remove(spark, folder: str) -> None:
    """Delete a folder of records."""
    fs, base = located(folder)
    if os.path.basename(base).startswith("records-"):
        fs.delete_dir(base)
