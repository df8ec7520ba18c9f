"""Checkpoints and Arrow helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only where it is unset and the master local (tests), one of our own."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="newsloom-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession):
    """What is executed within leaves no shuffle files behind once it has ended; a plan executed again makes them again."""
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df once in the shared checkpoint folder, cut its lineage, and remove the shuffle files that it took.

    What comes back has no estimate of its size: a checkpoint keeps that of its plan, which in a loop of joins or
    cogroups is a product that grows with every round until the planner can't hold it.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    with cleaning(spark):
        made = df.select("*").checkpoint(eager=True)._jdf  # a plan made here knows of the setting
    found = made.queryExecution().logical().rdd().getCheckpointFile()
    plain = DataFrame(spark._jsparkSession.internalCreateDataFrame(made.queryExecution().toRdd(), made.schema(), False), spark)
    plain.checkpoint_file = found.get() if found.isDefined() else None
    return plain


def released(df: DataFrame) -> None:
    """Remove the checkpoint that cut() made for df, which nothing may read any more."""
    if getattr(df, "checkpoint_file", None):
        dropped(df.checkpoint_file)


def saved(df: DataFrame) -> DataFrame:
    """df as written to Parquet in the shared folder and read back: cuts the lineage like cut(), and estimates of size follow the files.

    A checkpoint keeps the estimate of the plan that made it; in a loop of joins that number grows with every round.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    with cleaning(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a folder's address; plain paths are local."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file whole under a name of its own, then give it its name; a repeated task replaces it."""
    fs, base = located(folder)
    fs.create_dir(base, recursive=True)
    own = f"{base}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, f"{base}/{name}")


def got(folder: str, name: str) -> bytes:
    """The content of a file that put() wrote."""
    fs, base = located(folder)
    with fs.open_input_stream(f"{base}/{name}") as f:
        return f.read()


def dropped(folder: str) -> None:
    """Remove a folder of files that no later step reads."""
    fs, base = located(folder)
    if fs.get_file_info(base).type == pafs.FileType.Directory:
        fs.delete_dir(base)


def text_size(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts together."""
    return int(docs.agg(F.sum(F.octet_length(text).cast("long")).alias("bytes")).first()["bytes"] or 0)


def share_count(size: int, most: int, spark: SparkSession, least: int = 1 << 20) -> int:
    """Into how many shares to deal ``size`` bytes: as many as bytes ask for at ``most`` each; where these are fewer than partitions, smaller ones of ``least`` bytes."""
    return max(1, -(-size // most), min(partitions(spark), -(-size // least)))


def memory_returned() -> None:
    """Give the memory of finished work back to the system; a Python worker lives on and others need the room."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def partitions(spark: SparkSession) -> int:
    """How many partitions the cluster wants for a shuffle of this input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids fall in the fold of the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column, end to end, and each row's start (one more than rows). Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    rows = len(column)
    if rows == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + rows + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def in_slices(batches, most_bytes: int = 8 << 20, column: str = "text"):
    """Arrow batches cut so that each holds about most_bytes of text at most (one row at least), to bound memory."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, starts = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(starts, starts[at] + most_bytes, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
