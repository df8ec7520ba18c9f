"""Vectors as scaled integers, stored once for many passes, and exact sums of groups of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import saved

#: Rows of a batch that are worked on at once.
ROWS = 4096


def largest(dims: int) -> int:
    """The largest component whose squared differences, summed over so many dimensions, stay within 64 bits."""
    return int((2**62 / max(1, dims)) ** 0.5) // 2


def finite(vector: str) -> Column:
    """Whether a vector is there and has neither null nor non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~bad


def scaled(vectors: DataFrame, vector: str, dims: int, scale: int, columns: list[Column]) -> DataFrame:
    """``columns`` and code (int32 components, little-endian, of floor(scale * x)) of the finite vectors of ``dims`` components; stored.

    A component beyond largest(dims) can't be told exactly in 64 bits and ends the job with an error that says so.
    """
    kept = vectors.where(finite(vector) & (F.size(vector) == dims)).select(*columns, F.col(vector).cast("array<double>").alias("_x"))
    fields = kept.schema.fields[:-1]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lists = batch.column(len(fields))
            values = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            whole = np.floor(values * scale)
            if np.abs(whole).max(initial=0) > min(largest(dims), 2**31 - 1):
                raise ValueError(f"a vector has a component beyond {largest(dims)}/{scale}; exact distances would exceed 64 bits")
            codes = whole.astype("<i4")
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], pa.array([row.tobytes() for row in codes], pa.binary())], [*(f.name for f in fields), "code"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", code binary"
    return saved(kept.mapInArrow(made, schema))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The components of codes, one row each."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dims).astype(np.int64)


def group_sums(coded: DataFrame, assigned, groups: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """How many members each group has, and the sums of their components. assigned: from a batch to (group, members' components) pairs.

    Every task adds up its own rows, so one row for each group leaves it; the driver gets ``groups`` rows in all.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(groups, np.int64), np.zeros((groups, dims), np.int64)
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                for group, rows in assigned(batch.slice(low, ROWS)):
                    count += np.bincount(group, minlength=groups)
                    order = np.argsort(group, kind="stable")
                    used, first = np.unique(group[order], return_index=True)
                    if len(used):
                        total[used] += np.add.reduceat(rows[order], first)
        used = np.flatnonzero(count)
        if len(used):
            sums = pa.FixedSizeListArray.from_arrays(pa.array(total[used].ravel(), pa.int64()), dims).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used], pa.int64()), sums], ["group", "n", "sums"])

    parts = coded.mapInArrow(made, "group int, n long, sums array<long>")
    # sums of components are exact in 64 bits up to 2**32 rows of the largest components; decimals go on beyond
    rows = parts.groupBy("group").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims))).collect()
    count, total = np.zeros(groups, object), np.zeros((groups, dims), object)
    for r in rows:
        count[r.group] = r.n
        total[r.group] = [int(r[f"s{i}"]) for i in range(dims)]
    return count, total


def means(old: np.ndarray, count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Componentwise floor of sum / count; groups without members stay as they are."""
    return np.array([[int(s) // int(n) for s in t] if n else o.tolist() for o, n, t in zip(old, count, total, strict=True)], np.int64).reshape(old.shape)
