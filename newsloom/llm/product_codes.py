"""Product codes of vectors, with partial-distance search for the nearest codebook entry.

Each part of a vector is replaced by the number of the nearest entry of its codebook. The dimensions of a part are taken
in the order of falling variance over its codebook, so that distances grow fast. One entry of each vector, the
nearest by the first dimensions, gets its complete distance; then all entries go on together, dimension by dimension, and an
entry is dropped once its sum so far strictly exceeds the vector's best complete distance. What survives is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import cut
from newsloom.llm.integer_vectors import ROWS, finite, group_sums, matrix, means, scaled

#: Dimensions by which the first complete distance is chosen.
FIRST = 4
#: Rows whose distances to all entries are held at once.
HELD = 1024


def by_variance(book: np.ndarray) -> np.ndarray:
    """Dimensions in the order of falling variance over a codebook's entries."""
    return np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Each row's nearest entry (ties: the lower), its squared distance, and how many squares were added up."""
    turn = by_variance(book)
    x, book = x[:, turn], book[:, turn]
    rows, dims = x.shape
    codes, best, work = np.zeros(rows, np.int64), np.zeros(rows, np.int64), 0
    for low in range(0, rows, HELD):
        part = x[low : low + HELD]
        head = min(FIRST, dims)
        so_far = np.zeros((len(part), len(book)), np.int64)
        for d in range(head):
            gap = part[:, d, None] - book[None, :, d]
            so_far += gap * gap
        guess = so_far.argmin(axis=1)
        gap = part[:, head:] - book[guess][:, head:]
        limit = so_far[np.arange(len(part)), guess] + (gap * gap).sum(axis=1)
        at, entry = np.nonzero(so_far <= limit[:, None])
        total = so_far[at, entry]
        work += so_far.size * head + gap.size
        for d in range(head, dims):
            gap = part[at, d] - book[entry, d]
            total = total + gap * gap
            work += len(at)
            stay = total <= limit[at]
            at, entry, total = at[stay], entry[stay], total[stay]
        least = np.full(len(part), np.iinfo(np.int64).max)
        np.minimum.at(least, at, total)
        won = total == least[at]
        at, entry = at[won], entry[won]
        first = np.unique(at, return_index=True)[1]  # entries of a row are in rising order
        codes[low : low + HELD], best[low : low + HELD] = entry[first], least
    return codes, best, work


def common_size(vectors: DataFrame, vector: str, parts: int) -> int:
    """The most frequent number of components, a multiple of ``parts``, among finite vectors (ties: the larger); 0 without any."""
    sizes = vectors.where(finite(vector)).groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n"))
    found = sizes.where((F.col("size") > 0) & (F.col("size") % parts == 0)).orderBy(F.desc("n"), F.desc("size")).first()
    return found["size"] if found else 0


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", small: int = 1_000_000) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every row that takes part.

    Rows take part whose vector has no null or non-finite components and the table's most frequent length that ``parts``
    divides; components become floor(scale * x). Codebooks begin as the parts of the ``entries`` smallest ids (fewer if
    there are fewer rows; rows of one id in the order of their components; rows without an id last). Repeated rows
    count as often as they come; null labels are one label. An empty table gives no rows. Other columns are left out.
    Components whose distances would exceed 64 bits end the job with an error. Sums of errors by label are joined by
    broadcast up to ``small`` labels, beyond by hash.
    """
    schema = "vec_id long, label string, code string, error long"
    dims = common_size(vectors, vector, parts)
    if not dims:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = scaled(vectors, vector, dims, scale, [F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label")])
    begin = coded.orderBy(F.asc_nulls_last("vec_id"), F.hex("code")).limit(entries).select("code").collect()
    books = np.array([np.frombuffer(bytes(r.code), "<i4") for r in begin], np.int64).reshape(len(begin), parts, dims // parts).transpose(1, 0, 2)

    def split(batch: pa.RecordBatch) -> np.ndarray:
        return matrix(batch.column(2), dims).reshape(-1, parts, dims // parts)

    for _ in range(rounds):

        def assigned(batch: pa.RecordBatch, books=books):
            x = split(batch)
            for p in range(parts):
                yield nearest(x[:, p], books[p])[0] + p * books.shape[1], x[:, p]

        flat = books.reshape(-1, dims // parts)
        books = means(flat, *group_sums(coded, assigned, len(flat), dims // parts)).reshape(books.shape)

    width = max(2, len(f"{books.shape[1] - 1:x}"))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:0{width}x}" for i in range(books.shape[1])], object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = split(part)
                found = [nearest(x[:, p], books[p]) for p in range(parts)]
                code = sum((digits[f[0]] for f in found[1:]), digits[found[0][0]])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(code, pa.string()), pa.array(sum(f[1] for f in found), pa.int64())], ["vec_id", "label", "code", "error"])

    found = cut(coded.mapInArrow(last, schema))
    sums = cut(found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"))
    told = F.broadcast(sums) if sums.count() <= small else sums
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = found.join(told, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
