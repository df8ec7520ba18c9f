"""Substring deduplication behind a count-min prefilter.

First pass: packs of documents send sketches of their windows, which are added up (see windows.py). Second pass:
only windows estimated repeated are grouped exactly, by their 64-bit hash, to find the smallest id of a document in
which each starts. No repeated window is lost, since a sketch never underestimates. Third pass: each document drops
the words covered by a window that also starts in a document with a smaller id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.llm.common import text_bytes
from newsloom.llm.pretoken import spread
from newsloom.llm.windows import answers, bucket_of, cell_of, deltas, from_deltas, from_planes, looked_up, occurrences, packed, planes, repeated, sketches, window_hashes, word_hashes

NONE = np.iinfo(np.int64).max


def identities(table: pa.Table) -> np.ndarray:
    """doc_id of each row; a number above all others for none, so that it is never the smaller one."""
    return table.column("doc_id").combine_chunks().fill_null(NONE).to_numpy(zero_copy_only=False).astype(np.int64)


def smallest(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, each with the smallest of its ids."""
    order = np.argsort(hashes, kind="stable")
    hashes, ids = hashes[order], ids[order]
    if not len(hashes):
        return hashes, ids
    at = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    return hashes[at], np.minimum.reduceat(ids, at)


def first_owners(packs: DataFrame, flagged: DataFrame, size: int, buckets: int) -> DataFrame:
    """(_pack, hashes, owners): for each pack, its repeated windows that also start in a document of another pack with a smaller id than any in this one."""

    def asked(docs: pa.Table, found: pa.Table) -> pa.Table:
        out = ([], [], [], [])
        if docs.num_rows and found.num_rows:
            cells, _ = answers(found)
            hashes, rows = occurrences(*text_bytes(docs.column("text")), size)
            _, hit = looked_up(cells, cell_of(hashes, buckets))
            keys, ids = smallest(hashes[hit], identities(docs)[rows[hit]])
            bucket = bucket_of(keys, buckets).astype(np.int64)
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(keys) else [0]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                out[0].append(int(bucket[low]))
                out[1].append(docs.column("_pack")[0].as_py())
                out[2].append(deltas(keys[low:high]))
                out[3].append(planes(ids[low:high].view(np.uint64)))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["bucket", "_pack", "hashes", "owners"])

    schema = "bucket int, _pack int, hashes binary, owners binary"
    wanted = packs.groupBy("_pack").cogroup(flagged.groupBy("_pack")).applyInArrow(asked, schema)

    def owned(table: pa.Table) -> pa.Table:
        hashes = [from_deltas(c, np.uint64) for c in table.column("hashes").to_pylist()]
        ids = [from_planes(c, np.uint64).view(np.int64) for c in table.column("owners").to_pylist()]
        keys, least = smallest(np.concatenate(hashes), np.concatenate(ids))
        out = ([], [], [])
        for pack, own, own_ids in zip(table.column("_pack").to_pylist(), hashes, ids, strict=True):
            at, _ = looked_up(keys, own)
            earlier = least[at] < own_ids
            if earlier.any():
                out[0].append(pack)
                out[1].append(deltas(own[earlier]))
                out[2].append(planes(least[at[earlier]].view(np.uint64)))
        return pa.table([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["_pack", "hashes", "owners"])

    return wanted.groupBy("bucket").applyInArrow(owned, "_pack int, hashes binary, owners binary")


def covered(first: np.ndarray, words: int, size: int) -> np.ndarray:
    """Which words lie in a window that begins at one of ``first``."""
    steps = np.bincount(first, minlength=words + 1)[: words + 1] - np.bincount(first + size, minlength=words + 1)[: words + 1]
    return np.cumsum(steps)[:words] > 0


def deduplicate(docs: DataFrame, size: int = 13, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and row_hash and text, the kept words) for every row of docs (doc_id, text).

    A word goes if a window of ``size`` words over it also starts in a document with a smaller doc_id; windows are
    judged on the input. Null and empty texts have no words. A document without an id comes after all others: its words
    may go, and it takes no other's. Rows that share an id do not take each other's words. Hashes have 64 bits: two
    different windows are taken for one with a chance of about 1e-19 a pair. Other columns are left out.
    """
    packs, buckets = packed(docs)
    flagged = repeated(sketches(packs, lambda raw, starts: occurrences(raw, starts, size), buckets))
    owners = first_owners(packs, flagged, size, buckets)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["row_hash", "text"] * with_text
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.int64(), pa.string()] * with_text

    def cleaned(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        raw, starts = text_bytes(docs.column("text"))
        words, rows, (begins, ends) = word_hashes(raw, starts)
        hashes, first = window_hashes(words, rows, size)
        ids = identities(docs)
        own = ids[rows[first]]
        keys, least = smallest(hashes, own)
        at, _ = looked_up(keys, hashes)
        gone = least[at] < own
        if found.num_rows:
            other, owner = smallest(np.concatenate([from_deltas(c, np.uint64) for c in found.column("hashes").to_pylist()]), np.concatenate([from_planes(c, np.uint64).view(np.int64) for c in found.column("owners").to_pylist()]))
            at, there = looked_up(other, hashes)
            gone |= there & (owner[at] < own)
        kept = ~covered(first[gone], len(words), size)
        n = docs.num_rows
        n_words = np.bincount(rows, minlength=n)
        n_kept = np.bincount(rows[kept], minlength=n)
        lengths = ends[kept] - begins[kept] + 1
        text = np.append(raw, np.uint8(32))[spread(begins[kept], lengths)]
        text[np.cumsum(lengths) - 1] = 32
        bounds = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(n_kept)))].tolist()
        data = text.tobytes()
        parts = [data[a : max(a, b - 1)] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        columns = [docs.column("doc_id").combine_chunks(), pa.array(n_words, pa.int64()), pa.array(n_words - n_kept, pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string())]
        return pa.table(columns + ([docs.column("row_hash"), pa.array([p.decode() for p in parts], pa.string())] if with_text else []), names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", row_hash long, text string" * with_text
    return packs.groupBy("_pack").cogroup(owners.groupBy("_pack")).applyInArrow(cleaned, schema)
