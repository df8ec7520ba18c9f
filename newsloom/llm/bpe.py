"""Byte-pair encoding by speculation and verification, and decoding.

The longest vocabulary entries are taken greedily from the left of each distinct word. That proposal is what
merging by rank gives exactly if every two neighbours are compatible: looking back through the merges that made
them, no merge across their border would have come first. All neighbours of many words are tested at once; only
words with an incompatible pair are merged step by step.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsloom.llm.common import in_slices, text_bytes
from newsloom.llm.pretoken import Words, library, spread


@lru_cache
def byte_symbols() -> dict[str, int]:
    """The printable symbol by which byte-level vocabularies write each byte: itself if printable, else 256 and up in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level vocabulary file of the tokenizers library, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, symbols = whole["model"], byte_symbols()
        names = model["vocab"]
        # added tokens have ids beyond the model's; they have no bytes here, and texts with one are decoded by the library
        size = max([*names.values(), *(t["id"] for t in whole.get("added_tokens", ()))]) + 1
        self.token: list[bytes] = [b""] * size
        for name, i in names.items():
            if all(c in symbols for c in name):
                self.token[i] = bytes(symbols[c] for c in name)
        self.id = {t: i for i, t in enumerate(self.token) if t}
        #: The longest entry that begins with one or two given bytes, so that no longer one is tried.
        self.reach: dict[bytes, int] = {}
        for t in self.id:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 0))
        self.rank, self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = names[a], names[b], names[a + b]
            self.merge[x, y] = (rank, z)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = rank, x, y
        keys = sorted((x << 32 | y, rank) for (x, y), (rank, _) in self.merge.items())
        self.pair_keys = np.array([k for k, _ in keys], np.int64)
        self.pair_ranks = np.array([r for _, r in keys], np.int64)
        self.lengths = np.array([len(t) for t in self.token], np.int64)
        self.begins = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        decimals = [b"%d," % i for i in range(size)]
        self.digit_lengths = np.array([len(d) for d in decimals], np.int64)
        self.digit_begins = np.concatenate(([0], np.cumsum(self.digit_lengths)[:-1]))
        self.digits = np.frombuffer(b"".join(decimals), np.uint8)

    def pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of merging x and y; a huge one where they never merge."""
        key = (x << 32) | y
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], 1 << 40)

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of neighbours, whether merging their joined bytes by rank leaves these two tokens."""
        x, y = x.astype(np.int64), y.astype(np.int64)
        limit = np.full(len(x), 1 << 39, np.int64)
        good, at = np.ones(len(x), bool), np.arange(len(x))
        while len(at):
            a, b = x[at], y[at]
            clash = self.pair_rank(a, b) < limit[at]
            good[at[clash]] = False
            at, a, b = at[~clash], a[~clash], b[~clash]
            ra, rb = self.rank[a], self.rank[b]
            more = (ra >= 0) | (rb >= 0)
            at, a, b, ra, rb = at[more], a[more], b[more], ra[more], rb[more]
            undo_left = ra > rb  # equal ranks: the merge further right came last
            x[at] = np.where(undo_left, self.right[a], a)
            y[at] = np.where(undo_left, b, self.left[b])
            limit[at] = np.where(undo_left, ra, rb + 1)
        return good

    def longest_match(self, word: bytes) -> list[int]:
        """Greedy proposal: the longest entry at each place; ValueError if a byte has none."""
        out, at, n, find, reach = [], 0, len(word), self.id.get, self.reach.get
        while at < n:
            end = min(n, at + reach(word[at : at + 2], 1))
            while (token := find(word[at:end])) is None:
                end -= 1
                if end == at:
                    raise ValueError(f"the vocabulary has no entry for byte {word[at]}")
            out.append(token)
            at = end
        return out

    def exact_merge(self, word: bytes) -> list[int]:
        """Merging by rank, the leftmost of equal ranks first. Pairs wait in a heap, so n bytes take about n log n steps."""
        part = [self.id[bytes((b,))] for b in word]
        n, find = len(part), self.merge.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(found[0], i, part[i], part[i + 1]) for i in range(n - 1) if (found := find((part[i], part[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, x, y = heapq.heappop(heap)
            j = after[i]
            if part[i] != x or j >= n or part[j] != y:
                continue  # one of the two has been merged since
            part[i], part[j] = find((x, y))[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := find((part[i], part[k])):
                    heapq.heappush(heap, (found[0], i, part[i], part[k]))
            if (h := before[i]) >= 0 and (found := find((part[h], part[i]))):
                heapq.heappush(heap, (found[0], h, part[h], part[i]))
        return [p for p in part if p >= 0]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Exact ids of each word: proposals, one test of all neighbours, and merging only where it fails."""
        data = [w.encode() for w in words]
        proposed = [[whole] if (whole := self.id.get(d)) is not None and self.rank[whole] >= 0 else self.longest_match(d) for d in data]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(proposed)), lengths)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        failed = np.unique(owner[inner[~self.compatible(flat[inner], flat[inner + 1])]])
        for i in failed.tolist():
            proposed[i] = self.exact_merge(data[i])
        return proposed

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids end to end."""
        return self.bytes[spread(self.begins[ids], self.lengths[ids])]

    def decimal(self, ids: np.ndarray) -> np.ndarray:
        """Ids as decimal digits, a comma after each."""
        return self.digits[spread(self.digit_begins[ids], self.digit_lengths[ids])]


@lru_cache
def vocabulary(path: str) -> Vocabulary:
    """A vocabulary, read once a process."""
    return Vocabulary(path)


@lru_cache
def words_of(path: str) -> Words:
    """The encoder of a vocabulary file; texts with special tokens or unknown code points go to the library."""
    tokenizer = library(path)
    special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())
    return Words("byte", vocabulary(path).encode_words, lambda t: tokenizer.encode(t, add_special_tokens=False).ids, special)


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every whole text; a null text has none."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for batch in in_slices(batches, 2 << 20, text):
            ids, bounds = words.encode(*text_bytes(batch.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lists], ["doc_id", "ids"])

    return docs.select(doc_id, text).mapInArrow(made, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids; bytes that are no UTF-8 become replacement characters. Null ids: null text."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = vocabulary(path)
        tokenizer = library(path)
        for batch in batches:
            out = []
            for row in batch.column(1):
                one = None if not row.is_valid else np.array(row.as_py(), np.int64)
                if one is None:
                    out.append(None)
                elif len(one) and (one.max() >= len(found.lengths) or not found.lengths[one].all()):
                    out.append(tokenizer.decode(one.tolist(), skip_special_tokens=False))
                else:
                    out.append(found.decode(one).tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select(doc_id, ids).mapInArrow(made, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text and return counts and checksums of both.

    One row for each row of docs: a null text is empty (no ids; checksums of the empty string); ids of rows may be
    null or repeated. Texts of any length are encoded whole, in slices of about 2 MB of whole rows.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found, tokenizer = words_of(path), vocabulary(path), library(path)
        for batch in in_slices(batches, 2 << 20, text):
            ids, bounds = words.encode(*text_bytes(batch.column(1)))
            n = batch.num_rows
            lengths = found.lengths[ids]
            special = set(np.searchsorted(bounds, np.flatnonzero(lengths == 0), side="right") - 1)
            digits, data = found.decimal(ids).tobytes(), found.decode(ids).tobytes()
            digit_at = np.concatenate(([0], np.cumsum(found.digit_lengths[ids])))[bounds].tolist()
            byte_at = np.concatenate(([0], np.cumsum(lengths)))[bounds].tolist()
            id_hash, text_hash = [], []
            for i in range(n):
                id_hash.append(hashlib.sha256(digits[digit_at[i] : max(digit_at[i], digit_at[i + 1] - 1)]).hexdigest())
                if i in special:
                    back = tokenizer.decode(ids[bounds[i] : bounds[i + 1]].tolist(), skip_special_tokens=False)
                else:
                    back = data[byte_at[i] : byte_at[i + 1]].decode("utf-8", "replace")
                text_hash.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(np.diff(bounds), pa.int64()), pa.array(id_hash, pa.string()), pa.array(text_hash, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(doc_id, text).mapInArrow(made, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
