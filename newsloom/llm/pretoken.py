"""Splitting whole batches of text into words for byte-pair vocabularies, by array operations, and caching each word's ids.

Two splits are known: ``byte`` (words keep the space before them) and ``word`` (lower case, white space dropped). Both
work on code points. Texts with a code point or a special token whose handling is not known here go to the
tokenizers library as a whole, so every text gets the library's ids.
"""

from __future__ import annotations

import hashlib
import os
import unicodedata
from functools import lru_cache

import numpy as np

LETTER, NUMBER, OTHER, SPACE, UNKNOWN = range(5)
#: Code points from here on are left to the library.
KNOWN = 0x3000


@lru_cache
def classes() -> np.ndarray:
    """The class of each code point below KNOWN, and UNKNOWN at the end for all above."""
    out = np.full(KNOWN + 1, UNKNOWN, np.uint8)
    white = {*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F}
    for c in range(KNOWN):
        kind = unicodedata.category(chr(c))
        if c in white:
            out[c] = SPACE
        elif kind[0] in "LN":
            out[c] = LETTER if kind[0] == "L" else NUMBER
        elif kind not in ("Cn", "Cs"):
            out[c] = OTHER
    return out


@lru_cache
def lower_case() -> np.ndarray:
    """The lower case of each code point below KNOWN, letter by letter; 0 where it is not one code point below KNOWN."""
    out = np.arange(KNOWN + 1, dtype=np.uint32)
    for c in range(1, KNOWN):
        small = chr(c).lower() if c != 0x3A3 else chr(0x3C3)
        out[c] = ord(small) if len(small) == 1 and ord(small) < KNOWN else 0
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers, so that all their bits can be used."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Spans of so many bytes or fewer are hashed eight bytes at a time, all together; longer ones one by one.
SHORT = 64


def blocks(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first eight bytes from each place as one number, with zeros from a size on. data: bytes, with eight more at the end."""
    every = np.ndarray(len(data) - 7, "<u8", data.data, strides=(1,))
    cut = np.minimum(sizes, 8).astype(np.uint64) * np.uint64(8)
    mask = np.where(cut == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (cut & np.uint64(63))) - np.uint64(1))
    return every[at] & mask


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, short: int = SHORT) -> np.ndarray:
    """A 64-bit hash of each span of symbols (uint8 or uint16): equal spans, equal hashes, wherever they lie.

    Each block of eight bytes is scrambled into what came before it, so no structure of a word makes hashes meet: spans of up
    to eight bytes meet those of equal length never, others by chance only. Long spans have the digest of a keyed hash.
    """
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    width = symbols.dtype.itemsize
    data = np.concatenate((np.ascontiguousarray(symbols).view(np.uint8), np.zeros(8, np.uint8)))
    at, sizes = starts.astype(np.int64) * width, (ends - starts).astype(np.int64) * width
    out = mixed(blocks(data, at, sizes) ^ (sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    live = np.flatnonzero((sizes > 8) & (sizes <= short))
    step = 8
    while len(live):
        out[live] = mixed((out[live] + np.uint64(0xD6E8FEB86659FD93)) ^ blocks(data, at[live] + step, sizes[live] - step))
        step += 8
        live = live[sizes[live] > step]
    for i in np.flatnonzero(sizes > short).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[at[i] : at[i] + sizes[i]].data, digest_size=8, key=b"span").digest(), "little")
    return out


def code_points(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the first of each row (one more than rows)."""
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(cp) == len(raw):
        return cp, starts
    heads = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return cp, heads[starts]


def split(cp: np.ndarray, first: np.ndarray, style: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts laid end to end. first: each text's first code point, and the end."""
    n = len(cp)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[np.minimum(cp, KNOWN)]
    head = np.zeros(n + 1, bool)
    head[first] = True
    run = head[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    run[0] = True
    start = np.zeros(n + 1, bool)
    start[:n] = run
    start[n] = True
    if style == "byte":
        after = np.flatnonzero(run & (kind != SPACE) & ~head[:n])
        after = after[kind[after - 1] == SPACE]
        start[after - 1] = True
        start[after[cp[after - 1] == 0x20]] = False
    else:
        start[:n] |= kind == NUMBER
    marks = np.flatnonzero((cp == 0x27) & start[:n])
    if len(marks):
        padded = np.concatenate((cp.astype(np.uint64), np.zeros(3, np.uint64)))
        ends = np.concatenate((head, [True, True, True]))
        one, two = padded[marks + 1], padded[marks + 2]
        short = np.isin(one, np.array([ord(c) for c in "stmd"], np.uint64)) & ~ends[marks + 1]
        pair = (one << np.uint64(32)) | two
        long = np.isin(pair, np.array([(ord(a) << 32) | ord(b) for a, b in ("re", "ve", "ll")], np.uint64)) & ~ends[marks + 1] & ~ends[marks + 2]
        start[marks[short | long] + 1] = False
        for which, length in ((short, 2), (long & ~short, 3)):
            at = marks[which] + length
            at = at[at < n]
            start[at[(kind[at] == LETTER) & ~head[at]]] = True
    begins = np.flatnonzero(start[:n])
    stops = np.flatnonzero(start)[1:]
    if style == "word":
        real = kind[begins] != SPACE
        begins, stops = begins[real], stops[real]
    return begins, stops


class Words:
    """Ids of whole texts by looking up each distinct word once.

    encode_words: from a list of words to a list of id lists. encode_text: from one text to its ids, for texts with
    anything special. Words are found by a hash and then compared letter by letter; a text with a word that
    another one's hash hides is encoded whole. The cache holds at most ``most`` words, of 2**26 letters in all or
    so, and starts anew when full.
    """

    def __init__(self, style: str, encode_words, encode_text, special: tuple[str, ...], most: int = 800_000):
        self.style, self.encode_words, self.encode_text, self.most = style, encode_words, encode_text, most
        self.special = [s.encode() for s in special]
        self.clear()

    def clear(self) -> None:
        self.where: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.letters, self.written = np.zeros(1 << 16, np.uint16), 0
        self.first, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def learn(self, keys: list[int], words: list[str], letters: np.ndarray, sizes: np.ndarray) -> None:
        """Keep the ids of new words, and their letters, laid end to end."""
        ids = self.encode_words(words)
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        total, at, n = int(lengths.sum()), len(self.where), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while at + n > len(self.begin):
            self.begin, self.length, self.first, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.begin, self.length, self.first, self.size))
        while self.written + len(letters) > len(self.letters):
            self.letters = np.concatenate((self.letters, np.zeros_like(self.letters)))
        self.letters[self.written : self.written + len(letters)] = letters
        self.size[at : at + n] = sizes
        self.first[at : at + n] = self.written + np.cumsum(sizes) - sizes
        self.written += len(letters)
        self.flat[self.used : self.used + total] = np.fromiter((x for one in ids for x in one), np.uint32, total)
        self.length[at : at + n] = lengths
        self.begin[at : at + n] = self.used + np.concatenate(([0], np.cumsum(lengths[:-1]))) if n else 0
        self.used += total
        self.where.update(zip(keys, range(at, at + n), strict=True))

    def unusual(self, raw: np.ndarray, starts: np.ndarray, cp: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows that only the library can encode."""
        odd = np.zeros(len(starts) - 1, bool)
        data = raw.tobytes()
        seen = data.lower() if self.style == "word" else data
        for mark in self.special:
            at = seen.find(mark)
            while at >= 0:
                odd[np.searchsorted(starts, at, side="right") - 1] = True
                at = seen.find(mark, at + 1)
        strange = classes()[np.minimum(cp, KNOWN)] == UNKNOWN
        if self.style == "word":
            strange |= lower_case()[np.minimum(cp, KNOWN)] == 0
            composed = cp >= 0x300
            for row in np.unique(np.searchsorted(first, np.flatnonzero(composed), side="right") - 1):
                odd[row] |= not unicodedata.is_normalized("NFC", data[starts[row] : starts[row + 1]].decode())
        odd[np.searchsorted(first, np.flatnonzero(strange), side="right") - 1] = True
        return odd

    def encode(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end (uint32), and the first of each row (one more than rows)."""
        rows = len(starts) - 1
        cp, first = code_points(raw, starts)
        odd = self.unusual(raw, starts, cp, first)
        if self.style == "word":
            cp = lower_case()[np.minimum(cp, KNOWN)]
        begins, stops = split(cp, first, self.style)
        row = np.searchsorted(first, begins, side="right") - 1
        if odd.any():
            plain = ~odd[row]
            begins, stops, row = begins[plain], stops[plain], row[plain]
        letters, sizes = np.minimum(cp, KNOWN).astype(np.uint16), stops - begins
        keys, at, inverse = np.unique(span_hashes(letters, begins, stops), return_index=True, return_inverse=True)
        if len(self.where) + len(keys) > self.most or self.written > 1 << 26:
            self.clear()
        known = keys.tolist()
        new = [i for i, k in enumerate(known) if k not in self.where]
        if new:
            b, e = begins[at[new]], stops[at[new]]
            text = [cp[x:y].tobytes().decode("utf-32-le") for x, y in zip(b.tolist(), e.tolist(), strict=True)]
            self.learn([known[i] for i in new], text, letters[spread(b, e - b)], e - b)
        place = np.fromiter((self.where[k] for k in known), np.int64, len(known))[inverse]
        hidden = self.size[place] != sizes
        same = np.flatnonzero(~hidden)
        wrong = np.flatnonzero(letters[spread(begins[same], sizes[same])] != self.letters[spread(self.first[place[same]], sizes[same])])
        hidden[same[np.searchsorted(np.cumsum(sizes[same]), wrong, side="right")]] = True
        if hidden.any():
            odd[row[hidden]] = True
            plain = ~odd[row]
            place, row = place[plain], row[plain]
        begin, length = self.begin[place], self.length[place].astype(np.int64)
        ids = self.flat[spread(begin, length)]
        counts = np.bincount(row, weights=length, minlength=rows).astype(np.int64)
        bounds = np.concatenate(([0], np.cumsum(counts)))
        if odd.any():
            parts = np.split(ids, bounds[1:-1])
            for i in np.flatnonzero(odd):
                parts[i] = np.array(self.encode_text(raw[starts[i] : starts[i + 1]].tobytes().decode()), np.uint32)
            ids = np.concatenate(parts)
            bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, bounds


def spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... for length[0] numbers, then those of the next span, and so on."""
    total = int(length.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.concatenate(([0], np.cumsum(length)[:-1]))
    return np.repeat(begin - before, length) + np.arange(total)


@lru_cache
def library(path: str):
    """The tokenizers library's tokenizer of a file, once a process, without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


@lru_cache
def library_words(path: str, style: str) -> Words:
    """Words encoded by the tokenizers library. The special tokens are those that the file adds."""
    tokenizer = library(path)
    special = tuple(t.content.lower() if style == "word" else t.content for t in tokenizer.get_added_tokens_decoder().values())

    def words(found: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(found, add_special_tokens=False)]

    return Words(style, words, lambda t: tokenizer.encode(t, add_special_tokens=False).ids, special)
