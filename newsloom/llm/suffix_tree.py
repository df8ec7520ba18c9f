"""Language-model scores from a probabilistic suffix tree learned from all training documents.

The tree's root holds each token's share of all training tokens. A context of one or more preceding tokens becomes a
state if predicting its training occurrences from its own counts (each left out in turn) beats its parent's
prediction: a divergence test that random counts fail. A state's distribution is smoothed by its parent's, with the
weight of as many occurrences as the context has different next tokens. A token is scored in the longest suffix of its
history that is a state.

The tree grows by one token of context a level, over all documents at once, and lies spread over ranges of hashes. A
pack of documents (about 8 MB of text of one input partition) sends the owner of each range the contexts and next
tokens that it holds, with training counts, and gets totals back in the order in which it asked. Between two levels a
pack's state lies in the shared checkpoint folder: only the places whose context can still have a state among its
extensions. A level is two jobs: packs learn from the last answers and save their state; those answers are removed; packs
ask what follows from their state. So a level's requests never lie beside the answers of the level before. What cannot have a state: a context seen once in training, and one whose next tokens are so well predicted, or so seldom
repeated, that no extension could gain enough: only a next token that an extension has twice or more can gain, so one that
the context itself has once never does. Both rules lose nothing. A next token that is known to follow a shorter
context once in training and in no other document is only counted, not named. A context so frequent that it would fill more than its share of a range is
dealt over several ranges by next token. Tokens are named by the owner of their range, so next tokens are exact; contexts
are compared by 64-bit hashes. Those of one or two tokens are sent as sorted names, which take less than half the room of a hash.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import checkpoint_dir, cut, dropped, got, in_slices, memory_returned, partitions, put, released, share_count, text_bytes, text_size
from newsloom.llm.pretoken import mixed
from newsloom.llm.windows import bucket_of, from_planes, lowered, planes, word_hashes

END = np.uint64(0x5E4D0F7E37A3C6B1)
MIX = np.uint64(0x9FB21C651E98DF25)
#: Steps of a nat in which a parent's log probability is sent, for the divergence test only.
STEP = 1 / 256
#: Bytes of text of a pack and of a range.
PACK, RANGE = 8 << 20, 12 << 20
#: What a range is asked (Level.requests) and what it answers (owned_contexts).
REQUEST = (np.uint64, np.uint64, np.uint8, np.uint32, np.uint32, np.uint64, np.uint32, np.uint16, np.uint8)
ANSWER = (np.uint32, np.uint8, np.uint32, np.uint32, *[np.uint32] * 3, *[np.float64] * 3)
ASKED = "bucket int, pack long, blob binary"
TOLD = "bucket int, pack long, blob binary, tokens long, different long"


def squeezed(*parts: np.ndarray) -> bytes:
    """Arrays as planes, together, compressed."""
    heads = np.array([len(p) for p in parts], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(heads + b"".join(planes(np.ascontiguousarray(p)) for p in parts))


def unsqueezed(blob: bytes, *kinds) -> list[np.ndarray]:
    """The arrays of squeezed()."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    lengths = np.frombuffer(data, "<i8", len(kinds))
    out, at = [], 8 * len(kinds)
    for length, kind in zip(lengths.tolist(), kinds, strict=True):
        size = length * np.dtype(kind).itemsize
        out.append(from_planes(data[at : at + size], kind))
        at += size
    return out


def steps(rising: np.ndarray) -> np.ndarray:
    """Differences of rising numbers."""
    return np.diff(rising, prepend=rising.dtype.type(0))


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the number of each key among them."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], inverse


def spelt(names: list[np.ndarray], depth: int) -> list[np.ndarray]:
    """Contexts as they are sent: steps of the last tokens' names, and of the names before within each last one; longer ones as steps of hashes."""
    first = steps(names[0])
    if depth != 2:
        return [first, first[:0]]
    return [first, np.where(first == 0, steps(names[1]), names[1])]


def hashes_of(sent: list[np.ndarray], depth: int) -> np.ndarray:
    """The hashes of contexts sent as by spelt()."""
    first = np.cumsum(sent[0], dtype=np.uint64)
    if depth > 2:
        return first
    if depth == 1 or not len(first):
        return chained([first])
    total = np.cumsum(sent[1], dtype=np.uint64)
    heads = np.flatnonzero((sent[0] != 0) | (np.arange(len(first)) == 0))
    return chained([first, total - np.repeat((total - sent[1])[heads], np.diff(heads, append=len(first)))])


def chained(names: list[np.ndarray]) -> np.ndarray:
    """Hashes of contexts by their tokens' names, the last token first."""
    hashed = mixed(names[0] + MIX)
    for name in names[1:]:
        hashed = mixed(hashed * MIX + name)
    return hashed


def coded(counts: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Twice a training count, and one more where that is the only occurrence in all documents, held out or not."""
    return np.minimum(counts, 0x7FFFFFFF).astype(np.uint32) * np.uint32(2) + ((counts == 1) & ~held).astype(np.uint32)


class Places:
    """A pack's tokens and what is known of its open places, those whose contexts are to grow.

    Of each row: ids, absent (no id), held, size (tokens). Of each place: token (number among the pack's distinct ones, later by name), row,
    within (place in the row). Of each distinct token: name (given by the owner), code (see coded()). Of the open places:
    logp, own (code of the context that ends there; saved up to 4 where the count itself isn't read again), shares (over how many
    ranges the context before is dealt) and last (no longer context occurs twice). total: each row's log probability in all places that are not open. While contexts have one token only, fan, times and state say for
    each distinct token what it is as a context; logp then follows from these and needs no room.
    """

    TOKENS = {"ids": np.int64, "absent": np.uint8, "held": np.uint8, "size": np.uint32, "token": np.uint32}
    ORDER = {"order": np.uint32}
    NAMES = {**TOKENS, "name": np.uint64, "code": np.uint32}
    OPEN = {"total": np.float64, "open": np.uint32, "logp": np.float32, "own": np.uint32, "shares": np.uint32, "last": np.uint8}
    FIRST = {"total": np.float64, "open": np.uint32, "own": np.uint32, "shares": np.uint32, "last": np.uint8, "fan": np.uint32, "times": np.uint32, "state": np.uint8}

    def packed(self, kinds: dict) -> bytes:
        return squeezed(*(np.asarray(steps(getattr(self, name)) if name in ("open", "name") else getattr(self, name)).astype(kind) for name, kind in kinds.items()))

    def unpacked(self, blob: bytes, kinds: dict) -> None:
        for name, x in zip(kinds, unsqueezed(blob, *kinds.values()), strict=True):
            setattr(self, name, np.cumsum(x, dtype=np.int64 if name == "open" else np.uint64) if name in ("open", "name") else x)
        if "token" in kinds:
            self.row = np.repeat(np.arange(len(self.size)), self.size)
            ends = np.cumsum(self.size, dtype=np.int64)
            self.within = np.arange(len(self.token)) - np.repeat(ends - self.size, self.size)

    def narrowed(self, stay: np.ndarray, logp: np.ndarray, own: np.ndarray, shares: np.ndarray, rare: np.ndarray) -> None:
        """Close the open places that don't stay; new values of the others. rare: where the longer context occurs less than twice, and so does what holds it."""
        after = np.zeros(len(self.token) + 1, bool)
        after[self.open[rare] + 1] = True
        self.last = after[self.open[stay]]
        self.total = self.total + np.bincount(self.row[self.open[~stay]], weights=logp[~stay], minlength=len(self.size))
        self.open, self.logp, self.own, self.shares = self.open[stay], logp[stay], own[stay], shares[stay]

    def root(self, tokens: int, different: int) -> np.ndarray:
        """Log probability of every place's token in the root."""
        return np.log(((self.code >> 1) + 1.0) / (tokens + different + 1.0))[self.token]

    def opened(self, buckets: int, tokens: int, different: int) -> None:
        """Open all places whose context of one token occurs twice or more."""
        code = self.code[self.token]
        times = np.concatenate(([0], code[:-1] >> 1))
        self.open, self.total = np.arange(len(self.token)), np.zeros(len(self.size))
        inner = self.within > 0
        self.narrowed(inner & (times >= 2), self.root(tokens, different), code, dealt(times, buckets, tokens), inner & (times < 2))

    def after_first(self, tokens: int, different: int) -> None:
        """logp of the open places where contexts of one token are known."""
        context = self.token[self.open - 1]
        self.logp = smoothed(self.root(tokens, different)[self.open], self.own >> 1, self.state[context] > 0, self.fan[context].astype(np.float64), self.times[context].astype(np.float64))


def smoothed(logp: np.ndarray, count: np.ndarray, state: np.ndarray, fan: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Log probabilities in contexts: those of the parent, or in a state the smoothed ones."""
    out = logp.astype(np.float64)
    out[state] = np.log((count[state] + fan[state] * np.exp(out[state])) / (times[state] + fan[state]))
    return out


def dealt(times: np.ndarray, buckets: int, tokens: int) -> np.ndarray:
    """Over how many ranges contexts of at most so many occurrences are dealt: as many as they would fill evenly."""
    return np.minimum(buckets, np.maximum(1, -(-times.astype(np.int64) * 4 * buckets // max(1, tokens))))


def tokenised(batch: pa.RecordBatch, folds: int, held: int) -> tuple[Places, np.ndarray, np.ndarray, np.ndarray]:
    """A pack's places before anything is known; its distinct tokens' hashes, in order, their training counts here, and whether held-out documents have them."""
    raw, starts = text_bytes(batch.column(1))
    words, rows, _ = word_hashes(lowered(raw), starts)
    n = batch.num_rows
    size = np.bincount(rows, minlength=n) + 1
    ends = np.cumsum(size)
    token = np.full(int(ends[-1]), END)
    inner = np.ones(len(token), bool)
    inner[ends - 1] = False
    token[inner] = words
    hashes, local = numbered(token)
    places = Places()
    ids = batch.column(0).to_pylist()
    places.ids, places.absent = np.array([i or 0 for i in ids]), np.array([i is None for i in ids])
    places.held = np.array([zlib.crc32(b"" if i is None else str(i).encode()) % folds == held for i in ids], bool)
    # frequent tokens get small numbers, which take less room
    places.order = np.argsort(-np.bincount(local), kind="stable")
    rank = np.empty(len(hashes), np.int64)
    rank[places.order] = np.arange(len(hashes))
    places.size, places.token = size, rank[local]
    out = np.repeat(places.held, size)
    train = np.bincount(local[~out], minlength=len(hashes)).astype(np.uint32)
    elsewhere = np.bincount(local[out], minlength=len(hashes)) > 0
    return places, hashes, train, elsewhere


def unigram_requests(hashes: np.ndarray, train: np.ndarray, elsewhere: np.ndarray, buckets: int) -> list[tuple[int, bytes]]:
    """For each range, this pack's tokens there with their training counts and whether held-out documents have them."""
    bounds = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
    return [(b, squeezed(steps(hashes[low:high]), train[low:high], elsewhere[low:high].astype(np.uint8))) for b, (low, high) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if low < high]


def learn_unigrams(pack: Places, answers: list[tuple[int, bytes]], buckets: int) -> None:
    """Counts and names of this pack's tokens, which are numbered anew in the order of names."""
    parts = [(b, *unsqueezed(blob, np.uint32, np.uint32)) for b, blob in sorted(answers)]
    pack.code = np.concatenate([p[1] for p in parts])[pack.order]
    name = np.concatenate([p[2].astype(np.uint64) * np.uint64(buckets) + np.uint64(p[0]) for p in parts])[pack.order]
    # the only occurrence of a token, and tokens never learned, are in no open context and never named: all of a kind are one
    top = name.max(initial=np.uint64(0))
    pack.name, inverse = numbered(np.where(pack.code == 3, top + np.uint64(2), np.where(pack.code == 0, top + np.uint64(1), name)))
    code = np.empty(len(pack.name), np.uint32)
    code[inverse] = pack.code
    pack.code, pack.token = code, inverse[pack.token]


class Level:
    """The contexts of ``depth`` tokens of a pack's open places: what is asked about them and what the answers tell."""

    def __init__(self, pack: Places, depth: int, buckets: int, tokens: int):
        self.pack, self.depth, self.buckets, self.tokens = pack, depth, buckets, tokens
        if depth <= 2:
            key = pack.token[pack.open - 1].astype(np.uint64)
            if depth == 2:
                key = (key << np.uint64(32)) | pack.token[pack.open - 2].astype(np.uint64)
            key, self.of = numbered(key)
            self.names = [pack.name[(key >> np.uint64(32 * k)) & np.uint64(0xFFFFFFFF)] for k in reversed(range(depth))]
            self.context = chained(self.names)
            # in the order of ranges, within these of names
            order = np.argsort(bucket_of(self.context, buckets).astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            self.of, self.context, self.names = place[self.of], self.context[order], [x[order] for x in self.names]
        else:
            names = pack.name[pack.token]
            self.context, self.of = numbered(chained([names[pack.open - back] for back in range(1, depth + 1)]))
            self.names = [self.context]
        train = pack.held[pack.row[pack.open]] == 0
        logp = pack.logp.astype(np.float64)
        surprise = np.minimum(0xFFFF, np.rint(-logp / STEP))
        size = len(self.context)
        self.lone = lone = (pack.own & 1) == 1
        self.lone_count = np.bincount(self.of[lone], minlength=size)
        self.named = np.flatnonzero(~lone & (pack.own > 1))
        token = pack.token[pack.open[self.named]]
        pair, self.pair_of = numbered((self.of[self.named] << 32) | token.astype(np.int64))
        first = np.empty(len(pair), np.int64)
        first[self.pair_of[::-1]] = self.named[::-1]
        owner, following = pair >> 32, pack.name[pair & 0xFFFFFFFF]
        counts = np.bincount(self.pair_of[train[self.named]], minlength=len(pair))
        elsewhere = np.bincount(self.pair_of[~train[self.named]], minlength=len(pair)) > 0
        shares = np.ones(size, np.int64)
        shares[self.of] = pack.shares
        home = bucket_of(self.context, buckets).astype(np.int64)
        bucket = (home[owner] + (mixed(following ^ MIX) % shares[owner].astype(np.uint64)).astype(np.int64)) % buckets
        # pairs are in the order of contexts, and so of ranges, but for those that are dealt
        self.order = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.int64), kind="stable")
        # what occurs once has no gain, so its surprise isn't read
        surprise = np.where((counts > 0) & (pack.own[first] >= 4), surprise[first], 0)
        self.sent = (bucket[self.order], owner[self.order], following[self.order], counts[self.order], surprise[self.order], elsewhere[self.order])
        # every context asks every range over which it is dealt, so that its sums are whole
        entry = np.repeat(np.arange(size), shares)
        shift = np.arange(len(entry)) - np.repeat(np.cumsum(shares) - shares, shares)
        entry_bucket = (home[entry] + shift) % buckets
        order = np.lexsort((entry, entry_bucket))
        self.entry_bucket, self.entry, self.entry_home = entry_bucket[order], entry[order], shift[order] == 0
        self.alone = (shares == 1)[self.entry]

    def requests(self) -> list[tuple[int, bytes]]:
        """For each range: contexts, whether dealt, how many named next tokens follow, their lone ones' number; then those, with counts, surprise and whether held-out documents have them."""
        bucket, owner, following, counts, surprise, elsewhere = self.sent
        out = []
        edges = np.flatnonzero(np.diff(self.entry_bucket, prepend=-1, append=-1))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            b = int(self.entry_bucket[low])
            a, z = np.searchsorted(bucket, (b, b + 1))
            of, home = self.entry[low:high], self.entry_home[low:high]
            fans = np.bincount(np.searchsorted(of, owner[a:z]), minlength=len(of))
            lone = np.where(home, self.lone_count[of], 0)
            values = (*spelt([x[of] for x in self.names], self.depth), ~self.alone[low:high], fans, lone, following[a:z], counts[a:z], surprise[a:z], elsewhere[a:z])
            out.append((b, squeezed(*(np.asarray(v).astype(k) for v, k in zip(values, REQUEST, strict=True)))))
        return out

    def learn(self, answers: list[tuple[int, bytes]], least_gain: float) -> None:
        """Log probabilities in the states among these contexts, and which places stay open for longer ones."""
        pack, size = self.pack, len(self.context)
        parts = [unsqueezed(blob, *ANSWER) for _, blob in sorted(answers)]
        codes, verdict, fans, totals, *sums = (np.concatenate([np.zeros(0), *c]) for c in zip(*parts, strict=True))
        pairs = np.zeros(len(self.sent[0]), np.int64)
        pairs[self.order] = codes
        # contexts of one range were judged there
        fan, n, state, hopeful = np.zeros(size), np.zeros(size), np.zeros(size, bool), np.zeros(size, bool)
        own_entry, verdict = self.entry[self.alone], verdict.astype(np.int64)
        state[own_entry], hopeful[own_entry] = verdict & 1 > 0, verdict & 2 > 0
        fan[own_entry[verdict & 1 > 0]], n[own_entry[verdict > 0]] = fans, totals  # of the others neither matters
        if len(sums[0]):  # the sums of dealt ones are added up here
            dealt_entry = self.entry[~self.alone]
            which, of = numbered(dealt_entry)
            found = judged(*(np.bincount(of, weights=x.astype(np.float64), minlength=len(which)) for x in sums), least_gain)
            fan[which], n[which], state[which], hopeful[which] = found
        own = np.zeros(len(pack.open), np.int64)
        own[self.lone] = 3
        own[self.named] = pairs[self.pair_of]
        times = own >> 1
        logp = smoothed(pack.logp, times, state[self.of], fan[self.of], n[self.of])
        bound = n[self.of]
        # where the place before is open too, it tells how often the longer context occurs; whether it is open follows from the
        # context alone (but for contexts that occur twice, which aren't dealt), so all packs deal a context alike
        after = np.flatnonzero(np.diff(pack.open) == 1) + 1
        bound[after] = np.minimum(bound[after], times[after - 1])
        inner = pack.within[pack.open] > self.depth
        rare = (pack.last > 0) | (inner & (pack.code[pack.token[pack.open - 1 - np.where(inner, self.depth, 0)]] < 4))
        # of a longer context's two occurrences, one whose next token occurs once leaves none that occurs twice
        futile = (bound == 2) & (times < 2) & (pack.held[pack.row[pack.open]] == 0)
        stay = hopeful[self.of] & (bound >= 2) & inner & ~rare & ~futile
        rare[after] |= times[after - 1] < 2
        if self.depth == 1:
            pack.fan, pack.times, pack.state = (np.zeros(len(pack.name), kind) for kind in (np.uint32, np.uint32, np.uint8))
            context = pack.token[pack.open - 1]
            pack.fan[context], pack.times[context], pack.state[context] = fan[self.of], n[self.of], state[self.of]
        pack.narrowed(stay, logp, own, dealt(bound, self.buckets, self.tokens), rare)


def judged(fan: np.ndarray, once: np.ndarray, more: np.ndarray, gained: np.ndarray, inner: np.ndarray, surprise: np.ndarray, least_gain: float) -> tuple:
    """Different next tokens and occurrences of contexts, which are states, and which can have states among their extensions."""
    n = once + more
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = once * np.log(fan / (n - 1 + fan)) + gained - more * np.log(n - 1 + fan)
    state = (n >= 2) & (np.where(np.isfinite(gain), gain, -1.0) > least_gain)
    # of an extension's next tokens only those with c >= 2 gain, each c * (surprise + log((c - 1) / c)) at most, which grows with c;
    # a state's own surprise is below log(n + fan) - log(c) and half a step (a little more for rounding)
    left = np.where(state, more * (np.log(np.maximum(n + fan, 1)) + 0.51 * STEP) - inner, surprise)
    return fan, n, state, (n >= 2) & (np.maximum(left, 0) > least_gain - 1e-6)


def owned_unigrams(blobs: list[bytes]) -> tuple[list[bytes], int, int]:
    """A range's answers: the coded counts of what each pack asked, and each token's number here; its numbers of tokens and of different ones in training."""
    asked = [unsqueezed(b, np.uint64, np.uint32, np.uint8) for b in blobs]
    names = [np.cumsum(a[0], dtype=np.uint64) for a in asked]
    keys, inverse = numbered(np.concatenate(names))
    totals = np.bincount(inverse, weights=np.concatenate([a[1] for a in asked]), minlength=len(keys)).astype(np.uint64)
    number = np.empty(len(keys), np.uint32)
    number[np.argsort(-totals.astype(np.int64), kind="stable")] = np.arange(len(keys))  # frequent tokens get small numbers
    codes = coded(totals, np.bincount(inverse, weights=np.concatenate([a[2] for a in asked]), minlength=len(keys)) > 0)
    bounds = np.cumsum([0] + [len(x) for x in names])
    return [squeezed(codes[inverse[a:b]], number[inverse[a:b]]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], int(totals.sum()), int(np.count_nonzero(totals))


def owned_contexts(blobs: list[bytes], depth: int, least_gain: float, undealt: int) -> list[bytes]:
    """A range's answers: the coded training count of each next token asked; what each context is, with its next tokens if it is a state and occurrences if it is more than closed, or its sums here if it is dealt over several ranges."""
    asked = [unsqueezed(b, *REQUEST) for b in blobs]
    names = [hashes_of(a[:2], depth) for a in asked]
    asked = [a[2:] for a in asked]
    contexts, entry = numbered(np.concatenate(names))
    size = len(contexts)
    joined = lambda k: np.concatenate([a[k] for a in asked])
    several_ranges, lone = joined(0) > 0, joined(2)
    lone = np.bincount(entry, weights=lone, minlength=size)
    owner, following = np.repeat(entry, joined(1)), joined(3)
    bits = int(following.max(initial=0)).bit_length()
    order = np.argsort((owner.astype(np.uint64) << np.uint64(bits)) | following) if bits + size.bit_length() <= 64 else np.lexsort((following, owner))
    owner, following = owner[order], following[order]
    new = np.ones(len(order), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (following[1:] != following[:-1])
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.cumsum(new) - 1
    of = owner[new]
    counts = np.bincount(inverse, weights=joined(4), minlength=len(of))
    parent = np.maximum.reduceat(joined(5)[order], np.flatnonzero(new)) * STEP if len(order) else np.zeros(0)
    codes = coded(counts, np.bincount(inverse, weights=joined(6), minlength=len(of)) > 0)
    several = counts >= 2
    c, at, surprise = counts[several], of[several], parent[several]
    rise = np.log(c - 1) - np.log(c)
    sums = (
        np.bincount(of[counts >= 1], minlength=size) + lone,
        np.bincount(of[counts == 1], minlength=size) + lone,
        np.bincount(at, weights=c, minlength=size),
        np.bincount(at, weights=c * (np.log(c - 1) + surprise), minlength=size),
        np.bincount(at, weights=c * (np.log(c) - rise), minlength=size),
        np.bincount(at, weights=c * np.maximum(surprise + rise, 0), minlength=size),
    )
    fan, n, state, hopeful = judged(*sums, least_gain)
    # counts in contexts that are no states only bound those of longer ones; up to undealt, more than two are alike
    plain = ~state & (n <= undealt) & (np.bincount(entry, weights=several_ranges, minlength=size) == 0)
    n, codes = np.where(plain, np.minimum(n, 3), n), np.where(plain[of], np.minimum(codes, 6), codes)
    verdict = state.astype(np.uint8) + hopeful.astype(np.uint8) * np.uint8(2)
    out, p, e = [], 0, 0
    for a, own in zip(asked, names, strict=True):
        mine, k = entry[e : e + len(own)], len(a[3])
        apart = several_ranges[e : e + len(own)]
        whole = mine[~apart]
        values = (codes[inverse[p : p + k]], verdict[whole], fan[whole[state[whole]]], n[whole[verdict[whole] > 0]], *(x[mine[apart]] for x in sums))
        out.append(squeezed(*(v.astype(kind) for v, kind in zip(values, ANSWER, strict=True))))
        p, e = p + k, e + len(own)
    return out


def score(docs: DataFrame, folds: int = 7, held: int = 2, depth: int = 6, least_gain: float = 2.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text).

    Tokens are words in lower case (A-Z) and one end for each document. Documents whose crc32 of the id as text leaves
    ``held`` modulo ``folds`` are scored but not learned from; a null id counts as the empty text. base_score is the sum of
    log10((c+1)/(N+V+1)), score the log10 probability in the tree; an unknown token has the root's probability of one more token.
    Contexts grow up to ``depth`` tokens, or until none can gain more than ``least_gain`` nats. A null or empty text has only
    its end. Rows are kept whatever they hold; repeated rows count as often as they come. An empty table gives no rows.
    docs must give the same rows in the same partitions when read again, as tables do.
    """
    spark = docs.sparkSession
    size, width = text_size(docs), partitions(spark)
    buckets = share_count(size, RANGE, spark)
    each = max(1, size // share_count(size, PACK, spark))
    folder = f"{checkpoint_dir(spark)}/suffix-tree-{uuid.uuid4().hex}"

    def asked(pack: int, requests: list[tuple[int, bytes]]) -> pa.RecordBatch:
        """Requests as rows, and one without content, so that every pack gets an answer."""
        rows = [*requests, (pack % buckets, None)]
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([pack] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "pack", "blob"])

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(in_slices(batches, each)):
            pack = (TaskContext.get().partitionId() << 32) + number
            places, hashes, train, elsewhere = tokenised(batch, folds, held)
            put(f"{folder}/tokens", str(pack), places.packed(Places.TOKENS))
            put(f"{folder}/order", str(pack), places.packed(Places.ORDER))
            yield asked(pack, unigram_requests(hashes, train, elsewhere, buckets))
            memory_returned()

    def told(owned):
        def answered(table: pa.Table) -> pa.Table:
            memory_returned()
            blobs = table.column("blob").to_pylist()
            real = [i for i, b in enumerate(blobs) if b is not None]
            found, tokens, different = [], None, None
            if real:
                found = owned([blobs[i] for i in real])
                if isinstance(found, tuple):
                    found, tokens, different = found
            for i, b in zip(real, found, strict=True):
                blobs[i] = b
            bucket, pack = table.column("bucket").to_pylist(), table.column("pack").to_pylist()
            if tokens is not None:  # the range's own numbers, for all
                bucket, pack, blobs = [*bucket, bucket[0]], [*pack, -1], [*blobs, None]
            sums = [[None] * (len(pack) - 1) + [x] for x in (tokens, different)]
            return pa.table([pa.array(c, k) for c, k in zip((bucket, pack, blobs, *sums), (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], ["bucket", "pack", "blob", "tokens", "different"])

        return answered

    def placed(pack: int, level: int, tokens: int, different: int) -> Places:
        """A pack as it is before a level's contexts are asked."""
        places = Places()
        places.unpacked(got(f"{folder}/names", str(pack)), Places.NAMES)
        if level == 1:
            places.opened(buckets, tokens, different)
        elif level == 2:
            places.unpacked(got(f"{folder}/{level}", str(pack)), Places.FIRST)
            places.after_first(tokens, different)
        else:
            places.unpacked(got(f"{folder}/{level}", str(pack)), Places.OPEN)
        return places

    def learned(table: pa.Table, level: int, tokens: int, different: int) -> tuple[int, Places]:
        """A pack after the answers of a level; with those of level 0 it is saved anew with its names."""
        memory_returned()
        pack = table.column("pack")[0].as_py()
        answers = [(b, x) for b, x in zip(table.column("bucket").to_pylist(), table.column("blob").to_pylist(), strict=True) if x is not None]
        if level == 0:
            places = Places()
            places.unpacked(got(f"{folder}/tokens", str(pack)), Places.TOKENS)
            places.unpacked(got(f"{folder}/order", str(pack)), Places.ORDER)
            learn_unigrams(places, answers, buckets)
            put(f"{folder}/names", str(pack), places.packed(Places.NAMES))
            places.opened(buckets, tokens, different)
        else:
            places = placed(pack, level, tokens, different)
            if answers:
                Level(places, level, buckets, tokens).learn(answers, least_gain)
        return pack, places

    def learning(level: int, tokens: int, different: int):
        def made(table: pa.Table) -> pa.Table:
            pack, places = learned(table, level - 1, tokens, different)
            known = np.minimum(places.own, 4)
            if level == 2:
                if not hasattr(places, "fan"):  # no place of this pack has a context
                    places.fan = places.times = places.state = np.zeros(len(places.name))
                places.own = np.where(places.state[places.token[places.open - 1]] > 0, places.own, known)
                put(f"{folder}/{level}", str(pack), places.packed(Places.FIRST))
            elif level > 2:
                places.own = known
                put(f"{folder}/{level}", str(pack), places.packed(Places.OPEN))
            return pa.table({"pack": pa.array([pack], pa.int64())})

        return made

    def asking(level: int, tokens: int, different: int):
        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for pack in batch.column(0).to_pylist():
                    memory_returned()
                    places = placed(pack, level, tokens, different)
                    yield asked(pack, Level(places, level, buckets, tokens).requests() if len(places.open) else [])

        return made

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def scoring(level: int, tokens: int, different: int):
        def made(table: pa.Table) -> pa.Table:
            _, places = learned(table, level, tokens, different)
            total = places.total + np.bincount(places.row[places.open], weights=places.logp, minlength=len(places.size))
            ids = pa.array(places.ids, mask=places.absent.astype(bool))
            known, base = (np.bincount(places.row, weights=x, minlength=len(places.size)) for x in (places.code[places.token] > 1, places.root(tokens, different)))
            columns = [ids, places.held.astype(bool), places.size, known, np.full(len(places.size), tokens), base / np.log(10), total / np.log(10)]
            return pa.table([c if isinstance(c, pa.Array) else pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)], names)

        return made

    requests = docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(begun, ASKED)
    answers = cut(requests.repartition(width, "bucket").groupBy("bucket").applyInArrow(told(owned_unigrams), TOLD))
    sums = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("different"), F.lit(0)).alias("different")).first()
    level, undealt = 0, int(sums[0]) // (4 * buckets)  # contexts of so many occurrences have one range, see dealt()
    while level < depth and not answers.where("blob is not null").isEmpty():
        level += 1
        packs = cut(answers.where("pack >= 0").select("bucket", "pack", "blob").repartition(width, "pack").groupBy("pack").applyInArrow(learning(level, *sums), "pack long"))
        for part in ("tokens", "order") if level == 1 else (level - 1,):
            dropped(f"{folder}/{part}")  # what was learned is saved, so nothing reads this and the last answers any more
        released(answers)
        requests = packs.mapInArrow(asking(level, *sums), ASKED)
        answers = cut(requests.repartition(width, "bucket").groupBy("bucket").applyInArrow(told(lambda blobs, depth=level: owned_contexts(blobs, depth, least_gain, undealt)), TOLD))
        released(packs)
    scores = answers.where("pack >= 0").select("bucket", "pack", "blob").repartition(width, "pack").groupBy("pack").applyInArrow(scoring(level, *sums), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    scores = cut(scores)
    dropped(folder)
    released(answers)
    return scores
