"""Removal of long repeated byte strings by run-length indexes that are spread over the cluster.

Every window of ``size`` bytes is assigned to its anchor: of the 32-byte grams within it, the one with the least
hash. Equal windows have equal anchors, and neighbouring windows mostly share one, so a document is some runs of windows,
each a snippet of about 140 bytes for every 35 bytes of text. First pass: packs of documents add up how often each
anchor occurs (see windows.py). Second pass: snippets of anchors that occur more than once go to the owner of the anchor's
range, each distinct one of a pack once, with the first place where it begins. There the first snippets of every anchor make
a run-length index, and the later ones are streamed against it by matching statistics (see run_index.py): a match of
``size`` bytes or more is a window that begins earlier. Windows that match nothing earlier are told to the packs whose
they are. Third pass: all other windows of repeated anchors go.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import cut, memory_returned, text_bytes
from newsloom.llm.pretoken import blocks, mixed, span_hashes, spread
from newsloom.llm.run_index import cut_out, marked, runs_of, whole_windows
from newsloom.llm.substring_dedup import identities
from newsloom.llm.windows import answers, bucket_of, cell_of, from_planes, looked_up, packed, planes, repeated, sketches

#: Bytes of a gram; window starts that are worked on at once; bytes of text of a range; messages to a range that are merged at once; snippets compared at once.
GRAM, STARTS, RANGE, FAN, CHUNK = 32, 1 << 20, 8 << 20, 1024, 1 << 14
SEED = np.uint64(0x6A09E667F3BCC909)
#: What a snippet says beside its bytes: length, anchor, id and hash of its row, start in the row, pack.
KINDS = (np.uint16, np.uint64, np.int64, np.int64, np.int64, np.int32)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place; that two meet costs time only."""
    places = np.arange(len(raw) - gram + 1)
    data = np.concatenate((raw, np.zeros(8, np.uint8)))
    total = np.zeros(len(places), np.uint64)
    for k in range(0, gram, 8):
        width = min(8, gram - k)
        every = np.ndarray(len(data) - 7, "<u8", data.data, strides=(1,))[k : k + len(places)] if width == 8 else blocks(data, places + k, np.full(len(places), width))
        total = (total ^ (total >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25) + every
    return mixed(total)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(values) - width + 1], out[width - have : len(values) - have + 1]) if width > have else out


def anchors(raw: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the anchor's hash, first window start, number of windows, row."""
    gram = min(GRAM, max(1, size // 3))
    valid = whole_windows(starts, size)
    out = ([], [], [])
    for low in range(0, len(raw) - size + 1, STARTS):
        high = min(low + STARTS, len(raw) - size + 1)
        if not valid[low:high].any():
            continue
        hashes = gram_hashes(raw[low : high + size - 1], gram)
        # the upper half of the hash, then the place: of equal ones the first
        keyed = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
        place = (least_of(keyed, size - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        own = valid[low:high]
        begin = own.copy()
        begin[1:] &= ~own[:-1] | (place[1:] != place[:-1])
        end = own.copy()
        end[:-1] &= ~own[1:] | (place[1:] != place[:-1])
        first = np.flatnonzero(begin)
        out[0].append(mixed(hashes[place[first]] ^ SEED))  # least hashes, dealt evenly again
        out[1].append(first + low)
        out[2].append(np.flatnonzero(end) + 1 - first)
    hashes, first, count = (np.concatenate([np.zeros(0, kind), *x]) for x, kind in zip(out, (np.uint64, np.int64, np.int64), strict=True))
    return hashes, first, count, np.searchsorted(starts, first, side="right") - 1


def occurrences(raw: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Every run of windows: the anchor's hash and the row."""
    hashes, _, _, rows = anchors(raw, starts, size)
    return hashes, rows


def message(raw: np.ndarray, *columns) -> bytes:
    """Snippets, end to end, and what is said of each."""
    head = np.array([len(columns[0])], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(planes(np.asarray(c).astype(k)) for c, k in zip(columns, KINDS, strict=True)) + raw.tobytes())


def said(blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """The snippets and columns of message()."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at, columns = int(np.frombuffer(data, "<i8", 1)[0]), 8, []
    for kind in KINDS:
        width = n * np.dtype(kind).itemsize
        columns.append(from_planes(data[at : at + width], kind))
        at += width
    return np.frombuffer(data, np.uint8, offset=at), columns


def alike(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each text: the same for equal texts. Found by a hash, and compared byte by byte."""
    hashes = span_hashes(raw, starts[:-1], starts[1:], short=256)
    _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    size, model = np.diff(starts), first[number]
    equal = bool((size == size[model]).all())
    for low in range(0, len(size) if equal else 0, CHUNK):
        mine, its = slice(low, low + CHUNK), model[low : low + CHUNK]
        equal &= bool((raw[starts[low] : starts[min(low + CHUNK, len(size))]] == raw[spread(starts[its], size[mine])]).all())
    if equal:
        return number
    texts: dict[bytes, int] = {}  # two texts of one hash: never seen
    return np.array([texts.setdefault(raw[a:b].tobytes(), len(texts)) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)])


def earliest(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Each distinct snippet at its first place, in the order of anchors and places, once for each pack that has it there: number, bytes, columns."""
    parts = [said(blob) for blob in blobs]
    raw = np.concatenate([p[0] for p in parts])
    columns = [np.concatenate([p[1][k] for p in parts]) for k in range(len(KINDS))]
    del parts
    lengths, anchor, ids, rows, start, pack = columns
    starts = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
    number = alike(raw, starts)
    order = np.lexsort((pack, start, rows, ids, number))
    same = number[order][1:] == number[order][:-1]
    head = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(order)), 0))
    first = order[head]
    tied = (ids[order] == ids[first]) & (rows[order] == rows[first]) & (start[order] == start[first])
    tied[1:] &= ~(same & (pack[order][1:] == pack[order][:-1]))
    chosen = order[tied]
    chosen = chosen[np.lexsort((pack[chosen], number[chosen], start[chosen], rows[chosen], ids[chosen], anchor[chosen]))]
    return number[chosen], cut_out(raw, starts[chosen], lengths[chosen].astype(np.int64))[0], [c[chosen] for c in columns]


def first_windows(packs: DataFrame, flagged: DataFrame, size: int, buckets: int) -> DataFrame:
    """(_pack, runs): for each pack, its windows of repeated anchors that begin nowhere earlier, as row's hash, start and number."""

    def asked(docs: pa.Table, found: pa.Table) -> pa.Table:
        out = ([], [], [])
        if docs.num_rows and found.num_rows:
            raw, starts = text_bytes(docs.column("text"))
            hashes, first, count, row = anchors(raw, starts, size)
            _, hit = looked_up(answers(found)[0], cell_of(hashes, buckets))
            hashes, first, count, row = hashes[hit], first[hit], count[hit], row[hit]
            ids, keys = identities(docs)[row], docs.column("row_hash").to_numpy()[row]
            start = first - starts[row]
            lengths = count + size - 1
            order = np.lexsort((start, keys, ids))
            chosen = order[:0]
            if len(order):
                snippets, edges = cut_out(raw, first[order], lengths[order])
                chosen = order[np.sort(np.unique(alike(snippets, edges), return_index=True)[1])]
                del snippets
            bucket = bucket_of(hashes[chosen], buckets).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            chosen, bucket = chosen[order], bucket[order]
            pack = docs.column("_pack")[0].as_py()
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)).tolist() if len(chosen) else [0]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                at = chosen[low:high]
                out[0].append(int(bucket[low]))
                out[1].append(pack)
                out[2].append(message(cut_out(raw, first[at], lengths[at])[0], lengths[at], hashes[at], ids[at], keys[at], start[at], np.full(len(at), pack)))
        memory_returned()
        return pa.table([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int32(), pa.binary()), strict=True)], ["bucket", "_pack", "blob"])

    wanted = packs.groupBy("_pack").cogroup(flagged.groupBy("_pack")).applyInArrow(asked, "bucket int, _pack int, blob binary")

    def merged(table: pa.Table) -> pa.Table:
        _, raw, columns = earliest(table.column("blob").to_pylist())
        return pa.table([table.column("bucket").slice(0, 1), table.column("_pack").slice(0, 1), pa.array([message(raw, *columns)], pa.binary())], ["bucket", "_pack", "blob"])

    many = flagged.agg(F.max("_pack")).first()[0] or 0
    while many > FAN:  # so that a snippet that nearly all packs have reaches its range a bounded number of times
        many = many // FAN
        wanted = wanted.withColumn("_pack", F.pmod(F.xxhash64("_pack"), F.lit(many + 1)).cast("int")).groupBy("bucket", "_pack").applyInArrow(merged, "bucket int, _pack int, blob binary")

    def owned(table: pa.Table) -> pa.Table:
        number, raw, (lengths, anchor, _, rows, start, pack) = earliest(table.column("blob").to_pylist())
        new = np.ones(len(number), bool)  # entries of one snippet differ by their pack only and lie together
        new[1:] = number[1:] != number[:-1]
        edges = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        if not new.all():
            raw, _ = cut_out(raw, edges[:-1][new], np.diff(edges)[new])
        starts = np.concatenate(([0], np.cumsum(lengths[new], dtype=np.int64)))
        _, group = np.unique(anchor[new], return_inverse=True)
        later = marked(raw, starts, group, size, within=False)  # windows of one snippet differ, as their anchors lie differently
        at, windows = runs_of(whole_windows(starts, size) & ~later, starts)
        of = np.searchsorted(starts, at, side="right") - 1
        which = np.cumsum(new) - 1
        low, high = np.searchsorted(of, which, side="left"), np.searchsorted(of, which, side="right")
        entry = np.repeat(np.arange(len(number)), high - low)
        run = spread(low, high - low)
        order = np.argsort(pack[entry], kind="stable")
        entry, run = entry[order], run[order]
        owner = pack[entry].astype(np.int64)
        edges = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)).tolist() if len(owner) else [0]
        out = ([], [])
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            e, r = entry[a:b], run[a:b]
            out[0].append(int(owner[a]))
            out[1].append(planes(rows[e]) + planes(start[e] + at[r] - starts[of[r]]) + planes(windows[r]))
        memory_returned()
        return pa.table([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.binary()), strict=True)], ["_pack", "runs"])

    return wanted.groupBy("bucket").applyInArrow(owned, "_pack int, runs binary")


def deduplicate(docs: DataFrame, size: int = 100, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and row_hash and kept, the bytes left) for every row of docs (doc_id, text).

    A byte of the text's UTF-8 goes if a string of ``size`` bytes over it, within the text, also begins earlier: in a
    document of a smaller doc_id, or in the same one nearer its start. Strings are judged on the input. n_spans counts the
    maximal runs of bytes that go. Null texts are empty. Rows without an id come after all others; rows of one id are
    in the order of a hash of their text, and rows alike in id and text count as one document, so that they keep the same
    bytes. Texts of any length are taken whole. An empty table gives no rows. Other columns are left out.
    """
    packs, buckets = packed(docs, RANGE)
    flagged = cut(repeated(sketches(packs, lambda raw, starts: occurrences(raw, starts, size), buckets)))
    first = first_windows(packs, flagged, size, buckets)
    told = flagged.unionByName(first.select("_pack", F.lit(-1).alias("bucket"), F.col("runs").alias("cells"), F.lit(None).cast("binary").alias("counts")))
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["row_hash", "kept"] * with_bytes
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.int64(), pa.binary()] * with_bytes

    def cleaned(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        raw, starts = text_bytes(docs.column("text"))
        cover = np.zeros(len(raw) + 1, np.int32)
        if found.num_rows:
            own = pa.compute.equal(found.column("bucket"), -1)
            cells, _ = answers(found.filter(pa.compute.invert(own)))
            hashes, begin, count, _ = anchors(raw, starts, size)
            _, hit = looked_up(cells, cell_of(hashes, buckets))
            gone = np.zeros(len(raw) + 1, np.int32)
            np.add.at(gone, begin[hit], 1)
            np.subtract.at(gone, begin[hit] + count[hit], 1)
            gone = np.cumsum(gone[:-1]) > 0
            keys = docs.column("row_hash").to_numpy()
            order = np.argsort(keys, kind="stable")
            for blob in found.filter(own).column("cells").to_pylist():
                n = len(blob) // 24
                rows, start, number = (from_planes(blob[8 * k * n : 8 * (k + 1) * n], np.int64) for k in range(3))
                low, high = np.searchsorted(keys[order], rows, side="left"), np.searchsorted(keys[order], rows, side="right")
                at = starts[order[spread(low, high - low)]] + np.repeat(start, high - low)
                gone[spread(at, np.repeat(number, high - low))] = False
            at, number = runs_of(gone, starts)
            np.add.at(cover, at, 1)
            np.subtract.at(cover, at + number + size - 1, 1)
        removed = np.cumsum(cover[:-1]) > 0
        spans, _ = runs_of(removed, starts)
        sums = np.concatenate(([0], np.cumsum(removed)))[starts]
        kept = raw[~removed].tobytes()
        bounds = (starts - sums).tolist()
        parts = [kept[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        columns = [
            docs.column("doc_id").combine_chunks(),
            pa.array(np.diff(starts), pa.int64()),
            pa.array(np.diff(sums), pa.int64()),
            pa.array(np.bincount(np.searchsorted(starts, spans, side="right") - 1, minlength=docs.num_rows), pa.int64()),
            pa.array([hashlib.sha256(p).hexdigest() for p in parts], pa.string()),
        ]
        memory_returned()
        return pa.table(columns + ([docs.column("row_hash"), pa.array(parts, pa.binary())] if with_bytes else []), names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", row_hash long, kept binary" * with_bytes
    return packs.groupBy("_pack").cogroup(told.groupBy("_pack")).applyInArrow(cleaned, schema)
