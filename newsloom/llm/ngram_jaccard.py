"""Exact Jaccard join of word n-gram sets, with set relations used to skip work.

1. A count-min pass (windows.py) tells each pack of documents which of its n-grams occur in other sets too. A set
   in which too few do can have no partner. Equal sets are collapsed.
2. n-grams are ordered by count, rarest first; partners must share one in their prefixes. Index lists of prefix
   n-grams are cut into blocks by set size, each with the most that follows any of its positions; an entry skips
   every block in which no position leaves enough n-grams to link.
3. The sets of a list meet in the family of the list's least set. In a family, the overlaps of a set with all others
   are derived from those of a similar set already computed: only the lists of n-grams in which the two differ
   are read. A family that is too large for one task is dealt into blocks; then only sets outside its largest
   component still meet all other blocks, since two sets of one component need no link of their own.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import cut, partitions, text_bytes
from newsloom.llm.components import components
from newsloom.llm.pretoken import mixed, spread
from newsloom.llm.windows import answers, cell_of, chained, looked_up, lowered, packed, repeated, sketches, window_hashes, word_hashes

#: Links need similarity of at least NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 4, 5
#: Sets that have been compared with a whole family and serve to derive others' overlaps.
REFERENCES = 16


def least_overlap(a, b):
    """The smallest intersection of sets of sizes a and b that link: J >= 4/5 is 9 * overlap >= 4 * (a + b)."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def shingle_sets(raw: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, row) of each row's n-grams, by row; a row of fewer words has one, of all its words."""
    words, rows, _ = word_hashes(lowered(raw), starts)
    found, first = window_hashes(words, rows, size)
    owner = rows[first]
    n = len(starts) - 1
    counts = np.bincount(rows, minlength=n)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        begin = np.concatenate(([0], np.cumsum(counts)))[short]
        whole = [chained([words[at + i : at + i + 1] for i in range(k)])[0] for at, k in zip(begin.tolist(), counts[short].tolist(), strict=True)]
        found, owner = np.concatenate((found, np.array(whole, np.uint64))), np.concatenate((owner, short))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], owner[new]


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, row_hash, n, key (null for an empty set), and for one row of each key in a pack: shared, its repeated n-grams, rarest first.

    key is 128 bits of the set; shared is null where so few n-grams are repeated that the set can have no partner.
    """
    packs, buckets = packed(docs)
    flagged = repeated(sketches(packs, lambda raw, starts: shingle_sets(raw, starts, size), buckets))

    def profiled(docs: pa.Table, found: pa.Table) -> pa.Table:
        names, kinds = ["doc_id", "row_hash", "n", "key", "shared"], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        if not docs.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        hashes, rows = shingle_sets(*text_bytes(docs.column("text")), size)
        n = np.bincount(rows, minlength=docs.num_rows)
        bounds = np.concatenate(([0], np.cumsum(n)))
        full = np.flatnonzero(n)
        sums = [np.zeros(docs.num_rows, np.uint64) for _ in range(2)]
        if len(full):
            sums[0][full] = np.add.reduceat(hashes, bounds[full])
            sums[1][full] = np.add.reduceat(mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), bounds[full])
        keys = [struct.pack(">QQ", int(a), int(b)) if k else None for a, b, k in zip(*sums, n, strict=True)]
        cells, counts = answers(found) if found.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.uint32))
        at, hit = looked_up(cells, cell_of(hashes, buckets))
        shared, seen = [], set()
        for i, key in enumerate(keys):
            low, high = bounds[i], bounds[i + 1]
            own = hit[low:high]
            if key is None or key in seen or own.sum() * DENOMINATOR < NUMERATOR * n[i]:
                shared.append(None)
                continue
            seen.add(key)
            mine = hashes[low:high][own]
            shared.append(mine[np.lexsort((mine, counts[at[low:high][own]]))].tobytes())
        return pa.table([docs.column("doc_id").combine_chunks(), docs.column("row_hash").combine_chunks(), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(shared, pa.binary())], names)

    return packs.groupBy("_pack").cogroup(flagged.groupBy("_pack")).applyInArrow(profiled, "doc_id long, row_hash long, n long, key binary, shared binary")


def prefix_entries(sets: DataFrame) -> DataFrame:
    """(gram, key, n, left): the n-grams of each set's prefix; left: how many of the set there are from this one on."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams, keys, sizes, left = [], [], [], []
            for key, n, shared in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = np.frombuffer(shared, np.int64)
                alone = n - len(mine)  # n-grams of no other set come first in the order
                most = n - -(-NUMERATOR * n // DENOMINATOR) + 1 - alone
                if most > 0:
                    mine = mine[:most]
                    grams.append(mine)
                    keys += [key] * len(mine)
                    sizes.append(np.full(len(mine), n))
                    left.append(n - alone - np.arange(len(mine)))
            columns = [pa.array(np.concatenate([np.zeros(0, np.int64), *c]), pa.int64()) for c in (grams, sizes, left)]
            yield pa.RecordBatch.from_arrays([columns[0], pa.array(keys, pa.binary()), columns[1], columns[2]], ["gram", "key", "n", "left"])

    return sets.select("key", "n", "shared").mapInArrow(made, "gram long, key binary, n long, left long")


def families(sets: DataFrame) -> DataFrame:
    """Distinct (hub, key): sets that share an index list and could link to a set of it; hub is the least key of the list."""
    entries = prefix_entries(sets).withColumn("size", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DENOMINATOR / NUMERATOR))).cast("int"))
    blocks = entries.groupBy("gram", "size").agg(F.count("*").alias("sets"), F.max("left").alias("left"), F.min("n").alias("n"), F.min("key").alias("hub"))
    lists = blocks.groupBy("gram").agg(F.min("hub").alias("hub"), F.sum("sets").alias("sets"), F.collect_list(F.struct("size", "sets", "left", "n")).alias("blocks"))
    # blocks of sizes that differ by one step or less; another set there; enough n-grams left on both sides
    reachable = F.expr(
        f"exists(blocks, b -> abs(b.size - size) <= 1 and b.sets > if(b.size = size, 1, 0) and least(left, b.left) * {NUMERATOR + DENOMINATOR} >= {NUMERATOR} * (n + b.n))"
    )
    return entries.join(lists.where("sets > 1").select("gram", "hub", "blocks"), "gram").where(reachable).select("hub", "key").distinct()


def overlaps(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set in turn, its number and its overlaps with all sets, derived from a similar set's where that reads less."""
    lengths = np.array([len(s) for s in sets], np.int64)
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(gram, kind="stable")
    members = owner[order]
    sizes = np.bincount(gram)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    known: list[tuple[int, np.ndarray]] = []
    mine = np.zeros(len(sizes), bool)

    def read(grams: np.ndarray) -> np.ndarray:
        return np.bincount(members[spread(begin[grams], sizes[grams])], minlength=len(sets))

    for x in range(len(sets)):
        own = gram[bounds[x] : bounds[x + 1]]
        best = min(known, key=lambda r: lengths[r[0]] + lengths[x] - 2 * r[1][x], default=None)
        if best is not None and 2 * (lengths[best[0]] + lengths[x] - 2 * best[1][x]) <= lengths[x]:
            other = gram[bounds[best[0]] : bounds[best[0] + 1]]
            mine[own] = True
            lost = other[~mine[other]]
            mine[own] = False
            mine[other] = True
            gained = own[~mine[own]]
            mine[other] = False
            yield x, best[1] + read(gained) - read(lost)
        else:
            found = read(own)
            if len(known) < REFERENCES:
                known.append((x, found))
            yield x, found


def linked_groups(sets: list[np.ndarray], n: np.ndarray, probes: np.ndarray | None = None) -> np.ndarray:
    """A label for each set: the same for sets that links connect. probes: only links of which one end is among these."""
    label = np.arange(len(sets))
    for x, found in overlaps(sets):
        link = found * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (n + n[x])
        if probes is not None and not probes[x]:
            link &= probes
        link[x] = True
        joined = np.unique(label[link])
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    return label


def star_edges(rows: DataFrame, groups: list[str], probes: bool) -> DataFrame:
    """Edges from each set to the least of its component among the rows of its group; rows: groups, blocks, key, n, shared (and probe).

    Many small families are worked on together; each block of a large one alone.
    """
    n = partitions(rows.sparkSession)
    small = F.pmod(F.xxhash64(*groups), F.lit(32 * n))
    dealt = rows.withColumn("_task", F.when(F.col("blocks") > 1, F.xxhash64(F.lit("block"), *groups)).otherwise(small)).drop("blocks").repartition(n, "_task")

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by([*((g, "ascending") for g in groups), ("n", "ascending"), ("key", "ascending")])
        group = list(zip(*(table.column(g).to_pylist() for g in groups), strict=True))
        keys, n, shared = table.column("key").to_pylist(), table.column("n").to_numpy(), table.column("shared").to_pylist()
        probe = table.column("probe").to_numpy(zero_copy_only=False) if probes else None
        edges = [i for i in range(len(group)) if i == 0 or group[i] != group[i - 1]] + [len(group)]
        out: set[tuple[bytes, bytes]] = set()
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            if high - low > 1:
                label = linked_groups([np.frombuffer(s, np.uint64) for s in shared[low:high]], n[low:high], None if probe is None else probe[low:high])
                out |= {(keys[low + i], keys[low + at]) for i, at in enumerate(label.tolist()) if at != i}
        out = sorted(out)
        return pa.table([pa.array([e[k] for e in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    return dealt.groupBy("_task").applyInArrow(joined, "a binary, b binary").where("a != b")


def links(sets: DataFrame, most: int = 500_000) -> DataFrame:
    """(node, component) of the sets that link to another; sets: key, n, shared. most: n-grams of a family in one block."""
    member = cut(families(sets).join(sets.select("key", "n", "shared"), "key"))
    total = member.groupBy("hub").agg(F.sum(F.octet_length("shared") / 8).alias("grams"))
    blocks = cut(total.select("hub", F.ceil(F.col("grams") / most).cast("int").alias("blocks")))
    placed = member.join(blocks, "hub").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    edges = cut(star_edges(placed, ["hub", "block"], probes=False))
    found = components(edges)
    large = blocks.where("blocks > 1")
    if large.isEmpty():
        return found
    wide = placed.join(large.select("hub"), "hub").join(found.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    wide = cut(wide)
    main = wide.groupBy("hub", "component").agg(F.count("*").alias("sets")).groupBy("hub").agg(F.max_by("component", "sets").alias("main"))
    apart = wide.join(main, "hub").where(F.col("component") != F.col("main")).select("hub", "blocks", "key", "n", "shared")
    shares = apart.groupBy("hub").agg(F.ceil(F.sum(F.octet_length("shared") / 8) / most).cast("int").alias("shares"))
    probing = (
        apart.join(shares, "hub")
        .withColumn("share", F.pmod(F.xxhash64("key", F.lit("share")), F.col("shares")).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("hub", "block", "share", "blocks", "key", "n", "shared", F.lit(True).alias("probe"))
    )
    built = (
        wide.join(shares, "hub")
        .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        .select("hub", "block", "share", "blocks", "key", "n", "shared", F.lit(False).alias("probe"))
    )
    more = star_edges(probing.unionByName(built), ["hub", "block", "share"], probes=True)
    return components(cut(edges.unionByName(more)))


def join(docs: DataFrame, size: int = 5, most: int = 500_000) -> DataFrame:
    """doc_id, n_shingles, component_id (and row_hash, see windows.py) for every row of docs (doc_id, text).

    A set holds the distinct ``size``-word n-grams of a text in lower case (A-Z); a text of fewer words has one n-gram,
    of all its words; a null or empty text or one of white space has none and links with nothing. Sets link if their
    similarity is 0.8 or more, and component_id is the smallest id that links reach. A row without an id takes part, but
    its id is no component's; if no row of its component has one, component_id is null. Repeated rows stay, with equal
    values. n-grams are compared by 64-bit hashes. Other columns are left out.
    """
    found = cut(profiles(docs, size))
    sets = cut(found.where("shared is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("shared").alias("shared")))
    owners = found.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    linked = links(sets, most).withColumnRenamed("node", "key")
    named = owners.join(linked, "key", "left").withColumn("component", F.coalesce("component", "key"))
    named = cut(named)
    several = named.where("key != component").select("component").distinct()
    smallest = named.join(several, "component", "left_semi").groupBy("component").agg(F.min("least").alias("smallest"))
    ids = named.join(smallest, "component", "left").select("key", F.coalesce("smallest", "least").alias("component_id"))
    return found.join(ids, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "row_hash")
