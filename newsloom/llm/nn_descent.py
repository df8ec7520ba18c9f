"""Approximate nearest neighbours by NN-descent and greedy graph search.

Equal vectors are one node. Nodes are dealt into cells by the signs of random projections and begin with their
nearest within the cells of a few such trees. Then neighbours of neighbours are joined: each cell asks the others for the vectors of its
nodes' neighbours, compares the neighbours of each node with each other, and proposes close pairs to their
cells, which keep the nearest. Queries start at their own place in the graph and expand the nearest nodes found so far;
how many of these are worth expanding (the width) is doubled until a sample of the queries finds its true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import cut, partitions

#: A node's address: its cell times 2**32, plus its place there.
CELL = 32
STATE = "cell int, n int, vectors binary, near binary, far binary, back binary, fresh binary"


def usable(vectors: DataFrame) -> DataFrame:
    """id and vec (array<double>) of the rows that take part: not null, not zero, every component finite, of the most common length."""
    seen = vectors.select(F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vec"))
    seen = seen.where("id is not null and vec is not null and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x != 0)")
    lengths = seen.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return seen.where(F.size("vec") == (lengths[0]["size"] if lengths else 0))


def nodes(rows: DataFrame, keep: int) -> DataFrame:
    """id, vec, ids: one row for each different vector, with the ``keep`` smallest of its ids in order; id is the first."""
    first = Window.partitionBy("vec").orderBy("id")
    few = rows.distinct().withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= keep)
    return few.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("id"), "vec", "ids")


def celled(found: DataFrame, size: int, least: int, seed: int, total: int | None = None) -> DataFrame:
    """found with cell and place. Cells hold about ``size`` nodes or fewer, and at least ``least`` unless there is only one."""
    total = found.count() if total is None else total
    bits = max(0, int(np.log2(max(1, total / size))))
    dim = found.select(F.size("vec").alias("d")).first()
    directions = np.random.default_rng(seed).standard_normal((bits, dim["d"] if dim else 0))

    @F.pandas_udf("int")
    def code(vec):
        import pandas as pd

        x = np.stack(vec.to_numpy()) if len(vec) else np.zeros((0, directions.shape[1]))
        return pd.Series(((x @ directions.T) > 0).astype(np.int64) @ (1 << np.arange(bits)) if bits else np.zeros(len(x), np.int64), dtype="int32")

    coded = cut(found.withColumn("_code", code("vec")))
    counts = {r["_code"]: r["count"] for r in coded.groupBy("_code").count().collect()}  # at most one for each ``size`` nodes
    rest = sum(n for n in counts.values() if n < least)
    pool = -1 if rest >= least or len(counts) < 2 else max(counts, key=counts.get)
    cells, parts, at = {}, {}, 0
    for c in sorted(counts):
        if counts[c] >= least or (pool == c):
            n = counts[c] + (rest if pool == c else 0)
            cells[c], parts[c] = at, -(-n // size)
            at += parts[c]
    if pool == -1 and rest:
        cells[-1], parts[-1] = at, -(-rest // size)
    spark = found.sparkSession
    places = [(c, cells.get(c, cells.get(pool, 0)), parts.get(c, parts.get(pool, 1))) for c in counts]
    # a few numbers for each ``size`` nodes; joined by hash like any other table where that is large
    where = spark.createDataFrame(places, "_code int, _first int, _parts int")
    placed = coded.join(where, "_code").withColumn("cell", (F.col("_first") + F.pmod(F.xxhash64("id", F.lit(seed)), F.col("_parts"))).cast("int"))
    within = Window.partitionBy("cell").orderBy("id")
    return placed.withColumn("place", F.row_number().over(within) - 1).select("cell", "place", *found.columns)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x and y, also stacked."""
    return np.maximum(0, (x * x).sum(-1)[..., :, None] + (y * y).sum(-1)[..., None, :] - 2 * x @ np.swapaxes(y, -1, -2))


def best(owner: np.ndarray, other: np.ndarray, d: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each owner (a small number) its ``keep`` nearest different others, in order."""
    if not len(owner):
        return owner, other, d
    names, code = (None, other) if other.max() < 1 << 31 else np.unique(other, return_inverse=True)
    # the same pair comes up often: each once, with its least distance, by one sort of single numbers
    pair = owner.astype(np.int64) << 31 | code
    order = np.argsort(pair)
    pair, d = pair[order], d[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    pair, d = pair[first], np.minimum.reduceat(d, first)
    owner, code = pair >> 31, pair & 0x7FFFFFFF
    order = np.lexsort((d, owner))  # stable: of equal distances the smaller other is first
    owner, code, d = owner[order], code[order], d[order]
    top = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left") < keep
    return owner[top], code[top] if names is None else names[code[top]], d[top]


def table_of(owner: np.ndarray, other: np.ndarray, d: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ordered lists as tables of k columns: addresses (-1: none) and squared distances (infinite)."""
    near, far = np.full((n, k), -1, np.int64), np.full((n, k), np.inf, np.float32)
    column = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
    near[owner, column], far[owner, column] = other, d
    return near, far


class Cell:
    """A cell's state, from and to a row."""

    def __init__(self, row: dict):
        self.cell, self.n = row["cell"], row["n"]
        self.vectors = np.frombuffer(row["vectors"], np.float32).reshape(self.n, -1)
        self.near = np.frombuffer(row["near"], np.int64).reshape(self.n, -1)
        self.far = np.frombuffer(row["far"], np.float32).reshape(self.n, -1)
        self.back = np.frombuffer(row["back"], np.int64).reshape(self.n, -1)
        self.fresh = np.frombuffer(row["fresh"], bool).reshape(self.n, -1)

    def around(self) -> np.ndarray:
        """Addresses of each node's neighbours in both directions; -1: none."""
        return np.concatenate((self.near, self.back), axis=1)

    def family(self) -> np.ndarray:
        """Each node's own address and those around it."""
        return np.concatenate((np.arange(self.n)[:, None] + (self.cell << CELL), self.around()), axis=1)


def state_row(cell: int, vectors: np.ndarray, near: np.ndarray, far: np.ndarray, back: np.ndarray, fresh: np.ndarray) -> pa.Table:
    """One row of STATE."""
    parts = {"cell": pa.array([cell], pa.int32()), "n": pa.array([len(vectors)], pa.int32())}
    for name, x in (("vectors", vectors.astype(np.float32)), ("near", near), ("far", far), ("back", back), ("fresh", fresh)):
        parts[name] = pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
    return pa.table(parts)


def stacked(vec: pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column as rows, in single precision."""
    return vec.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(vec), -1)


def lowest(d: np.ndarray, m: int) -> np.ndarray:
    """Columns of the m least of each row, in order; m is less than the number of columns."""
    top = np.argpartition(d, m, axis=1)[:, :m]
    return np.take_along_axis(top, np.lexsort((top, np.take_along_axis(d, top, 1)), axis=1), 1)


def begun(placed: DataFrame, k: int) -> DataFrame:
    """STATE in which each node knows its nearest in its own cell."""

    def made(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        cell, n = table.column("cell")[0].as_py(), table.num_rows
        x = stacked(table.column("vec"))
        near, far = np.full((n, k), -1, np.int64), np.full((n, k), np.inf, np.float32)
        for at in range(0, n, 512):
            d = squares(x[at : at + 512], x)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            m = min(k, n - 1)
            if m:
                top = lowest(d, m)
                near[at : at + len(d), :m] = top + (cell << CELL)
                far[at : at + len(d), :m] = np.take_along_axis(d, top, 1)
        return state_row(cell, x, near, far, np.full((n, k), -1, np.int64), near >= 0)

    return placed.select("cell", "place", "vec").groupBy("cell").applyInArrow(made, STATE)


PROPOSED = "cell int, place binary, other binary, d binary, back binary"


def rows_proposed(out: list[tuple]) -> pa.Table:
    """Rows of PROPOSED from sent(place, other, squared distance, whether other lists the place)."""
    kinds = {"cell": pa.int32(), "place": pa.binary(), "other": pa.binary(), "d": pa.binary(), "back": pa.binary()}
    return pa.table([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds.values())], list(kinds))


def grown(placed: DataFrame, k: int) -> DataFrame:
    """Proposals from another tree: each node's nearest among those of its cell there. placed: cell, place, address, vec."""

    def made(table: pa.Table) -> pa.Table:
        address, n = table.column("address").to_numpy(), table.num_rows
        x = stacked(table.column("vec"))
        m = min(k, n - 1)
        if m < 1:
            return rows_proposed([])
        other, far = [], []
        for at in range(0, n, 512):
            d = squares(x[at : at + 512], x)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            top = lowest(d, m)
            other.append(address[top].ravel())
            far.append(np.take_along_axis(d, top, 1).ravel())
        to = np.repeat(address, m)
        return rows_proposed(sent(to >> CELL, (to & 0xFFFFFFFF).astype(np.int32), np.concatenate(other), np.concatenate(far).astype(np.float32), np.zeros(len(to), bool)))

    return placed.select("cell", "address", "vec").groupBy("cell").applyInArrow(made, PROPOSED)


def sent(cells: np.ndarray, *columns: np.ndarray) -> list[tuple]:
    """Columns of numbers by the cell to which they go: (cell, bytes of each column)."""
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    columns = [c[order] for c in columns]
    edges = np.flatnonzero(np.diff(cells, prepend=-1, append=-1))
    return [(int(cells[a]), *(np.ascontiguousarray(c[a:b]).tobytes() for c in columns)) for a, b in zip(edges[:-1], edges[1:], strict=True)] if len(cells) else []


def merged(state: DataFrame, proposed: DataFrame, k: int) -> DataFrame:
    """STATE with each node's k nearest of those known and proposed, and the k nearest that list it."""

    def merge(own: pa.Table, proposed: pa.Table) -> pa.Table:
        mine = Cell(own.to_pylist()[0])
        read = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(b, kind) for b in proposed.column(name).to_pylist())])
        place, other, d, back = read("place", np.int32).astype(np.int64), read("other", np.int64), read("d", np.float32), read("back", bool)
        self_address = place + (mine.cell << CELL)
        real = other != self_address
        place, other, d, back = place[real], other[real], d[real], back[real]
        known = np.argwhere(mine.near >= 0)
        all_owner = np.concatenate((known[:, 0], place))
        all_other = np.concatenate((mine.near[known[:, 0], known[:, 1]], other))
        all_d = np.concatenate((mine.far[known[:, 0], known[:, 1]], d))
        near, far = table_of(*best(all_owner, all_other, all_d, k), mine.n, k)
        behind, _ = table_of(*best(place[back], other[back], d[back], k), mine.n, k)
        fresh = (near >= 0) & ~(near[:, :, None] == mine.near[:, None, :]).any(axis=2)
        return state_row(mine.cell, mine.vectors, near, far, behind, fresh)

    return state.groupBy("cell").cogroup(proposed.groupBy("cell")).applyInArrow(merge, STATE)



def descend(state: DataFrame, k: int) -> DataFrame:
    """One round: the neighbours of every node meet, and close pairs are proposed to both."""

    def ask(table: pa.Table) -> pa.Table:
        mine = Cell(table.to_pylist()[0])
        wanted = np.unique(mine.family())
        wanted = wanted[wanted >= 0]
        out = sent(wanted >> CELL, (wanted & 0xFFFFFFFF).astype(np.int32))
        return pa.table({"cell": pa.array([c for c, _ in out], pa.int32()), "asker": pa.array([mine.cell] * len(out), pa.int32()), "places": pa.array([p for _, p in out], pa.binary())})

    asked = state.groupBy("cell").applyInArrow(ask, "cell int, asker int, places binary")

    def answer(asks: pa.Table, own: pa.Table) -> pa.Table:
        mine = Cell(own.to_pylist()[0])
        rows = [(a, mine.cell, p, mine.vectors[at].tobytes(), mine.far[at, -1].tobytes()) for a, p in zip(asks.column("asker").to_pylist(), asks.column("places").to_pylist(), strict=True) for at in (np.frombuffer(p, np.int32),)]
        kinds = {"cell": pa.int32(), "owner": pa.int32(), "places": pa.binary(), "vectors": pa.binary(), "worst": pa.binary()}
        return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    told = asked.groupBy("cell").cogroup(state.groupBy("cell")).applyInArrow(answer, "cell int, owner int, places binary, vectors binary, worst binary")

    def meet(own: pa.Table, told: pa.Table) -> pa.Table:
        mine = Cell(own.to_pylist()[0])
        address, vectors, worst = [], [], []
        for owner, places, data, kth in zip(*(told.column(c).to_pylist() for c in ("owner", "places", "vectors", "worst")), strict=True):
            at = np.frombuffer(places, np.int32).astype(np.int64)
            address.append(at + (owner << CELL))
            vectors.append(np.frombuffer(data, np.float32).reshape(len(at), -1))
            worst.append(np.frombuffer(kth, np.float32))
        if not address:
            return rows_proposed([])
        address, vectors, worst = np.concatenate(address), np.concatenate(vectors), np.concatenate(worst)
        order = np.argsort(address)
        address, vectors, worst = address[order], vectors[order], worst[order]
        around = mine.family()
        fresh = np.concatenate((np.zeros((mine.n, 1), bool), mine.fresh, np.ones_like(mine.back, bool)), axis=1)
        at = np.where(around >= 0, np.searchsorted(address, around), 0)
        found = [[], [], []]
        for low in range(0, mine.n, 128):
            part, here, new = at[low : low + 128], around[low : low + 128] >= 0, fresh[low : low + 128]
            x = vectors[part]
            d = squares(x, x)
            good = here[:, :, None] & here[:, None, :] & (new[:, :, None] | new[:, None, :]) & (part[:, :, None] != part[:, None, :]) & (d < worst[part][:, :, None])
            u, i, j = np.nonzero(good)
            found[0].append(part[u, i])
            found[1].append(part[u, j])
            found[2].append(d[u, i, j])
        owner, other, d = best(*(np.concatenate(f) for f in found), k)
        # what lists me is proposed to me too, marked as pointing back
        known = np.argwhere(mine.near >= 0)
        mine_address = known[:, 0] + (mine.cell << CELL)
        listed = mine.near[known[:, 0], known[:, 1]]
        listed_d = mine.far[known[:, 0], known[:, 1]]
        to = np.concatenate((address[owner], listed))
        out = sent(to >> CELL, (to & 0xFFFFFFFF).astype(np.int32), np.concatenate((address[other], mine_address)), np.concatenate((d, listed_d)).astype(np.float32), np.concatenate((np.zeros(len(d), bool), np.ones(len(listed), bool))))
        return rows_proposed(out)

    proposed = state.groupBy("cell").cogroup(told.groupBy("cell")).applyInArrow(meet, PROPOSED)

    return merged(state, proposed, k)


NET = "cell int, n int, vectors binary, first binary, next binary"


def edges(state: DataFrame) -> DataFrame:
    """NET: each cell's vectors and the neighbours of its nodes in both directions (addresses; first: where each node's begin)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                mine = Cell(row)
                lists = [np.unique(x[x >= 0]) for x in mine.around()]
                yield net_row(mine.cell, mine.vectors, lists).to_batches()[0]

    return state.mapInArrow(made, NET)


def net_row(cell: int, vectors: np.ndarray, lists: list[np.ndarray]) -> pa.Table:
    """One row of NET."""
    first = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    parts = {"cell": pa.array([cell], pa.int32()), "n": pa.array([len(vectors)], pa.int32())}
    for name, x in (("vectors", vectors.astype(np.float32)), ("first", first.astype(np.int32)), ("next", np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64))):
        parts[name] = pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())
    return pa.table(parts)


def fresh_entries(state: DataFrame) -> int:
    """How many entries of the lists came with the last round."""
    return state.agg(F.expr("sum(length(hex(fresh)) - length(replace(hex(fresh), '1', '')))").alias("n")).first()["n"] or 0


def graph(found: DataFrame, k: int = 20, rounds: int | None = None, cell: int = 400, trees: int = 4, seed: int = 7, few: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(address, id, vec, ids) of every node, and NET: the neighbour graph of found (id, vec, ids) after NN-descent.

    Rounds go on until no more than ``few`` of all list entries are new, or for ``rounds`` where that is given. It begins with the nearest in the cells of several trees of projections, which overlap and so connect the graph.
    """
    placed = cut(celled(found, cell, max(64, 2 * k), seed).withColumn("address", F.shiftleft(F.col("cell").cast("long"), CELL) + F.col("place")))
    state, total = begun(placed, k), placed.count()
    proposed = [grown(celled(placed.select("id", "address", "vec"), cell, max(64, 2 * k), seed + t, total), k) for t in range(1, trees)]
    for more in proposed[1:]:
        proposed[0] = proposed[0].unionByName(more)
    state = cut(merged(state, proposed[0], k) if proposed else state)
    done = 0
    while done != rounds and fresh_entries(state) > few * total * k:
        state = cut(descend(state, k))
        done += 1
    return placed.select("address", "id", "vec", "ids"), cut(edges(state))


def distance(a: str, b: str):
    """Euclidean distance of two arrays of doubles, summed in order."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda total, x: total + x))


BEAM = "part int, open long, blob binary, seen binary"
#: Queries of one part of a beam.
PART = 64
#: Cells of one block of a net, at most.
BLOCK = 64


def blob(*columns: np.ndarray) -> bytes:
    """Columns of one length, end to end."""
    return np.int64(len(columns[0])).tobytes() + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unblob(data: bytes, *kinds) -> list[np.ndarray]:
    """The columns of blob()."""
    n, at, out = int(np.frombuffer(data, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


FOUND = (np.int32, np.int64, np.float32, np.bool_)


def together(blobs: list[bytes], *kinds) -> list[np.ndarray]:
    """The columns of many blobs, one after the other."""
    parts = [unblob(b, *kinds) for b in blobs]
    return [np.concatenate([np.zeros(0, kind), *(p[i] for p in parts)]) for i, kind in enumerate(kinds)]


def turn(owner: np.ndarray, done: np.ndarray, width: int, step: int) -> np.ndarray:
    """Which nodes to expand: of each query the ``step`` nearest that are not expanded, among its ``width`` nearest. In order of owner and distance."""
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    open_ = ~done & (rank < width)
    before = np.cumsum(open_) - open_
    return open_ & (before - before[np.searchsorted(owner, owner)] < step)


def dealt(to: np.ndarray, name: str, *columns: np.ndarray) -> pa.Table:
    """(name, blob): columns by the number to which they go."""
    rows = sent(to, *columns)
    size = [len(r[1]) // columns[0].itemsize for r in rows]
    return pa.table({name: pa.array([r[0] for r in rows], pa.int32()), "blob": pa.array([np.int64(n).tobytes() + b"".join(r[1:]) for n, r in zip(size, rows, strict=True)], pa.binary())})


def pairs(owner: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Queries and cells, each pair once, in order."""
    pair = np.unique(owner.astype(np.int64) << 32 | cell)
    return (pair >> 32).astype(np.int32), (pair & 0xFFFFFFFF).astype(np.int32)


BLOCKS = "block int, cell int, n int, vectors binary, first binary, roads binary"


def blocked(net: DataFrame, blocks: int) -> DataFrame:
    """BLOCKS: each cell's vectors and the cells to which the edges of each of its nodes lead (first: where each node's begin)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, after = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("first", "next"))
            starts, roads = [], []
            for f, x in zip(first, after, strict=True):
                count = np.diff(np.frombuffer(f, np.int32))
                node, cell = pairs(np.repeat(np.arange(len(count)), count), np.frombuffer(x, np.int64) >> CELL)
                starts.append(np.searchsorted(node, np.arange(len(count) + 1)).astype(np.int32).tobytes())
                roads.append(cell.tobytes())
            cell = batch.column(batch.schema.get_field_index("cell")).to_numpy()
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("cell", "n", "vectors")]
            yield pa.RecordBatch.from_arrays([pa.array(cell % blocks, pa.int32()), *kept, pa.array(starts, pa.binary()), pa.array(roads, pa.binary())], names=["block", "cell", "n", "vectors", "first", "roads"])

    return net.mapInArrow(made, BLOCKS)


def true_nearest(net: DataFrame, wanted: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Addresses of the ``keep`` nearest nodes of each wanted vector and their squared distances, by comparing with all; a few vectors, one pass in blocks."""
    centre = wanted.mean(axis=0)  # products about the centre lose less in single precision
    about = wanted - centre

    def merged(d: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(d, axis=1, kind="stable")[:, :keep]
        return np.take_along_axis(d, order, 1), np.take_along_axis(at, order, 1)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, at = np.zeros((len(wanted), 0), np.float32), np.zeros((len(wanted), 0), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["vectors"], np.float32).reshape(row["n"], -1)
                here = np.tile(np.arange(row["n"]) + (row["cell"] << CELL), (len(wanted), 1))
                d, at = merged(np.concatenate((d, squares(about, x - centre)), axis=1), np.concatenate((at, here), axis=1))
        yield pa.RecordBatch.from_pydict({"d": pa.array([d.tobytes()], pa.binary()), "at": pa.array([at.tobytes()], pa.binary())})

    d, at = np.zeros((len(wanted), 0), np.float32), np.zeros((len(wanted), 0), np.int64)
    for r in net.mapInArrow(made, "d binary, at binary").collect():  # ``keep`` of each wanted vector from a partition: 12 bytes each, some 8 kB; an iterator would pass over the partitions one by one
        d, at = merged(np.concatenate((d, np.frombuffer(r["d"], np.float32).reshape(len(wanted), -1)), axis=1), np.concatenate((at, np.frombuffer(r["at"], np.int64).reshape(len(wanted), -1)), axis=1))
    return at, d


def search(net: DataFrame, queries: DataFrame, keep: int, width: int = 64, goal: float = 0.96, at_once: int = 20_000) -> DataFrame:
    """(query_id, address) of the ``keep`` nearest nodes that greedy search reaches, and all about as near as the last of them.

    queries: query_id, qvec, address of the start. A query begins in its own cell. Each round expands, for every query, the
    nearest nodes found but not expanded, if among its ``width`` nearest: the cells to which their edges lead are compared
    with it as wholes, each once, until no query has such a node. Then the first queries' lists are compared with
    their true neighbours; while fewer than ``goal`` of these were found, the width is doubled and the search begins again.
    Queries are searched ``at_once`` together (this bounds what is broadcast: their vectors), in an order given by a hash.
    """
    spark = net.sparkSession
    n = partitions(spark)
    cells = net.agg(F.max("cell").alias("last")).first()["last"]
    blocks = max(n, -(-((cells or 0) + 1) // BLOCK))
    net = blocked(net, blocks).repartition(n, "block").sortWithinPartitions("block").persist(StorageLevel.MEMORY_AND_DISK)  # every round reads it where it lies
    total = queries.count()
    batches = max(1, -(-total // at_once))
    found = None
    for number in range(batches):
        mine = sorted(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(batches)) == number).collect(), key=lambda r: (r["query_id"] * 0x9E3779B97F4A7C15 % 2**64, r["query_id"]))
        if not mine:
            continue
        part, wide = beam(net, np.array([r["qvec"] for r in mine], np.float32), np.array([r["address"] for r in mine], np.int64), keep, width, goal, blocks)
        width = wide
        ids = spark.sparkContext.broadcast(np.array([r["query_id"] for r in mine], np.int64))  # at_once numbers at most

        def emitted(rows: Iterator[pa.RecordBatch], ids=ids) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for data in batch.column(2).to_pylist():
                    owner, address, d, _ = unblob(data, *FOUND)
                    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
                    at = np.flatnonzero(rank == keep - 1)
                    limit = dict(zip(owner[at].tolist(), d[at].tolist(), strict=True))
                    last = np.array([limit.get(o, np.inf) for o in owner.tolist()])
                    near = d <= last + tolerance(last)
                    yield pa.RecordBatch.from_arrays([pa.array(ids.value[owner[near]]), pa.array(address[near])], ["query_id", "address"])

        rows = cut(part.mapInArrow(emitted, "query_id long, address long"))
        found = rows if found is None else found.unionByName(rows)
    net.unpersist()
    return found if found is not None else spark.createDataFrame([], "query_id long, address long")


def beam(net: DataFrame, vectors: np.ndarray, start: np.ndarray, keep: int, width: int, goal: float, blocks: int) -> tuple[DataFrame, int]:
    """BEAM of the queries with these vectors, begun at these addresses, and the width at which the goal is met. net: BLOCKS."""
    spark = net.sparkSession
    shared = spark.sparkContext.broadcast(vectors)

    def begun(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells in which the queries lie."""
        for batch in rows:
            for data in batch.column(0).to_pylist():
                owner, address = unblob(data, np.int32, np.int64)
                yield from dealt(owner // PART, "part", owner, (address >> CELL).astype(np.int32)).to_batches()

    def asked(width: int, step: int):
        def made(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                for data in batch.column(2).to_pylist():
                    owner, address, _, done = unblob(data, *FOUND)
                    now = turn(owner, done, width, step)
                    yield from dealt((address[now] >> CELL) % blocks, "block", owner[now], address[now]).to_batches()

        return made

    def followed(asks: pa.Table, own: pa.Table) -> pa.Table:
        """(part, blob): queries at nodes of a block, and the cells to which these nodes' edges lead."""
        owner, address = together(asks.column("blob").to_pylist(), np.int32, np.int64)
        order = np.argsort(address >> CELL, kind="stable")
        owner, address = owner[order], address[order]
        to = [[np.zeros(0, np.int32)], [np.zeros(0, np.int32)]]
        for cell, first, roads in zip(*(own.column(c).to_pylist() for c in ("cell", "first", "roads")), strict=True):
            a, z = np.searchsorted(address, (cell << CELL, (cell + 1) << CELL))
            place, first, roads = address[a:z] & 0xFFFFFFFF, np.frombuffer(first, np.int32).astype(np.int64), np.frombuffer(roads, np.int32)
            count = first[place + 1] - first[place]
            to[0].append(np.repeat(owner[a:z], count))
            to[1].append(roads[np.repeat(first[place] - (np.cumsum(count) - count), count) + np.arange(count.sum())])
        owner, cell = pairs(*map(np.concatenate, to))
        return dealt(owner // PART, "part", owner, cell)

    def visits(most: int):
        def made(state: pa.Table, roads: pa.Table) -> pa.Table:
            """(block, blob): queries, the cells that are new to them, and the distance within which nodes there are of use."""
            if not state.num_rows or not roads.num_rows:
                return dealt(np.zeros(0, np.int32), "block", np.zeros(0, np.int32))
            owner, cell = pairs(*together(roads.column("blob").to_pylist(), np.int32, np.int32))
            seen = unblob(state.column("seen")[0].as_py(), np.int32, np.int32)
            new = ~np.isin(owner.astype(np.int64) << 32 | cell, seen[0].astype(np.int64) << 32 | seen[1])
            owner, cell = owner[new], cell[new]
            low = state.column("part")[0].as_py() * PART
            bound = np.full(PART, np.inf, np.float32)
            whose, _, d, _ = unblob(state.column("blob")[0].as_py(), *FOUND)
            at = np.arange(len(whose)) - np.searchsorted(whose, whose) == most - 1
            bound[whose[at] - low] = d[at]
            return dealt(cell % blocks, "block", owner, cell, bound[owner - low])

        return made

    def measured(most: int):
        def made(asks: pa.Table, own: pa.Table) -> pa.Table:
            """(part, blob, seen): distances of queries to nodes of a block's cells that are of use, and which cells these were."""
            owner, cell, bound = together(asks.column("blob").to_pylist(), np.int32, np.int32, np.float32)
            order = np.argsort(cell, kind="stable")
            owner, cell, bound = owner[order], cell[order], bound[order]
            found = [[np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]]
            for name, n, data in zip(*(own.column(c).to_pylist() for c in ("cell", "n", "vectors")), strict=True):
                a, z = np.searchsorted(cell, (name, name + 1))
                x = np.frombuffer(data, np.float32).reshape(n, -1)
                centre = x.mean(axis=0)  # products about the centre lose less in single precision
                y = x - centre
                for at in range(a, z, 512):
                    who = owner[at : min(z, at + 512)]
                    q = shared.value[who] - centre
                    d, within = squares(q, y), bound[at : at + len(who)].copy()
                    open_ = np.isinf(within) & (n > most)
                    if open_.any():
                        within[open_] = np.partition(d[open_], most - 1, axis=1)[:, most - 1]
                    error = (x.shape[1] + 8) * 6e-8 * ((q * q).sum(axis=1) + (y * y).sum(axis=1).max())
                    i, j = np.nonzero(d <= (within + 2 * error + tolerance(within))[:, None])
                    found[0].append(who[i])
                    found[1].append(j + (name << CELL))
                    found[2].append(((x[j] - shared.value[who[i]]) ** 2).sum(axis=1))
            who, address, d = map(np.concatenate, found)
            told, known, none = dealt(who // PART, "part", who, address, d), dealt(owner // PART, "part", owner, cell), blob(np.zeros(0, np.int32))
            told = told.append_column("seen", pa.array([none] * told.num_rows, pa.binary()))
            return pa.concat_tables([told, pa.table({"part": known.column("part"), "blob": pa.array([none] * known.num_rows, pa.binary()), "seen": known.column("blob")})])

        return made

    def merged(width: int, step: int, most: int):
        def made(state: pa.Table, told: pa.Table) -> pa.Table:
            owner, address, d, done = unblob(state.column("blob")[0].as_py(), *FOUND)
            done = done | turn(owner, done, width, step)
            new_owner, new_address, new_d = together(told.column("blob").to_pylist(), np.int32, np.int64, np.float32)
            owner, address, d = np.concatenate((owner, new_owner)), np.concatenate((address, new_address)), np.concatenate((d, new_d))
            done = np.concatenate((done, np.zeros(len(new_owner), bool)))
            order = np.lexsort((address, d, owner))
            owner, address, d, done = owner[order], address[order], d[order], done[order]
            rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
            last = np.full(PART, np.inf, np.float32)
            low = state.column("part")[0].as_py() * PART
            at = rank == keep - 1
            last[owner[at] - low] = d[at]
            last = last[owner - low]
            stay = (rank < most) | (d <= last + tolerance(last))  # all ties of the last stay
            left = int((~done & (rank < width)).sum())
            seen = together([*state.column("seen").to_pylist(), *told.column("seen").to_pylist()], np.int32, np.int32)
            return pa.table({"part": state.column("part"), "open": pa.array([left], pa.int64()), "blob": pa.array([blob(owner[stay], address[stay], d[stay], done[stay])], pa.binary()), "seen": pa.array([blob(*seen)], pa.binary())})

        return made

    nothing = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, bool))
    parts = range(-(-len(start) // PART))
    begin = cut(spark.createDataFrame([(p, 1, bytearray(blob(*nothing)), bytearray(blob(*nothing[:1], nothing[0]))) for p in parts], BEAM))
    own = spark.createDataFrame([(bytearray(blob(np.arange(p * PART, min(len(start), (p + 1) * PART), dtype=np.int32), start[p * PART : (p + 1) * PART])),) for p in parts], "blob binary")
    sample = min(PART, len(start))
    wanted, far = true_nearest(net, vectors[:sample], keep)
    nodes, places = net.select("block", "cell", "first", "roads").groupBy("block"), net.select("block", "cell", "n", "vectors").groupBy("block")
    while True:
        most, state, step = max(keep, width), begin, 0
        roads = own.mapInArrow(begun, "part int, blob binary")
        while True:
            new = state.groupBy("part").cogroup(roads.groupBy("part")).applyInArrow(visits(most), "block int, blob binary")
            told = new.groupBy("block").cogroup(places).applyInArrow(only(measured(most), "part", "seen"), "part int, blob binary, seen binary")
            state = cut(state.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(merged(width, step, most), BEAM))
            if not state.agg(F.sum("open").alias("open")).first()["open"]:
                break
            step = min(width, max(1, 2 * step))  # few at first, while the distance that a node must keep within is still wide
            asks = state.mapInArrow(asked(width, step), "block int, blob binary")
            roads = asks.groupBy("block").cogroup(nodes).applyInArrow(only(followed, "part"), "part int, blob binary")
        owner, address, d, _ = unblob(bytes(state.where("part = 0").first()["blob"]), *FOUND)
        first = (np.arange(len(owner)) - np.searchsorted(owner, owner) < keep) & (owner < sample)
        # another node as near as the last of the true ones does as well
        hits = sum((d[(owner == i) & first] <= far[i].max() + tolerance(far[i].max())).sum() for i in range(sample))
        # a list's own node is in both; it counts on neither side
        if hits - sample >= goal * (wanted.size - sample) or width >= 1 << 20:
            return state, width
        width *= 2


def tolerance(d: np.ndarray) -> np.ndarray:
    """By how much squared distances in single precision may differ that are equal in exact ones."""
    return d * np.float32(1e-4) + np.float32(1e-6)


def only(f, key: str, *more: str):
    """f where both sides have rows; else nothing."""

    def made(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({key: pa.array([], pa.int32())} | {name: pa.array([], pa.binary()) for name in ("blob", *more)})
        return f(left, right)

    return made


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, **settings) -> DataFrame:
    """query_id, rank, vec_id, score: for each vec_id divisible by ``every`` its ``k`` nearest found, by distance and then vec_id.

    vectors: vec_id, embedding. Rows that take no part: null id or vector, zero vectors, null or non-finite components, a length
    that is not the table's most common. Rows alike in id and vector count once. Equal vectors are one node of the graph
    that keeps its k + 1 smallest ids, which is as many as any answer needs. With too few candidates all are returned; an
    empty table gives no rows. Scores are computed in double precision from the vectors as given.
    """
    rows = cut(usable(vectors.select("vec_id", "embedding")))
    found = cut(nodes(rows, k + 1))
    placed, net = graph(found, **settings)
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select(F.col("id").alias("query_id"), "vec").distinct()
    queries = cut(asked.join(placed.select("vec", "address"), "vec").select("query_id", F.col("vec").alias("qvec"), "address"))
    reached = search(net, queries, k + 1)  # its own node and k more hold k other ids at least
    exact = reached.join(placed, "address").join(queries.select("query_id", "qvec"), "query_id")
    each = exact.select("query_id", distance("vec", "qvec").alias("d"), F.explode("ids").alias("vec_id")).where("vec_id != query_id")
    order = Window.partitionBy("query_id").orderBy("d", "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("d").alias("score"))

