import numpy as np
from pyspark.sql import functions as F

from newsloom.llm import nn_descent as nn

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % every == 0:
            out[q] = sorted({(float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, w)))), i) for i, w in good if i != q})[:k]
    return out


def test_recall_ties_and_bad_rows(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 8))
    rows = [(i, np.float32(centres[i % 5] + rng.normal(size=8) * 0.5).tolist()) for i in range(1200)]
    rows += [(2000 + i, rows[40][1]) for i in range(30)] + [rows[7]] * 5  # equal vectors, repeated rows
    rows += [(3000, None), (3100, [0.0] * 8), (3200, [float("nan")] + [1.0] * 7), (3300, [1.0, None] + [1.0] * 6), (3400, [float("inf")] * 8), (None, [1.0] * 8), (3500, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    got = {}
    for r in nn.nearest(df, every=20, k=10, rounds=3, cell=150).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    want = brute(rows, 20, 10)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [f[1:] for f in found] == sorted(f[1:] for f in found)
        hits += len({f[2] for f in found} & {i for _, i in want[q]})
    assert hits >= 0.9 * 10 * len(want)
    assert sorted(f[2] for f in got[2000]) == [i for _, i in want[2000]] == sorted([40, *range(2001, 2010)])


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (100, [3.0, 2.0], 1)], SCHEMA)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in nn.nearest(few).collect()) == [(0, 1, 1), (0, 2, 100), (100, 1, 0), (100, 2, 1)]
    assert nn.nearest(few.limit(0)).count() == 0
    assert nn.nearest(few.where("vec_id = 0")).count() == 0


def test_ties_at_the_last_distance(spark):
    centre = [10.0] + [0.0] * 7
    around = [[x + s * (i == j) for j, x in enumerate(centre)] for i in range(8) for s in (1, -1)]
    rows = [(0, centre)] + [(i * 7 % 17 + 1, v) for i, v in enumerate(around)]
    got = nn.nearest(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA), k=10, cell=8).collect()
    assert sorted((r.score, r.vec_id) for r in got) == brute(rows, 100, 10)[0]


def test_search_goes_on_while_nodes_are_open(spark):
    """A chain of nodes over several cells: the query's neighbour is at its other end."""
    n, each = 12, 4
    cells = [nn.net_row(c, np.arange(c * each, (c + 1) * each, dtype=np.float32)[:, None], [np.array([((i + 1) // each << nn.CELL) + (i + 1) % each] if i + 1 < n else [], np.int64) for i in range(c * each, (c + 1) * each)]) for c in range(n // each)]
    net = spark.createDataFrame([r for c in cells for r in c.to_pylist()], nn.NET)
    queries = spark.createDataFrame([(0, [float(n - 1)], 0)], "query_id long, qvec array<double>, address long")
    assert ((n - 1) // each << nn.CELL) + (n - 1) % each in {r.address for r in nn.search(net, queries, 2).collect()}


def test_width_grows_until_true_neighbours_are_found(spark):
    """Vectors without any structure: a width of 4 finds few neighbours, so the search has to widen by itself."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA)
    found = nn.cut(nn.nodes(nn.cut(nn.usable(df)), 11))
    placed, net = nn.graph(found, k=8, rounds=1)
    queries = nn.cut(placed.where("id % 30 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"), "address"))
    got = {}
    for r in nn.search(net, queries, 11, width=4).join(placed, "address").collect():
        got.setdefault(r.query_id, set()).add(r.id)
    hits = [len(set(np.argsort(((x - x[q]) ** 2).sum(1), kind="stable")[1:11].tolist()) & ids) for q, ids in got.items()]
    assert len(hits) == 100 and sum(hits) >= 0.9 * 10 * len(hits)
