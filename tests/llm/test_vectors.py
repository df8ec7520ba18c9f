"""Product codes and centroids against plain Python."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from newsloom.llm import centroids, product_codes, queries
from newsloom.llm.integer_vectors import largest

DATA = "/root/testdata/sf0.001"


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def moved(old, members):
    return [sum(c) // len(members) for c in zip(*members)] if members else old


def clusters(rows, k, rounds, dims, scale):
    kept = sorted(((i, [math.floor(scale * x) for x in v]) for i, v in rows if good(v) and len(v) == dims), key=str)
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), np.array(v, "<i4").tobytes(), v) for i, v in kept if i is not None)
    found = [v for *_, v in first[:k]]
    if not found:
        return []
    near = lambda v: min((distance(v, c), j) for j, c in enumerate(found))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        found = [moved(c, members[j]) for j, c in enumerate(found)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, d, j in last:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in last), key=str)


def codes(rows, parts, entries, rounds, scale, dims):
    kept = [(i, [math.floor(scale * x) for x in v], lab) for i, v, lab in rows if good(v) and len(v) == dims]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))
    width = dims // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda v, p: min((distance(cut(v, p), c), j) for j, c in enumerate(books[p]))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p in range(parts):
                members[p, near(v, p)[1]].append(cut(v, p))
        books = [[moved(c, members[p, j]) for j, c in enumerate(books[p])] for p in range(parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, sums = [], defaultdict(int)
    for i, v, lab in kept:
        found = [near(v, p) for p in range(parts)]
        error = sum(d for d, _ in found)
        sums[lab] += error
        out.append((i, "".join(f"{j:02x}" for _, j in found), error, lab))
    return sorted(((i, c, e, sums[lab], digest) for i, c, e, lab in out), key=str)


@pytest.fixture(scope="module")
def rows():
    """Vectors with ties, repeated rows, null ids and labels, and all kinds that take no part."""
    rng = random.Random(9)
    made = [(i * 3 % 101, [rng.choice([-1.0, -0.3, 0.0, 0.01, 0.5, 2.0]) + (rng.random() if i % 3 else 0) for _ in range(8)], i % 4 or None) for i in range(100)]
    return made + [made[5]] * 3 + [(None, made[7][1], 1), (None, made[8][1], 2), (7, made[9][1], 3), (500, None, 1), (501, [], 1), (502, [1.0] * 7, 1), (503, [None] * 8, 1), (504, [float("nan")] + [1.0] * 7, 2), (505, [float("-inf")] + [1.0] * 7, 2)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "vec_id long, embedding array<double>, label int, cluster int, code string, _label string").repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_clusters_of_hard_rows(table, rows):
    for k, rounds in ((5, 3), (500, 1), (1, 0)):
        assert got(centroids.cluster(table, k, rounds, dims=8, scale=64)) == clusters([r[:2] for r in rows], k, rounds, 8, 64)
    assert centroids.cluster(table, dims=9).count() == 0
    assert centroids.cluster(table.limit(0)).count() == 0


def test_codes_of_hard_rows(table, rows):
    for parts, entries, rounds in ((4, 16, 4), (2, 500, 1), (8, 1, 0)):
        assert got(product_codes.encode(table, parts, entries, rounds, scale=1024)) == codes(rows, parts, entries, rounds, 1024, 8)
    assert got(product_codes.encode(table, 4, 16, 2, small=0)) == codes(rows, 4, 16, 2, 1024, 8)
    assert product_codes.encode(table.limit(0)).count() == 0


def test_queries_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(queries.op13_centroids(spark, DATA)) == clusters([r[:2] for r in rows], 16, 3, 64, 64)


@pytest.mark.parametrize("name", ["op11_product_codes", "op13_centroids"])
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    found = queries.queries()[name](spark, DATA)
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(found.columns)
    assert got(found.select(columns)) == sorted(want.fetchall(), key=str)


def test_screening_computes_fewer_distances():
    """Vectors whose weight lies in different blocks: bounds rule most centroids out, and what is left is exact."""
    rng = np.random.default_rng(4)
    home = rng.integers(0, 16, 3000)
    shape = rng.integers(0, 300, (16, 8))
    x = np.repeat(shape[home], 8, axis=1) + rng.integers(-9, 9, (3000, 64))
    c = np.repeat(shape, 8, axis=1)
    nearest, best, done = centroids.assign(x, centroids.block_norms(x), c)
    all_ = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (nearest == all_.argmin(axis=1)).all() and (best == all_.min(axis=1)).all() and done < 0.3 * all_.size


def test_partial_distances_add_fewer_squares():
    rng = np.random.default_rng(5)
    spread = np.linspace(30, 900, 16).astype(int)  # dimensions of unequal variance, the widest last
    x, book = rng.integers(-spread, spread, (3000, 16)), rng.integers(-spread, spread, (256, 16))
    x[:5], book[7] = book[3], book[3]
    found, best, work = product_codes.nearest(x, book)
    all_ = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (found == all_.argmin(axis=1)).all() and (best == all_.min(axis=1)).all() and (found[:5] == 3).all() and work < 0.6 * all_.size * 16


def test_components_that_don_t_fit(spark):
    table = spark.createDataFrame([(1, [float(largest(8))] * 8, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="exceed 64 bits"):
        centroids.cluster(table, dims=8).count()
