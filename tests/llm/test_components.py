import random

from newsloom.llm.components import components


def expected(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return sorted((x, root(x)) for x in list(up))


def found(spark, edges):
    return sorted((r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())


def test_long_path_in_random_order(spark):
    names = list(range(10_000))
    random.Random(4).shuffle(names)
    edges = list(zip(names, names[1:]))
    assert found(spark, edges) == [(x, 0) for x in range(10_000)]


def test_random_graph_loops_and_none(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(600), rng.randrange(600)) for _ in range(300)] + [(700, 700), (700, 700), (3, 3), (5, 9), (9, 5)]
    assert found(spark, edges) == expected(edges)
    assert found(spark, []) == []
    star = [(0, x) for x in range(1, 500)] + [(x, 1000 + x) for x in range(1, 500)]
    assert found(spark, star) == expected(star)
