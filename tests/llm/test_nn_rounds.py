import numpy as np

from newsloom.llm import nn_descent as nn


def test_a_wide_list_is_expanded_in_few_rounds(spark, monkeypatch):
    """A start with 150 neighbours that lead to one more each: every round passes over the whole net, so few must do."""
    n, rounds = 301, []
    after = [np.arange(1, 151), *(np.array([i + 150]) for i in range(1, 151)), *([np.zeros(0, np.int64)] * 150)]
    net = spark.createDataFrame(nn.net_row(0, np.arange(n, dtype=np.float32)[:, None], after).to_pylist(), nn.NET)
    queries = spark.createDataFrame([(0, [float(n - 1)], 0)], "query_id long, qvec array<double>, address long")
    cut = nn.cut
    monkeypatch.setattr(nn, "cut", lambda df: rounds.append(1) or cut(df))
    found = {r.address for r in nn.search(net, queries, 2).collect()}
    assert n - 1 in found and len(rounds) <= 20, len(rounds)


def test_nearest_of_each_owner():
    rng = np.random.default_rng(2)
    for scale in (1, 1 << 33):  # places, and addresses
        owner, other = rng.integers(0, 40, 3000), rng.integers(0, 60, 3000) * scale
        d = rng.integers(0, 9, 3000).astype(np.float32)
        least = {}
        for o, x, y in zip(owner.tolist(), other.tolist(), d.tolist()):
            least[o, x] = min(y, least.get((o, x), y))
        wanted = [(o, x, y) for k in range(40) for y, x, o in sorted((y, x, o) for (o, x), y in least.items() if o == k)[:7]]
        assert list(zip(*(a.tolist() for a in nn.best(owner, other, d, 7)))) == wanted
