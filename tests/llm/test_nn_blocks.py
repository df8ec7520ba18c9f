import numpy as np

from newsloom.llm import nn_descent as nn

QUERIES = "query_id long, qvec array<double>, address long"


def test_a_cell_is_compared_as_a_whole(spark, monkeypatch):
    """Two chains of 60 nodes in two cells: a round passes over the whole net, so a round for each node of a chain would not do at scale."""
    n, rounds = 120, []
    after = [np.array([(i + 1) // 60 << nn.CELL | (i + 1) % 60] if i + 1 < n else [], np.int64) for i in range(n)]
    cells = [nn.net_row(c, np.arange(c * 60, c * 60 + 60, dtype=np.float32)[:, None], after[c * 60 : c * 60 + 60]).to_pylist()[0] for c in (0, 1)]
    cut = nn.cut
    monkeypatch.setattr(nn, "cut", lambda df: rounds.append(1) or cut(df))
    found = nn.search(spark.createDataFrame(cells, nn.NET), spark.createDataFrame([(0, [float(n - 1)], 0)], QUERIES), 2).collect()
    assert 1 << nn.CELL | 59 in {r.address for r in found} and len(rounds) <= 12, len(rounds)


def test_all_ties_of_the_last_stay(spark):
    """More nodes at one distance than the width, in several cells and far from the origin; queries of several parts."""
    x = np.concatenate((np.eye(30), -np.eye(30))).astype(np.float32) + 100
    all_ = [np.delete(np.concatenate([(c << nn.CELL) + np.arange(20) for c in range(3)]), i) for i in range(60)]
    net = spark.createDataFrame([nn.net_row(c, x[c * 20 : c * 20 + 20], all_[c * 20 : c * 20 + 20]).to_pylist()[0] for c in range(3)], nn.NET)
    queries = spark.createDataFrame([(q, [100.0] * 30, q % 3 << nn.CELL) for q in range(70)], QUERIES)
    found = {}
    for r in nn.search(net, queries, 5, width=2).collect():
        found.setdefault(r.query_id, []).append(r.address)
    assert len(found) == 70 and all(sorted(a) == [c << nn.CELL | i for c in range(3) for i in range(20)] for a in found.values())
