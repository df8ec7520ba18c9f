import random
import re

import numpy as np

from newsloom.llm import ngram_jaccard as j


def expected(rows, size=5):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return [(i, len(s), i if not s else least.get(g)) for (i, _), s, g in zip(rows, sets, group)]


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_against_all_pairs(docs, rows, none):
    for most in (2_000_000, 300):
        got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.join(docs, 5, most).collect()), key=key)
        assert got == sorted(expected(rows), key=key)
    assert j.join(none).count() == 0


def chain(n):
    """Documents of which each differs by one word from the last, so the ends are far apart."""
    rng = random.Random(9)
    text = [f"w{rng.randint(0, 9999)}" for _ in range(90)]
    rows = []
    for i in range(n):
        rows.append((i, " ".join(text)))
        text[rng.randrange(90)] = f"n{i}"
    return rows


def test_chain_of_near_copies(spark):
    rows = chain(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (2_000_000, 500):
        got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in j.join(df, 5, most).collect())
        assert got == sorted(expected(rows))


def test_long_chain(spark):
    """2,000 documents in one component, dealt anew by a hash, in one block and in many."""
    rows = chain(2000)
    df = spark.createDataFrame([((i * 7919) % 2003, t) for i, t in rows], "doc_id long, text string")
    want = {(i * 7919) % 2003 for i, _ in rows}
    for most in (2_000_000, 20_000):
        got = j.join(df, 5, most).collect()
        assert {r.doc_id for r in got} == want and {r.component_id for r in got} == {0}


def test_overlaps_are_exact():
    rng = np.random.default_rng(1)
    base = rng.choice(10_000, 200, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate((rng.permutation(base)[: 200 - k], rng.integers(20_000, 30_000, k).astype(np.uint64)))) for k in rng.integers(0, 60, 40)]
    for x, found in j.overlaps(sets):
        assert found.tolist() == [len(np.intersect1d(sets[x], s)) for s in sets]
