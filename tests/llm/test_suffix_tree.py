import collections
import math
import re
import zlib

import numpy as np
import pytest

from newsloom.llm import suffix_tree as s


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


def model(rows, depth):
    """The tree from dictionaries: every context of every length is counted and tested, none is left out."""
    train = [tokens(t) for i, t in rows if zlib.crc32(b"" if i is None else str(i).encode()) % 7 != 2]
    c = collections.Counter(x for w in train for x in w)
    n, v = sum(c.values()), len(c)

    def root(h, t):
        return (c[t] + 1) / (n + v + 1)

    def smoothed(k, known, counts, parent):
        def p(h, t):
            last = h[-k:] if len(h) >= k else None
            if last in known:
                cc = counts[last]
                return (cc[t] + len(cc) * parent(h, t)) / (sum(cc.values()) + len(cc))
            return parent(h, t)

        return p

    p, states = root, 0
    for k in range(1, depth + 1):
        counts = collections.defaultdict(collections.Counter)
        for w in train:
            for at in range(k, len(w)):
                counts[tuple(w[at - k : at])][w[at]] += 1
        known = set()
        for h, cc in counts.items():
            m, f = sum(cc.values()), len(cc)
            if m > 1 and sum(math.log(f / (m - 1 + f)) if x == 1 else x * (math.log(x - 1) + round(-math.log(p(h, t)) / s.STEP) * s.STEP - math.log(m - 1 + f)) for t, x in cc.items()) > 2.0:
                known.add(h)
        states += len(known)
        p = smoothed(k, known, counts, p)
    return c, n, root, p, states


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_against_dictionaries(docs, rows, none, depth, monkeypatch):
    monkeypatch.setattr(s, "PACK", 3000)  # many packs and ranges, so that frequent contexts are dealt over several
    monkeypatch.setattr(s, "RANGE", 9000)
    c, n, p0, p, _ = model(rows, depth)
    want = []
    for i, t in rows:
        w = tokens(t)
        want.append((-1 if i is None else i, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10(p0((), x)) for x in w), sum(math.log10(p(tuple(w[:at]), x)) for at, x in enumerate(w))))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in s.score(docs, depth=depth).collect())
    assert len(got) == len(rows)
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-7)
    assert s.score(none, depth=depth).count() == 0


def test_longer_contexts_become_states(spark):
    """What follows four words depends on the first of them only."""
    rows = [(i, " ".join([f"{a} the same three {b}" for a, b in (("red", "rose"), ("blue", "sky"))] * 8)) for i in range(40)]
    assert model(rows, 4)[4] > model(rows, 3)[4]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    short, long = ({r.doc_id: r.score for r in s.score(df, depth=d).collect()} for d in (3, 4))
    assert all(long[i] > short[i] + 1 for i, _ in rows)


def test_distribution_sums_to_one(rows):
    c, n, p0, p, _ = model(rows, 4)
    unknown = object()
    for h in ((), ("the",), ("one", "two")):
        assert sum(p(h, t) for t in [*c, unknown]) == pytest.approx(1)


def test_words_of_one_training_and_one_held_out_document(spark, monkeypatch):
    """A word that training documents hold once must still be found there by the held-out one that shares its context."""
    monkeypatch.setattr(s, "PACK", 200)
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(i, f"only{i} here and there lies a word{i} of its own") for i in range(100) if i != held] + [(held, "and there lies a word5 of its own only7 here")]
    c, n, p0, p, _ = model(rows, 3)
    w = tokens(rows[-1][1])
    got = {r.doc_id: r.score for r in s.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), depth=3).collect()}
    assert got[held] == pytest.approx(sum(math.log10(p(tuple(w[:at]), x)) for at, x in enumerate(w)), rel=1e-7)


def test_answers_are_removed_before_the_next_level_asks(docs, monkeypatch):
    """The answers of one level and the requests of the next don't lie on disk together."""
    cut, released, alive, asked = s.cut, s.released, [], []

    def cutting(df):
        if "blob" in df.columns:
            asked.append(len(alive))
        made = cut(df)
        if "blob" in made.columns:
            alive.append(made)
        return made

    def releasing(df):
        alive[:] = [x for x in alive if x is not df]
        released(df)

    monkeypatch.setattr(s, "cut", cutting)
    monkeypatch.setattr(s, "released", releasing)
    s.score(docs)
    assert len(asked) > 3 and not any(asked) and not alive


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_contexts_sent_as_names(depth):
    """What is sent gives the same hashes, also where ranges of names follow each other, in less room for short contexts."""
    rng = np.random.default_rng(5)
    names = [rng.integers(0, 3000, 20000).astype(np.uint64) ** 2 for _ in range(depth)]
    order = np.lexsort((*names[::-1], np.arange(20000) < 12000))
    names = [x[order] for x in names]
    hashed = s.chained(names)
    sent = s.spelt(names if depth < 3 else [hashed], depth)
    assert (s.hashes_of(sent, depth) == hashed).all()
    assert depth == 3 or len(s.squeezed(*sent)) < 0.7 * len(s.squeezed(s.steps(np.sort(hashed))))
    assert len(s.hashes_of([x[:0] for x in sent], depth)) == 0
