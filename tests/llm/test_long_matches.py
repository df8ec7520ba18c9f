import hashlib
import random

import numpy as np
import pytest

from newsloom.llm import long_matches as m
from newsloom.llm import queries
from newsloom.llm.run_index import RunIndex, marked


def alphabets(rng):
    return rng.choice([b"a", b"ab", b"\x00\xffa", bytes(range(256))])


def drawn(rng, count, longest):
    letters = alphabets(rng)
    texts = [bytes(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(count)]
    texts += [t for t in texts if rng.random() < 0.5]
    rng.shuffle(texts)
    return letters, texts


def joined(texts):
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])


def test_index_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        depth = rng.choice([1, 2, 3, 8, 40])
        letters, texts = drawn(rng, rng.randint(1, 12), 60)
        index = RunIndex(*joined(texts), depth)
        symbols = [x for i, t in enumerate(texts) for x in [*(b + 1000 for b in t), i]]
        assert index.order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])
        asked = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(5)] + [texts[0] + texts[-1], b"\x07"]
        raw, starts = joined(asked)
        found = index.matching(raw, starts)
        for i, q in enumerate(asked):
            for p in range(len(q)):
                best = max(k for k in range(min(depth, len(q) - p) + 1) if k == 0 or any(q[p : p + k] in t for t in texts))
                assert found[starts[i] + p] == best


def test_marks_against_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        size = rng.choice([2, 3, 8, 40])
        _, texts = drawn(rng, rng.randint(1, 12), 60)
        raw, starts = joined(texts)
        got = marked(raw, starts, np.zeros(len(texts), np.int64), size, most=rng.choice([1, 50, 1 << 20]))
        seen = set()
        for i, t in enumerate(texts):
            for p in range(len(t)):
                w = t[p : p + size]
                assert got[starts[i] + p] == (len(w) == size and w in seen)
                seen |= {w} if len(w) == size else set()


def expected(rows, size):
    """rows: (doc_id, text) in the order in which they count; rows alike in both are one document."""
    first = {}
    for rank, (_, t) in enumerate(rows):
        data = (t or "").encode()
        for p in range(len(data) - size + 1):
            first.setdefault(data[p : p + size], (rank, p))
    out = []
    for rank, (i, t) in enumerate(rows):
        data = (t or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - size + 1):
            if first[data[p : p + size]] < (rank, p):
                gone[p : p + size] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        kept = np.frombuffer(data, np.uint8)[~gone[:-1]].tobytes()
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def values(df):
    return [tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in df.collect()]


@pytest.mark.parametrize("size", [100, 20, 7])
def test_against_dictionary(spark, size):
    rng = random.Random(size)
    words = ["ba", "ko", "ri", "té", "Zu'x", "the", "of", "–", "12", "中"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = make(200), make(40)
    texts = [make(rng.randint(1, 80)) for _ in range(20)] + [base, base, base[:150] + "!" + base[150:], base[10:]] + [make(20) + passage + make(20) for _ in range(5)]
    texts += ["", None, "a" * 1500, "b" + "a" * 700, "ab" * 400, passage + passage, "x\x00y" * 60, make(4000)]
    rows = [(i * 7 % 60 + 1, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, row_hash string").repartition(3)
    assert sorted(values(m.deduplicate(docs, size))) == sorted(expected(sorted(rows, key=lambda r: r[0]), size))


def test_repeated_rows_null_ids_and_small_packs(spark, docs, rows, none, monkeypatch):
    """Rows alike in id and text keep the same bytes; rows without an id come last. Many small packs, ranges and merged messages."""
    from newsloom.llm import windows

    monkeypatch.setattr(windows, "PACK", 1 << 12)
    monkeypatch.setattr(m, "RANGE", 1 << 12)
    monkeypatch.setattr(m, "FAN", 3)
    hashes = {(r.doc_id, r.text): r.h for r in docs.select("doc_id", "text", windows.row_hash().alias("h")).collect()}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashes[r]))
    want = dict(zip(order, expected(order, 60), strict=True))
    key = lambda r: (r[0] is None, *map(str, r))
    assert sorted(values(m.deduplicate(docs, 60)), key=key) == sorted((want[r] for r in rows), key=key)
    assert m.deduplicate(none).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    assert sorted(values(queries.op12_long_matches(spark, "/root/testdata/sf0.001"))) == expected(rows, 100)
