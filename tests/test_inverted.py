"""The stored index against BM25 by a plain model and against the scan."""

import math
import random
import re
from collections import Counter

import pytest

from newsloom.operators import inverted, retrieval

WORDS = [f"{a}{b}" for a in ("ba", "ko", "ri", "té", "Zu") for b in ("n", "lo", "mi", "sa")] + ["USA", "the", "of-it", "12"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    rare = lambda: rng.choice(WORDS) if rng.random() < 0.8 else f"rare{rng.randint(0, 400)}"
    texts = {i: " ".join(rare() for _ in range(rng.randint(1, 60))) for i in range(1500)}
    return texts | {1500: None, 1501: "", 1502: "?!", 1503: texts[3], 1504: texts[3], 1505: "the " * 3000}


@pytest.fixture(scope="module")
def index(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    rows = [(i, t, "x") for i, t in corpus.items()] + [(None, "ban", "y")]
    inverted.build(spark.createDataFrame(rows, "doc_id long, text string, term string").repartition(5), "doc_id", "text", path, buckets=16)
    return path


def expected(corpus, question, top):
    bags = {i: Counter(tokens(t or "")) for i, t in corpus.items()}
    average = sum(map(Counter.total, bags.values())) / len(bags)
    scores = Counter()
    for term in sorted(set(tokens(question))):
        held = [i for i, b in bags.items() if term in b]
        idf = math.log(1 + (len(bags) - len(held) + 0.5) / (len(held) + 0.5))
        for i in held:
            f = bags[i][term]
            scores[i] += idf * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * bags[i].total() / average))
    return sorted(((round(s, 9), i) for i, s in scores.items()), key=lambda x: (-x[0], x[1]))[:top]


def tokens(text):
    out = []
    for raw in text.replace("?!", "").split():
        out += [raw.lower().replace("é", "e")] if len(raw) > 1 else []
        out += [raw] if raw.isupper() and 2 <= len(raw) <= 8 else []
    return out


def test_a_table_of_questions(spark, index, corpus, monkeypatch):
    monkeypatch.setattr(inverted, "SLICE", 100)
    rng = random.Random(8)
    asked = [" ".join(rng.choice([*WORDS, f"rare{rng.randint(0, 500)}"]) for _ in range(rng.randint(1, 6))) for _ in range(500)]
    rows = [(f"q{i}", q) for i, q in enumerate(asked)] + [("q0", asked[0]), ("none", "unknownword"), ("null", None)]
    got = {}
    for r in inverted.search(spark, index, spark.createDataFrame(rows, "qid string, question string"), 7).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.bm25_score, r.key))
    for i, q in enumerate(asked):
        want = expected(corpus, q, 7)
        assert [k for _, k in got.get(f"q{i}", [])] == [k for _, k in want], q
        assert [s for s, _ in got.get(f"q{i}", [])] == pytest.approx([s for s, _ in want], abs=1e-8)
    assert not {"none", "null"} & set(got)


def test_equals_the_scan(spark, index, corpus):
    docs = spark.createDataFrame(list(corpus.items()), "doc_id long, text string")
    for question in ("ban rare7 USA", "the of-it"):
        scan = [(r.doc_id, round(r.bm25_score, 6)) for r in retrieval.bm25(docs, "doc_id", "text", question, 10).orderBy("rank").collect()]
        one = spark.createDataFrame([(1, question)], "qid int, question string")
        assert [(r.key, round(r.bm25_score, 6)) for r in inverted.search(spark, index, one, 10).orderBy("rank").collect()] == scan


def test_blocks_below_the_last_answer_are_left_out(spark, index, monkeypatch):
    """Only buckets of the question's terms are read, and few blocks are scored."""
    seen, plans = [], []
    true = inverted.scored

    def watched(postings, weighed, pairs, *more):
        seen.append(pairs.count())
        plans.append(postings._jdf.queryExecution().executedPlan().toString())
        return true(postings, weighed, pairs, *more)

    monkeypatch.setattr(inverted, "scored", watched)
    one = spark.createDataFrame([(1, "rare7 ban")], "qid int, question string")
    assert inverted.search(spark, index, one, 3).count() == 3
    assert sum(seen) < spark.read.parquet(f"{index}/postings").select("block").distinct().count() + inverted.PROBED
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=)", plans[0]) and re.search(r"PushedFilters: \[[^\]]*term", plans[0])


def test_empty(spark, tmp_path):
    path = str(tmp_path / "i")
    inverted.build(spark.createDataFrame([(1, None)], "k long, t string"), "k", "t", path)
    assert inverted.search(spark, path, spark.createDataFrame([(1, "ban")], "qid int, question string"), 3).count() == 0
