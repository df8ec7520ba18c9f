import random
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm import compression_quality as q

DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, quality int, toxic int"


def rows(n, seed=1):
    r = random.Random(seed)
    words = ["river", "garden", "window", "letter", "morning", "paper", "summer", "music"]
    out = []
    for i in range(n):
        good = i % 4 != 0
        text = " ".join(r.choice(words) + ("" if good else r.choice(["%%%", "$$$", "###"])) for _ in range(60))
        out.append((i, text, int(good)))
    return out


def test_held_out_accuracy_and_hard_rows(spark):
    data = rows(400)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(None, None, None), (1000, "", None), (1001, None, "x"), (1, data[1][1], "x"), (1002, "word " * 60000, "x")], DOCS)
    labels = spark.createDataFrame([(i, g, 0) for i, _, g in data] + [(None, 1, 0), (5, None, None)], LABELS)
    model = q.fit(docs, labels, per_class=60)
    got = q.score(docs, model).select("doc_id", "score").collect()
    assert len(got) == 405 and all(0 <= r.score <= 1 for r in got)
    score = {r.doc_id: r.score for r in got}
    right = sum((score[i] >= 0.3) == bool(g) for i, _, g in data)
    assert right >= 390
    assert score[1000] == score[1001]
    assert model == q.fit(docs, labels, per_class=60)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = q.fit(docs, spark.createDataFrame([], LABELS))
    assert [r.score for r in q.score(docs, model).collect()] == [0.5]
    none = spark.createDataFrame([], T.StructType.fromDDL("doc_id long, text string"))
    assert q.score(none, q.fit(none, spark.createDataFrame([(1, 1, 0)], LABELS))).count() == 0


def test_against_plain_compression(spark):
    """The whole classifier once more from its definition, text by text."""
    data = rows(300, seed=5) + [(400, "", 1), (401, None, 0)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in data] + [(2, "other text of id two", "x")], DOCS)
    labels = spark.createDataFrame([(i, g, 0) for i, _, g in data] + [(3, 0, 0), (3, 1, 0)], LABELS)
    model = q.fit(docs, labels, per_class=80, block=100)
    mixed = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    learn = {i: (min(t, "other text of id two") if i == 2 else t, g) for i, t, g in data if zlib.crc32(str(i).encode()) % 5 != 0 and i != 3}
    drawn = {kind: [i for i in sorted((i for i in learn if learn[i][1] == kind), key=lambda i: (mixed[i], i))[:80] if learn[i][0]] for kind in (0, 1)}
    parts = {kind: [learn[i][0].encode() for i in sorted(found, key=lambda i: i * 2654435761 % 2**32)] for kind, found in drawn.items()}
    books = []
    for kind in (1, 0):
        blocks = [t[a : a + 100] for t in parts[kind][::2] for a in range(0, len(t), 100)]
        books.append(zstandard.train_dictionary(max(256, min(64 << 10, sum(map(len, blocks)) // 8)), blocks))

    def size(text, book):
        return sum(len(zstandard.ZstdCompressor(level=3, dict_data=book, write_content_size=False, write_dict_id=False).compress(text[a : a + 100])) for a in range(0, len(text), 100))

    def x(text):
        return (size(text, books[1]) - size(text, books[0])) / (len(text) + 64)

    seen = np.array([x(t) for kind in (0, 1) for t in parts[kind][1::2]])
    good = np.array([kind for kind in (0, 1) for _ in parts[kind][1::2]], float)
    scale, a, b = seen.std(), 0.0, 0.0
    for _ in range(4000):  # plain gradient steps to the same optimum
        p = 1 / (1 + np.exp(-(a * seen / scale + b)))
        a, b = a + 0.05 * ((good - p) @ (seen / scale) - 1e-3 * a), b + 0.05 * ((good - p).sum() - 1e-3 * b)
    share = (sum(g for _, g in learn.values()) + 1) / (len(learn) + 2)
    b += np.log(share / (1 - share)) - np.log(good.mean() / (1 - good.mean()))
    for r in q.score(docs, model).select("doc_id", "text", "score").collect():
        assert abs(r.score - 1 / (1 + np.exp(-(a / scale * x((r.text or "").encode()) + b)))) < 0.02
