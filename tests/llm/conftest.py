"""Documents with everything that real tables hold: nulls, empty and very long texts, repeated rows, clashing columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_hash string, _score double, shard string, size int, _kept string"


def texts():
    rng = random.Random(3)
    words = [f"{a}{b}" for a in ("ba", "ko", "ri", "té", "Zu") for b in ("n", "lo", "mi", "sa", "x'")] + ["the", "of", "–", "12", "I'll"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = make(120), make(30)
    out = [make(rng.randint(1, 80)) for _ in range(30)]
    out += [base, base, base.replace(" the ", " of ", 2), base + " ende", base.upper()]
    out += [make(40) + " " + passage + "\n" + make(30) for _ in range(5)]
    out += ["", None, "   \n\t ", "one two", "one two", "<|endoftext|> x <|startoftext|>", "中文 和 😀 é", make(20000), "a b\x0bc d", "z"]
    return out


@pytest.fixture(scope="session")
def rows():
    found = [(i * 7 % 60, t) for i, t in enumerate(texts())]
    return found + [found[3], found[3], (None, texts()[30]), (None, None), (None, texts()[0]), (900, texts()[31])]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t), "r", 0.5, "s", 1, "k") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
