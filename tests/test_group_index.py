"""Groups over batches against the groups of one pass."""

import os
import random

import pytest

from newsloom.operators import dedup
from newsloom.operators.group_index import Groups

SCHEMA = "o long, u string, c string"


def made(n, seed):
    r = random.Random(seed)
    return [(i * 3 + 1, r.choice([None, "", *(f"u{k}" for k in range(n // 3))]), r.choice([None, *(f"c{k}" for k in range(n // 2))])) for i in range(n)]


def model(rows):
    """One pass in order."""
    by_url, by_content, out = {}, {}, {}
    for o, u, c in sorted(rows):
        group = by_url.get(u) if u else None
        group = by_content.get(c) if group is None and c is not None else group
        out[o] = (group is not None, o if group is None else group)
        if u:
            by_url.setdefault(u, out[o][1])
        if c is not None:
            by_content.setdefault(c, out[o][1])
    return out


def batches(rows, how):
    if how == "in order":
        return [rows[:50], rows[50:51], [], rows[51:]]
    mixed = rows[:]
    random.Random(5).shuffle(mixed)
    return [mixed[:40], mixed[40:41], mixed[41:]] if how == "mixed" else [rows[60:], rows[:60]]


@pytest.mark.parametrize("how", ["in order", "mixed", "late"])
def test_batches_give_the_groups_of_one_pass(spark, tmp_path, how):
    rows = made(120, 3)
    index, seen = Groups(spark, str(tmp_path / "index"), buckets=4), []
    for i, part in enumerate(batches(rows, how)):
        version = index.absorb(spark.createDataFrame(part, SCHEMA), "o", "u", "c", ("crawl", i))
        assert index.absorb(spark.createDataFrame(part, SCHEMA), "o", "u", "c", ("crawl", i)) == version  # a repeated batch
        seen += part
    got = {r.o: (r.is_duplicate, r.group_id) for r in index.of(spark.createDataFrame(rows, SCHEMA), "o", "u", "c").collect()}
    assert got == model(rows)
    assert {r.o: (r.is_duplicate, r.group_id) for r in dedup.greedy_groups(spark.createDataFrame(rows, SCHEMA), "o", "u", "c").collect()} == got


def test_chains_within_one_batch(spark, tmp_path):
    rows = []
    for i in range(40):  # each row shares its content with the one before and its url with the one after
        rows.append((i, f"u{(i + 1) // 2}", f"c{i // 2}"))
    index = Groups(spark, str(tmp_path / "index"), buckets=2)
    index.absorb(spark.createDataFrame(rows[20:], SCHEMA), "o", "u", "c")
    index.absorb(spark.createDataFrame(rows[:20], SCHEMA), "o", "u", "c")
    assert {r.group_id for r in index.of(spark.createDataFrame(rows, SCHEMA), "o", "u", "c").collect()} == {0}


def test_untouched_buckets_stay(spark, tmp_path):
    index = Groups(spark, str(tmp_path / "index"), buckets=64)
    index.absorb(spark.createDataFrame(made(90, 1), SCHEMA), "o", "u", "c")
    before = index.table.snapshot()["at"]
    index.absorb(spark.createDataFrame([(9000, "new url", "new content")], SCHEMA), "o", "u", "c")
    after = index.table.snapshot()["at"]
    assert sum(before.get(b) != f for b, f in after.items()) <= 2
    assert all(os.path.isdir(f) for f in before.values())


def test_nulls_and_clashing_columns(spark, tmp_path):
    index = Groups(spark, str(tmp_path / "index"), buckets=2)
    rows = spark.createDataFrame([(1, None, None, "x"), (2, "", None, "x"), (None, "u", "c", "y"), (4, "u", "c", "z")], SCHEMA + ", root string")
    index.absorb(rows, "o", "u", "c")
    got = {(r.o, r.root): (r.is_duplicate, r.group_id) for r in index.of(rows, "o", "u", "c").collect()}
    assert got == {(1, "x"): (False, 1), (2, "x"): (False, 2), (None, "y"): (None, None), (4, "z"): (False, 4)}
    assert index.of(rows.limit(0), "o", "u", "c").count() == 0
