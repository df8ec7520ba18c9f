"""The bucketed table: what a commit rewrites, two writers, crashes, restarts."""

import os

import pytest
from pyspark.sql import functions as F

from newsloom.operators import bucketed

SCHEMA = "k long, v string, t long"


@pytest.fixture()
def table(spark, tmp_path):
    made = bucketed.Table(spark, str(tmp_path / "t")).create(spark.createDataFrame([], SCHEMA).schema, ["k"], 8)
    made.upsert(spark.range(200).selectExpr("id AS k", "'old' AS v", "0L AS t"))
    return made


def rows(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA)


def test_untouched_buckets_keep_their_files(spark, table):
    before = table.snapshot()
    assert table.upsert(rows(spark, (7, "new", 1), (7, "newer", 2), (1000, "more", 1)), F.col("t")) == 2
    after = table.snapshot()
    touched = {str(b) for b in after["touched"]}
    assert 1 <= len(touched) <= 2 and {b: f for b, f in before["at"].items() if b not in touched} == {b: f for b, f in after["at"].items() if b not in touched}
    got = {r.k: r.v for r in table.read().collect()}
    assert got == {k: "old" for k in range(200)} | {7: "newer", 1000: "more"}
    assert {r.v for r in table.read(1).collect()} == {"old"}
    assert table.delete(spark.createDataFrame([(7,), (5000,)], "k long")) == 3 and table.read().count() == 200


def test_new_columns_and_null_keys(spark, table):
    table.upsert(spark.createDataFrame([(3, 1.5)], "k long, w double"))
    got = {r.k: (r.v, r.w) for r in table.read().collect()}
    assert got[3] == (None, 1.5) and got[4] == ("old", None) and len(got) == 200
    with pytest.raises(Exception, match="null"):
        table.upsert(rows(spark, (None, "x", 1)))
    assert table.upsert(rows(spark)) == table.versions()[-1]


def test_two_writers(spark, table):
    """A second writer commits while the first is at work: other buckets are taken over, the same bucket is done again."""
    for mine, other in (((1, "mine", 1), (1, "other", 1)), ((2, "mine", 1), (3, "other", 1)), ((4, "mine", 1), (9000, "other", 1))):
        second, commit, done = bucketed.Table(spark, table.path), table.commit, []

        def late(state):
            if not done:
                done.append(1)
                second.upsert(rows(spark, other))
            commit(state)

        table.commit = late
        table.upsert(rows(spark, mine))
        table.commit = commit
        got = {r.k: r.v for r in table.read().where(F.col("k").isin(mine[0], other[0])).collect()}
        assert got == {other[0]: "other", mine[0]: "mine"}
    with pytest.raises(bucketed.Taken):
        table.commit(table.snapshot())


def test_a_crash_before_the_commit(spark, table):
    commit = table.commit
    table.commit = lambda state: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        table.upsert(rows(spark, (1, "never", 1)))
    table.commit = commit
    assert {r.v for r in table.read().collect()} == {"old"}
    folders = len(os.listdir(f"{table.path}/data"))
    assert folders == 2 and table.vacuum() == 1 and table.read().count() == 200


def test_a_stream_twice(spark, table, tmp_path):
    for i in range(3):
        rows(spark, (1, f"s{i}", i), (100 + i, "s", i)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    bucketed.ingest(stream(), table, "s", str(tmp_path / "c1"), "t")
    versions = table.versions()
    bucketed.ingest(stream(), table, "s", str(tmp_path / "c2"), "t")  # as if the stream's own record were lost
    assert table.versions() == versions and table.read().count() == 200
    assert sum(r.v.startswith("s") for r in table.read().collect()) == 4
