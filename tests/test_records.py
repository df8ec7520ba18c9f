"""Sinks and sources around articles."""

import datetime

import pytest

from newsloom.operators import records as R


def test_audit_files(spark, tmp_path):
    rows = [("1", "t", "c", "s1", "economy_finance_stock", datetime.datetime(2024, 1, 5)), ("2", "t", "c", "s1", "x", datetime.datetime(2024, 1, 6)), ("3", "t", "c", "s2", "economy_finance_stock", datetime.datetime(2024, 1, 7))]
    df = spark.createDataFrame(rows, "article_id string, title string, cleaned_content string, source_name string, topic string, published_at timestamp_ntz")
    df.write.json(str(tmp_path / "a"))
    read = lambda **k: [r.article_id for r in R.read_audit(spark, str(tmp_path / "a"), **k).orderBy("article_id").collect()]
    from pyspark.sql import functions as F

    assert read() == ["1", "2", "3"] and read(source="s1") == ["1", "2"] and read(topic="kinh_te_tai_chinh_chung_khoan") == ["1", "3"] and read(limit=2) == ["1", "2"]
    assert read(since=F.lit(datetime.datetime(2024, 1, 6)).cast("timestamp_ntz")) == ["2", "3"]
    (tmp_path / "a" / "bad.json").write_text("{broken")
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILED_READ|Malformed"):
        read()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("OK", 3), ("FAIL", 1)], "status string, n int")
    folder = R.report(df, str(tmp_path))
    assert sorted(map(tuple, spark.read.json(folder).select("status", "n").collect())) == [("FAIL", 1), ("OK", 3)]
    empty = spark.read.parquet(R.reset(df, str(tmp_path / "t")))
    assert empty.count() == 0 and empty.columns == df.columns


def test_embedding_in_batches(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(150)], "id int, embedding_text string").coalesce(1)

    def embed(texts):
        assert len(texts) <= 64
        return [[len(t), 1] for t in texts]

    got = {r.id: r.embedding for r in R.embedded(df, embed).collect()}
    assert got == {i: [0.0 if i == 3 else float(i), 1.0] for i in range(150)}
    with pytest.raises(Exception, match="as many vectors"):
        R.embedded(df, lambda texts: texts[:1] and [[1.0]]).collect()
