import corpus_pipeline as c
from newsloom.llm import ngram_jaccard, substring_dedup


def test_stages_on_hard_rows(spark, docs, rows, tmp_path):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 0, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for name, stage in c.STAGES:
        after = stage(spark, now, str(tmp_path))
        after.write.parquet(str(tmp_path / name.replace(" ", "_")))
        after = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        if name != c.STAGES[-1][0]:
            assert after.columns == docs.columns
            assert {r.row_hash for r in after.collect()} == {"r"} and {r._score for r in after.collect()} == {0.5}
        if name.startswith("n-gram"):
            again = ngram_jaccard.join(after, 5).where("doc_id is not null and n_shingles > 0").collect()
            assert all(r.component_id == r.doc_id for r in again)
        if name.startswith("substring"):
            assert after.count() == now.count()
            whole = {(r.doc_id, r.text) for r in now.collect()}
            removed = {r.doc_id for r in substring_dedup.deduplicate(now).where("n_removed > 0").collect()}
            assert all((r.doc_id, r.text) in whole or r.doc_id in removed for r in after.collect())
        now = after
    assert now.count() > 0


def test_empty_table(spark, none, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    none.write.parquet(str(tmp_path / "documents.parquet"))
    assert c.run(spark, str(tmp_path)).count() == 0
