"""Queries over whole tables, on tables large enough that a cut of rows shows."""

import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracles import ORACLES, QUERIES, plain

from newsloom.operators import assembly, classify, retrieval

DATA = "/root/testdata/sf0.01"
RANKING = ["reranked", "simple_rerank", "scoped_candidates", "fallback_ladder", "topic_guard", "evidence_gate", "filtered_candidates"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def same(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", RANKING)
def test_ranking_takes_every_article(spark, duck, name):
    same(spark, duck, name)


def test_ids_beyond_the_old_cut(spark):
    assert QUERIES["reranked"](spark, DATA).where("article_id >= 500").count() > 0


def test_texts_of_every_whole_chunk(spark):
    chunks = {r.chunk_id: (r.article_id, r.chunk_text) for r in QUERIES["article_chunks"](spark, DATA).collect()}
    topics = {r.article_id: r.primary_topic for r in QUERIES["article_topics"](spark, DATA).collect()}
    entities = {}
    for r in QUERIES["article_entities"](spark, DATA).orderBy("doc_id", "type", "name").collect():
        entities.setdefault(r.doc_id, []).append(r.name)
    titles = {r.doc_id: ((r.text or "").split("\n")[0], r.source) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    shown = {"first": "First", "second": "Second", "third": "Third", classify.GENERAL[0]: classify.GENERAL[1]}
    got = QUERIES["embedding_texts"](spark, DATA).collect()
    assert sorted(r.chunk_id for r in got) == sorted(chunks)
    for r in got:
        article, text = chunks[r.chunk_id]
        (title, source), topic, names = titles[article], shown[topics[article]], entities.get(article, [])
        date = (datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=article)).isoformat()
        assert r.embedding_text == f"Tiêu đề: {title}\nTóm tắt: \nChủ đề: {topic}\nThực thể: {', '.join(names)}\nNguồn: {source}\nNgày đăng: {date}\nNội dung:\n{text}"
        assert r.search_text == "\n".join([title, source, topic, ",".join(names), " ".join(names), text])


def test_statistics_of_rare_terms(spark, duck):
    same(spark, duck, "postings_statistics")
    assert QUERIES["postings_statistics"](spark, DATA).where("documents < 5").count() > 0


def test_every_article_is_cited(spark, duck):
    same(spark, duck, "citations")
    same(spark, duck, "diverse_chunks")


def test_few_articles_are_enough(spark):
    chunks = spark.createDataFrame([(1, 10, 0.2), (1, 11, 0.1), (2, 20, 0.3), (2, 21, 0.3), (2, 22, 0.0), (3, 30, 0.2), (None, 40, 0.9)], "a int, o int, s double")
    assert {r.a: r.citation for r in assembly.cited(chunks, "a", "s", "o").collect()} == {None: 1, 2: 2, 1: 3, 3: 4}
    capped = assembly.capped_articles(chunks, "a", [F.desc("s"), F.col("o")], 2, 3).collect()
    assert sorted(r.o for r in capped) == [10, 11, 20, 21, 40]


def test_every_scored_document_is_diversified(spark):
    docs = spark.createDataFrame([(i, "that letion" if i % 2 else "none") for i in range(40)], "d int, t string")
    assert retrieval.bm25(docs, "d", "t", "that letion", None).count() == 20
    assert "1000000" not in QUERIES["diversified_topk"](spark, DATA)._jdf.queryExecution().toString()
