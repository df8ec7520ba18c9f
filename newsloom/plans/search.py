"""Retrieval queries: BM25, lexical, vector, hybrid."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.operators import inverted, retrieval
from newsloom.operators.dedup import shared_folder
from newsloom.plans.registry import query
from newsloom.sources.views import articles, table

_TOKENS = """w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9À-ỹĐđ-]+')) AS raw FROM documents),
 t AS (SELECT doc_id, token FROM (SELECT doc_id, lower(replace(replace(strip_accents(raw), 'đ', 'd'), 'Đ', 'D')) AS token FROM w) WHERE length(token) >= 2
 UNION ALL SELECT doc_id, raw FROM w WHERE raw = upper(raw) AND raw <> lower(raw) AND length(raw) BETWEEN 2 AND 8),
 dl AS (SELECT doc_id, count(t.token) AS l FROM documents LEFT JOIN t USING (doc_id) GROUP BY 1), st AS (SELECT count(*) AS n, avg(l) AS a FROM dl),
 tf AS (SELECT doc_id, token, count(*) AS f FROM t WHERE token IN ('that', 'ation', 'with', 'letion') GROUP BY 1, 2), df AS (SELECT token, count(*) AS d FROM tf GROUP BY 1),
 bm AS (SELECT doc_id, sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * l / a))) AS s FROM tf JOIN df USING (token) JOIN dl USING (doc_id), st GROUP BY 1)"""
QUESTION = "that ation with letion"


@query(f"WITH {_TOKENS} SELECT doc_id, round(s, 6) AS bm25_score, CAST(row_number() OVER (ORDER BY s DESC, doc_id) AS INTEGER) AS rank FROM bm ORDER BY s DESC, doc_id LIMIT 20")
def bm25_topk(spark, sf_dir):
    """The best documents for a query (A-15, J-15, X-51, R-02, O-05, W-11)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.bm25(d, "doc_id", "text", QUESTION, 20).withColumn("bm25_score", F.round("bm25_score", 6))


@query(f"WITH {_TOKENS} SELECT doc_id, round(s, 6) AS bm25_score FROM bm JOIN documents USING (doc_id) WHERE lower(source) = 'src3' ORDER BY s DESC, doc_id LIMIT 10")
def bm25_filtered(spark, sf_dir):
    """Filters leave the statistics alone (F-04, Q-28)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return retrieval.bm25(d, "doc_id", "text", QUESTION, 10, F.lower("source") == "src3").select("doc_id", F.round("bm25_score", 6).alias("bm25_score"))


_ASKED = _TOKENS.split("),\n dl AS")[0].replace("documents", "benchmark").replace("doc_id", "item_id").replace("w AS", "qw AS").replace("t AS", "qt AS").replace("FROM w", "FROM qw") + ")"


@query(
    f"""WITH {_TOKENS}, {_ASKED}, q AS (SELECT DISTINCT item_id, token FROM qt), f AS (SELECT doc_id, token, count(*) AS f FROM t WHERE token IN (SELECT token FROM q) GROUP BY 1, 2), fd AS (SELECT token, count(*) AS d FROM f GROUP BY 1),
 s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * l / a))), 9) AS s FROM q JOIN f USING (token) JOIN fd USING (token) JOIN dl USING (doc_id), st GROUP BY 1, 2)
 SELECT item_id, doc_id, round(s, 6) AS bm25_score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5"""
)
def bm25_questions(spark, sf_dir):
    """A table of questions, the benchmark's passages, answered from a stored index (A-15, J-15, R-02, O-05, W-11)."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    inverted.build(table(spark, sf_dir, "documents"), "doc_id", "text", folder)
    found = inverted.search(spark, folder, table(spark, sf_dir, "benchmark"), 5, "item_id", "text")
    return found.select(F.col("qid").alias("item_id"), F.col("key").alias("doc_id"), F.round("bm25_score", 6).alias("bm25_score"), "rank")


@query(f"WITH {_TOKENS} SELECT token AS term, count(*) AS documents, sum(f)::BIGINT AS occurrences FROM (SELECT doc_id, token, count(*) AS f FROM t GROUP BY 1, 2) GROUP BY 1")
def postings_statistics(spark, sf_dir):
    """The index of all terms (A-15)."""
    p = retrieval.postings(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return p.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


@query("SELECT article_id, (3 * contains(lt, 'the')::INT + contains(lx, 'the')::INT + 3 * contains(lt, 'ation')::INT + contains(lx, 'ation')::INT)::DOUBLE AS lexical_score FROM (SELECT doc_id AS article_id, lower(strip_accents(split_part(text, chr(10), 1))) AS lt, lower(strip_accents(text)) AS lx FROM documents) WHERE contains(lx, 'the') OR contains(lx, 'ation') ORDER BY 2 DESC, 1 LIMIT 50")
def lexical_topk(spark, sf_dir):
    """Terms in titles and texts (R-03, X-52, O-06)."""
    return retrieval.lexical(articles(spark, sf_dir), "article_id", "title", "content", ["the", "ation"], 50)


_COS = """q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, 1 - list_dot_product(embedding::DOUBLE[], e::DOUBLE[]) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]))) AS d FROM embeddings, q)"""


@query(f"WITH {_COS} SELECT vec_id, round(d, 6) + 0 AS distance, round(1 / (1 + d), 6) AS score FROM v ORDER BY d, vec_id LIMIT 20")
def vector_topk(spark, sf_dir):
    """Exact nearest by cosine (R-01, J-16, X-50, O-04)."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id = 0").select("embedding").first()
    found = retrieval.nearest(e, "vec_id", "embedding", asked[0] if asked else [], 20)
    return found.select("vec_id", (F.round("distance", 6) + 0.0).alias("distance"), F.round("score", 6).alias("score"))


@query(
    f"""WITH {_TOKENS}, {_COS}, vt AS (SELECT vec_id AS k, 1 / (1 + d) AS s FROM v ORDER BY d, vec_id LIMIT 40), bt AS (SELECT doc_id AS k, s FROM bm ORDER BY s DESC, doc_id LIMIT 40),
 j AS (SELECT coalesce(vt.k, bt.k) AS k, coalesce(vt.s, 0) AS vs, coalesce(bt.s, 0) AS bs FROM vt FULL JOIN bt ON vt.k = bt.k),
 b AS (SELECT (SELECT min(s) FROM vt) AS lv, (SELECT max(s) FROM vt) AS hv, (SELECT min(s) FROM bt) AS lb, (SELECT max(s) FROM bt) AS hb),
 h AS (SELECT k, vs, bs, 0.65 * (vs - lv) / (hv - lv) + 0.35 * (bs - lb) / (hb - lb) AS hs FROM j, b)
 SELECT k AS article_id, round(vs, 6) AS vector_score, round(bs, 6) AS bm25_score, round(hs, 6) AS hybrid_score, round(greatest(vs, hs), 6) AS score FROM h"""
)
def hybrid_merge(spark, sf_dir):
    """Two lists as one (R-04, J-03, A-16, X-53, Q-01, Q-03, U-02)."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id = 0").select("embedding").first()
    v = retrieval.nearest(e, "vec_id", "embedding", asked[0] if asked else [], 40).withColumnRenamed("vec_id", "article_id")
    b = retrieval.bm25(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text"), "article_id", "text", QUESTION, 40)
    found = retrieval.hybrid(v, b, "article_id", retrieval.weights_for(QUESTION, False))
    return found.select("article_id", *(F.round(c, 6).alias(c) for c in ("vector_score", "bm25_score", "hybrid_score", "score")))


@query(
    f"""WITH {_TOKENS}, r AS (SELECT doc_id, source, s, row_number() OVER (PARTITION BY source ORDER BY s DESC, doc_id) AS n FROM bm JOIN documents USING (doc_id))
 SELECT doc_id, source, round(s, 6) AS bm25_score FROM r WHERE n <= 3 ORDER BY s DESC, doc_id LIMIT 20"""
)
def diversified_topk(spark, sf_dir):
    """At most so many of a source (W-04, W-05)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    ranked = retrieval.bm25(d.drop("source"), "doc_id", "text", QUESTION, None).join(d.select("doc_id", "source"), "doc_id")
    few = retrieval.diversified(ranked, "doc_id", "source", [F.desc("bm25_score"), F.col("doc_id")], 20)
    return few.select("doc_id", "source", F.round("bm25_score", 6).alias("bm25_score"))
