"""Whole tables of questions, answered in one plan each."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import inverted, plan_retrieval
from newsloom.operators.dedup import shared_folder
from newsloom.plans.registry import query
from newsloom.plans.search import _ASKED, _TOKENS
from newsloom.plans.texts import FOLD
from newsloom.sources.views import ART, articles, table

_B = "(CASE WHEN {0} <= 0 THEN 0 WHEN {0} <= 1 THEN {0} ELSE {0} / (1 + {0}) END)"
_WORDS = "list_distinct(list_filter(regexp_extract_all({0}, '[\\pL\\pN_]+'), lambda w: length(w) >= 3))"
#: How many candidates a question has, and how many results.
FETCHED, TOP = 50, 8


@query(
    f"""WITH {_TOKENS}, {_ASKED}, {ART}, qd AS (SELECT DISTINCT item_id, token FROM qt), f AS (SELECT doc_id, token, count(*) AS f FROM t WHERE token IN (SELECT token FROM qd) GROUP BY 1, 2), fd AS (SELECT token, count(*) AS d FROM f GROUP BY 1),
 s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * l / a))), 9) AS b FROM qd JOIN f USING (token) JOIN fd USING (token) JOIN dl USING (doc_id), st GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY b DESC, doc_id) <= {FETCHED}),
 p AS (SELECT item_id, {_WORDS.format(FOLD.format('text'))} AS asked, list_sort(list_transform(list_filter({_WORDS.format(FOLD.format('text'))}, lambda w: length(w) >= 4), lambda w: {{'l': length(w), 'w': w}}))[1].w AS e, ['en', '', 'de', 'es'][item_id % 4 + 1] AS topic, item_id % 3 = 0 AS explicit, CASE WHEN item_id % 7 = 6 THEN 'src1' END AS src, item_id % 2 = 0 AS recent, item_id % 5 = 0 AS images FROM benchmark),
 c AS (SELECT s.item_id, doc_id, b, b / (1 + b) AS h, art.source, category, published_at, doc_id % 2 = 0 AS has_images, asked, e, topic, explicit, src, recent, images, {FOLD.format("title || ' ' || content")} AS body FROM s JOIN art ON art.article_id = s.doc_id JOIN p ON p.item_id = s.item_id),
 g AS (SELECT *, topic = '' OR category = topic AS on_topic, e IS NULL OR contains(body, e) AS named, NOT recent OR published_at >= TIMESTAMP '2024-01-13' AS timely, src IS NULL OR source = src AS from_source, NOT images OR has_images AS shown, count(*) FILTER (WHERE NOT explicit OR topic = '' OR category = topic) OVER (PARTITION BY item_id) >= {TOP} AS scoped FROM c),
 i AS (SELECT *, NOT scoped OR NOT explicit OR on_topic AS inside FROM g),
 m AS (SELECT *, inside AND on_topic AND named AND timely AND from_source AND shown AS s0, src IS NULL AND inside AND shown AND named AS s1, src IS NULL AND named AS s3, src IS NULL AND inside AS s4 FROM i),
 k AS (SELECT *, CASE WHEN bool_or(s0) OVER w THEN 0 WHEN bool_or(s1) OVER w THEN 1 WHEN bool_or(s3) OVER w THEN 3 WHEN bool_or(s4) OVER w THEN 4 ELSE -1 END AS lvl FROM m WINDOW w AS (PARTITION BY item_id)),
 o AS (SELECT *, CASE lvl WHEN 0 THEN s0 WHEN 1 THEN s1 WHEN 3 THEN s3 WHEN 4 THEN s4 ELSE false END AS hit FROM k), r AS (SELECT *, hit AND (lvl <> 4 OR row_number() OVER (PARTITION BY item_id ORDER BY hit DESC, h DESC, doc_id) <= 8) AS passed FROM o),
 u AS (SELECT *, passed AND NOT contains(body, 'worthless') AND (on_topic OR contains(body, 'ation')) AS good FROM r), v AS (SELECT *, count(*) FILTER (WHERE passed) OVER (PARTITION BY item_id) AS filtered, count(*) FILTER (WHERE good) OVER (PARTITION BY item_id) AS guarded FROM u),
 x AS (SELECT *, guarded = 0 AND lvl <= 0 AND src IS NULL AND NOT explicit AS fin FROM v), y AS (SELECT * FROM x WHERE CASE WHEN guarded > 0 THEN good WHEN fin THEN inside ELSE passed AND lvl > 0 END),
 z AS (SELECT *, CASE WHEN topic <> '' AND category = topic THEN 1.0 ELSE 0.0 END AS match, CASE WHEN e IS NOT NULL AND contains(body, e) THEN 1.0 ELSE 0.0 END AS ent, {_WORDS.format('body')} AS has, least(0.2, (row_number() OVER (PARTITION BY item_id, source ORDER BY h DESC, doc_id) - 1) * 0.05) AS again, CASE WHEN topic = '' OR category = topic THEN 0.0 WHEN explicit THEN 0.9 ELSE 0.45 END AS loss FROM y),
 n AS (SELECT *, (0.35 * {_B.format('h')} + 0.25 * {_B.format('b')} + 0.10 * (CASE WHEN len(asked) = 0 OR len(has) = 0 THEN 0 ELSE len(list_intersect(asked, has)) / len(asked) END)) * 0.40 + least(1.0, exp(-greatest(0, epoch(TIMESTAMP '2024-01-20' - published_at)) / 86400.0 / 5.0)) * 0.08 + ent * 0.08 + match * 0.44 + 0.7 * 0.05 + (CASE WHEN images AND has_images THEN 0.05 ELSE 0 END) - again - (CASE WHEN ent >= 0.75 THEN least(loss, 0.15) ELSE loss END) AS final FROM z)
 SELECT item_id, doc_id AS article_id, CASE WHEN fin THEN 'scoped_fallback' ELSE ['all', 'relaxed_entity_filter', '', 'entity_over_topic_fallback', 'pre_filter_topk_fallback'][lvl + 1] END AS step, filtered, guarded, round(final, 6) AS final_score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(final, 9) DESC, h DESC, doc_id) AS INTEGER) AS rank FROM n QUALIFY rank <= {TOP}"""
)
def retrieved_plans(spark, sf_dir):
    """The benchmark's passages as questions, each with a plan of its own: candidates from the stored index, then all of retrieval in one plan (R-05, F-05, F-06, F-16, F-17, O-08, O-10, W-04, T-27, A-29)."""
    folder = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    inverted.build(table(spark, sf_dir, "documents"), "doc_id", "text", folder)
    asked = table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    short = F.array_sort(F.transform(F.filter(T.terms(F.col("text")), lambda w: F.length(w) >= 4), lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))
    plans = asked.select(
        "item_id", F.col("text").alias("question"), F.lit("topic_news").alias("intent"), F.element_at(F.array(*map(F.lit, ("en", "", "de", "es"))), (i % 4 + 1).cast("int")).alias("topic"), (i % 3 == 0).alias("explicit_topic"), F.lit(0.5).alias("topic_confidence"),
        F.transform(F.slice(short, 1, 1), lambda x: x["w"]).alias("entities"), F.when(i % 7 == 6, "src1").alias("source"), F.when(i % 2 == 0, "7d").alias("time_range"), (i % 5 == 0).alias("need_images"), F.lit(5.0).alias("half_life"), F.lit(TOP).alias("least"), F.lit(TOP).alias("top"),
    )
    hits = inverted.search(spark, folder, asked, FETCHED, "item_id", "text")
    a = articles(spark, sf_dir)
    none = F.array().cast("array<string>")
    texts = a.select("article_id", "title", F.col("content").alias("text"), "source", F.col("category").alias("primary_topic"), none.alias("secondary_topics"), none.alias("entity_names"), "published_at", (F.col("article_id") % 2 == 0).alias("has_images"))
    b = F.col("bm25_score")
    candidates = hits.select(F.col("qid").alias("item_id"), F.col("key").alias("article_id"), "bm25_score", F.lit(0.0).alias("vector_score"), (b / (1 + b)).alias("hybrid_score")).join(texts, "article_id")
    body = F.col("_body")
    found = plan_retrieval.retrieve(candidates, plans, "item_id", F.expr("timestamp_ntz '2024-01-20'"), [F.desc("hybrid_score"), F.col("article_id")], body.contains("worthless"), body.contains("ation"), F.lit(False))
    return found.select("item_id", "article_id", "step", F.col("counts.filtered").alias("filtered"), F.col("counts.guarded").alias("guarded"), F.round("final_score", 6).alias("final_score"), "rank")
