"""Evaluation of responses made from documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import evaluation as E
from newsloom.plans.registry import query
from newsloom.plans.texts import FOLD
from newsloom.sources.views import articles, table

_AS_OF = "2024-02-20"
#: A response for each document, in DuckDB's words; responses() says the same.
_RESPONSES = f"""a AS (SELECT doc_id, source, lang, text, split_part(text, chr(10), 1) AS title, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS made_at FROM documents),
 r AS (SELECT *, CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN 'Không tìm thấy' WHEN 2 THEN NULL ELSE left(text, (doc_id % 80)::INT) END AS answer, CASE doc_id % 3 WHEN 0 THEN 'latest_news' WHEN 1 THEN 'topic_news' ELSE '' END AS intent, CASE lang WHEN 'en' THEN 'World_News' WHEN 'de' THEN 'kinh_te' ELSE 'internet' END AS topic,
  (doc_id % 4)::INT AS n_sources, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE (doc_id % 3)::INT END AS n_images, (doc_id % 3)::INT AS n_related, CASE doc_id % 4 WHEN 0 THEN 'finance' WHEN 1 THEN 'world' WHEN 2 THEN 'ai' END AS expected FROM a)"""


def responses(spark, sf_dir):
    """A response and what was expected of it for each document."""
    d = articles(spark, sf_dir).withColumnsRenamed({"article_id": "doc_id", "content": "text", "category": "lang"})
    i = F.col("doc_id")
    source = lambda k: F.struct(F.when(F.lit(k) == 1, F.col("source")).otherwise(F.lit(f"src{k}")).alias("source"), F.col("title").alias("title"), (F.col("published_at") - F.expr(f"interval {k} days")).alias("published_at"))
    related = lambda k: F.struct(F.lit(None).cast("string").alias("article_id"), F.when(F.lit(k) == 2, F.lit(" ONE ")).otherwise(F.lit("one")).alias("title"))
    take = lambda make, n, most: F.slice(F.array(*(make(k) for k in range(1, most + 1))), F.lit(1), n.cast("int"))
    expected = F.when(i % 4 == 0, "finance").when(i % 4 == 1, "world").when(i % 4 == 2, "ai")
    return d.select(
        "doc_id",
        F.when(i % 9 == 0, "").when(i % 9 == 1, "Không tìm thấy").when(i % 9 == 2, F.lit(None)).otherwise(F.left("text", (i % 80).cast("int"))).alias("answer"),
        F.when(i % 3 == 0, "latest_news").when(i % 3 == 1, "topic_news").otherwise("").alias("intent"),
        F.when(F.col("lang") == "en", "World_News").when(F.col("lang") == "de", "kinh_te").otherwise("internet").alias("topic"),
        take(source, i % 4, 3).alias("sources"),
        F.when(i % 5 == 0, F.lit(None)).otherwise(take(lambda k: F.lit(f"u{k}"), i % 3, 2)).alias("images"),
        take(related, i % 3, 2).alias("related"),
        F.array(F.lit("Zoo")).alias("entities"),
        F.when(i % 2 == 0, "latest_news").alias("expected_intent"),
        F.array_compact(F.array(expected)).alias("expected_topics"),
        F.when(i % 6 == 0, "SRC1").otherwise("").alias("expected_source"),
        F.when(i % 7 == 0, F.array(F.lit("zóo"))).when(i % 7 == 1, F.array(F.lit("there"))).otherwise(F.array().cast("array<string>")).alias("expected_entities"),
        (i % 3).cast("int").alias("min_sources"),
        (i % 2).cast("int").alias("min_images"),
        (i % 2 == 1).alias("requires_multi_source"),
        (i % 3 == 1).alias("requires_images"),
        (i % 5 != 4).alias("requires_recent"),
    )


_SCORES = f"""s AS (SELECT *, CASE WHEN n_images IS NULL OR answer IS NULL THEN 'FAIL' ELSE 'OK' END AS schema_score, CASE WHEN doc_id % 2 <> 0 THEN 'SKIP' WHEN intent <> 'latest_news' THEN 'WARN' ELSE 'OK' END AS intent_score,
  CASE WHEN expected IS NULL THEN 'SKIP' WHEN (expected = 'finance' AND topic = 'kinh_te') OR (expected = 'world' AND topic = 'World_News') OR (expected = 'ai' AND topic = 'internet') THEN 'OK' ELSE 'WARN' END AS topic_score,
  CASE WHEN n_sources < doc_id % 3 OR (doc_id % 6 = 0 AND NOT (n_sources >= 1 AND contains(lower(source), 'src1'))) THEN 'WARN' ELSE 'OK' END AS source_score,
  CASE WHEN doc_id % 2 <> 1 THEN 'SKIP' WHEN n_sources >= 3 OR (n_sources = 2 AND source <> 'src2') THEN 'OK' ELSE 'WARN' END AS multi_source_score,
  CASE doc_id % 7 WHEN 0 THEN 'OK' WHEN 1 THEN CASE WHEN n_sources > 0 AND contains({FOLD.format('title')}, 'there') THEN 'OK' ELSE 'WARN' END ELSE 'SKIP' END AS entity_score,
  CASE WHEN doc_id % 3 <> 1 THEN 'SKIP' WHEN coalesce(n_images, 0) < 1 THEN 'WARN' ELSE 'OK' END AS image_score, CASE WHEN (n_related = 0 AND n_sources > 0) OR n_related = 2 THEN 'WARN' ELSE 'OK' END AS related_score,
  CASE WHEN trim(coalesce(answer, '')) = '' THEN 'FAIL' WHEN (n_sources > 0 AND (doc_id % 9 = 1 OR length(trim(answer)) < 40)) OR (n_sources = 0 AND doc_id % 9 <> 1) THEN 'WARN' ELSE 'OK' END AS answer_score,
  CASE WHEN doc_id % 5 = 4 THEN 'SKIP' WHEN n_sources = 0 OR floor(epoch(TIMESTAMP '{_AS_OF}' - (made_at - INTERVAL 1 DAY)) / 86400) > 30 THEN 'WARN' ELSE 'OK' END AS recency_score FROM r),
 t AS (SELECT *, CASE WHEN 'FAIL' IN (schema_score, answer_score) THEN 'FAIL' WHEN 'WARN' IN (intent_score, topic_score, source_score, multi_source_score, entity_score, image_score, related_score, answer_score, recency_score) THEN 'WARN' ELSE 'OK' END AS status FROM s)"""


@query(f"WITH {_RESPONSES}, {_SCORES} SELECT doc_id, schema_score, intent_score, topic_score, source_score, multi_source_score, entity_score, image_score, related_score, answer_score, recency_score, status FROM t")
def response_scores(spark, sf_dir):
    """Ten scores of every response, and the worst (R-12)."""
    found = E.scored(responses(spark, sf_dir), F.expr(f"timestamp_ntz '{_AS_OF}'"))
    return found.select("doc_id", *(c for c in found.columns if c.endswith("_score")), "status")


@query(f"WITH {_RESPONSES}, {_SCORES} SELECT status, count(*) AS responses FROM t GROUP BY 1")
def evaluation_status(spark, sf_dir):
    """How many responses are fine (A-14, K-14)."""
    return E.rolled_up(E.scored(responses(spark, sf_dir), F.expr(f"timestamp_ntz '{_AS_OF}'")))


@query(
    f"""WITH {_RESPONSES} SELECT doc_id, CASE WHEN trim(coalesce(answer, '')) = '' THEN 'FAIL' WHEN n_sources = 0 THEN 'FAIL' WHEN contains({FOLD.format('answer')}, 'khong tim thay') THEN 'WARN' WHEN n_sources >= 2 THEN 'OK' ELSE 'WARN' END AS status,
  CASE WHEN trim(coalesce(answer, '')) = '' THEN 'empty_answer' WHEN n_sources = 0 THEN 'missing_sources' WHEN contains({FOLD.format('answer')}, 'khong tim thay') THEN 'answer_indicates_insufficient_data' WHEN n_sources >= 2 THEN 'answer_has_multiple_sources' ELSE 'single_source' END AS reason,
  CASE WHEN n_images IS NULL OR answer IS NULL THEN 'FAIL' WHEN n_sources = 0 THEN 'WARN' ELSE 'OK' END AS smoke FROM r"""
)
def answer_reasons(spark, sf_dir):
    """Why an answer does or doesn't hold, and whether the response is whole (R-11, R-13)."""
    r = responses(spark, sf_dir)
    status = E.answer_status(T.folded(F.col("answer")), F.size("sources"))
    whole = F.col("images").isNotNull() & F.col("answer").isNotNull()
    return r.select("doc_id", status["status"].alias("status"), status["reason"].alias("reason"), E.smoke(whole, F.size("sources")).alias("smoke"))


@query(
    f"""WITH d AS (SELECT doc_id, {FOLD.format('text')} AS a, CASE lang WHEN 'en' THEN 'economy_finance_stock' WHEN 'de' THEN 'general_news' ELSE 'real_estate' END AS topic, CASE WHEN doc_id % 3 = 0 THEN ['real_estate'] WHEN doc_id % 3 = 1 THEN ['economy_finance_stock', 'x'] ELSE [] END AS st FROM documents)
 SELECT doc_id, array_to_string(list_filter([CASE WHEN topic = 'economy_finance_stock' AND contains(a, 'worth') THEN 'forbidden_technical_terms' END, CASE WHEN contains(a, 'chaft') OR contains(a, 'ering') THEN 'instruction_leak' END, CASE WHEN topic = 'economy_finance_stock' AND doc_id % 2 = 0 AND NOT contains(a, 'ation') THEN 'stock_answer_missing_stock_terms' END,
  CASE WHEN topic <> 'general_news' AND len(st) > 0 AND NOT list_contains(st, topic) THEN 'sources_do_not_match_answer_topic' END], lambda x: x IS NOT NULL), ',') AS violations FROM d"""
)
def answer_violations(spark, sf_dir):
    """What speaks against answers of a topic (R-11)."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    topic = F.when(F.col("lang") == "en", "economy_finance_stock").when(F.col("lang") == "de", "general_news").otherwise("real_estate")
    sources = F.when(i % 3 == 0, F.array(F.lit("real_estate"))).when(i % 3 == 1, F.array(F.lit("economy_finance_stock"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    asked = F.when(i % 2 == 0, "ration").otherwise("none")
    return d.select("doc_id", F.array_join(E.violations(F.col("text"), asked, topic, sources, ("chaft", "ering"), ("worth",), ("ation",)), ",").alias("violations"))


@query("SELECT o_orderkey, array_to_string(list_sort(list_filter([o_orderkey % 7, o_orderkey % 5, 3], lambda x: x > o_custkey % 4)), ',') AS wrong FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 7 <> o_orderkey % 5 AND o_orderkey % 7 <> 3 AND o_orderkey % 5 <> 3)")
def wrong_citations(spark, sf_dir):
    """Citations of no source (U-04)."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 7 != o_orderkey % 5 and o_orderkey % 7 != 3 and o_orderkey % 5 != 3")
    cited = F.expr("array(o_orderkey % 7, o_orderkey % 5, cast(3 as bigint))")
    return o.select("o_orderkey", F.array_join(E.uncited(cited, F.expr("sequence(cast(0 as bigint), o_custkey % 4)")), ",").alias("wrong"))
