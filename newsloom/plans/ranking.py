"""Reranking, scoping and guarding over candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import rerank
from newsloom.plans.registry import query
from newsloom.sources.views import ART, articles

_CAND = f"{ART}, cand AS (SELECT article_id, source, category, title, content, published_at, (article_id % 97) / 97.0::DOUBLE AS v, (article_id % 13)::DOUBLE AS b, (article_id % 29) / 29.0::DOUBLE AS h FROM art)"
_B = "CASE WHEN {0} <= 0 THEN 0 WHEN {0} <= 1 THEN {0} ELSE {0} / (1 + {0}) END"


def candidates(spark, sf_dir):
    """Articles with made-up scores that both engines can compute."""
    a = articles(spark, sf_dir)
    i = F.col("article_id")
    return a.select(
        "article_id", "source", "title", F.col("content").alias("text"), "published_at", F.col("category").alias("primary_topic"), F.when(i % 4 == 0, F.array(F.lit("en"))).otherwise(F.array().cast("array<string>")).alias("secondary_topics"),
        F.array().cast("array<string>").alias("entity_names"), (i % 2 == 0).alias("has_images"), (i % 97 / F.lit(97.0)).alias("vector_score"), (i % 13).cast("double").alias("bm25_score"), (i % 29 / F.lit(29.0)).alias("hybrid_score"),
    )


@query(
    f"""WITH {_CAND}, r AS (SELECT *, 0.35 * ({_B.format('h')}) + 0.30 * ({_B.format('v')}) + 0.25 * ({_B.format('b')}) AS rel, CASE WHEN category = 'en' THEN 1.0 WHEN article_id % 4 = 0 THEN 0.5 ELSE 0.0 END AS t,
 least(0.2, (row_number() OVER (PARTITION BY source ORDER BY h DESC, article_id) - 1) * 0.05) AS div, least(1.0, greatest(0.0, exp(-epoch(TIMESTAMP '2024-02-01' - published_at) / 86400.0 / 1.5))) AS rec FROM cand)
 SELECT article_id, round(rel * 0.38 + rec * 0.16 + t * 0.38 + (CASE WHEN source = 'src1' THEN 1.0 ELSE 0.7 END) * 0.05 + (CASE WHEN article_id % 2 = 0 THEN 0.05 ELSE 0 END) - div - (CASE WHEN t > 0 THEN 0 ELSE 0.9 END), 6) AS final_score FROM r"""
)
def reranked(spark, sf_dir):
    """The whole composite (X-43, X-44, X-55, X-56, X-57, X-59, X-62, X-65, W-03, O-09, Q-34)."""
    q = rerank.Question(intent="latest_news", topic="en", explicit_topic=True, preferred_sources=("src1",), need_images=True, days=1.5)
    found = rerank.rerank(candidates(spark, sf_dir), q, F.expr("timestamp_ntz '2024-02-01'"), [F.desc("hybrid_score"), F.col("article_id")])
    return found.select("article_id", F.round("final_score", 6).alias("final_score"))


@query(f"WITH {_CAND} SELECT article_id, round(v * 0.7 + 0.25 * contains(' ' || regexp_replace(lower(content), '[^a-z]+', ' ', 'g') || ' ', ' the ')::INT + 0.05 * contains(' ' || regexp_replace(lower(title), '[^a-z]+', ' ', 'g') || ' ', ' the ')::INT, 6) AS final_score FROM cand WHERE category = 'en'")
def simple_rerank(spark, sf_dir):
    """Vector score and words of the question (X-08, X-09, X-63, O-08, U-03)."""
    c = candidates(spark, sf_dir).where("primary_topic = 'en'")
    return c.select("article_id", F.round(rerank.simple_score(F.col("vector_score"), "the", F.col("text"), F.col("title")), 6).alias("final_score"))


@query(f"WITH {_CAND} SELECT article_id, true AS scoped FROM cand WHERE category = 'de'")
def scoped_candidates(spark, sf_dir):
    """Only the topic's candidates where there are enough (F-15)."""
    return rerank.scoped(candidates(spark, sf_dir), F.col("primary_topic") == "de", 5).select("article_id", "scoped")


@query(f"WITH {_CAND}, n AS (SELECT count(*) FILTER (WHERE category = 'de') >= 1000000000 AS scoped FROM cand) SELECT article_id, scoped FROM cand, n WHERE NOT scoped OR category = 'de'")
def unscoped_candidates(spark, sf_dir):
    """All candidates where the topic has too few (F-15)."""
    return rerank.scoped(candidates(spark, sf_dir), F.col("primary_topic") == "de", 1_000_000_000).select("article_id", "scoped")


@query(
    f"""WITH {_CAND}, m AS (SELECT article_id, category = 'fr' AND published_at > TIMESTAMP '2025-01-01' AS a, category = 'fr' AND published_at >= TIMESTAMP '2024-01-15' AS b FROM cand), f AS (SELECT bool_or(a) AS fa, bool_or(b) AS fb FROM m)
 SELECT article_id, CASE WHEN fa THEN 'strict' WHEN fb THEN 'relaxed_time' ELSE 'pre_filter' END AS step FROM m, f WHERE CASE WHEN fa THEN a WHEN fb THEN b ELSE true END"""
)
def fallback_ladder(spark, sf_dir):
    """The first condition that any candidate meets (F-06, F-16)."""
    steps = [("strict", (F.col("primary_topic") == "fr") & (F.col("published_at") > F.expr("timestamp_ntz '2025-01-01'"))), ("relaxed_time", (F.col("primary_topic") == "fr") & (F.col("published_at") >= F.expr("timestamp_ntz '2024-01-15'"))), ("pre_filter", F.lit(True))]
    return rerank.laddered(candidates(spark, sf_dir), steps).select("article_id", "step")


@query(
    f"""WITH {_CAND}, m AS (SELECT contains(lower(content), 'worthless') AS denied, category = 'en' AS on_topic, contains(lower(content), 'ation') AS allowed, v > 0.5 AS soft FROM cand),
 c AS (SELECT count(*) AS retrieved, count(*) FILTER (WHERE NOT denied AND (on_topic OR soft)) AS kept, count(*) FILTER (WHERE NOT denied AND NOT on_topic AND NOT soft) AS wrong_topic, count(*) FILTER (WHERE denied) AS denied, count(*) FILTER (WHERE on_topic) AS topic_matches, count(*) FILTER (WHERE allowed) AS allow_matches FROM m)
 SELECT *, CASE WHEN kept < least(2, retrieved) THEN 'too_few_valid_chunks_after_guard' WHEN wrong_topic / retrieved > 0.4 THEN 'wrong_topic_ratio_above_threshold' WHEN allow_matches = 0 AND topic_matches = 0 THEN 'no_topic_or_allow_keyword_evidence' ELSE 'ok' END AS reason,
 round(least(1.0, kept / retrieved * 0.6 + topic_matches / retrieved * 0.3 + least(0.1, allow_matches * 0.03)), 6) AS guard_score FROM c"""
)
def topic_guard(spark, sf_dir):
    """A verdict on a context (F-17, A-29, Q-27)."""
    text = F.lower("text")
    g = rerank.guarded(candidates(spark, sf_dir), text.contains("worthless"), F.col("primary_topic") == "en", text.contains("ation"), F.col("vector_score") > 0.5)
    return g.withColumn("guard_score", F.round("guard_score", 6))


@query(f"WITH {_CAND} SELECT max(v) AS best_vector, max(greatest(v, b, h)) AS best_any, max(v) >= 0.05 AND max(greatest(v, b, h)) >= 0.15 AS sufficient FROM cand")
def evidence_gate(spark, sf_dir):
    """Whether the best scores suffice (F-18, F-19, F-20, Q-32)."""
    return rerank.evidence(candidates(spark, sf_dir), "vector_score", "bm25_score", "hybrid_score")


@query(f"WITH {_CAND} SELECT article_id FROM cand WHERE CAST(published_at + INTERVAL 7 HOUR AS DATE) = DATE '2024-01-12' AND lower(source) IN ('src1', 'src2', 'src3', 'src4') AND article_id % 2 = 0")
def filtered_candidates(spark, sf_dir):
    """A local date, sources, and images (F-10, F-11, F-12, F-13, F-14, Q-19)."""
    from newsloom.functions.text import truthy

    local = F.to_date(F.col("published_at") + F.expr("interval 7 hours"))
    return candidates(spark, sf_dir).where((local == F.lit("2024-01-12").cast("date")) & F.lower("source").isin("src1", "src2", "src3", "src4") & truthy(F.col("has_images"))).select("article_id")


@query(
    f"""WITH {_CAND}, g AS (SELECT source, max(v) AS best, strftime(max(published_at), '%Y-%m-%d %H:%M:%S') AS newest FROM cand GROUP BY source) SELECT source, round(best, 9) AS best, newest, row_number() OVER (ORDER BY best DESC, newest DESC, source) AS place FROM g"""
)
def articles_in_order(spark, sf_dir):
    """Groups by their best score, then by time as text (O-07, O-10)."""
    from pyspark.sql import Window

    g = candidates(spark, sf_dir).groupBy("source").agg(F.max("vector_score").alias("best"), F.date_format(F.max("published_at"), "yyyy-MM-dd HH:mm:ss").alias("newest"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.desc("best"), F.desc("newest"), "source")  # one row for each source
    return g.select("source", F.round("best", 9).alias("best"), "newest", F.row_number().over(order).cast("long").alias("place"))


@query(f"WITH {_CAND} SELECT count(*) AS candidates, max(h) AS best, coalesce(max(h) < 0.99, true) AS weak FROM cand")
def weak_context(spark, sf_dir):
    """Whether even the best final score is below a limit (F-20)."""
    return rerank.weak(candidates(spark, sf_dir).withColumn("final_score", F.col("hybrid_score")), 0.99).select("candidates", "best", "weak")


def _weighted(name: str, w: tuple) -> str:
    return f"WHEN '{name}' THEN rel * {w[0]} + rec * {w[1]} + t * {w[3]}"


@query(
    f"""WITH {_CAND}, k AS (SELECT unnest({list(rerank.WEIGHTS)}) AS intent), r AS (SELECT *, 0.35 * ({_B.format('h')}) + 0.30 * ({_B.format('v')}) + 0.25 * ({_B.format('b')}) AS rel, CASE WHEN category = 'en' THEN 1.0 WHEN article_id % 4 = 0 THEN 0.5 ELSE 0.0 END AS t, least(1.0, greatest(0.0, exp(-epoch(TIMESTAMP '2024-02-01' - published_at) / 86400.0 / 5.0))) AS rec,
  least(0.2, (row_number() OVER (PARTITION BY source ORDER BY h DESC, article_id) - 1) * 0.05) AS div FROM cand)
 SELECT intent, article_id, round(CASE intent {' '.join(_weighted(n, w) for n, w in rerank.WEIGHTS.items())} END + 0.7 * 0.05 - div - (CASE WHEN t > 0 THEN 0 ELSE 0.45 END), 6) AS final_score FROM r, k"""
)
def reranked_by_intent(spark, sf_dir):
    """The composite with the weights of every intent and a topic of middling certainty (X-57, X-59)."""
    out = None
    for intent in rerank.WEIGHTS:
        q = rerank.Question(intent=intent, topic="en", topic_confidence=0.5, days=5.0)
        found = rerank.rerank(candidates(spark, sf_dir), q, F.expr("timestamp_ntz '2024-02-01'"), [F.desc("hybrid_score"), F.col("article_id")])
        # the quality of overviews has a query of its own; it is left out here
        one = found.select(F.lit(intent).alias("intent"), "article_id", F.round(F.col("final_score") - F.col("quality_score") * rerank.WEIGHTS[intent][4], 6).alias("final_score"))
        out = one if out is None else out.unionByName(one)
    return out
