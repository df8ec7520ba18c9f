"""Incremental synchronisation of an index with its articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import sync
from newsloom.plans.registry import query
from newsloom.sources.views import ART, articles, table

_STATE = """state AS (SELECT article_id, CASE WHEN article_id % 3 = 1 THEN 'old' ELSE content_hash END AS known_hash, article_id % 6 = 2 AS outdated FROM art WHERE article_id % 3 <> 0)"""


def _state(spark, sf_dir):
    a = articles(spark, sf_dir).where("article_id % 3 <> 0")
    return a.select("article_id", F.when(F.col("article_id") % 3 == 1, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.lit("active").alias("status"), F.when(F.col("article_id") % 6 == 2, "v0").otherwise("v1").alias("index_version"))


@query(f"WITH {ART}, {_STATE} SELECT a.article_id, CASE WHEN s.article_id IS NULL THEN 'new' WHEN s.known_hash <> a.content_hash THEN 'changed' ELSE 'unchanged' END AS change FROM art a LEFT JOIN state s USING (article_id)")
def changes(spark, sf_dir):
    """New, changed and unchanged articles (J-06)."""
    return sync.classify(articles(spark, sf_dir).select("article_id", "content_hash"), _state(spark, sf_dir), "article_id").select("article_id", "change")


@query(f"WITH {ART}, {_STATE} SELECT article_id FROM art WHERE article_id NOT IN (SELECT article_id FROM state WHERE known_hash IN (SELECT content_hash FROM art WHERE art.article_id = state.article_id) AND NOT outdated)")
def to_index(spark, sf_dir):
    """Articles that the manifest doesn't let skip (F-27)."""
    a = articles(spark, sf_dir).select("article_id", "content_hash")
    return sync.not_current(a, _state(spark, sf_dir), "article_id", {"index_version": "v1"}).select("article_id")


@query(
    f"""WITH {ART}, {_STATE}, c AS (SELECT a.source, a.article_id, s.known_hash = a.content_hash AS same, row_number() OVER (PARTITION BY a.source ORDER BY a.published_at DESC, a.article_id) AS pos FROM art a LEFT JOIN state s USING (article_id)),
 g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY pos) AS island FROM c),
 k AS (SELECT *, sum(CASE WHEN same THEN 1 ELSE 0 END) OVER (PARTITION BY source, island ORDER BY pos) AS streak FROM g),
 e AS (SELECT *, min(CASE WHEN streak >= 2 THEN pos END) OVER (PARTITION BY source) AS stop FROM k)
 SELECT source, article_id FROM e WHERE (stop IS NULL OR pos <= stop) AND NOT coalesce(same, false)"""
)
def incremental_scan(spark, sf_dir):
    """What a scan finds that ends a source after two unchanged articles in a row (W-07, W-12, Q-26)."""
    c = sync.classify(articles(spark, sf_dir).select("article_id", "content_hash", "source", "published_at"), _state(spark, sf_dir), "article_id")
    seen = sync.until_streak(c, "source", [F.desc("published_at"), F.col("article_id")], F.col("change") == "unchanged", 2)
    return seen.where("change <> 'unchanged'").select("source", "article_id")


@query("SELECT user_id, count(*) AS streaks, max(n) AS longest FROM (SELECT user_id, g, count(*) AS n FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events) WHERE event_type = 'view' GROUP BY 1, 2) GROUP BY 1")
def view_streaks(spark, sf_dir):
    """Runs of equal events of a user (W-12)."""
    return sync.streaks(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "view")


@query(f"WITH {ART}, {_STATE} SELECT count(*) FILTER (WHERE s.article_id IS NULL) AS missing, count(*) FILTER (WHERE a.article_id IS NULL) AS extra, count(*) FILTER (WHERE a.article_id IS NOT NULL AND s.article_id IS NOT NULL) AS both FROM art a FULL JOIN state s USING (article_id)")
def index_health(spark, sf_dir):
    """Counts of what two stores share and miss."""
    return sync.health(articles(spark, sf_dir).select("article_id"), _state(spark, sf_dir).select("article_id"), "article_id")


@query("SELECT event_type, window_start, count(*) AS n, sum(value) AS value FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, ts) AS window_start FROM events) GROUP BY 1, 2")
def hourly_events(spark, sf_dir):
    """Tumbling windows over event time, as the stream in newsloom.streaming counts them."""
    from newsloom.streaming.events import hourly

    return hourly(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
