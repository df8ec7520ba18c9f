"""Scans, dedup, upserts and other maintenance of lakehouse tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from newsloom.operators import dedup, group_index, tables
from newsloom.plans.registry import query
from newsloom.sources.views import ART, articles, table


@query(f"WITH {ART} SELECT article_id, source, title, category, published_at FROM art WHERE content IS NOT NULL AND length(trim(content)) > 0 AND published_at >= TIMESTAMP '2024-01-10' ORDER BY published_at DESC, article_id LIMIT 50")
def gold_scan(spark, sf_dir):
    """Filtered scan in order of time with a limit (S-03, F-01, O-01)."""
    a = articles(spark, sf_dir).where("content is not null and length(trim(content)) > 0 and published_at >= timestamp_ntz '2024-01-10'")
    return a.orderBy(F.desc("published_at"), "article_id").select("article_id", "source", "title", "category", "published_at").limit(50)


@query(f"WITH {ART}, top AS (SELECT article_id, source, published_at FROM art ORDER BY published_at DESC, article_id LIMIT 200) SELECT * FROM top WHERE source = 'src1'")
def gold_scan_limit_then_source(spark, sf_dir):
    """The source filter applies after the limit (S-04, Q-24)."""
    a = articles(spark, sf_dir).select("article_id", "source", "published_at")
    return a.orderBy(F.desc("published_at"), "article_id").limit(200).where("source = 'src1'")


@query(f"WITH {ART} SELECT source, article_id, published_at FROM (SELECT *, row_number() OVER (ORDER BY source, published_at DESC, article_id) AS n FROM art) WHERE n <= 100")
def source_major_scan(spark, sf_dir):
    """Source first, then newest (O-02)."""
    return articles(spark, sf_dir).select("source", "article_id", "published_at").orderBy("source", F.desc("published_at"), "article_id").limit(100)


@query(f"WITH {ART} SELECT DISTINCT source, article_id, content_hash FROM art WHERE source = 'src2'")
def existing_keys(spark, sf_dir):
    """Keys already known of a source (S-02)."""
    return articles(spark, sf_dir).where("source = 'src2'").select("source", "article_id", "content_hash").distinct()


@query(f"WITH {ART} SELECT article_id, source, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY published_at DESC, article_id) AS rn FROM art) WHERE rn = 1")
def gold_dedup(spark, sf_dir):
    """The newest row of equal content (W-01)."""
    a = articles(spark, sf_dir).select("article_id", "source", "content_hash", "published_at")
    return dedup.newest_by_key(a, F.col("content_hash"), F.desc("published_at"), F.col("article_id")).drop("published_at")


_GROUPS = f"""WITH RECURSIVE {ART}, k AS (SELECT article_id AS ord, CASE WHEN article_id % 3 = 0 THEN '' ELSE source || '/' || CAST(article_id % 101 AS VARCHAR) END AS url, content_hash FROM art),
 p AS (SELECT *, CASE WHEN url <> '' THEN min(ord) OVER (PARTITION BY url) END AS u, min(ord) OVER (PARTITION BY content_hash) AS h FROM k),
 q AS (SELECT ord, CASE WHEN u < ord THEN u WHEN h < ord THEN h END AS parent FROM p),
 r(ord, root) AS (SELECT ord, ord FROM q WHERE parent IS NULL UNION ALL SELECT q.ord, r.root FROM q JOIN r ON q.parent = r.ord)
 SELECT q.ord, q.parent IS NOT NULL AS is_duplicate, r.root AS group_id FROM q JOIN r USING (ord)"""


@query(_GROUPS)
def dedup_groups(spark, sf_dir):
    """Greedy groups by url, else by content (W-02, Q-05)."""
    return dedup.greedy_groups(_keyed(spark, sf_dir), "ord", "url", "content_hash").select("ord", "is_duplicate", "group_id")


def _keyed(spark, sf_dir):
    """ord, url, content_hash of all articles."""
    url = F.when(F.col("article_id") % 3 == 0, "").otherwise(F.concat("source", F.lit("/"), (F.col("article_id") % 101).cast("string")))
    return articles(spark, sf_dir).select(F.col("article_id").alias("ord"), url.alias("url"), "content_hash")


@query(_GROUPS)
def dedup_groups_batches(spark, sf_dir):
    """The same groups from three batches, the last of them late, by a stored index of keys (W-02, K-06)."""
    rows = _keyed(spark, sf_dir)
    index = group_index.Groups(spark, f"{dedup.shared_folder(spark)}/groups-{uuid.uuid4().hex}", buckets=16)
    half = rows.agg(F.expr("percentile_approx(ord, 0.5)")).first()[0] or 0
    late = F.col("ord") % 10 == 3
    for number, part in enumerate((rows.where(~late & (F.col("ord") < half)), rows.where(~late & (F.col("ord") >= half)), rows.where(late))):
        index.absorb(part, "ord", "url", "content_hash", ("articles", number))
    return index.of(rows, "ord", "url", "content_hash").select("ord", "is_duplicate", "group_id")


@query(f"WITH {ART} SELECT source, min(article_id) AS article_id, title FROM art GROUP BY source, title")
def first_by_title(spark, sf_dir):
    """The first occurrence wins (W-08)."""
    return dedup.first_occurrence(articles(spark, sf_dir).select("source", "title", "article_id"), ["source", "title"], F.col("article_id"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 2 <> 0 UNION ALL SELECT o_orderkey, 'U', o_totalprice * 2 FROM orders WHERE o_orderkey % 2 = 0")
def upsert_by_key(spark, sf_dir):
    """Upsert on a key (K-04, K-05, K-07, K-10, J-01)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    source = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("U").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return tables.upsert(o.where("o_orderkey % 3 <> 0"), source, ["o_orderkey"])


_DOCS = "raw AS (SELECT source AS source_name, 'c' || CAST(doc_id % 211 AS VARCHAR) AS canonical_url, 'u' || CAST(doc_id % 307 AS VARCHAR) AS url, doc_id FROM documents)"


@query(
    f"""WITH {_DOCS}, src AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_name, canonical_url ORDER BY doc_id DESC) AS rn FROM raw WHERE doc_id % 10 = 0) WHERE rn = 1)
 SELECT source_name, canonical_url, url, doc_id FROM raw t WHERE doc_id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM src s WHERE s.source_name = t.source_name AND (s.canonical_url = t.canonical_url OR s.url = t.url))
 UNION ALL SELECT source_name, canonical_url, url, doc_id FROM src"""
)
def upsert_either_key(spark, sf_dir):
    """Upsert where either of two keys matches (K-03, J-02, Q-09)."""
    raw = table(spark, sf_dir, "documents").select(
        F.col("source").alias("source_name"), F.concat(F.lit("c"), (F.col("doc_id") % 211).cast("string")).alias("canonical_url"), F.concat(F.lit("u"), (F.col("doc_id") % 307).cast("string")).alias("url"), "doc_id"
    )
    return tables.upsert_either(raw.where("doc_id % 10 <> 0"), raw.where("doc_id % 10 = 0"), "source_name", ("canonical_url", "url"), F.col("doc_id"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 7 <> 0")
def delete_by_key(spark, sf_dir):
    """Delete by keys (K-08)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return tables.delete(o, o.where("o_custkey % 7 = 0").select("o_custkey"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'inactive' ELSE 'active' END AS status FROM orders")
def soft_delete(spark, sf_dir):
    """Mark rows inactive by keys (K-11)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("active").alias("status"))
    gone = table(spark, sf_dir, "orders").where("o_custkey % 5 = 0").select("o_orderkey")
    return tables.deactivate(o, gone)


@query("SELECT count(*) FILTER (WHERE event_id BETWEEN 100 AND 250) AS planned, count(*) AS rows FROM events")
def planned_rollback(spark, sf_dir):
    """What deleting a range would take (K-16)."""
    return tables.without_range(table(spark, sf_dir, "events"), "event_id", 100, 250)[1]


@query("SELECT event_id FROM events WHERE NOT event_id BETWEEN 100 AND 250")
def rollback_range(spark, sf_dir):
    """Delete a range (K-16)."""
    return tables.without_range(table(spark, sf_dir, "events").select("event_id"), "event_id", 100, 250)[0]


@query("SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS primary_topic, CAST(NULL AS DOUBLE) AS topic_confidence FROM nation")
def schema_evolution(spark, sf_dir):
    """Add the columns that a table lacks (K-02)."""
    return tables.evolve(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), {"n_name": "string", "primary_topic": "string", "topic_confidence": "double"})


@query(
    f"""WITH {ART} SELECT article_id, coalesce(nullif(CASE WHEN article_id % 4 = 0 THEN NULL ELSE category END, ''), 'general_news') AS primary_topic, coalesce(CAST(NULL AS DOUBLE), 0.0) AS topic_confidence, '[]' AS entities_json
 FROM (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY published_at DESC, article_id) AS rn FROM art WHERE length(trim(content)) > 0) WHERE rn = 1"""
)
def gold_rebuild(spark, sf_dir):
    """Gold from Silver: dedup and defaults (K-06, Q-08)."""
    a = articles(spark, sf_dir).where("length(trim(content)) > 0")
    one = dedup.newest_by_key(a, F.col("content_hash"), F.desc("published_at"), F.col("article_id"))
    topic = F.when(F.col("article_id") % 4 == 0, F.lit(None)).otherwise(F.col("category"))
    return one.select("article_id", F.coalesce(F.nullif(topic, F.lit("")), F.lit("general_news")).alias("primary_topic"), F.coalesce(F.lit(None).cast("double"), F.lit(0.0)).alias("topic_confidence"), F.lit("[]").alias("entities_json"))


@query("SELECT d.doc_id, d.source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND e.source = d.source AND e.n_chars = d.n_chars)")
def skip_existing(spark, sf_dir):
    """Rows whose exact key is not known yet (J-05, Q-10)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return d.join(d.where("doc_id % 2 = 0").select("source", "n_chars"), ["source", "n_chars"], "left_anti").select("doc_id", "source")


@query(
    """WITH img AS (SELECT l_orderkey, count(*) AS images, min(l_linenumber) AS first_position FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey),
 alt AS (SELECT o_custkey, count(*) AS images FROM orders JOIN img ON o_orderkey = l_orderkey GROUP BY o_custkey)
 SELECT o_orderkey, coalesce(img.images, alt.images, 0) AS image_count, coalesce(img.images, alt.images, 0) > 0 AS has_images FROM orders LEFT JOIN img ON o_orderkey = l_orderkey LEFT JOIN alt USING (o_custkey)"""
)
def images_with_fallback(spark, sf_dir):
    """Images by article, else by its page (J-04, A-28)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    own = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("own"))
    page = o.join(own, "o_orderkey").groupBy("o_custkey").agg(F.count("*").alias("page"))
    n = F.coalesce("own", "page", F.lit(0).cast("long"))
    return o.join(own, "o_orderkey", "left").join(page, "o_custkey", "left").select("o_orderkey", n.alias("image_count"), (n > 0).alias("has_images"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_returnflag = 'R') DESC, l_quantity DESC, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def representative_image(spark, sf_dir):
    """The best child of each parent (W-09)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return dedup.newest_by_key(li, F.col("l_orderkey"), (F.col("l_returnflag") == "R").desc(), F.desc("l_quantity"), F.col("l_linenumber")).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey IN (1, 2, 3, 5, 8, 13, 21, 34)")
def image_scan(spark, sf_dir):
    """Children of a list of parents (S-05, S-09)."""
    wanted = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 8, 13, 21, 34)], "l_orderkey long")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").join(F.broadcast(wanted), "l_orderkey", "left_semi")


@query(
    """WITH n AS (SELECT o_orderkey, o_custkey, o_totalprice + 1 AS o_totalprice, 'changed' AS note FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_totalprice, 'new' FROM orders WHERE o_orderkey % 5 = 0)
 SELECT * FROM (SELECT * FROM n UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, NULL FROM orders WHERE o_orderkey % 3 <> 0) WHERE o_custkey % 10 <> 4"""
)
def bucketed_upserts(spark, sf_dir):
    """A stored table of hash buckets with a commit log: all orders, then changed and new ones with a further column, then a delete by key (K-01, K-02, K-07, K-08, K-10)."""
    import uuid

    from newsloom.operators.bucketed import Table
    from newsloom.operators.dedup import shared_folder

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    kept = Table(spark, f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}").create(orders.schema, ["o_orderkey"], 32)
    kept.upsert(orders)
    new = orders.where("o_orderkey % 5 = 0").withColumns({"o_orderkey": F.col("o_orderkey") + 1000000000, "note": F.lit("new")})
    changed = orders.where("o_orderkey % 3 = 0").withColumns({"o_totalprice": F.col("o_totalprice") + 1, "note": F.lit("changed")})
    kept.upsert(changed.unionByName(new))
    kept.delete(kept.read().where("o_custkey % 10 = 4"))
    return kept.read()
