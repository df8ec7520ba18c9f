"""Audits of articles, chunks and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import quality
from newsloom.plans.registry import query
from newsloom.sources.views import ART, CHUNKS, articles, chunks, table


@query(f"WITH {CHUNKS} SELECT count(*) AS chunks, count(DISTINCT article_id) AS articles, count(DISTINCT nullif(source, '')) AS sources FROM chunk")
def chunk_overview(spark, sf_dir):
    """Rows and exact distinct counts (A-01, A-02, A-27)."""
    return chunks(spark, sf_dir).agg(F.count("*").alias("chunks"), F.count_distinct("article_id").alias("articles"), F.count_distinct(F.nullif("source", F.lit(""))).alias("sources"))


@query(
    f"""WITH {CHUNKS}, s AS (SELECT length(text) AS l FROM chunk), v AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS r, count(*) OVER () AS n FROM s)
 SELECT count(*) AS chunks, CAST(min(l) AS INTEGER) AS min_length, CAST(max(l) AS INTEGER) AS max_length, round(sum(l) / count(*), 2) AS avg_length, median(l) AS median_length,
 CAST(max(l) FILTER (WHERE r = round_even((n - 1) * 0.9, 0)) AS INTEGER) AS p90_length, count(*) FILTER (WHERE l < 80) AS short, count(*) FILTER (WHERE l > 700) AS long FROM v"""
)
def chunk_lengths(spark, sf_dir):
    """Length statistics with a nearest-rank percentile (A-03, A-04, Q-13)."""
    return quality.length_stats(chunks(spark, sf_dir), "text", 80, 700)


@query(
    """WITH t AS (SELECT count(*) AS n, count(*) FILTER (WHERE text IS NULL OR trim(text) = '') AS a, count(*) FILTER (WHERE lang IS NULL OR lang = 'de') AS b, count(*) FILTER (WHERE source IS NULL OR trim(source) = '') AS c FROM documents)
 SELECT 'text' AS field, a AS missing, round(a / n, 4) AS missing_ratio FROM t UNION ALL SELECT 'lang', b, round(b / n, 4) FROM t UNION ALL SELECT 'source', c, round(c / n, 4) FROM t"""
)
def metadata_completeness(spark, sf_dir):
    """Missing values of each column in one pass (A-05)."""
    d = table(spark, sf_dir, "documents").withColumn("lang", F.when(F.col("lang") != "de", F.col("lang")))
    return quality.completeness(d, ["text", "lang", "source"])


@query("SELECT 'props' AS field, count(*) FILTER (WHERE json_valid(props)) AS valid, count(*) FILTER (WHERE NOT json_valid(props)) AS invalid, count(*) FILTER (WHERE props IS NULL) AS blank FROM events UNION ALL SELECT 'event_type', 0, count(*), 0 FROM events")
def json_validity(spark, sf_dir):
    """Whether text columns hold JSON (A-06)."""
    return quality.json_validity(table(spark, sf_dir, "events"), ["props", "event_type"])


@query(
    """SELECT l_orderkey, l_linenumber, reason FROM (SELECT l_orderkey, l_linenumber, unnest(list_filter([CASE WHEN l_quantity > 45 THEN 'large' END, CASE WHEN l_discount = 0 THEN 'no_discount' END, CASE WHEN l_linenumber > 6 THEN 'many' END], lambda x: x IS NOT NULL)) AS reason FROM lineitem) ORDER BY l_orderkey, l_linenumber, reason LIMIT 50"""
)
def consistency_violations(spark, sf_dir):
    """The first violations of several rules (A-07)."""
    broken = quality.reasons(("large", F.col("l_quantity") > 45), ("no_discount", F.col("l_discount") == 0), ("many", F.col("l_linenumber") > 6))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(broken).alias("reason")).orderBy("l_orderkey", "l_linenumber", "reason").limit(50)


@query(f"WITH {CHUNKS}, g AS (SELECT article_id, count(*) AS n FROM chunk GROUP BY 1) SELECT count(*) AS groups, min(n) AS min_rows, max(n) AS max_rows, round(avg(n), 2) AS avg_rows, count(*) FILTER (WHERE n = 1) AS single, count(*) FILTER (WHERE n >= 10) AS ten_or_more FROM g")
def article_grouping(spark, sf_dir):
    """Chunks of each article (A-08, A-17)."""
    return quality.grouping_stats(chunks(spark, sf_dir), "article_id")


@query(f"WITH {CHUNKS} SELECT article_id, count(*) AS n FROM chunk GROUP BY 1 ORDER BY n DESC, article_id LIMIT 10")
def largest_articles(spark, sf_dir):
    """The most frequent keys (O-16)."""
    return quality.most_common(chunks(spark, sf_dir), "article_id", 10)


@query(f"WITH {CHUNKS}, g AS (SELECT text, count(*) AS n FROM chunk GROUP BY 1) SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM g")
def chunk_duplicates(spark, sf_dir):
    """Repeated texts (A-09)."""
    return quality.duplicate_count(chunks(spark, sf_dir), "text")


@query(f"WITH {CHUNKS}, g AS (SELECT article_id, text, count(*) AS n FROM chunk GROUP BY 1, 2) SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM g")
def chunk_duplicates_in_article(spark, sf_dir):
    """Texts repeated within an article (A-09)."""
    return quality.duplicate_count(chunks(spark, sf_dir), "article_id", "text")


@query(f"WITH {CHUNKS} SELECT count(*) FILTER (WHERE regexp_matches(text, '^[,.;:]')) AS bad_start, count(*) FILTER (WHERE NOT regexp_matches(text, '[.!?]$')) AS open_end, count(*) FILTER (WHERE length(text) < 20) AS tiny FROM chunk")
def boundary_warnings(spark, sf_dir):
    """Chunks that begin or end oddly (A-10)."""
    c = F.col("text")
    return chunks(spark, sf_dir).agg(F.count_if(c.rlike("^[,.;:]")).alias("bad_start"), F.count_if(~c.rlike("[.!?]$")).alias("open_end"), F.count_if(F.length(c) < 20).alias("tiny"))


@query(
    f"""WITH {CHUNKS}, r AS (SELECT source, round(count(*) FILTER (WHERE length(text) < 80) / count(*), 4) AS short, round(count(*) FILTER (WHERE length(text) > 700) / count(*), 4) AS long, round((count(*) - count(DISTINCT text)) / count(*), 4) AS twice FROM chunk GROUP BY source)
 SELECT source, short, long, twice, CASE WHEN short >= 0.1 OR long >= 0.05 OR twice >= 0.05 THEN 'WARN' ELSE 'OK' END AS status FROM r"""
)
def audit_status(spark, sf_dir):
    """Status of each source by thresholds on rounded ratios (A-11, A-12, Q-30)."""
    t, n = F.col("text"), F.count("*")
    r = chunks(spark, sf_dir).groupBy("source").agg(F.round(F.count_if(F.length(t) < 80) / n, 4).alias("short"), F.round(F.count_if(F.length(t) > 700) / n, 4).alias("long"), F.round((n - F.count_distinct(t)) / n, 4).alias("twice"))
    return r.withColumn("status", quality.status(F.lit(0.0), F.lit(0.0), F.col("short"), F.col("long"), F.col("twice")))


_RULES = """[CASE WHEN length(text) < 120 THEN 'content_short' END, CASE WHEN lang IS NULL THEN 'missing_lang' END, CASE WHEN doc_id % 9 = 0 THEN 'missing_published_at' END]"""


def _checked(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rules = quality.reasons(("content_short", F.length("text") < 120), ("missing_lang", F.col("lang").isNull()), ("missing_published_at", F.col("doc_id") % 9 == 0))
    return d.withColumn("reasons", rules)


@query(f"WITH r AS (SELECT doc_id, list_filter({_RULES}, lambda x: x IS NOT NULL) AS reasons FROM documents) SELECT doc_id, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0")
def invalid_rows(spark, sf_dir):
    """Rows against which there are reasons (A-20, U-06, K-13)."""
    return quality.split_valid(_checked(spark, sf_dir))[1].select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH r AS (SELECT doc_id, unnest(list_filter({_RULES}, lambda x: x IS NOT NULL)) AS reason FROM documents) SELECT reason, count(*) AS n FROM r GROUP BY 1")
def invalid_reasons(spark, sf_dir):
    """How often each reason occurs (A-13, A-14)."""
    return _checked(spark, sf_dir).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS rows, min(length(text)) AS min_length, max(length(text)) AS max_length, round(avg(length(text)), 2) AS avg_length FROM documents GROUP BY source")
def audit_by_source(spark, sf_dir):
    """Counters of each source (A-13, A-24)."""
    size = F.length("text").cast("long")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("rows"), F.min(size).alias("min_length"), F.max(size).alias("max_length"), F.round(F.avg(size), 2).alias("avg_length"))


@query(f"WITH {ART}, r AS (SELECT article_id, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY article_id) AS rn FROM art) SELECT article_id FROM r WHERE rn > 1")
def repeated_ids(spark, sf_dir):
    """Second and later occurrences of a key in scan order (A-20, Q-29)."""
    from pyspark.sql import Window

    w = Window.partitionBy("content_hash").orderBy("article_id")
    return articles(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn > 1").select("article_id")


@query("SELECT event_id, max(CASE WHEN event_type = 'click' THEN CAST(value AS VARCHAR) END) IS NOT NULL AS clicked, max(CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) END) AS viewer FROM events GROUP BY event_id")
def eav_pivot(spark, sf_dir):
    """Entity-attribute-value rows as columns (A-25, S-18)."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_type") == "view", F.col("user_id")).alias("i"), F.when(F.col("event_type") == "click", F.col("value")).alias("f"))
    return quality.pivoted(e, "event_id", "event_type", ["i", "f"], ["click", "view"]).select("event_id", F.col("click").isNotNull().alias("clicked"), F.col("view").alias("viewer"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY 1")
def metadata_histogram(spark, sf_dir):
    """Histogram of a value in JSON (A-26, X-70)."""
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT 'left' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'right', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def index_differences(spark, sf_dir):
    """What only one of two stores holds (U-01, K-15)."""
    return quality.differences(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), "doc_id")


@query("SELECT l.quality, l.toxic, count(*) AS n, round(avg(length(d.text)), 2) AS avg_length FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2")
def label_report(spark, sf_dir):
    """Expected and found side by side (A-14, R-12)."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 2).alias("avg_length"))
