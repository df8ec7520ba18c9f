"""Queries that assemble articles and answers from chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import assembly, followups
from newsloom.plans.registry import query
from newsloom.sources.views import ART, CHUNKS, articles, chunks, table

_SCORED = f"{CHUNKS}, s AS (SELECT *, ((ord * 7919) % 1009) / 1009.0::DOUBLE AS score FROM chunk)"


def _scored(spark, sf_dir):
    return chunks(spark, sf_dir).withColumn("score", (F.col("ord") * 7919 % 1009) / F.lit(1009.0))


@query(f"WITH {_SCORED}, d AS (SELECT article_id, text, min(chunk_index) AS i FROM s GROUP BY 1, 2) SELECT article_id, max(score) AS score, arg_max(chunk_index, score * 1e6 - chunk_index * 1e-6) AS best, (SELECT string_agg(text, ' ' ORDER BY i) FROM d WHERE d.article_id = s.article_id) AS text FROM s GROUP BY article_id")
def article_results(spark, sf_dir):
    """The best chunk and the merged text of each article (A-17, A-18, A-19, T-23)."""
    return assembly.best_per_article(_scored(spark, sf_dir), "article_id", "score", "chunk_index", "text")


@query(
    f"""WITH {_SCORED}, {ART}, j AS (SELECT s.article_id, s.chunk_index, s.score, a.published_at FROM s JOIN art a USING (article_id)), n AS (SELECT article_id FROM j GROUP BY 1 ORDER BY max(published_at) DESC, max(score) DESC, article_id LIMIT 12)
 SELECT article_id, chunk_index, score FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, chunk_index) AS r FROM j WHERE article_id IN (SELECT article_id FROM n)) WHERE r <= 2"""
)
def latest_results(spark, sf_dir):
    """Two chunks of each of the newest articles (A-21, A-22)."""
    c = _scored(spark, sf_dir).join(articles(spark, sf_dir).select("article_id", "published_at"), "article_id")
    return assembly.latest_articles(c, "article_id", "published_at", "score", "chunk_index", 12, 2).select("article_id", "chunk_index", "score")


@query(
    f"""WITH {_SCORED}, t AS (SELECT * FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, ord) AS n, row_number() OVER (ORDER BY score DESC, ord) AS pos FROM t), f AS (SELECT *, min(pos) OVER (PARTITION BY article_id) AS first FROM r WHERE n <= 2), d AS (SELECT *, dense_rank() OVER (ORDER BY first) AS k FROM f) SELECT article_id, chunk_index FROM d WHERE k <= 15"""
)
def diverse_chunks(spark, sf_dir):
    """Caps on chunks of an article and on articles (W-06)."""
    return assembly.capped_articles(_scored(spark, sf_dir), "article_id", [F.desc("score"), F.col("ord")], 2, 15).select("article_id", "chunk_index")


@query(f"WITH {_SCORED}, f AS (SELECT article_id, min(pos) AS p FROM (SELECT article_id, row_number() OVER (ORDER BY score DESC, ord) AS pos FROM s) GROUP BY 1) SELECT article_id, CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS citation FROM f")
def citations(spark, sf_dir):
    """Numbers in the order of first appearance (W-10, J-12)."""
    return assembly.cited(_scored(spark, sf_dir), "article_id", "score", "ord")


@query("SELECT o_orderkey, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, ''), o_orderstatus) AS label FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0")
def parent_override(spark, sf_dir):
    """What the parent has counts before what the child has (J-07, J-08, X-74)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("label"))
    c = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("label"))
    return assembly.with_parent(o, c, "o_custkey", ["label"]).select("o_orderkey", "label")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def with_images_only(spark, sf_dir):
    """Semi join unless it leaves nothing (J-10)."""
    return assembly.only_if_any(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def without_images(spark, sf_dir):
    """Anti join (J-09, J-11)."""
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


@query("SELECT conv_id, turn, role, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations")
def follow_ups(spark, sf_dir):
    """Each turn with the one before (R-10)."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return assembly.previous_turn(c, "conv_id", "turn", "text").drop("text")


_ASKED = "[' nguồn 2', ' tin này nói gì', ' xem ảnh [1]', ' rút gọn', '', ' bài báo số 7', ' giải thích thêm ý trên'][turn // 2 % 7 + 1]"
_REFERS = "regexp_matches(q, 'bai nay|bai do|bai bao nay|bai bao do|tin nay|tin do|nguon nay|nguon do|y tren|doan tren')"


@query(
    f"""WITH RECURSIVE c AS (SELECT *, role <> 'user' AS answer, lower(strip_accents(replace(text, 'đ', 'd'))) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
 f AS (SELECT conv_id, n, turn, answer, trim(regexp_replace(x || lower(strip_accents({_ASKED})), '\\s+', ' ', 'g')) AS q, list_filter(string_split(x, chr(10)), lambda l: trim(l) <> '')[1:3] AS lines FROM c),
 g AS (SELECT *, CASE WHEN answer THEN NULL ELSE coalesce(nullif(regexp_extract(q, '\\[(\\d{{1,2}})\\]', 1), ''), nullif(regexp_extract(q, '(?:nguon|source)\\s*(?:so)?\\s*(\\d{{1,2}})', 1), ''), nullif(regexp_extract(q, '(?:bai\\s+bao|article)\\s*(?:so)?\\s*(\\d{{1,2}})', 1), ''), nullif(regexp_extract(q, '(?:bai|tin)\\s*(?:so)?\\s*(\\d{{1,2}})', 1), ''))::INTEGER END AS cited, {_REFERS} AS refers,
  list_filter(regexp_extract_all(q, '[\\pL\\pN_]+'), lambda t: length(t) >= 3 AND NOT list_contains(['tom','tat','bai','bao','tin','nguon','source','article','noi','dung','nay','cua','cho','toi','hay','minh','duoc','khong','can'], t) AND NOT regexp_matches(t, '^\\d+$')) AS terms FROM f),
 r(conv_id, n, turn, answer, q, cited, refers, lines, chosen, status, found) AS (SELECT conv_id, 0::BIGINT, NULL::BIGINT, true, '', NULL::INTEGER, false, []::VARCHAR[], NULL::INTEGER, '', NULL::INTEGER FROM (SELECT DISTINCT conv_id FROM g)
  UNION ALL SELECT conv_id, n, turn, answer, q, cited, refers, held, CASE WHEN answer AND len(lines) > 0 THEN NULL WHEN status = 'source' THEN found ELSE chosen END, status, CASE WHEN status = 'none' THEN NULL ELSE found END FROM (
   SELECT *, CASE WHEN answer THEN '' WHEN len(held) = 0 THEN 'none' WHEN number IS NOT NULL AND number > len(held) THEN 'clarify' WHEN number IS NOT NULL AND len(terms) > 0 AND len(words) > 0 AND NOT list_has_any(terms, words) THEN 'none' WHEN number IS NOT NULL THEN 'source' WHEN NOT refers THEN 'none' WHEN len(held) = 1 THEN 'source' ELSE 'clarify' END AS status,
    CASE WHEN number IS NOT NULL THEN number WHEN len(held) = 1 THEN 1 END AS found FROM (
    SELECT g.*, r.chosen, CASE WHEN g.answer AND len(g.lines) > 0 THEN g.lines ELSE r.lines END AS held, coalesce(g.cited, r.chosen) AS number, list_filter(regexp_extract_all(coalesce(r.lines[coalesce(g.cited, r.chosen)], ''), '[\\pL\\pN_]+'), lambda t: length(t) >= 3) AS words FROM r JOIN g ON g.conv_id = r.conv_id AND g.n = r.n + 1)))
 SELECT conv_id, turn, status, coalesce(found, 0) AS citation_id, CASE WHEN regexp_matches(q, 'tom tat ngan hon|noi ngan gon|ngan gon hon|rut gon|viet ngan hon') THEN 'followup_simplify' WHEN regexp_matches(q, 'xem anh|hinh anh|anh cua') AND (refers OR cited IS NOT NULL) THEN 'followup_media_lookup' WHEN regexp_matches(q, 'tom tat|noi gi|noi dung gi|bai nay|tin nay|nguon nay') AND (refers OR cited IS NOT NULL) THEN 'followup_article_summary'
  WHEN cited IS NOT NULL THEN 'followup_citation_question' WHEN regexp_matches(q, 'giai thich them|y tren|doan tren') THEN 'followup_expand' END AS intent FROM r WHERE NOT answer"""
)
def resolved_follow_ups(spark, sf_dir):
    """Questions of all conversations, with phrases of follow-ups at their ends, resolved against the lines of the answers before them (R-10, X-22)."""
    phrases = F.array(*map(F.lit, (" nguồn 2", " tin này nói gì", " xem ảnh [1]", " rút gọn", "", " bài báo số 7", " giải thích thêm ý trên")))
    asked = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("role") == "user", phrases[F.floor(F.col("turn") / 2 % 7).cast("int")]).otherwise(""))
    lines = F.slice(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), 1, 3)
    empty = F.lit(None).cast("string")
    source = F.transform(lines, lambda x, i: F.struct((i + 1).cast("int").alias("citation_id"), empty.alias("article_id"), empty.alias("url"), x.alias("title"), empty.alias("snippet"), empty.alias("source"), empty.alias("topic")))
    c = table(spark, sf_dir, "conversations").withColumns({"text": asked, "sources": F.when(F.col("role") != "user", source)})
    return followups.resolve(c, "conv_id", "turn", "role", "text", "sources").withColumn("citation_id", F.coalesce("citation_id", F.lit(0)))


@query()
def extractive_answers(spark, sf_dir):
    """The sentences that answer best, in order (T-22, O-14, X-14, X-21)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assembly.best_sentences(d, "doc_id", "text", "that with the ation", 3)


@query()
def served_images(spark, sf_dir):
    """Images of each request under three limits that depend on each other (W-13, T-25, Q-21)."""
    li = table(spark, sf_dir, "lineitem")
    image = F.struct(F.col("l_orderkey").cast("string").alias("article"), F.concat(F.lit("img"), (F.col("l_partkey") % 50).cast("string")).alias("url"))
    lists = li.groupBy(F.col("l_suppkey").alias("request")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", image.alias("image")))), lambda x: x["image"]).alias("images"))
    return assembly.served_images(lists, "request", 1, 5)
