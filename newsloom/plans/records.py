"""Raw documents, audit rows, chunk metadata, contexts and JSON lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import records as R
from newsloom.plans.registry import query
from newsloom.sources.views import ART, CHUNKS, articles, chunks, table

_GOLD = f"""{ART}, gold AS (SELECT *, CASE WHEN article_id % 7 = 0 THEN true WHEN article_id % 7 = 1 THEN NULL ELSE false END AS is_duplicate, CASE WHEN article_id % 3 = 0 THEN NULL ELSE published_at END AS seen_at, published_at + INTERVAL 2 HOUR AS crawled_at, published_at + to_hours(article_id % 5) AS updated_at,
 CASE category WHEN 'en' THEN 'economy_finance_stock' WHEN 'de' THEN 'real_estate' ELSE 'general_news' END AS topic FROM art)"""


def gold(spark, sf_dir):
    """Articles with the other columns of a Gold table."""
    i = F.col("article_id")
    return articles(spark, sf_dir).select(
        "*", F.when(i % 7 == 0, True).when(i % 7 == 1, F.lit(None)).otherwise(False).alias("is_duplicate"), (F.col("published_at") + F.expr("interval 2 hours")).alias("crawled_at"), F.expr("published_at + make_dt_interval(0, cast(article_id % 5 as int))").alias("updated_at"),
        F.when(F.col("category") == "en", "economy_finance_stock").when(F.col("category") == "de", "real_estate").otherwise("general_news").alias("primary_topic"),
    ).withColumn("published_at", F.when(i % 3 == 0, F.lit(None)).otherwise(F.col("published_at")))


@query(f"WITH {_GOLD} SELECT article_id, row_number() OVER (ORDER BY coalesce(seen_at, crawled_at) DESC, updated_at DESC, article_id) AS place FROM gold WHERE NOT coalesce(is_duplicate, false) AND content IS NOT NULL AND trim(content) <> '' AND coalesce(seen_at, crawled_at) >= TIMESTAMP '2024-01-05' AND topic = 'economy_finance_stock' AND source = 'src1'")
def client_scan(spark, sf_dir):
    """The client's predicate, filters by names of topics, and its order (F-02, F-03, O-01)."""
    from pyspark.sql import Window

    found = R.chosen(R.live(gold(spark, sf_dir), F.expr("timestamp_ntz '2024-01-05'")), "src1", "kinh_te_tai_chinh_chung_khoan")
    order = Window.partitionBy("source").orderBy(F.coalesce("published_at", "crawled_at").desc(), F.desc("updated_at"), "article_id")
    return found.select("article_id", F.row_number().over(order).cast("long").alias("place"))


@query(f"WITH {_GOLD} SELECT CAST(article_id AS VARCHAR) AS article_id, source, title, sha256(trim(content)) AS content_hash, topic AS primary_topic, seen_at AS crawled_at, 1.0::DOUBLE AS topic_confidence FROM gold")
def audited_articles(spark, sf_dir):
    """Gold rows under the audit's names and back as articles (S-06, T-26)."""
    found = R.audit_articles(R.audit_scan(gold(spark, sf_dir).withColumn("title", F.trim("title"))))
    return found.select("article_id", "source", "title", "content_hash", "primary_topic", "crawled_at", "topic_confidence")


@query(f"WITH {ART} SELECT article_id, source AS source_name, 'run-1' AS crawl_run_id, content_hash AS checksum, content AS raw_text, title AS payload_title, content_hash AS metadata_hash FROM art")
def raw_documents(spark, sf_dir):
    """Raw documents with payloads and metadata as JSON (T-05, K-01)."""
    a = articles(spark, sf_dir).withColumns({"url": F.concat(F.lit("https://e.com/"), F.col("article_id").cast("string")), "canonical_url": F.lit(None).cast("string")})
    made = R.raw_documents(a, "run-1", F.expr("timestamp_ntz '2024-02-01'"))
    return made.select(F.regexp_extract("url", r"(\d+)$", 1).cast("long").alias("article_id"), "source_name", "crawl_run_id", "checksum", "raw_text", F.get_json_object("raw_payload", "$.title").alias("payload_title"), F.get_json_object("metadata", "$.content_hash").alias("metadata_hash"))


@query(
    f"""WITH {ART}, e AS (SELECT article_id, CASE article_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['Ann'] ELSE ['Ann', 'Bo'] END AS names, CASE article_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['person'] ELSE ['person'] END AS kinds, (article_id % 4)::INT AS images FROM art)
 SELECT article_id, article_id AS parent_id, array_to_string(names, ',') AS entity_names, array_to_string(kinds, ',') AS entity_types, array_to_string(names, ' ') AS entities_text, images > 0 AS has_images, images AS image_count, 'm1' AS embedding_model FROM e"""
)
def chunk_metadata(spark, sf_dir):
    """Metadata of chunks: names and kinds of entities, images, versions (T-16, X-75, X-76, A-28)."""
    i = F.col("article_id")
    entity = lambda kind, name: F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"))
    entities = F.when(i % 3 == 0, F.array().cast("array<struct<type: string, name: string>>")).when(i % 3 == 1, F.array(entity("person", "Ann"), entity("person", " Ann "))).otherwise(F.array(entity("person", "Ann"), entity("person", "Bo"), entity("", "")))
    images = F.when(i % 4 == 0, F.lit(None).cast("array<int>")).otherwise(F.sequence(F.lit(1), (i % 4).cast("int")))
    a = articles(spark, sf_dir).select("*", i.cast("string").alias("chunk_id"), F.lit(0).alias("chunk_index"), F.lit("body").alias("chunk_type"), F.lit("t").alias("primary_topic"), entities.alias("entities"), images.alias("images"))
    made = R.chunk_metadata(a, "m1", "c1", "i1", F.lit("now"))
    return made.select("article_id", "parent_id", "entity_names", "entity_types", "entities_text", "has_images", "image_count", "embedding_model")


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN rtrim(left(text, 300)) || chr(10) || '[CONTEXT_TRUNCATED]' ELSE text END AS context FROM documents")
def prompt_contexts(spark, sf_dir):
    """Contexts cut to a length, with a mark (T-19)."""
    return table(spark, sf_dir, "documents").select("doc_id", R.prompt_context(F.col("text"), 300).alias("context"))


@query("SELECT doc_id, md5(translate(text, 'àáảãạâăèéêìíòóôơùúưỳýđÀÁẢÃẠÂĂÈÉÊÌÍÒÓÔƠÙÚƯỲÝĐ', 'aaaaaaaeeeiioooouuuyydAAAAAAAEEEIIOOOOUUUYYD')) AS narrow FROM documents")
def narrow_accents(spark, sf_dir):
    """Texts without the accents of a short table (X-20)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(R.narrow_ascii(F.col("text"))).alias("narrow"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'a,b' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE '' END AS items FROM events")
def strict_lists(spark, sf_dir):
    """JSON arrays; anything else is null (X-71)."""
    i = F.col("event_id")
    given = F.when(i % 5 == 0, "").when(i % 5 == 1, '["a", "b"]').when(i % 5 == 2, '{"a": 1}').when(i % 5 == 3, "[broken").otherwise(F.lit(None))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(R.strict_list(given), ",").alias("items"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%d/%m/%Y') || ' | ' || strftime(ts, '%H:%M') || ' GMT+7' WHEN 1 THEN strftime(ts, '%H:%M') || ', ' || strftime(ts, '%d-%m-%Y') WHEN 2 THEN strftime(ts, '%d/%m/%Y') ELSE '' END AS found FROM events")
def date_texts(spark, sf_dir):
    """Dates found in free text (X-42)."""
    i, day, hour = F.col("event_id"), F.date_format("ts", "dd/MM/yyyy"), F.date_format("ts", "HH:mm")
    text = F.when(i % 4 == 0, F.concat(F.lit("Cập nhật "), day, F.lit(" |  "), hour, F.lit(" GMT+7 bởi A"))).when(i % 4 == 1, F.concat(F.lit("lúc "), hour, F.lit(", "), F.date_format("ts", "dd-MM-yyyy"), F.lit(" x"))).when(i % 4 == 2, F.concat(F.lit("ngày "), day, F.lit("."))).otherwise("không có")
    return table(spark, sf_dir, "events").select("event_id", R.date_text(text).alias("found"))


@query("SELECT 'u' || (o_orderkey % 40) AS image_url, min_by(CAST(o_orderkey AS VARCHAR), o_orderkey) AS article_id, min_by('c' || o_orderkey, o_orderkey) AS caption FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def related_images(spark, sf_dir):
    """Images of results, each address once (T-24, X-70)."""
    o = table(spark, sf_dir, "orders")
    one = F.to_json(F.array(F.struct(F.concat(F.lit("u"), (F.col("o_orderkey") % 40).cast("string")).alias("image_url"), F.concat(F.lit("c"), F.col("o_orderkey").cast("string")).alias("caption"))))
    results = o.select(F.col("o_orderkey").cast("string").alias("article_id"), "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "broken").otherwise(one).alias("images_json"))
    return R.related_images(results, F.col("o_orderkey"))


@query(f"WITH {ART}, m AS (SELECT article_id % 11 <> 0 AS active, content_hash AS h FROM art WHERE article_id % 2 = 0) SELECT DISTINCT content_hash AS hash FROM art WHERE content_hash IN (SELECT h FROM m WHERE active)")
def known_hashes(spark, sf_dir):
    """Hashes that an active manifest row holds (F-28)."""
    a = articles(spark, sf_dir)
    manifest = a.where("article_id % 2 = 0").select(F.when(F.col("article_id") % 11 == 0, "inactive").otherwise("active").alias("status"), F.array("content_hash", F.lit("x")).alias("chunk_hashes"))
    return R.holds_hash(manifest, a.select(F.col("content_hash").alias("hash")).distinct())


@query(f"WITH {ART}, f AS (SELECT source, arg_min(article_id, article_id) AS article_id FROM art GROUP BY source) SELECT f.source, f.article_id, CASE WHEN f.article_id % 2 = 0 THEN 'parent' ELSE a.title END AS title FROM f JOIN art a USING (article_id)")
def related_articles(spark, sf_dir):
    """The first result of each article with its parent's values (J-13)."""
    a = articles(spark, sf_dir).select("article_id", "source", "title")
    parents = a.where("article_id % 2 = 0").groupBy("source").agg(F.min("article_id").alias("_least"))
    first = a.groupBy("source").agg(F.min("article_id").alias("_first")).join(parents, "source", "left")
    given = first.select("source", F.when(F.col("_first") % 2 == 0, "parent").alias("title"))
    return R.related(a, "source", [F.col("article_id")], given, ["title"]).select("source", "article_id", "title")


@query(
    """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN [string_split(text, chr(10))[1], source, lang] WHEN doc_id % 4 = 1 THEN [lang, text, source] WHEN doc_id % 4 = 2 THEN [text] ELSE [] END AS v FROM documents)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS place, value FROM (SELECT doc_id, unnest(v) AS value, generate_subscripts(v, 1) AS i FROM d) WHERE regexp_matches(value, '[^\\s]')"""
)
def json_images(spark, sf_dir):
    """Image values of JSON made of whole documents: under keys, in lists and objects, escaped, repeated, broken (X-72, X-71)."""
    from pyspark.sql import Window

    text, title, i = F.col("text"), F.substring_index("text", "\n", 1), F.col("doc_id") % 4
    inner = F.struct(title.alias("contentUrl"), F.lit("no").alias("caption"))
    first = F.to_json(F.struct(F.array(F.struct(F.array(inner).alias("url"))).alias("image"), F.col("source").alias("imageUrl"), F.col("lang").alias("contentUrl"), F.struct(F.lit("no").alias("image")).alias("other")))
    second = F.concat(F.lit('[{"url": "gone", "url": '), F.to_json(F.array("lang", "text")), F.lit('}, 1, null, {"thumbnailUrl": '), F.regexp_replace(F.to_json(F.array("source")), r"^\[|\]$", ""), F.lit("}]"))
    third = F.regexp_replace(F.to_json(F.array("text")), r"^\[|\]$", "")
    given = table(spark, sf_dir, "documents").select("doc_id", F.when(i == 0, first).when(i == 1, second).when(i == 2, third).otherwise(F.concat(F.lit("{"), text)).alias("json"))
    found = R.images_under(given, "doc_id", "json")
    return found.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1).alias("place"), "value")


@query("SELECT source, count(*) AS pages, sum(doc_id % 7)::BIGINT AS found, sum(doc_id % 7 // 2)::BIGINT AS new, sum(doc_id % 7 - doc_id % 7 // 2)::BIGINT AS repeated, count(*) FILTER (WHERE doc_id % 13 = 0) AS failed FROM documents GROUP BY source")
def crawl_totals(spark, sf_dir):
    """Totals of a crawl for each source (A-23)."""
    pages = table(spark, sf_dir, "documents").selectExpr("source", "doc_id % 7 as found", "doc_id % 7 div 2 as new", "doc_id % 13 = 0 as failed")
    return R.crawl_totals(pages, "source")


@query(f"WITH {CHUNKS} SELECT article_id, chunk_index, md5(text) AS hash FROM chunk WHERE ord % 10 <> 0")
def stored_chunks(spark, sf_dir):
    """All chunks of a store but the padding (S-08)."""
    c = chunks(spark, sf_dir).withColumn("is_padding", F.when(F.col("ord") % 10 == 0, "True").otherwise(F.when(F.col("ord") % 3 == 0, F.lit(None)).otherwise("false")))
    return R.real_chunks(c).select("article_id", "chunk_index", F.md5("text").alias("hash"))


@query("SELECT 'own' AS kind, doc_id FROM documents WHERE doc_id % 50 = 7 AND doc_id % 2 = 1 UNION ALL SELECT 'canonical', doc_id FROM documents WHERE doc_id % 50 = 8")
def chunks_by_address(spark, sf_dir):
    """Look-ups by address, with the canonical one where there is no other (S-09, J-07)."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    c = d.select("doc_id", i.alias("chunk_index"), F.when((i % 50 == 7) & (i % 2 == 1), "u7").otherwise("x").alias("url"), F.when(i % 50 == 8, "u8").when(i % 50 == 9, "u7").otherwise("y").alias("canonical_url"))
    return R.looked_up(c, "u7", 1 << 30).select(F.lit("own").alias("kind"), "doc_id").unionByName(R.looked_up(c, "u8", 1 << 30).select(F.lit("canonical").alias("kind"), "doc_id"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace('Tin ' || source || ' hôm nay MỚI NHẤT', '(?i)hôm nay|hom nay|mới nhất|moi nhat', ' ', 'g'), '\\s+', ' ', 'g')) AS question FROM documents")
def relaxed_questions(spark, sf_dir):
    """Questions without their words for today and newest (F-26)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", R.relaxed(F.concat(F.lit("Tin "), "source", F.lit(" hôm nay MỚI NHẤT"))).alias("question"))


@query(r"SELECT page_id, md5(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<[^>]*>', '', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&#39;', chr(39)), '&amp;', '&')) AS stripped FROM pages")
def stripped_pages(spark, sf_dir):
    """Pages without tags, scripts' text included (X-02)."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(R.stripped(F.col("html"))).alias("stripped"))


@query(f"WITH {CHUNKS} SELECT article_id, arg_min(source, chunk_index) AS source, md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index)) AS content FROM chunk GROUP BY article_id")
def parent_articles(spark, sf_dir):
    """Articles from their chunks (T-23)."""
    found = R.parents(chunks(spark, sf_dir).withColumn("title", F.col("text")))
    return found.select("article_id", "source", F.md5("content").alias("content"))


@query("SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN doc_id % 4 = 0 THEN doc_id * 3 ELSE doc_id END DESC, source DESC, 'u' || doc_id DESC) AS place FROM documents ORDER BY place LIMIT 60")
def parse_order(spark, sf_dir):
    """The first raw documents to be parsed (O-03)."""
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat(F.lit("u"), i.cast("string")).alias("url"), F.when(i % 4 == 0, i * 3).alias("published_at"), i.alias("crawled_at"))
    first = R.parse_order(d).limit(60)
    return first.select("doc_id", F.expr("row_number() over (order by coalesce(published_at, crawled_at) desc, source desc, url desc)").cast("long").alias("place"))


@query("SELECT o_orderkey AS article_id, list(l_linenumber ORDER BY l_linenumber % 3 = 0 DESC, l_linenumber)[1] AS first_position, count(*) AS images FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def ordered_images(spark, sf_dir):
    """Images with the representative first, then by position (O-11)."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    first = F.min_by("l_linenumber", F.struct((F.col("l_linenumber") % 3 != 0).alias("other"), F.col("l_linenumber")))
    return lines.groupBy(F.col("l_orderkey").alias("article_id")).agg(first.alias("first_position"), F.count("*").alias("images"))


@query("SELECT doc_id, source FROM documents")
def images_if_any(spark, sf_dir):
    """A semi join that would leave nothing leaves all (J-10)."""
    from newsloom.operators import assembly

    return assembly.only_if_any(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").where("toxic = 7"), "doc_id")
