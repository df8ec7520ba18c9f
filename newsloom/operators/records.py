"""Records around articles: raw documents, audit rows, chunk metadata, contexts for prompts, and lists kept as JSON."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import ids
from newsloom.functions import text as T
from newsloom.operators.dedup import newest_by_key, settled

#: Other names of topics in filters; letters of the narrow accent table; a context's length and its mark.
TOPIC_FILTERS = {
    "kinh_te_tai_chinh_chung_khoan": "economy_finance_stock", "cong_nghe_ai_internet": "tech_ai_internet", "thoi_su_chinh_tri_xa_hoi": "politics_society", "quoc_te_dia_chinh_tri_the_gioi": "world_geopolitics",
    "doanh_nghiep_khoi_nghiep": "business_startup", "bat_dong_san": "real_estate", "doi_song_giao_duc_suc_khoe_giai_tri": "lifestyle_education_health_entertainment",
}
NARROW = ("àáảãạâăèéêìíòóôơùúưỳýđ", "aaaaaaaeeeiioooouuuyyd")
CONTEXT, CUT_MARK = 12_000, "[CONTEXT_TRUNCATED]"


def live(df: DataFrame, since: Column | None = None) -> DataFrame:
    """Articles that are no duplicates (unknown counts as none) and have content; published, or else crawled, from ``since`` on."""
    kept = df.where(~F.coalesce("is_duplicate", F.lit(False)) & F.col("content").isNotNull() & (F.trim("content") != ""))
    return kept if since is None else kept.where(F.coalesce("published_at", "crawled_at") >= since)


def topic_filter(name: str | None) -> str | None:
    """The topic that a filter's name means; null for none."""
    name = (name or "").strip()
    return TOPIC_FILTERS.get(name, name) or None


def chosen(df: DataFrame, source: str | None = None, topic: str | None = None) -> DataFrame:
    """Rows of a source and a topic, where these are given."""
    if (source or "").strip():
        df = df.where(F.col("source") == source.strip())
    wanted = topic_filter(topic)
    return df.where(F.col("primary_topic") == wanted) if wanted else df


def newest_first(df: DataFrame) -> DataFrame:
    """By time of publication, or else of crawling, then of update; newest first."""
    return df.orderBy(F.coalesce("published_at", "crawled_at").desc(), F.desc("updated_at"))


def narrow_ascii(text: Column) -> Column:
    """Without the accents of a short table of letters; others stay."""
    return F.translate(text, NARROW[0] + NARROW[0].upper(), NARROW[1] + NARROW[1].upper())


def strict_list(value: Column) -> Column:
    """A JSON array as array of strings; empty for null or no text, null for anything that is no array."""
    whole = F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>"))
    parsed = F.when(F.trim(value).startswith("["), F.try_parse_json(value))
    return whole.otherwise(F.when(parsed.isNotNull(), F.from_json(value, "array<string>")))


def date_text(text: Column) -> Column:
    """The first text that looks like a date: with a time after it, with a time before it, or alone; empty if none."""
    gap, zone = r"(?:\s|,|\||-|–|—|lúc|luc)+", r"(?:\s*\(?GMT\s*[+-]\s*\d{1,2}:?\d{0,2}\)?)?"
    day, hour = r"\d{1,2}[/-]\d{1,2}[/-]\d{4}", r"\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM|SA|CH)?"
    clean = T.clean(text)
    return F.coalesce(*(F.regexp_substr(clean, F.lit(f"(?i){p}")) for p in (day + gap + hour + zone, hour + gap + day + zone, day)), F.lit(""))


def raw_documents(articles: DataFrame, run: str, at: Column) -> DataFrame:
    """One raw document for each parsed article (source, url, canonical_url, title, content, category, published_at): payload and metadata as JSON, checksum, identity."""
    checksum = ids.content_hash(F.col("content"))
    payload = F.to_json(F.struct("title", "content", "category", F.col("published_at").cast("string").alias("published_at"), at.cast("string").alias("crawled_at"), checksum.alias("content_hash")), {"ignoreNullFields": "false"})
    metadata = F.to_json(F.struct(F.col("source").alias("source_name"), F.col("url").alias("article_url"), "category", "canonical_url", "title", checksum.alias("content_hash")), {"ignoreNullFields": "false"})
    return articles.select(
        ids.uuid5(F.concat_ws("|", "source", F.coalesce("canonical_url", "url"))).alias("raw_document_id"),
        F.col("source").alias("source_name"),
        F.lit(run).alias("crawl_run_id"),
        "url",
        "canonical_url",
        F.lit("article").alias("page_type"),
        F.lit("success").alias("fetch_status"),
        at.alias("fetched_at"),
        F.lit("json").alias("payload_format"),
        payload.alias("raw_payload"),
        F.col("content").alias("raw_text"),
        checksum.alias("checksum"),
        metadata.alias("metadata"),
    )


def audit_articles(rows: DataFrame) -> DataFrame:
    """Articles from audit rows (article_id, title, cleaned_content, source_name, topic, published_at), as an index takes them."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    content, topic = text("cleaned_content"), text("topic")
    return rows.select(
        text("article_id").alias("article_id"),
        text("source_name").alias("source"),
        text("title").alias("title"),
        content.alias("content"),
        "published_at",
        F.col("published_at").alias("crawled_at"),
        F.sha2(content, 256).alias("content_hash"),
        text("article_id").alias("dedup_group_id"),
        F.lit(False).alias("is_duplicate"),
        topic.alias("primary_topic"),
        topic.alias("primary_topic_name"),
        F.lit(1.0).alias("topic_confidence"),
    )


def audit_scan(df: DataFrame) -> DataFrame:
    """Gold rows under the names that the audit uses."""
    return df.select("article_id", "title", F.col("content").alias("cleaned_content"), F.col("source").alias("source_name"), F.col("primary_topic").alias("topic"), "published_at")


def read_audit(spark, path: str, source: str | None = None, topic: str | None = None, since: Column | None = None, limit: int | None = None) -> DataFrame:
    """Audit rows from files of JSON lines; a bad line is an error. limit is the number of rows that a caller asks for, in order of article_id."""
    rows = spark.read.schema("article_id string, title string, cleaned_content string, source_name string, topic string, published_at timestamp_ntz").option("mode", "FAILFAST").json(path)
    found = chosen(rows.withColumnsRenamed({"source_name": "source", "topic": "primary_topic"}), source, topic).withColumnsRenamed({"source": "source_name", "primary_topic": "topic"})
    found = found if since is None else found.where(F.col("published_at") >= since)
    return found if limit is None else found.orderBy("article_id").limit(limit)


def chunk_metadata(chunks: DataFrame, model: str, chunking: str, index: str, at: Column) -> DataFrame:
    """chunk_id and metadata of chunks (article_id, source, title, chunk_id, chunk_index, chunk_type, primary_topic, entities: array of struct type, name; images: array): names, counts and versions."""
    names = F.array_distinct(F.filter(F.transform("entities", lambda e: F.trim(e["name"])), lambda n: n != ""))
    kinds = F.array_distinct(F.filter(F.transform("entities", lambda e: F.trim(e["type"])), lambda n: n != ""))
    count = F.coalesce(F.size(F.col("images")), F.lit(0))
    return chunks.select(
        "chunk_id", "article_id", "chunk_index", "source", "title", "primary_topic", F.col("primary_topic").alias("topic_category"), F.array_join(names, ",").alias("entity_names"), F.array_join(kinds, ",").alias("entity_types"),
        F.array_join(names, " ").alias("entities_text"), (count > 0).alias("has_images"), F.greatest(count, F.lit(0)).alias("image_count"), "chunk_type", F.col("article_id").alias("parent_id"), F.lit(model).alias("embedding_model"), F.lit(chunking).alias("chunking_version"), F.lit(index).alias("index_version"), at.alias("indexed_at"),
    )


def prompt_context(text: Column, most: int = CONTEXT) -> Column:
    """A context of at most ``most`` characters; what is longer ends with a mark."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most))), F.lit("\n" + CUT_MARK))).otherwise(text)


def related(results: DataFrame, key: str, order: list[Column], parents: DataFrame, columns: list[str]) -> DataFrame:
    """The first result of each article with what its parent has filled."""
    from newsloom.operators.assembly import with_parent

    return with_parent(newest_by_key(results, F.col(key), *order), parents, key, columns)


def related_images(results: DataFrame, order: Column) -> DataFrame:
    """article_id, image_url, caption: the images of results (images_json: JSON array of objects), each address once, where it first appears."""
    parsed = results.select("article_id", order.alias("_o"), F.posexplode(F.from_json("images_json", "array<struct<image_url: string, caption: string>>")).alias("_i", "image"))
    named = parsed.where(F.coalesce("image.image_url", F.lit("")) != "")
    first = newest_by_key(named, F.col("image.image_url"), F.col("_o"), F.col("_i"))
    return first.select("article_id", F.col("image.image_url").alias("image_url"), F.coalesce("image.caption", F.lit("")).alias("caption"))


def holds_hash(manifest: DataFrame, hashes: DataFrame) -> DataFrame:
    """Of hashes (hash) those that an active manifest row's array of chunk_hashes holds."""
    known = manifest.where("status = 'active'").select(F.explode("chunk_hashes").alias("hash")).distinct()
    return hashes.join(known, "hash", "left_semi")


#: Keys under which a JSON object holds images, in the order in which they are read.
IMAGE_KEYS = ("image", "imageUrl", "thumbnailUrl", "url", "contentUrl")


def images_under(df: DataFrame, key: str, json: str) -> DataFrame:
    """key, path, value: the image values of each row's JSON, in the order of path within a row.

    A walk from the root: a string is a value unless blank; a list stands for its members in order; an object for what it
    holds under the image keys, in their order. All else holds none. One step of the walk is one pass over what is still
    open, whatever its depth. Null and broken JSON has no values; of a key that an object repeats the last counts.
    """
    spark = df.sparkSession
    setting = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        open_ = settled(df.select(key, F.array().cast("array<int>").alias("path"), F.try_parse_json(F.col(json)).alias("v")).where("v IS NOT NULL"))
        found = None
        while found is None or not open_.isEmpty():
            kinds = open_.withColumn("kind", F.schema_of_variant("v"))
            strings = kinds.where("kind = 'STRING'").select(key, "path", F.try_variant_get("v", "$", "string").alias("value")).where(F.col("value").rlike(r"(?U)\S"))
            found = strings if found is None else found.unionByName(strings)
            lists = kinds.where(F.col("kind").startswith("ARRAY")).select(key, "path", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("i", "v"))
            held = F.array(*(F.try_variant_get("v", f"$.{name}", "variant") for name in IMAGE_KEYS))
            objects = kinds.where(F.col("kind").startswith("OBJECT")).select(key, "path", F.posexplode(held).alias("i", "v")).where("v IS NOT NULL")
            open_ = settled(lists.unionByName(objects).select(key, F.concat("path", F.array("i")).alias("path"), "v"))
    finally:
        spark.conf.set(setting, before)
    return found


def real_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks of a vector store without the rows that only pad it."""
    return chunks.where(~T.truthy(F.col("is_padding")))


def looked_up(chunks: DataFrame, url: str, limit: int) -> DataFrame:
    """The first ``limit`` chunks of an address, by number; of the canonical address only if none has it as its own."""
    wanted = (F.col("url") == url) | (F.col("canonical_url") == url)
    few = chunks.where(wanted)
    own = few.agg(F.coalesce(F.bool_or(F.col("url") == url), F.lit(False)).alias("_own"))  # one row
    return few.join(F.broadcast(own)).where(~F.col("_own") | (F.col("url") == url)).drop("_own").orderBy("chunk_index").limit(limit)


def reset(df: DataFrame, path: str) -> str:
    """A new, empty version of a table with df's columns; returns its path."""
    from newsloom.operators.tables import swap

    return swap(df.limit(0), path)


def embedded(chunks: DataFrame, embed, text: str = "embedding_text", to: str = "embedding", size: int = 64) -> DataFrame:
    """chunks with the vectors that ``embed`` (from a list of texts to a list of vectors) makes of their texts, ``size`` at a time."""
    @F.pandas_udf("array<float>")
    def made(texts: pd.Series) -> pd.Series:
        out: list = []
        for at in range(0, len(texts), size):
            out += [list(map(float, v)) for v in embed(texts.iloc[at : at + size].tolist())]
        if len(out) != len(texts):
            raise ValueError("as many vectors as texts are needed")
        return pd.Series(out, index=texts.index)

    return chunks.withColumn(to, made(F.coalesce(F.col(text), F.lit(""))))


def report(counts: DataFrame, path: str) -> str:
    """A small table of counts as one JSON file of lines in a new folder; returns the folder."""
    import uuid

    folder = f"{path}/report-{uuid.uuid4().hex}"
    counts.coalesce(1).write.json(folder)
    return folder


def parse_order(documents: DataFrame) -> DataFrame:
    """Raw documents in the order in which they are parsed: latest published or crawled, then source, then address, all falling."""
    return documents.orderBy(F.coalesce("published_at", "crawled_at").desc(), F.desc("source"), F.desc("url"))


def crawl_totals(pages: DataFrame, source: str) -> DataFrame:
    """One row for each source: pages, found, new, repeated and failed articles. pages: found, new, failed."""
    return pages.groupBy(source).agg(F.count("*").alias("pages"), F.sum("found").alias("found"), F.sum("new").alias("new"), F.sum(F.col("found") - F.col("new")).alias("repeated"), F.count_if("failed").alias("failed"))


def relaxed(question: Column) -> Column:
    """A question without its words for today and newest, for a second try."""
    return T.collapse(F.regexp_replace(question, r"(?iU)hôm nay|hom nay|mới nhất|moi nhat", " "))


def stripped(html: Column) -> Column:
    """The text between tags, entities of HTML resolved for the five of XML; comments go."""
    text = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", ""), r"(?s)<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def parents(chunks: DataFrame) -> DataFrame:
    """Articles from their chunks (article_id, chunk_index, text, title, source): the first chunk's title and source, all texts in order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"])
    return chunks.groupBy("article_id").agg(F.min_by("title", "chunk_index").alias("title"), F.min_by("source", "chunk_index").alias("source"), F.array_join(ordered, "\n\n").alias("content"))
