"""Scoring of answers: what was expected of a response, whether its answer holds, and whether the response is whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators.router import STOCK_TOPIC, holds

#: Topics that count as each other, phrases of an answer that says it knows nothing, and ones that leak a prompt or a design.
TOPIC_ALIASES = {
    ("world", "quoc_te"): ("world", "quoc_te", "geopolitics", "the_gioi"),
    ("finance", "stock"): ("finance", "stock", "kinh_te", "chung_khoan", "tai_chinh"),
    ("ai", "technology"): ("ai", "tech", "technology", "cong_nghe", "internet"),
    ("business", "doanh_nghiep"): ("business", "doanh_nghiep", "startup", "khoi_nghiep"),
}
NO_ANSWER = ("khong du thong tin", "khong tim thay", "chua co du lieu", "khong co du lieu", "insufficient")
LEAKS = ("system prompt", "instruction", "huong dan he thong")


def topic_matches(expected: Column, actual: Column) -> Column:
    """Whether a folded topic name holds the expected one or one that counts as it."""
    alias = reduce(lambda a, kv: a.when(expected.isin(*kv[0]), holds(actual, kv[1])), TOPIC_ALIASES.items(), F.when(F.lit(False), False)).otherwise(F.lit(False))
    return actual.contains(expected) | alias


def scored(df: DataFrame, as_of: Column, markers: tuple[str, ...] = NO_ANSWER) -> DataFrame:
    """df with a column of OK, WARN, FAIL or SKIP for each of nine scores, and status: the worst of them.

    Of the response: answer, intent, topic, sources (array of struct source, title, published_at), images (array), related (array of
    struct article_id, title), entities (array). Expected: expected_intent, expected_topics, expected_source, expected_entities,
    min_sources, min_images, requires_multi_source, requires_images, requires_recent. A null array is none at all: the schema score fails.
    """
    c = F.col
    warn = lambda bad: F.when(bad, "WARN").otherwise("OK")
    skip = lambda given, bad: F.when(~F.coalesce(given, F.lit(False)), "SKIP").otherwise(warn(bad))
    sources, images, related = (F.coalesce(c(x), F.array().cast(df.schema[x].dataType)) for x in ("sources", "images", "related"))
    names = F.array_distinct(F.filter(F.transform(sources, lambda s: F.lower(F.trim(F.coalesce(s["source"], F.lit(""))))), lambda s: s != ""))
    keys = F.filter(F.transform(related, lambda r: F.lower(F.trim(T.first_filled(r["article_id"].cast("string"), r["title"])))), lambda k: k.isNotNull() & (k != ""))
    hay = T.folded(F.concat_ws(" ", c("entities"), F.transform(sources, lambda s: s["title"]), F.transform(related, lambda r: r["title"])))
    answer = F.trim(F.coalesce(c("answer"), F.lit("")))
    fallback, some = holds(T.folded(answer), markers), F.size(sources) > 0
    newest = F.array_max(F.transform(sources, lambda s: s["published_at"]))
    expected_source = F.coalesce(c("expected_source"), F.lit(""))
    out = {
        "schema_score": F.when(c("sources").isNull() | c("images").isNull() | c("related").isNull() | c("answer").isNull(), "FAIL").otherwise("OK"),
        "intent_score": skip(F.coalesce(c("expected_intent"), F.lit("")) != "", F.coalesce(c("intent"), F.lit("")) != c("expected_intent")),
        "topic_score": skip(F.size("expected_topics") > 0, ~F.exists("expected_topics", lambda t: topic_matches(T.folded(t), T.folded(c("topic"))))),
        "source_score": warn((F.size(sources) < c("min_sources")) | ((expected_source != "") & ~F.exists(sources, lambda s: F.lower(F.coalesce(s["source"], F.lit(""))).contains(F.lower(expected_source))))),
        "multi_source_score": skip(c("requires_multi_source"), F.size(names) < 2),
        "entity_score": skip(F.size("expected_entities") > 0, ~F.exists("expected_entities", lambda e: hay.contains(T.folded(e)))),
        "image_score": skip(c("requires_images"), F.size(images) < F.greatest(c("min_images"), F.lit(1))),
        "related_score": warn(((F.size(related) == 0) & some) | (F.size(F.array_distinct(keys)) < F.size(keys))),
        "answer_score": F.when(answer == "", "FAIL").otherwise(warn((some & (fallback | (F.length(answer) < 40))) | (~some & ~fallback))),
        "recency_score": skip(c("requires_recent"), F.coalesce(F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(newest.cast("timestamp"))) / 86400) > 30, F.lit(True))),
    }
    made = df.withColumns(out)
    worst = F.array(*(c(name) for name in out))
    return made.withColumn("status", F.when(F.array_contains(worst, "FAIL"), "FAIL").when(F.array_contains(worst, "WARN"), "WARN").otherwise("OK"))


def answer_status(answer: Column, sources: Column, markers: tuple[str, ...] = NO_ANSWER) -> Column:
    """struct status, reason: an answer needs words and sources; two sources make it OK unless it says that it knows nothing."""
    text = F.trim(F.coalesce(answer, F.lit("")))
    n = F.coalesce(sources, F.lit(0))
    reason = F.when(text == "", "empty_answer").when(n == 0, "missing_sources").when(holds(F.lower(text), markers), "answer_indicates_insufficient_data").when(n >= 2, "answer_has_multiple_sources").otherwise("single_source")
    status = F.when(reason.isin("empty_answer", "missing_sources"), "FAIL").when(reason == "answer_has_multiple_sources", "OK").otherwise("WARN")
    return F.struct(status.alias("status"), reason.alias("reason"))


def violations(answer: Column, question: Column, topic: Column, source_topics: Column, leaks: tuple[str, ...] = LEAKS, technical: tuple[str, ...] = (), stock: tuple[str, ...] = STOCK_TOPIC) -> Column:
    """What speaks against an answer: technical terms in a finance answer, leaked instructions, no stock terms for a stock question, sources all of other topics."""
    a, q = T.folded(answer), T.folded(question)
    finance = F.coalesce(topic == "economy_finance_stock", F.lit(False))
    named = F.coalesce((topic != "") & (topic != "general_news"), F.lit(False))
    found = [
        F.when(finance & holds(a, technical), "forbidden_technical_terms"),
        F.when(holds(a, leaks), "instruction_leak"),
        F.when(finance & holds(q, stock) & ~holds(a, stock), "stock_answer_missing_stock_terms"),
        F.when(named & (F.size(source_topics) > 0) & ~F.array_contains(source_topics, topic), "sources_do_not_match_answer_topic"),
    ]
    return F.array_compact(F.array(*found))


def smoke(whole: Column, sources: Column, strict: bool = False) -> Column:
    """FAIL for a response that lacks a field, else WARN (FAIL if strict) for one without sources, else OK."""
    return F.when(~F.coalesce(whole, F.lit(False)), "FAIL").when(F.coalesce(sources, F.lit(0)) == 0, "FAIL" if strict else "WARN").otherwise("OK")


def uncited(cited: Column, valid: Column) -> Column:
    """Cited numbers that no source has, in order."""
    return F.array_sort(F.array_except(cited, valid))


def rolled_up(df: DataFrame) -> DataFrame:
    """One row for each status, with how many responses have it."""
    return df.groupBy("status").agg(F.count("*").alias("responses"))
