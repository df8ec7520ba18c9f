"""Retrieval for a table of plans: filters, ladder, guard, ranking and diversity of many questions in one job.

A plan is a row of columns, and every decision is an expression over a candidate and its question's plan. Candidates meet
plans once, by question; all that follows (counts, ladder, guard, penalties, caps) are windows within a question,
which that one exchange serves. What each step left is counted by the same windows, so that a trace costs no pass of its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import dates
from newsloom.functions import text as T
from newsloom.operators import rerank
from newsloom.operators.metadata import SIGNALS
from newsloom.operators.router import holds

_LIST = "array<string>"
#: Columns of a plan beside its question's key, their types, and what a missing or null one means.
PLAN = {
    "question": ("string", ""), "intent": ("string", "default"), "topic": ("string", ""), "explicit_topic": ("boolean", False), "topic_confidence": ("double", 0.0), "entities": (_LIST, None), "wanted": (_LIST, None), "terms": (_LIST, None),
    "preferred_sources": (_LIST, None), "source": ("string", ""), "time_range": ("string", "all"), "days": ("int", 0), "date": ("date", None), "need_images": ("boolean", False), "requires_lexical": ("boolean", False),
    "half_life": ("double", 30.0), "hints": (_LIST, None), "least": ("int", 3), "latest": ("int", 8), "top": ("int", 8), "multi_source": ("boolean", False),
}
STEPS = ("all", "relaxed_entity_filter", "relaxed_time_filter", "entity_over_topic_fallback", "pre_filter_topk_fallback", "scoped_fallback")


def half_life(intent: Column, time_range: Column, n: Column) -> Column:
    """In how many days recency falls: 1.5 for the newest, 5 for recent, 3 for the stock market, else 30. n: the folded question."""
    newest = (intent == "latest_news") | time_range.isin("today", "24h") | n.contains("hom nay")
    recent = n.contains("gan day") | n.contains("moi nhat") | (time_range == "7d")
    return F.when(newest, 1.5).when(recent, 5.0).when(intent == "stock_market_overview", 3.0).otherwise(30.0)


def names_of(names: Column) -> Column:
    """Folded names and their compact forms, none empty or twice; null names count for nothing."""
    every = F.flatten(F.transform(F.coalesce(names, F.array().cast(_LIST)), lambda x: F.array(T.folded(x), T.compact(x))))
    return F.array_distinct(F.filter(every, lambda x: x != ""))


def with_aliases(plans: DataFrame, qid: str, column: str, aliases: DataFrame) -> DataFrame:
    """plans with ``column`` (folded names) widened by the aliases (name, alias) of any of its names."""
    asked = plans.select(qid, F.explode(column).alias("name"))
    table = aliases.select(T.folded(F.col("name")).alias("name"), T.folded(F.col("alias")).alias("_alias")).where("_alias != ''").distinct()
    more = asked.join(table, "name").groupBy(qid).agg(F.array_sort(F.collect_set("_alias")).alias("_more"))
    joined = plans.join(more, qid, "left")
    return joined.withColumn(column, F.array_distinct(F.concat(column, F.coalesce("_more", F.array().cast(_LIST))))).drop("_more")


def from_routes(routed: DataFrame, qid: str, question: str, top: int = 8, aliases: DataFrame | None = None) -> DataFrame:
    """Plans from routed questions (router.route), one row for each: tickers count as entities, a start date as the exact date.

    aliases: name and alias of entities, joined by name, however many there are.
    """
    n = F.col("normalized_query")
    plans = routed.select(
        qid, F.col(question).alias("question"), "intent", F.col("primary_topic").alias("topic"), "explicit_topic", "topic_confidence",
        F.array_distinct(F.transform(F.concat("entities", "stock_symbols"), T.folded)).alias("entities"), names_of(F.concat("entities", "stock_symbols")).alias("wanted"), names_of(F.col("lexical_terms")).alias("terms"),
        "source", "time_range", F.col("start_date").alias("date"), "need_images", "requires_lexical", half_life(F.col("intent"), F.col("time_range"), n).alias("half_life"), F.lit(max(3, top)).alias("least"), F.lit(top).alias("top"),
    )
    return plans if aliases is None else with_aliases(with_aliases(plans, qid, "wanted", aliases), qid, "terms", aliases)


def completed(plans: DataFrame, qid: str) -> DataFrame:
    """qid and plan, a struct of all columns of a plan; what is missing or null gets its default. A null key goes."""

    def one(name: str, kind: str, default) -> Column:
        empty = F.array().cast(_LIST) if kind == _LIST else F.lit(default).cast(kind)
        return (F.coalesce(F.col(f"`{name}`").cast(kind), empty) if name in plans.columns else empty).alias(name)

    made = plans.where(F.col(qid).isNotNull()).select(qid, *(one(name, *kind) for name, kind in PLAN.items()))
    if "wanted" not in plans.columns:
        made = made.withColumn("wanted", names_of(F.col("entities")))
    return made.select(qid, F.struct(*PLAN).alias("plan"))


def topic_fits(strict: Column, signals: dict[str, tuple[str, ...]]) -> Column:
    """A candidate of the asked topic, also as a secondary one; where strict, also one whose title speaks for it. Without a topic all fit."""
    topic = F.col("plan.topic")
    speaks = reduce(lambda a, kv: a | ((topic == kv[0]) & holds(F.col("_head"), kv[1])), signals.items(), F.lit(False))
    found = F.coalesce(F.col("primary_topic") == topic, F.lit(False)) | F.coalesce(F.array_contains("secondary_topics", topic), F.lit(False))
    return (topic == "") | found | (strict & speaks)


def names_match(wanted: Column, name: Column) -> Column:
    """Whether a folded name means a wanted one; see metadata.same_name."""
    own = F.regexp_replace(wanted, "[^a-z0-9]", "")
    alike = (own != "") & (F.regexp_replace(name, "[^a-z0-9]", "") == own)
    held = ((F.length(wanted) >= 3) & F.contains(name, wanted)) | ((F.length(name) >= 3) & F.contains(wanted, name))
    return (name != "") & ((name == wanted) | alike | F.when(wanted == "ai", name.isin("ai", "openai") | F.endswith(name, F.lit(" ai"))).otherwise(held))


def entities_fit(relaxed: bool) -> Column:
    """A candidate names a wanted entity, or its text holds it; relaxed, one of the plan's terms of three letters will do."""
    wanted, body = F.col("plan.wanted"), F.col("_body")
    named = F.exists("_names", lambda n: F.exists(wanted, lambda x: names_match(x, n)))
    found = named | F.exists(wanted, lambda x: (F.length(x) >= 2) & F.contains(body, x))
    if relaxed:
        found |= F.exists("plan.terms", lambda x: (F.length(x) >= 3) & F.contains(body, x))
    return (F.size(wanted) == 0) | found


def time_fits(as_of: Column) -> Column:
    """Published on the plan's date (in UTC or at +7 hours), today, or within its hours or days; a candidate without a time fits no limit."""
    at, span, date = F.col("published_at"), F.col("plan.time_range"), F.col("plan.date")
    days = F.when(span == "24h", 1).when(span == "7d", 7).otherwise(F.col("plan.days"))
    on = (F.to_date(at) == date) | (F.to_date(at + F.expr("interval 7 hours")) == date)
    found = F.when(date.isNotNull(), on).when(span == "today", F.to_date(at) == F.to_date(as_of)).when(days > 0, at >= as_of - F.make_dt_interval(days)).otherwise(True)
    return F.coalesce(found, F.lit(False))


def sources_named() -> Column:
    """Whether a plan asks for sources."""
    return (F.col("plan.source") != "") | (F.size("plan.preferred_sources") > 0)


def source_fits() -> Column:
    """One of the preferred sources or the one asked for, letter by letter; without any all fit."""
    found = (F.col("source") == F.nullif(F.col("plan.source"), F.lit(""))) | F.array_contains("plan.preferred_sources", F.col("source"))
    return ~sources_named() | F.coalesce(found, F.array_contains("plan.preferred_sources", F.coalesce("source", F.lit(""))), F.lit(False))


def scored(kept: DataFrame, qid: str, as_of: Column, order: list[Column]) -> DataFrame:
    """kept with final_score, as rerank.rerank gives it to each question's candidates."""
    p = lambda name: F.col(f"plan.{name}")
    words, found = T.terms(p("question")), T.terms(F.concat_ws(" ", "title", "text"))
    body, entities = F.col("_body"), p("entities")
    kept = kept.withColumn("_found", found)
    keyword = F.when(F.size("_found") == 0, 0.0).otherwise(T.overlap(words, F.col("_found")))
    finance = F.when(p("topic") == "economy_finance_stock", rerank.finance_score("economy_finance_stock", body)).otherwise(0.0)
    match = F.when(p("topic") == "", 0.0).when(F.col("primary_topic") == p("topic"), 1.0).when(F.array_contains("secondary_topics", p("topic")), 0.5).otherwise(0.0)
    hint = F.when(F.size("plan.hints") == 0, 0.0).otherwise(T.overlap(T.terms(F.array_join("plan.hints", " ")), F.col("_found")))
    asked = F.size(entities)
    share = F.greatest(F.size(F.array_intersect(entities, F.col("_names"))) / asked, F.size(F.filter(entities, lambda e: F.contains(body, e))) / asked)
    by_the_way = F.array_contains(entities, "techcombank") & ~holds(T.folded(p("question")), rerank.TRANSFERS) & holds(body, rerank.INCIDENTAL)
    entity = F.when(asked == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share - F.when(by_the_way, 0.30).otherwise(0.0))))
    loss = F.when(p("explicit_topic"), 0.90).when(p("topic_confidence") >= 0.75, 0.80).when(p("topic_confidence") >= 0.35, 0.45).otherwise(0.25)
    loss = F.when((p("topic") == "") | (F.coalesce(F.col("_match"), F.lit(0.0)) > 0), 0.0).otherwise(loss)
    quality = F.when(p("intent") == "stock_market_overview", rerank.overview_quality("stock_market_overview", body)).otherwise(0.0)
    trust = reduce(lambda a, kv: a.when(F.col("source") == kv[0], kv[1]), rerank.SOURCES.items(), F.when(F.array_contains("plan.preferred_sources", F.col("source")), 1.0)).otherwise(0.7)
    again = F.least(F.lit(0.2), (F.row_number().over(Window.partitionBy(qid, "source").orderBy(*order)) - 1) * 0.05)
    kept = kept.withColumns({"_match": match, "_keyword": F.greatest(keyword, finance)}).withColumns({"_topic": F.greatest("_match", hint), "_entity": entity})
    relevance = F.when(p("requires_lexical"), rerank.relevance(F.col("vector_score"), F.col("bm25_score"), F.col("hybrid_score"), F.col("_keyword"), True)).otherwise(
        rerank.relevance(F.col("vector_score"), F.col("bm25_score"), F.col("hybrid_score"), F.col("_keyword"), False)
    )
    weights = F.create_map(*(F.lit(x) for k, w in rerank.WEIGHTS.items() for x in (k, list(w))))
    kept = kept.withColumn("_w", F.coalesce(F.try_element_at(weights, p("intent")), F.array(*map(F.lit, rerank.WEIGHTS["default"]))))
    w = lambda i: F.col("_w")[i]
    image = F.when(p("need_images") & T.truthy(F.col("has_images")), 0.05).otherwise(0.0)
    penalty = F.when(F.col("_entity") >= 0.75, F.least(loss, F.lit(0.15))).otherwise(loss)
    recency = dates.recency(F.col("published_at"), as_of, p("half_life"))
    final = relevance * w(0) + recency * w(1) + F.col("_entity") * w(2) + F.col("_topic") * w(3) + quality * w(4) + trust * 0.05 + image - again - penalty
    return kept.withColumn("final_score", final).drop("_match", "_keyword", "_topic", "_entity", "_w", "_found")


def retrieve(candidates: DataFrame, plans: DataFrame, qid: str, as_of: Column, order: list[Column], denied: Column, allowed: Column, soft: Column, signals: dict[str, tuple[str, ...]] = SIGNALS) -> DataFrame:
    """Results for every plan from its candidates: the candidates' columns, step, scoped, counts, final_score and rank within the question.

    candidates: qid, article_id, title, text, source, primary_topic, secondary_topics, entity_names, published_at, has_images, vector_score,
    bm25_score, hybrid_score; as many for a question as router.candidate_count says. order: how they came, total within a question.
    denied, allowed, soft: what the topic's guard thinks of a candidate; they may read ``plan`` and ``_body``, the folded title and text. plans: a row for each question
    with any columns of PLAN; of a question that comes twice each plan is a question of its own only if its key differs, so keys must be unique.

    A question's candidates are scoped to its topic if that is sure and enough remain, then filtered by the first step of the
    ladder that any meets, guarded, ranked and thinned out. A question that names sources gets no others. If the guard leaves
    nothing of a fallback's candidates they stay; if nothing is left at all, a question that names no source and no sure topic
    keeps its scoped candidates. counts: how many were there, scoped, filtered and guarded. A question without
    candidates, or with none left, has no rows; empty tables give none. Further columns of candidates stay as they are.
    """
    own = Window.partitionBy(qid)
    joined = candidates.join(completed(plans, qid), qid)
    p = lambda name: F.col(f"plan.{name}")
    sure = p("explicit_topic") | (p("topic_confidence") >= 0.75)
    names = F.transform(F.coalesce("entity_names", F.array().cast(_LIST)), T.folded)
    marked = joined.withColumns({"_body": T.folded(F.concat_ws(" ", "title", "text")), "_head": T.folded(F.col("title")), "_names": names})
    strict, loose = topic_fits(sure, signals), topic_fits(F.lit(False), signals)
    entity, relaxed = entities_fit(False), entities_fit(True)
    images = ~p("need_images") | (p("intent") == "media_lookup") | T.truthy(F.col("has_images"))
    marked = marked.withColumns({"_sure": sure, "_strict": strict, "_loose": loose, "_ent": entity, "_rel": relaxed, "_src": source_fits(), "_img": images, "_time": time_fits(as_of)})
    scoping = ~(F.col("_sure") & (p("topic") != "")) | F.col("_strict")
    marked = marked.withColumn("_scoping", scoping)
    marked = marked.withColumn("scoped", F.count_if("_scoping").over(own) >= F.greatest(F.lit(1), p("least")))
    marked = marked.withColumn("_in", ~F.col("scoped") | F.col("_scoping"))
    free, inside = ~sources_named(), F.col("_in")
    rest = F.col("_src") & F.col("_img")
    conditions = [
        inside & F.col("_strict") & F.col("_ent") & F.col("_time") & rest,
        free & inside & rest & F.col("_rel"),
        free & inside & rest & F.col("_loose") & F.col("_rel"),
        free & F.col("_src") & F.col("_rel"),
        free & inside,
    ]
    marked = marked.withColumns({f"_s{i}": c for i, c in enumerate(conditions)})
    first = F.coalesce(*(F.when(F.bool_or(f"_s{i}").over(own), F.lit(i)) for i in range(len(conditions))), F.lit(-1))
    marked = marked.withColumn("_first", first)
    passed = reduce(lambda a, i: a | ((F.col("_first") == i) & F.col(f"_s{i}")), range(len(conditions)), F.lit(False))
    nth = F.row_number().over(own.orderBy(F.desc("_passed"), *order))
    marked = marked.withColumn("_passed", passed).withColumn("_nth", nth)
    few = (F.col("_first") != 4) | (F.col("_nth") <= F.greatest(F.lit(3), p("latest")))
    on_topic = p("topic").isin("", "general_news") | F.coalesce(F.col("primary_topic") == p("topic"), F.lit(False))
    no = lambda c: F.coalesce(c, F.lit(False))
    guard = ~no(denied) & (on_topic | no(soft) | no(allowed))
    marked = marked.withColumn("_passed", F.col("_passed") & few).withColumn("_guard", F.col("_passed") & guard)
    counted = F.struct(F.count("*").over(own).alias("candidates"), F.count_if("_in").over(own).alias("scoped"), F.count_if("_passed").over(own).alias("filtered"), F.count_if("_guard").over(own).alias("guarded"))
    marked = marked.withColumn("counts", counted)
    nothing = (F.col("counts.guarded") == 0) & F.col("_first").isin(-1, 0)
    last_resort = nothing & free & ~F.col("_sure")
    keep = F.when(F.col("counts.guarded") > 0, F.col("_guard")).when(last_resort, F.col("_in")).otherwise(F.col("_passed") & (F.col("_first") > 0))
    step = F.element_at(F.array(*map(F.lit, STEPS)), F.when(last_resort, 6).otherwise(F.col("_first") + 1))
    kept = marked.where(keep).withColumn("step", step).drop(*(f"_s{i}" for i in range(len(conditions))), "_sure", "_strict", "_loose", "_ent", "_rel", "_src", "_img", "_time", "_scoping", "_in", "_passed", "_guard", "_nth", "_first", "_head")
    ranked = scored(kept, qid, as_of, order)
    best = [F.desc("final_score"), *order]
    ranked = ranked.withColumn("_a", F.row_number().over(Window.partitionBy(qid, "article_id").orderBy(*best))).where("_a <= 2")
    ranked = ranked.withColumn("_n", F.row_number().over(Window.partitionBy(qid, "source").orderBy(*best)))
    cap = F.when(p("multi_source"), 2).otherwise(F.greatest(F.lit(2), p("top")))
    favoured = F.coalesce(F.exists("plan.preferred_sources", lambda s: F.lower(s) == F.lower("source")), F.lit(False))
    thinned = ranked.where((F.col("_n") <= cap) | favoured | (F.coalesce("source", F.lit("")) == ""))
    thinned = thinned.withColumn("rank", F.row_number().over(own.orderBy(*best))).where(F.col("rank") <= F.greatest(F.lit(1), p("top")))
    return thinned.drop("plan", "_a", "_n", "_body", "_names")
