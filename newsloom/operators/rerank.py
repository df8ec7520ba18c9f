"""Reranking, scoping and guarding of retrieved candidates."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import dates
from newsloom.functions import text as T

#: How much relevance, recency, entity, topic and quality weigh for each kind of question.
WEIGHTS = {
    "stock_market_overview": (0.32, 0.12, 0.04, 0.28, 0.24),
    "citation": (0.46, 0.06, 0.34, 0.14, 0.0),
    "followup": (0.36, 0.05, 0.24, 0.35, 0.0),
    "synthesis": (0.38, 0.06, 0.08, 0.48, 0.0),
    "latest_news": (0.38, 0.16, 0.08, 0.38, 0.0),
    "entity_news": (0.45, 0.10, 0.35, 0.10, 0.0),
    "article_summary": (0.75, 0.0, 0.15, 0.10, 0.0),
    "topic_news": (0.40, 0.08, 0.08, 0.44, 0.0),
    "default": (0.50, 0.10, 0.15, 0.25, 0.0),
}
#: Trust in each source; any other has 0.7.
SOURCES = {"vnexpress": 1.0, "cafef": 0.95, "genk": 0.9, "diendandoanhnghiep": 0.85}


#: What speaks for a finance article, for one on the whole market, for one on a single share, and what mentions a bank by the way only.
STRONG_FINANCE = ("chung khoan", "co phieu", "vn-index", "vnindex", "hnx", "upcom", "hose", "thanh khoan", "khop lenh", "tang tran", "giam san", "sac tim", "ma co phieu", "khoi ngoai", "tu doanh", "von hoa", "bluechip")
WEAK_FINANCE = ("doanh nghiep", "cong ty", "ngan hang", "tai chinh")
OVERVIEW = ("vn-index", "vnindex", "vn index", "hnx-index", "hnx", "upcom", "thi truong chung khoan", "chung khoan viet nam", "thanh khoan", "nhom nganh", "khoi ngoai", "nha dau tu", "co phieu ngan hang", "co phieu chung khoan", "san hose", "hose", "tang diem", "giam diem", "sac xanh", "sac do", "thi truong", "chi so")
SINGLE_SHARE = ("giai trinh", "tang tran", "tran nhieu phien", "tran 8 phien", "chia co tuc", "tang von", "len san", "doanh thu nhieu quy", "co phieu tang gia gap ruoi", "phat hanh rieng le")
TRANSFERS = ("chuyen nham", "chuyen tien", "giao dich", "doi lai tien")
INCIDENTAL = ("chuyen nham", "so tai khoan", "chu tai khoan", "khong quen biet", "doi lai tien", "bat can")


def hits(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words folded text holds."""
    return reduce(lambda a, w: a + F.when(text.contains(w), 1).otherwise(0), words, F.lit(0))


def finance_score(topic: str, text: Column, strong: tuple[str, ...] = STRONG_FINANCE, weak: tuple[str, ...] = WEAK_FINANCE) -> Column:
    """For a finance question 0.24 for each strong word of folded text and 0.04 for each weak one (0.16 at most), 1 at most; 0 without a strong word."""
    if topic != "economy_finance_stock":
        return F.lit(0.0)
    n = hits(text, strong)
    return F.when(n == 0, 0.0).otherwise(F.least(F.lit(1.0), n * 0.24 + F.least(F.lit(0.16), hits(text, weak) * 0.04)))


def overview_quality(intent: str, text: Column, overview: tuple[str, ...] = OVERVIEW, single: tuple[str, ...] = SINGLE_SHARE) -> Column:
    """For a question on the whole market: a quarter for each word on it, 1 at most, less 0.25 for an article on a single share; 0 at least."""
    if intent != "stock_market_overview":
        return F.lit(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), hits(text, overview) / 4) - F.when(hits(text, single) > 0, 0.25).otherwise(0.0))


def peripheral_penalty(question: str, entities: tuple[str, ...], text: Column, bank: str = "techcombank", transfers: tuple[str, ...] = TRANSFERS, incidental: tuple[str, ...] = INCIDENTAL) -> Column:
    """0.3 for a text that mentions an asked bank only as the place of a wrong transfer, unless transfers are asked about."""
    if bank not in entities or any(t in question for t in transfers):
        return F.lit(0.0)
    return F.when(hits(text, incidental) > 0, 0.30).otherwise(0.0)


def chunk_score(question: str, score: Column, text: Column, about: Column) -> Column:
    """How a chunk ranks within its article: 0.55 of its score, 0.3 of the question's words in its text, 0.15 in its title and categories."""
    words = T.terms(F.lit(question))
    return score * 0.55 + T.overlap(words, T.terms(text)) * 0.3 + T.overlap(words, T.terms(about)) * 0.15


@dataclass(frozen=True)
class Question:
    """What is asked, as far as ranking needs it."""

    text: str = ""
    intent: str = "default"
    topic: str = ""
    explicit_topic: bool = False
    topic_confidence: float = 0.0
    entities: tuple[str, ...] = ()
    preferred_sources: tuple[str, ...] = ()
    need_images: bool = False
    requires_lexical: bool = False
    days: float = 30.0
    hints: tuple[str, ...] = field(default=())


def bounded(score: Column) -> Column:
    """0..1: itself up to 1, then x / (1 + x); nothing below 0."""
    return F.when(score <= 0, 0.0).when(score <= 1, score).otherwise(score / (1 + score))


def relevance(vector: Column, bm25: Column, hybrid: Column, keyword: Column, lexical: bool) -> Column:
    """The mix of a candidate's scores; a lexical question weighs words more."""
    w = (0.35, 0.25, 0.35, 0.05) if lexical else (0.35, 0.30, 0.25, 0.10)
    return bounded(hybrid) * w[0] + bounded(vector) * w[1] + bounded(bm25) * w[2] + F.least(F.lit(1.0), F.greatest(F.lit(0.0), keyword)) * w[3]


def topic_score(topic: str, primary: Column, secondary: Column) -> Column:
    """1 for the asked primary topic, 0.5 for a secondary one, else 0."""
    if not topic:
        return F.lit(0.0)
    return F.when(primary == topic, 1.0).when(F.array_contains(secondary, topic), 0.5).otherwise(0.0)


def topic_penalty(q: Question, match: Column) -> Column:
    """What a candidate of another topic loses: more the surer the asked topic is."""
    if not q.topic:
        return F.lit(0.0)
    loss = 0.90 if q.explicit_topic else 0.80 if q.topic_confidence >= 0.75 else 0.45 if q.topic_confidence >= 0.35 else 0.25
    return F.when(F.coalesce(match, F.lit(0.0)) > 0, 0.0).otherwise(loss)


def source_score(source: Column, preferred: tuple[str, ...]) -> Column:
    """Trust in a source; preferred ones have all."""
    out = reduce(lambda a, kv: a.when(source == kv[0], kv[1]), SOURCES.items(), F.when(source.isin(*preferred) if preferred else F.lit(False), 1.0))
    return out.otherwise(0.7)


def rerank(candidates: DataFrame, q: Question, as_of: Column, order: list[Column]) -> DataFrame:
    """candidates with their scores and final_score; order is how they came, on which the penalty of repeated sources depends.

    Columns: title, text, source, primary_topic, secondary_topics, entity_names (array), published_at, has_images, vector_score,
    bm25_score, hybrid_score.
    """
    words = T.terms(F.lit(q.text))
    body = F.concat_ws(" ", "title", "text")
    found = T.terms(body)
    keyword = F.when(F.size(found) == 0, 0.0).otherwise(T.overlap(words, found))
    match = topic_score(q.topic, F.col("primary_topic"), F.col("secondary_topics"))
    hint = T.overlap(T.terms(F.lit(" ".join(q.hints))), found) if q.hints else F.lit(0.0)
    plain_body = T.folded(body)
    topic = F.greatest(match, hint)
    keyword = F.greatest(keyword, finance_score(q.topic, plain_body))
    if q.entities:
        wanted = F.array(*(F.lit(e) for e in q.entities))
        named = F.size(F.array_intersect(wanted, F.transform("entity_names", T.folded))) / len(q.entities)
        inside = reduce(lambda a, e: a + F.when(T.folded(body).contains(e), 1).otherwise(0), q.entities, F.lit(0)) / len(q.entities)
        entity = F.greatest(F.coalesce(named, F.lit(0.0)), inside) - peripheral_penalty(folded_question(q.text), q.entities, T.folded(body))
        entity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), entity))
    else:
        entity = F.lit(0.0)
    penalty = topic_penalty(q, match)
    penalty = F.when(entity >= 0.75, F.least(penalty, F.lit(0.15))).otherwise(penalty)
    repeated = F.least(F.lit(0.2), (F.row_number().over(Window.partitionBy("source").orderBy(*order)) - 1) * 0.05)
    w = WEIGHTS.get(q.intent, WEIGHTS["default"])
    image = F.when(T.truthy(F.col("has_images")), 0.05).otherwise(0.0) if q.need_images else F.lit(0.0)
    scored = candidates.withColumns(
        {
            "keyword_score": keyword,
            "topic_score": topic,
            "entity_score": entity,
            "topic_penalty": penalty,
            "recency_score": dates.recency(F.col("published_at"), as_of, q.days),
            "source_score": source_score(F.col("source"), q.preferred_sources),
            "diversity_penalty": repeated,
            "image_score": image,
            "quality_score": overview_quality(q.intent, plain_body),
        }
    )
    scored = scored.withColumn("relevance_score", relevance(F.col("vector_score"), F.col("bm25_score"), F.col("hybrid_score"), F.col("keyword_score"), q.requires_lexical))
    final = F.col("relevance_score") * w[0] + F.col("recency_score") * w[1] + F.col("entity_score") * w[2] + F.col("topic_score") * w[3] + F.col("quality_score") * w[4] + F.col("source_score") * 0.05 + F.col("image_score") - F.col("diversity_penalty") - F.col("topic_penalty")
    return scored.withColumn("final_score", final)


def folded_question(text: str) -> str:
    """A question folded as texts are."""
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", text.casefold()) if unicodedata.category(c) != "Mn").replace("đ", "d")


def simple_score(vector: Column, query: str, text: Column, title: Column) -> Column:
    """0.7 of the vector score, 0.25 of the query's words in the text, 0.05 in the title."""
    words = T.terms(F.lit(query))
    return vector * 0.7 + T.overlap(words, T.terms(text)) * 0.25 + T.overlap(words, T.terms(title)) * 0.05


def scoped(candidates: DataFrame, match: Column, least: int) -> DataFrame:
    """Only the matching candidates if there are ``least`` of them, else all; scoped tells which."""
    marked = candidates.withColumn("_m", match)
    enough = marked.agg((F.count_if("_m") >= max(1, least)).alias("scoped"))  # one row
    return marked.join(F.broadcast(enough)).where(~F.col("scoped") | F.col("_m")).drop("_m")


def laddered(candidates: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """The candidates of the first step that any satisfies, with the step's name."""
    marked = candidates
    for i, (_, condition) in enumerate(steps):
        marked = marked.withColumn(f"_s{i}", F.coalesce(condition, F.lit(False)))
    first = F.coalesce(*(F.when(F.bool_or(f"_s{i}"), F.lit(i)) for i in range(len(steps))))
    marked = marked.join(F.broadcast(marked.agg(first.alias("_first"))))  # one row
    keep = reduce(lambda a, i: a | ((F.col("_first") == i) & F.col(f"_s{i}")), range(len(steps)), F.lit(False))
    name = F.element_at(F.array(*(F.lit(n) for n, _ in steps)), F.col("_first") + 1)
    return marked.where(keep).withColumn("step", name).drop("_first", *(f"_s{i}" for i in range(len(steps))))


def guarded(candidates: DataFrame, denied: Column, on_topic: Column, allowed: Column, soft: Column) -> DataFrame:
    """One row: verdict on a context. Denied candidates go; ones of another topic go unless something else speaks for them.

    Accepted if enough stay, few are of a wrong topic, and anything speaks for the topic; score grows with all three.
    """
    n = F.count("*")
    kept = F.count_if(~denied & (on_topic | soft))
    wrong = F.count_if(~denied & ~on_topic & ~soft)
    counts = candidates.agg(n.alias("retrieved"), kept.alias("kept"), wrong.alias("wrong_topic"), F.count_if(denied).alias("denied"), F.count_if(on_topic).alias("topic_matches"), F.count_if(allowed).alias("allow_matches"))
    c = F.col
    reason = (
        F.when(c("retrieved") == 0, "empty_context")
        .when(c("kept") < F.least(F.lit(2), c("retrieved")), "too_few_valid_chunks_after_guard")
        .when(c("wrong_topic") / c("retrieved") > 0.4, "wrong_topic_ratio_above_threshold")
        .when((c("allow_matches") == 0) & (c("topic_matches") == 0), "no_topic_or_allow_keyword_evidence")
        .otherwise("ok")
    )
    score = F.least(F.lit(1.0), c("kept") / c("retrieved") * 0.6 + c("topic_matches") / c("retrieved") * 0.3 + F.least(F.lit(0.1), c("allow_matches") * 0.03))
    return counts.withColumn("reason", reason).withColumn("guard_score", F.when(c("reason") == "ok", score))


def evidence(candidates: DataFrame, vector: str, *others: str) -> DataFrame:
    """One row: the best vector score, the best of any, and whether they suffice (0.05 and 0.15)."""
    best = candidates.agg(F.max(vector).alias("best_vector"), F.max(F.greatest(vector, *others)).alias("best_any"))
    return best.withColumn("sufficient", F.coalesce((F.col("best_vector") >= 0.05) & (F.col("best_any") >= 0.15), F.lit(False)))


def weak(ranked: DataFrame, least: float) -> DataFrame:
    """One row: how many candidates, their best final score, and whether that is below ``least`` (or there is none)."""
    best = F.max("final_score")
    return ranked.agg(F.count("*").alias("candidates"), best.alias("best"), F.coalesce(best < least, F.lit(True)).alias("weak"))
