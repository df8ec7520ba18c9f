"""Which candidates fit a question by their metadata, and the whole way from candidates to results."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import rerank, retrieval
from newsloom.operators.router import holds

#: Phrases in a title that speak for a topic though the article was filed under another.
SIGNALS = {
    "economy_finance_stock": ("co phieu", "chung khoan", "vn-index", "vnindex", "hnx", "upcom", "loi nhuan", "eps", "p/e", "ma co phieu", "khoi ngoai", "tu doanh", "von hoa", "thanh khoan", "giao dich", "niem yet"),
    "real_estate": ("bat dong san", "can ho", "chung cu", "dat nen", "du an nha o", "gia nha", "thi truong bds"),
    "tech_ai_internet": ("tri tue nhan tao", "cong nghe", "chip ban dan", "ai generative", "openai", "google deepmind"),
}


@dataclass(frozen=True)
class Wanted:
    """What a question wants of metadata. aliases: other names of an entity, all folded."""

    question: rerank.Question = field(default_factory=rerank.Question)
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    lexical_terms: tuple[str, ...] = ()
    time_range: str = "all"
    days: int = 0
    date: str | None = None
    source: str | None = None
    signals: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(SIGNALS))
    least: int = 3
    latest: int = 8

    @property
    def sure(self) -> bool:
        """Whether the topic is certain enough to leave others out."""
        return self.question.explicit_topic or self.question.topic_confidence >= 0.75


def plain(name: str) -> str:
    """A name folded as texts are; white space stays."""
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", name.casefold()) if unicodedata.category(c) != "Mn").replace("đ", "d")


def compact(name: str) -> str:
    """Only the letters a-z and digits of a folded name."""
    return "".join(c for c in plain(name) if c.isascii() and c.isalnum())


def expanded(names: tuple[str, ...], aliases: dict[str, tuple[str, ...]]) -> list[str]:
    """Folded names, their compact forms, and the aliases of both."""
    out: dict[str, None] = {}
    for name in map(plain, names):
        for one in (name, compact(name)) if name else ():
            for x in (one, *aliases.get(one, ())):
                if x:
                    out[x] = None
    return list(out)


def fits_topic(w: Wanted, strict: bool) -> Column:
    """The asked topic is a candidate's primary or a secondary one; or, if strict, its title speaks for it. Without a topic all fit."""
    topic = w.question.topic
    if not topic:
        return F.lit(True)
    found = F.coalesce(F.col("primary_topic") == topic, F.lit(False)) | F.coalesce(F.array_contains("secondary_topics", topic), F.lit(False))
    return found | holds(T.folded(F.col("title")), w.signals.get(topic, ())) if strict else found


def same_name(wanted: str, name: Column) -> Column:
    """Whether a folded name means a wanted one: equal but for punctuation, or one holds the other and has three letters. ``ai`` is only itself, openai, or a last word."""
    found = T.compact(name) == compact(wanted) if compact(wanted) else F.lit(False)
    if wanted == "ai":
        return found | name.isin("ai", "openai") | name.endswith(" ai")
    inside = name.contains(wanted) if len(wanted) >= 3 else F.lit(False)
    return (name != "") & (found | inside | ((F.length(name) >= 3) & F.lit(wanted).contains(name)))


def fits_entities(w: Wanted, relaxed: bool = False) -> Column:
    """A candidate names an asked entity or its text holds it; relaxed, a lexical term of three letters will do. Without entities all fit."""
    if not w.question.entities:
        return F.lit(True)
    names = F.transform(F.coalesce("entity_names", F.array().cast("array<string>")), T.folded)
    wanted = expanded(w.question.entities, w.aliases)
    text = T.folded(F.concat_ws(" ", "title", "text"))
    named = F.exists(names, lambda n: reduce(lambda a, x: a | (n == x) | same_name(x, n), wanted, F.lit(False)))
    words = [x for x in wanted if len(x) >= 2] + ([x for x in expanded(w.lexical_terms, w.aliases) if len(x) >= 3] if relaxed else [])
    return named | holds(text, tuple(words))


def fits_time(w: Wanted, as_of: Column) -> Column:
    """Published on a date (in UTC or at +7 hours), today, within 24 hours, 7 days or so many; a candidate without a time never fits a limit."""
    at = F.col("published_at")
    if w.date:
        return F.coalesce((F.to_date(at) == F.lit(w.date).cast("date")) | (F.to_date(at + F.expr("interval 7 hours")) == F.lit(w.date).cast("date")), F.lit(False))
    if w.time_range == "today":
        return F.coalesce(F.to_date(at) == F.to_date(as_of), F.lit(False))
    days = {"24h": 1, "7d": 7}.get(w.time_range, w.days)
    return F.coalesce(at >= as_of - F.expr(f"interval {days} days"), F.lit(False)) if days > 0 else F.lit(True)


def fits_source(w: Wanted) -> Column:
    """One of the preferred sources or the one asked for, letter by letter; without any all fit."""
    named = [*w.question.preferred_sources, *([w.source] if w.source else [])]
    return F.coalesce(F.col("source").isin(*named), F.lit(False)) if named else F.lit(True)


def fits_images(w: Wanted) -> Column:
    """Has images, if these are wanted beside news; a question for images alone looks for them elsewhere."""
    return T.truthy(F.col("has_images")) if w.question.need_images and w.question.intent != "media_lookup" else F.lit(True)


def fits(w: Wanted, as_of: Column) -> Column:
    """All conditions together."""
    return fits_topic(w, w.sure) & fits_entities(w) & fits_time(w, as_of) & fits_source(w) & fits_images(w)


def filtered(candidates: DataFrame, w: Wanted, as_of: Column) -> DataFrame:
    """The candidates of the strictest condition that any meets, with its name in ``step`` and whether topics were scoped in ``scoped``.

    First the asked topic's candidates, if it is certain and there are enough of them, else all (scoped). Of these the ones that
    fit in all; then without topic and time; without time; of all candidates those with the entity and source; at last the
    first few. A question for one source gets no other: its ladder has one step.
    """
    scoping = fits_topic(w, strict=True) if w.sure and w.question.topic else F.lit(True)
    enough = candidates.agg((F.count_if(scoping) >= max(1, w.least)).alias("scoped"))  # one row
    marked = candidates.join(F.broadcast(enough)).withColumn("_in", ~F.col("scoped") | scoping)
    inside, rest = F.col("_in"), fits_source(w) & fits_images(w)
    steps = [("all", inside & fits(w, as_of))]
    if not (w.source or w.question.preferred_sources):
        steps += [
            ("relaxed_entity_filter", inside & rest & fits_entities(w, relaxed=True)),
            ("relaxed_time_filter", inside & rest & fits_topic(w, strict=False) & fits_entities(w, relaxed=True)),
            ("entity_over_topic_fallback", fits_source(w) & fits_entities(w, relaxed=True)),
            ("pre_filter_topk_fallback", inside),
        ]
    found = rerank.laddered(marked, steps).drop("_in")
    return found


def retrieve(candidates: DataFrame, w: Wanted, as_of: Column, order: list[Column], top: int, denied: Column, allowed: Column, soft: Column) -> DataFrame:
    """Results for a question from its candidates: filtered, guarded, reranked, diversified; with step, scoped and final_score.

    candidates: a list for one question (router.candidate_count), with the columns that rerank() needs and article_id. denied,
    allowed and soft: what a topic's guard thinks of a candidate. If the guard leaves nothing of a fallback's candidates they stay.
    """
    kept = filtered(candidates, w, as_of)
    last = kept.where("step = 'pre_filter_topk_fallback'").orderBy(*order).limit(max(3, w.latest))
    kept = kept.where("step != 'pre_filter_topk_fallback'").unionByName(last)
    topic = w.question.topic
    on_topic = F.coalesce(F.col("primary_topic") == topic, F.lit(False)) if topic and topic != "general_news" else F.lit(True)
    guard = ~denied & (on_topic | soft | allowed)
    some = kept.agg(F.coalesce(F.bool_or(guard), F.lit(False)).alias("_some"))  # one row
    guarded = kept.join(F.broadcast(some)).where(guard | (~F.col("_some") & (F.col("step") != "all"))).drop("_some")
    ranked = rerank.rerank(guarded, w.question, as_of, order)
    return retrieval.diversified(ranked, "article_id", "source", [F.desc("final_score"), *order], top, 2, max(2, top))
