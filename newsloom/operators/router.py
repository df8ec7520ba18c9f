"""Routing of questions: what is asked, of which topic, about whom, from when, and whether pictures are wanted.

Questions are rows, and each step is a set of column expressions, so a log of any number of them is routed in one pass
without a shuffle. What the words mean is given by a Lexicon.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import classify

#: Phrases by which a folded question shows what it wants.
LATEST = ("tin moi nhat", "moi nhat", "hom nay", "24h qua", "gan day")
IMAGES = ("anh", "hinh anh", "co anh", "co anh nao", "anh ve", "hinh ve", "xem anh", "cho toi anh", "cho toi xem anh", "photo", "image", "picture")
TIMELINE = ("dien bien", "timeline", "theo thoi gian")
SYNTHESIS = ("co gi moi", "tin moi", "tin tuc", "tinh hinh", "xu huong", "tong hop", "tom tat", "phan tich", "anh huong", "tac dong", "dien bien", "co gi dang chu y", "nhu the nao", "ra sao", "co gi", "giai thich", "sao vay", "vi sao", "tai sao")
CITATION = ("trich dan", "trich doan", "bai bao noi gi", "noi chinh xac", "so lieu", "la bao nhieu", "ai noi", "khi nao", "ngay nao", "luc may gio", "o dau", "ten day du", "chinh xac la", "nguyen van", "copy", "dan cu the")
FOLLOW_UP = ("vu nay", "su viec nay", "cai nay", "viec do", "chuyen do", "the nao", "sao nhi", "no la gi", "no anh huong", "giai thich them", "the co nghia la gi")
GENERIC = ("tin tuc", "tong hop", "moi nhat", "hom nay", "tuan nay", "thang nay", "nam 2026", "tinh hinh", "dien bien", "van de", "cap nhat", "co gi moi")
SCHEDULE = ("lich thi dau", "da luc may gio", "tran nao", "khi nao da", "lich bong da")
RESULT = ("ket qua bong da", "ket qua tran", "ti so", "ty so", "vo dich", "ai vo dich")
STANDING = ("bang xep hang", "bxh", "xep hang")
SPORTS = ("bong da", "the thao", "c1", "cup c1", "champions league", "ngoai hang anh", "world cup", "euro", "v-league", "vleague")
STOCK_TOPIC = ("chung khoan", "co phieu", "vn-index", "vnindex", "hnx", "upcom", "hose", "thanh khoan", "khop lenh", "tang tran", "giam san", "sac tim", "ma co phieu", "khoi ngoai", "tu doanh", "von hoa", "bluechip")
STOCK = ("co phieu", "chung khoan", "vn-index", "vnindex")
STOCK_CLASH = (*STOCK, "ma co phieu", "ma chung khoan")
OVERVIEW = ("gia co phieu hom nay", "vn-index tuan nay", "vnindex tuan nay", "thi truong chung khoan tuan nay", "chung khoan tuan nay")
PERIOD = ("hom nay", "tuan nay", "tuan qua", "7 ngay", "gan day", "thi truong")
ASKS_COURSE = ("dien bien", "the nao", "ra sao", "tang giam", "xu huong")
AI_MARKERS = ("tin ai", "tri tue nhan tao", "openai", "chatgpt", "genai", "generative ai", "mo hinh ai", "cong nghe ai", "ung dung ai")
TICKERS = ("VNINDEX", "HNX", "UPCOM", "HPG", "FPT", "VIC", "VHM", "VCB", "TCB", "BID", "CTG", "MWG", "VNM", "SSI", "VND", "MSN", "GAS", "VFS", "BSR")
SOURCES = {
    "vnexpress": ("vnexpress", "vn express", "vnepress", "vnepxress", "vnexress", "vnexpess"),
    "cafef": ("cafef", "cafe f", "cafef.vn"),
    "genk": ("genk", "gen k", "genk.vn"),
    "diendandoanhnghiep": ("diendandoanhnghiep", "dien dan doanh nghiep", "dddn"),
}
MEDIA = {
    "Trung Đông": ("trung dong", "middle east"), "Israel": ("israel",), "Iran": ("iran",), "Gaza": ("gaza",), "Palestine": ("palestine", "palestina"), "Hamas": ("hamas",), "Lebanon": ("lebanon", "liban"),
    "Syria": ("syria",), "Yemen": ("yemen",), "Houthi": ("houthi",), "Mỹ": ("my", "hoa ky"), "chiến sự": ("chien su",), "xung đột": ("xung dot",),
}
DOMAINS = {
    "economy_finance_stock": "tai_chinh", "tech_ai_internet": "cong_nghe", "real_estate": "bat_dong_san", "lifestyle_education_health_entertainment": "doi_song", "politics_society": "chinh_tri_xa_hoi",
    "world_geopolitics": "the_gioi", "business_startup": "startup",
}
FINANCE, PROPERTY, TECH, WORLD, BUSINESS, LIFE, POLITICS = PRIORITY = ("economy_finance_stock", "real_estate", "tech_ai_internet", "world_geopolitics", "business_startup", "lifestyle_education_health_entertainment", "politics_society")
CREDIT, LOANS = ("tin dung", "ngan hang", "lai suat", "vay von"), ("tin dung", "ngan hang", "lai suat", "vay mua nha", "cho vay")
ONLINE, ABROAD = ("zalo", "otp", "vneid", "an ninh mang", "lua dao online", "qua mang"), ("fed", "lai suat my", "usd", "thi truong toan cau")


@dataclass(frozen=True)
class Lexicon:
    """Keywords of each topic (strong, medium, weak: 3, 2 and 1 points), entities as in classify.ENTITIES, and fixed names."""

    topics: dict[str, tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]]
    entities: tuple[tuple[str, str, tuple[str, ...], float], ...] = ()
    media: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(MEDIA))
    sources: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(SOURCES))
    tickers: tuple[str, ...] = TICKERS


def holds(text: Column, phrases: tuple[str, ...]) -> Column:
    """Whether text holds any of the phrases, anywhere."""
    return reduce(lambda a, p: a | text.contains(p), phrases, F.lit(False))


def keyword(text: Column, word: str) -> Column:
    """Whether a folded question holds a keyword: one of letters and digits as a whole word, any other anywhere; a generic one never."""
    if not word.strip() or word in GENERIC:
        return F.lit(False)
    if not all(c.isalnum() or c == "_" for c in word):
        return text.contains(word)
    return bounded(text, word)


def bounded(text: Column, pattern: str) -> Column:
    """Whether a pattern stands in text with no word character at either side."""
    return text.rlike(rf"(?U)(?<!\w)(?:{pattern})(?!\w)")


def any_keyword(text: Column, words: tuple[str, ...]) -> Column:
    """Whether a folded question holds any of these keywords."""
    return reduce(lambda a, w: a | keyword(text, w), words, F.lit(False))


def topic_scores(n: Column, lexicon: Lexicon, has_symbols: Column, entities: Column) -> tuple[dict[str, Column], dict[str, Column], dict[str, Column]]:
    """Points, number of strong hits and matched keywords of each topic.

    A keyword of several words has one point more. A ticker speaks for finance, the chamber of commerce for business. Then
    topics that are often confused take points from each other; none falls below 0 by that.
    """
    points, strong, matched = {}, {}, {}
    for topic, groups in lexicon.topics.items():
        hits = [(w, weight + (" " in w.strip())) for words, weight in zip(groups, (3, 2, 1), strict=True) for w in words]
        points[topic] = reduce(lambda a, h: a + F.when(keyword(n, h[0]), h[1]).otherwise(0), hits, F.lit(0))
        strong[topic] = reduce(lambda a, w: a + F.when(keyword(n, w), 1).otherwise(0), groups[0], F.lit(0))
        matched[topic] = F.array_distinct(F.array_compact(F.array(*(F.when(keyword(n, w), w) for w, _ in hits)).cast("array<string>")))
    more = F.when(has_symbols, 1).otherwise(0)
    points[FINANCE], strong[FINANCE] = points[FINANCE] + 2 * more, strong[FINANCE] + more
    points[BUSINESS] = points[BUSINESS] + F.when(F.array_contains(F.transform(entities, T.normalized), "vcci"), 2).otherwise(0)
    strongly = {t: any_keyword(n, lexicon.topics[t][0]) for t in (FINANCE, PROPERTY, TECH)}
    rules = [
        (strongly[FINANCE], POLITICS, -3),
        (any_keyword(n, STOCK_CLASH), BUSINESS, -3),
        (any_keyword(n, STOCK_CLASH), FINANCE, 2),
        (strongly[PROPERTY] & ~any_keyword(n, CREDIT), POLITICS, -3),
        (strongly[PROPERTY] & any_keyword(n, LOANS), FINANCE, 3),
        (strongly[TECH] & any_keyword(n, ONLINE), POLITICS, -2),
        (any_keyword(n, ABROAD), FINANCE, 2),
    ]
    for condition, topic, change in rules:
        points[topic] = F.when(condition, F.greatest(F.lit(0), points[topic] + change)).otherwise(points[topic])
    return points, strong, matched


def exact_date(n: Column, year: Column) -> Column:
    """A day and month, and perhaps a year, in a folded question; ``year`` where it names none; null if it is no date."""
    pattern = r"(?:ngay\s+)?([0-3]?\d)\s*(?:/|-|thang\s+)(1[0-2]|0?\d)(?:\s*(?:/|-|nam\s+)?(19\d{2}|20\d{2}))?"
    part = lambda i: F.nullif(F.regexp_extract(n, pattern, i), F.lit("")).cast("int")
    return F.try_to_timestamp(F.format_string("%04d-%02d-%02d", F.coalesce(part(3), year), part(2), part(1)), F.lit("yyyy-MM-dd")).cast("date")


def time_range(n: Column) -> Column:
    """today, 24h, 7d or all."""
    return F.when(n.contains("hom nay"), "today").when(holds(n, ("24h", "24 gio")), "24h").when(holds(n, ("7 ngay", "tuan qua", "tuan nay", "gan day", "moi nhat")), "7d").otherwise("all")


def wants_images(n: Column) -> Column:
    """Whether pictures are asked for; what something brings about (anh huong) is none."""
    drawn = bounded(n, r"\d{1,2}\s+hinh") | bounded(n, r"(?:cho toi|xem|co|cac|nhung)\s+[^.?!]{0,30}hinh") | bounded(n, r"hinh\s+(?:ve|lien quan|nao)")
    return ~n.contains("anh huong") & (drawn | reduce(lambda a, k: a | bounded(n, T.quoted(k)), IMAGES, F.lit(False)))


def image_limit(n: Column) -> Column:
    """How many pictures are asked for, 1 to 12; 4 where no number stands by the word."""
    words = "(?:anh|hinh|hinh anh|photo|image|picture)"
    number = lambda p: F.nullif(F.regexp_extract(n, p, 1), F.lit("")).cast("int")
    found = F.coalesce(number(rf"(\d{{1,2}})\s*{words}"), number(rf"{words}\s*(\d{{1,2}})"))
    return F.coalesce(F.greatest(F.lit(1), F.least(F.lit(12), found)), F.lit(4))


def sports(n: Column) -> Column:
    """The kind of a question on fixtures, results or tables, else null."""
    return F.when(holds(n, SCHEDULE), "sports_schedule").when(holds(n, RESULT) & holds(n, SPORTS), "sports_result").when(holds(n, STANDING), "sports_standing")


def market_overview(n: Column) -> Column:
    """Whether a question is about the stock market as a whole."""
    return holds(n, OVERVIEW) | (holds(n, STOCK) & holds(n, PERIOD) & holds(n, ASKS_COURSE)) | (holds(n, STOCK) & holds(n, ("hom nay", "thi truong")))


def capitals(question: Column) -> Column:
    """Words of 2 to 8 capital letters."""
    return F.regexp_extract_all(question, F.lit(r"\b[A-Z]{2,8}\b"), 0)


def staged(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that later steps may use often: the explode of one element keeps the optimizer from repeating them."""
    made = df.select("*", F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))).alias("_stage"))
    return made.select(*df.columns, *(F.col(f"_stage.{name}").alias(name) for name in columns))


def route(questions: DataFrame, question: str, lexicon: Lexicon, year: Column | None = None, fallback: Column | None = None) -> DataFrame:
    """questions with the plan of each: intent, answer_mode, topic and how sure it is, entities, tickers, time, images, source.

    year: what a date without one means (default: this year). fallback: a topic for questions whose words give none. A null
    question is empty.
    """
    q = F.coalesce(F.col(question), F.lit(""))
    step = staged(questions, {"_q": q, "normalized_query": T.normalized(q)})
    n = F.col("normalized_query")
    pronoun = bounded(n, "ai") & ~F.col("_q").rlike(r"\bAI\b") & ~holds(n, AI_MARKERS)
    named = F.transform(classify.entities(n, list(lexicon.entities)), lambda e: e["name"]) if lexicon.entities else F.array().cast("array<string>")
    symbol_names = [name.upper() for kind, name, _, _ in lexicon.entities if kind == "stock_symbol"]
    symbols = F.filter(F.transform(named, F.upper), lambda s: s.isin(symbol_names)) if symbol_names else F.array().cast("array<string>")
    listed = F.transform(F.concat(symbols, capitals(F.col("_q"))), lambda s: F.when(s == "VN-INDEX", "VNINDEX").otherwise(s))
    media = F.array_compact(F.array(*(F.when(any_keyword(n, names), name) for name, names in lexicon.media.items())).cast("array<string>"))
    named = F.filter(named, lambda e: ~(F.col("_pronoun") & (T.normalized(e) == "ai")))
    step = staged(step.withColumn("_pronoun", pronoun), {"_named": F.concat(named, media), "stock_symbols": F.array_distinct(F.filter(listed, lambda s: s.isin(*lexicon.tickers))), "_date": exact_date(n, F.year(F.current_date()) if year is None else year)})
    # of names that fold alike the first counts
    folded = F.transform("_named", T.normalized)
    step = step.withColumn("entities", F.filter("_named", lambda e, i: (T.normalized(e) != "") & (F.array_position(folded, T.normalized(e)) == i + 1)))
    has_symbols = F.size("stock_symbols") > 0
    points, strong, matched = topic_scores(n, lexicon, has_symbols, F.col("entities"))
    order = [t for t in PRIORITY if t in points]
    ranked = F.array(*(F.struct((-points[t]).alias("neg"), F.lit(i).alias("priority"), F.lit(t).alias("topic"), strong[t].alias("strong"), matched[t].alias("matched")) for i, t in enumerate(order)))
    step = staged(step, {"_ranked": F.array_sort(ranked), "_sports": sports(n), "_overview": market_overview(n), "_stock_topic": holds(n, STOCK_TOPIC), "need_images": wants_images(n)})
    top = F.col("_ranked")[0]
    score, some = -top["neg"], (-top["neg"] >= 2) & ~((top["topic"] == TECH) & F.col("_pronoun"))
    explicit = some & ((top["strong"] > 0) | (score >= 4))
    confidence = F.when(~some, 0.0).when((top["strong"] > 0) | (score >= 5), 1.0).when(score >= 3, 0.7).otherwise(0.35)
    other = F.nullif(fallback, F.lit(classify.GENERAL[0])) if fallback is not None else F.lit(None).cast("string")
    topic = F.when(F.col("_overview") | F.col("_stock_topic"), FINANCE).when(F.col("_sports").isNotNull(), LIFE).when(has_symbols, FINANCE).otherwise(F.when(some, top["topic"]).otherwise(other))
    sure = F.col("_overview") | F.col("_stock_topic") | has_symbols
    sources = reduce(lambda a, kv: a.when(holds(n, kv[1]), kv[0]), lexicon.sources.items(), F.when(F.lit(False), F.lit(None).cast("string")))
    step = staged(step, {"primary_topic": topic, "source": sources, "time_range": F.when(F.col("_date").isNotNull(), "date").otherwise(time_range(n)), "topic_confidence": F.when(sure, 1.0).otherwise(confidence), "explicit_topic": sure | explicit})
    recent = F.col("time_range").isin("today", "24h", "7d") & holds(n, LATEST)
    some_entity = F.size("entities") > 0
    plain_intent = (
        F.when(F.col("need_images"), "media_lookup")
        .when(has_symbols, "entity_news")
        .when(recent, "latest_news")
        .when(F.col("primary_topic").isNotNull(), "topic_news")
        .when(some_entity, "entity_news")
        .otherwise("news_summary")
    )
    step = step.withColumn("intent", F.coalesce("_sports", F.when(F.col("_overview"), "stock_market_overview"), plain_intent))
    intent = F.col("intent")
    mode = (
        F.when(intent == "stock_market_overview", "synthesis")
        .when(holds(n, CITATION), "citation")
        .when(holds(n, FOLLOW_UP), "followup")
        .when(holds(n, SYNTHESIS) | ~intent.isin("entity_news", "article_summary", "article_qa"), "synthesis")
        .otherwise("citation")
    )
    domain = reduce(lambda a, kv: a.when(F.col("primary_topic") == kv[0], kv[1]), DOMAINS.items(), F.when(has_symbols, "tai_chinh")).otherwise("all")
    lexical = some_entity | has_symbols | (F.size(capitals(F.col("_q"))) > 0) | F.col("source").isNotNull() | (F.size(F.filter(F.split(n, " "), lambda w: w != "")) <= 5) | F.col("_q").rlike(r"(?U)\d")
    own = F.filter("_ranked", lambda r: r["topic"] == F.col("primary_topic"))
    return step.select(
        *questions.columns,
        "normalized_query",
        "intent",
        mode.alias("answer_mode"),
        "primary_topic",
        domain.alias("domain"),
        F.coalesce(F.try_element_at("stock_symbols", F.lit(1)), F.lit("")).alias("ticker"),
        "entities",
        "stock_symbols",
        lexical.alias("requires_lexical"),
        F.array_distinct(F.concat("stock_symbols", "entities", capitals(F.col("_q")))).alias("lexical_terms"),
        "time_range",
        F.col("_date").alias("start_date"),
        F.date_add("_date", 1).alias("end_date"),
        F.col("time_range").isin("today", "24h", "7d", "date").alias("needs_recent"),
        "need_images",
        F.when(F.col("need_images"), image_limit(n)).otherwise(0).alias("image_limit"),
        "source",
        holds(n, TIMELINE).alias("need_timeline"),
        F.when(F.col("_sports").isNotNull(), "structured_sports").otherwise("article_rag").alias("data_source"),
        "topic_confidence",
        F.when(F.col("topic_confidence") >= 1.0, "high").when(F.col("topic_confidence") >= 0.7, "medium").otherwise("low").alias("topic_confidence_label"),
        "explicit_topic",
        F.coalesce(F.try_element_at(F.transform(own, lambda r: r["matched"]), F.lit(1)), F.array().cast("array<string>")).alias("matched_keywords"),
        F.map_from_entries(F.transform("_ranked", lambda r: F.struct(r["topic"], -r["neg"]))).alias("topic_scores"),
    )


def candidate_count(top: Column, intent: Column, time_range: Column, n: Column) -> Column:
    """How many candidates to fetch for ``top`` results: ten times as many (50 at least), fifteen (80) where time matters."""
    top = F.greatest(F.lit(1), top)
    timely = intent.isin("latest_news", "stock_market_overview") | ((intent == "topic_news") & ~time_range.isin("", "all")) | (time_range == "date") | holds(n, ("hom nay", "moi nhat", "gan day", "hien nay", "24h qua"))
    return F.when(timely, F.greatest(top * 15, F.lit(80))).otherwise(F.greatest(top * 10, F.lit(50)))
