"""Routing of questions, and retrieval for one of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import router as R
from newsloom.plans.registry import query
from newsloom.plans.texts import FOLD
from newsloom.sources.views import table

#: Questions that between them take every way through the router; they are dealt over the turns of conversations.
ASKED = (
    "Chứng khoán hôm nay thế nào", "Tin AI mới nhất", "ai nói gì về Ukraine", "Cho tôi 5 ảnh về Gaza", "Lịch thi đấu bóng đá hôm nay", "Kết quả bóng đá Champions League", "bảng xếp hạng V-League", "HPG và FPT tăng trần",
    "tin tức vnexpress ngày 5/3/2024", "giá căn hộ chung cư và lãi suất", "công an điều tra vụ án", "diễn biến usd 7 ngày", "startup gọi vốn cùng VCCI", "trường học tuyển sinh ở Israel", "vụ này ra sao", "số liệu lạm phát 24h qua",
    "ngày 31 tháng 2", "image 20 của iPhone", "", "ứng dụng zalo và an ninh mạng", "anh hưởng của bão", "xem những hình đẹp", "doanh nghiệp niêm yết", "một câu hỏi dài không nói về điều gì cả",
)
ALSO = ("theo thời gian", "cafe f", "OpenAI ra mắt", "tuần này", "12 ảnh")
LEXICON = R.Lexicon(
    topics={
        R.TECH: (("ai", "cong nghe", "zalo", "openai"), ("otp",), ("xe dien",)),
        R.FINANCE: (("chung khoan", "lai suat", "usd", "vn-index", "lam phat"), ("loi nhuan",), ("thi truong",)),
        R.POLITICS: (("cong an", "dieu tra", "vu an"), ("dia phuong",), ()),
        R.WORLD: (("ukraine", "israel", "gaza"), (), ()),
        R.BUSINESS: (("startup", "goi von", "doanh nghiep"), ("nha may",), ()),
        R.PROPERTY: (("chung cu", "can ho"), ("xay dung",), ("du an",)),
        R.LIFE: (("truong hoc", "tuyen sinh", "bong da"), ("van hoa",), ("champions league",)),
    },
    entities=(("organization", "VCCI", ("VCCI",), 0.9), ("product", "AI", ("AI",), 0.8), ("stock_symbol", "HPG", ("HPG", "Hòa Phát"), 0.9), ("country", "Ukraine", ("Ukraine",), 0.9)),
)


def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _holds(phrases) -> str:
    return "(" + " OR ".join(f"contains(n, '{p}')" for p in phrases) + ")"


def _bounded(pattern: str) -> str:
    return f"regexp_matches(' ' || n || ' ', '[^\\pL\\pN_](?:{pattern})[^\\pL\\pN_]')"


def _keyword(word: str) -> str:
    if word in R.GENERIC:
        return "false"
    return _bounded(word) if word.replace("_", "").isalnum() else f"contains(n, '{word}')"


def _any(words) -> str:
    return "(" + " OR ".join(map(_keyword, words)) + ")"


def _points(topic: str) -> str:
    hits = [(w, p + (" " in w)) for words, p in zip(LEXICON.topics[topic], (3, 2, 1), strict=True) for w in words]
    out = " + ".join(f"(CASE WHEN {_keyword(w)} THEN {p} ELSE 0 END)" for w, p in hits)
    if topic == R.FINANCE:
        out = f"{out} + 2 * has_symbol"
        out = f"({out}) + (CASE WHEN {_any(R.STOCK_CLASH)} THEN 2 ELSE 0 END) + (CASE WHEN {_any(LEXICON.topics[R.PROPERTY][0])} AND {_any(R.LOANS)} THEN 3 ELSE 0 END) + (CASE WHEN {_any(R.ABROAD)} THEN 2 ELSE 0 END)"
    if topic == R.BUSINESS:
        out = f"({out} + (CASE WHEN {_bounded('vcci')} THEN 2 ELSE 0 END))"
        out = f"(CASE WHEN {_any(R.STOCK_CLASH)} THEN greatest(0, {out} - 3) ELSE {out} END)"
    if topic == R.POLITICS:
        for condition, less in ((_any(LEXICON.topics[R.FINANCE][0]), 3), (f"{_any(LEXICON.topics[R.PROPERTY][0])} AND NOT {_any(R.CREDIT)}", 3), (f"{_any(LEXICON.topics[R.TECH][0])} AND {_any(R.ONLINE)}", 2)):
            out = f"(CASE WHEN {condition} THEN greatest(0, {out} - {less}) ELSE {out} END)"
    return out


def _strong(topic: str) -> str:
    return f"{_any(LEXICON.topics[topic][0])}" + (" OR has_symbol > 0" if topic == R.FINANCE else "")


QUESTIONS = f"SELECT conv_id, turn, {_list(ASKED)}[(conv_id * 3 + turn) % {len(ASKED)} + 1] || CASE WHEN turn % 2 = 1 THEN ' ' || {_list(ALSO)}[(conv_id + turn) % {len(ALSO)} + 1] ELSE '' END AS question FROM conversations"
_WORDS = "(?:anh|hinh|hinh anh|photo|image|picture)"
_DATE = "(?:ngay\\s+)?([0-3]?\\d)\\s*(?:/|-|thang\\s+)(1[0-2]|0?\\d)(?:\\s*(?:/|-|nam\\s+)?(19\\d{2}|20\\d{2}))?"
_MEDIA = "list_filter([" + ", ".join(f"CASE WHEN {_any(names)} THEN '{name}' END" for name, names in R.MEDIA.items()) + "], lambda x: x IS NOT NULL)"
_NAMED = f"""list_filter([CASE WHEN {_bounded('ukraine')} THEN 'Ukraine' END, CASE WHEN {_bounded('vcci')} THEN 'VCCI' END, CASE WHEN {_bounded('ai')} AND NOT pronoun THEN 'AI' END, CASE WHEN {_bounded('hpg|hoa phat')} THEN 'HPG' END], lambda x: x IS NOT NULL)"""


@query(
    f"""WITH q AS ({QUESTIONS}), a AS (SELECT *, trim(regexp_replace({FOLD.format('question')}, '\\s+', ' ', 'g')) AS n FROM q),
 b AS (SELECT *, {_bounded('ai')} AND NOT regexp_matches(question, '(^|[^A-Za-z0-9_])AI([^A-Za-z0-9_]|$)') AND NOT {_holds(R.AI_MARKERS)} AS pronoun, regexp_extract_all(question, '\\b[A-Z]{{2,8}}\\b') AS caps FROM a),
 c AS (SELECT *, list_concat({_NAMED}, {_MEDIA}) AS entities, list_filter(list_concat(CASE WHEN {_bounded('hpg|hoa phat')} THEN ['HPG'] ELSE [] END, caps), lambda s: s IN {tuple(R.TICKERS)}) AS listed, try_cast(CASE WHEN regexp_matches(n, '{_DATE}') THEN printf('%04d-%02d-%02d', coalesce(nullif(regexp_extract(n, '{_DATE}', 3), '')::INT, 2024), regexp_extract(n, '{_DATE}', 2)::INT, regexp_extract(n, '{_DATE}', 1)::INT) END AS DATE) AS day FROM b),
 d AS (SELECT *, list_filter(listed, lambda s, i: list_position(listed, s) = i) AS symbols_, CASE WHEN len(listed) > 0 THEN 1 ELSE 0 END AS has_symbol FROM c),
 e AS (SELECT *, [{', '.join(f"{{'s': CAST({_points(t)} AS INT), 'p': {-i}, 't': '{t}', 'h': ({_strong(t)})}}" for i, t in enumerate(R.PRIORITY))}] AS scored,
  CASE WHEN {_holds(R.SCHEDULE)} THEN 'sports_schedule' WHEN {_holds(R.RESULT)} AND {_holds(R.SPORTS)} THEN 'sports_result' WHEN {_holds(R.STANDING)} THEN 'sports_standing' END AS sport,
  {_holds(R.OVERVIEW)} OR ({_holds(R.STOCK)} AND {_holds(R.PERIOD)} AND {_holds(R.ASKS_COURSE)}) OR ({_holds(R.STOCK)} AND {_holds(('hom nay', 'thi truong'))}) AS overview, {_holds(R.STOCK_TOPIC)} AS stock_topic,
  NOT contains(n, 'anh huong') AND ({_bounded('[0-9]{1,2} +hinh')} OR {_bounded('(?:cho toi|xem|co|cac|nhung) +[^.?!]{0,30}hinh')} OR {_bounded('hinh +(?:ve|lien quan|nao)')} OR {' OR '.join(_bounded(w) for w in R.IMAGES)}) AS need_images FROM d),
 f AS (SELECT *, list_sort(scored, 'DESC')[1] AS top FROM e), g AS (SELECT *, top.s >= 2 AND NOT (top.t = '{R.TECH}' AND pronoun) AS has_topic, overview OR stock_topic OR has_symbol > 0 AS sure FROM f),
 h AS (SELECT *, CASE WHEN overview OR stock_topic THEN '{R.FINANCE}' WHEN sport IS NOT NULL THEN '{R.LIFE}' WHEN has_symbol > 0 THEN '{R.FINANCE}' WHEN has_topic THEN top.t END AS primary_topic,
  CASE {' '.join(f"WHEN {_holds(names)} THEN '{s}'" for s, names in R.SOURCES.items())} END AS source,
  CASE WHEN day IS NOT NULL THEN 'date' WHEN contains(n, 'hom nay') THEN 'today' WHEN {_holds(('24h', '24 gio'))} THEN '24h' WHEN {_holds(('7 ngay', 'tuan qua', 'tuan nay', 'gan day', 'moi nhat'))} THEN '7d' ELSE 'all' END AS time_range FROM g),
 i AS (SELECT *, coalesce(sport, CASE WHEN overview THEN 'stock_market_overview' END, CASE WHEN need_images THEN 'media_lookup' WHEN has_symbol > 0 THEN 'entity_news' WHEN time_range IN ('today', '24h', '7d') AND {_holds(R.LATEST)} THEN 'latest_news' WHEN primary_topic IS NOT NULL THEN 'topic_news' WHEN len(entities) > 0 THEN 'entity_news' ELSE 'news_summary' END) AS intent FROM h)
 SELECT conv_id, turn, n AS normalized_query, intent, CASE WHEN intent = 'stock_market_overview' THEN 'synthesis' WHEN {_holds(R.CITATION)} THEN 'citation' WHEN {_holds(R.FOLLOW_UP)} THEN 'followup' WHEN {_holds(R.SYNTHESIS)} OR intent NOT IN ('entity_news', 'article_summary', 'article_qa') THEN 'synthesis' ELSE 'citation' END AS answer_mode,
  primary_topic, CASE WHEN has_symbol > 0 THEN 'tai_chinh' {' '.join(f"WHEN primary_topic = '{t}' THEN '{d}'" for t, d in R.DOMAINS.items())} ELSE 'all' END AS domain, coalesce(symbols_[1], '') AS ticker, array_to_string(symbols_, ',') AS symbols,
  len(entities) > 0 OR has_symbol > 0 OR len(caps) > 0 OR source IS NOT NULL OR len(list_filter(string_split(n, ' '), lambda w: w <> '')) <= 5 OR regexp_matches(question, '[0-9]') AS requires_lexical,
  array_to_string(list_sort(entities), ',') AS names, time_range, CAST(day AS VARCHAR) AS start_date, CAST(day + 1 AS VARCHAR) AS end_date, time_range <> 'all' AS needs_recent, need_images,
  CASE WHEN need_images THEN coalesce(greatest(1, least(12, coalesce(nullif(regexp_extract(n, '([0-9]{{1,2}})\\s*{_WORDS}', 1), '')::INT, nullif(regexp_extract(n, '{_WORDS}\\s*([0-9]{{1,2}})', 1), '')::INT))), 4) ELSE 0 END AS image_limit, source, {_holds(R.TIMELINE)} AS need_timeline,
  CASE WHEN sport IS NOT NULL THEN 'structured_sports' ELSE 'article_rag' END AS data_source, CASE WHEN sure THEN 1.0 WHEN NOT has_topic THEN 0.0 WHEN top.h OR top.s >= 5 THEN 1.0 WHEN top.s >= 3 THEN 0.7 ELSE 0.35 END::DOUBLE AS topic_confidence, sure OR (has_topic AND (top.h OR top.s >= 4)) AS explicit_topic, top.s AS top_score FROM i"""
)
def routed_questions(spark, sf_dir):
    """Plans of questions (R-06, R-07, R-08, X-11, X-46, X-73, J-14): every branch of topic, intent, time, image, source and sports."""
    found = R.route(questions(spark, sf_dir), "question", LEXICON, year=F.lit(2024))
    return found.select(
        "conv_id", "turn", "normalized_query", "intent", "answer_mode", "primary_topic", "domain", "ticker", F.array_join("stock_symbols", ",").alias("symbols"), "requires_lexical", F.array_join(F.array_sort("entities"), ",").alias("names"), "time_range", F.col("start_date").cast("string").alias("start_date"), F.col("end_date").cast("string").alias("end_date"),
        "needs_recent", "need_images", "image_limit", "source", "need_timeline", "data_source", "topic_confidence", "explicit_topic", F.array_max(F.map_values("topic_scores")).alias("top_score"),
    )


def questions(spark, sf_dir):
    """conv_id, turn, question: a question of the list, and to every second one more words."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    one = F.element_at(F.array(*map(F.lit, ASKED)), (F.pmod(F.col("conv_id") * 3 + F.col("turn"), F.lit(len(ASKED))) + 1).cast("int"))
    two = F.element_at(F.array(*map(F.lit, ALSO)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(ALSO))) + 1).cast("int"))
    return c.withColumn("question", F.when(F.col("turn") % 2 == 1, F.concat(one, F.lit(" "), two)).otherwise(one))


@query(
    f"""WITH q AS ({QUESTIONS}), r AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'latest_news' WHEN 1 THEN 'topic_news' ELSE 'entity_news' END AS intent, CASE turn % 3 WHEN 0 THEN 'all' WHEN 1 THEN '7d' ELSE 'date' END AS time_range, trim(regexp_replace({FOLD.format('question')}, '\\s+', ' ', 'g')) AS n FROM q)
 SELECT conv_id, turn, CAST(CASE WHEN intent = 'latest_news' OR (intent = 'topic_news' AND time_range <> 'all') OR time_range = 'date' OR {_holds(('hom nay', 'moi nhat', 'gan day', 'hien nay', '24h qua'))} THEN greatest(conv_id % 12 * 15, 15, 80) ELSE greatest(conv_id % 12 * 10, 10, 50) END AS BIGINT) AS candidates FROM r"""
)
def candidate_counts(spark, sf_dir):
    """How many candidates a question fetches (O-15)."""
    from newsloom.functions.text import normalized

    intent = F.when(F.col("conv_id") % 4 == 0, "latest_news").when(F.col("conv_id") % 4 == 1, "topic_news").otherwise("entity_news")
    span = F.when(F.col("turn") % 3 == 0, "all").when(F.col("turn") % 3 == 1, "7d").otherwise("date")
    return questions(spark, sf_dir).select("conv_id", "turn", R.candidate_count(F.col("conv_id") % 12, intent, span, normalized(F.col("question"))).alias("candidates"))


_CANDIDATES = f"""art AS (SELECT doc_id AS article_id, source, lang AS category, text AS content, split_part(text, chr(10), 1) AS title, TIMESTAMP '2024-01-01' + to_hours(doc_id) AS published_at FROM documents),
 cand AS (SELECT article_id, source, category, title, content, published_at, (article_id % 97) / 97.0::DOUBLE AS v, (article_id % 13)::DOUBLE AS b, (article_id % 29) / 29.0::DOUBLE AS h, CASE article_id % 5 WHEN 0 THEN ['The Ents', 'Open AI'] WHEN 1 THEN ['Der-Ung'] ELSE [] END AS names,
 {FOLD.format("title || ' ' || text")} AS body, {FOLD.format('title')} AS head FROM (SELECT *, content AS text FROM art))"""


def candidates(spark, sf_dir):
    """The candidates of ranking, with names of entities."""
    from newsloom.plans import ranking

    i = F.col("article_id")
    names = F.when(i % 5 == 0, F.array(F.lit("The Ents"), F.lit("Open AI"))).when(i % 5 == 1, F.array(F.lit("Der-Ung"))).otherwise(F.array().cast("array<string>"))
    return ranking.candidates(spark, sf_dir).withColumn("entity_names", names)


@query(
    f"""WITH {_CANDIDATES}, m AS (SELECT article_id, least(0.15, ((CASE WHEN contains(body, 'ation') THEN 1 ELSE 0 END) + (CASE WHEN contains(body, 'der') THEN 1 ELSE 0 END)) / 2.0 * 0.15) AS exact, least(0.15, ((CASE WHEN contains(head || ' ' || lower(array_to_string(names, ',')), 'open ai') THEN 1 ELSE 0 END) + (CASE WHEN contains(head || ' ' || lower(array_to_string(names, ',')), 'the') THEN 1 ELSE 0 END)) / 2.0 * 0.15) AS entity,
  CASE WHEN lower(source) IN ('src1', 'src4') THEN 0.08 ELSE 0.0 END AS preferred, CASE WHEN article_id % 2 = 0 THEN 0.1 ELSE 0.0 END AS image FROM cand) SELECT article_id, round(exact + entity + preferred + image, 9) AS bonus FROM m"""
)
def hybrid_bonuses(spark, sf_dir):
    """What a hybrid score gains by words, entities, source and images (X-54)."""
    from newsloom.operators import retrieval as V

    bonus = V.exact_bonus("ation der", F.col("text"), F.col("title")) + V.entity_bonus(("Open AI", "thé"), F.col("title"), F.col("entity_names")) + V.source_bonus(("SRC1", "src4"), F.col("source")) + V.image_bonus(True, F.col("has_images"))
    return candidates(spark, sf_dir).select("article_id", F.round(bonus, 9).alias("bonus"))


def _hits(field: str, words) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains({field}, '{w}') THEN 1 ELSE 0 END)" for w in words) + ")"


_STRONG, _WEAK, _OVER, _SINGLE, _BY = ("ation", "chaft", "ment"), ("the", "der", "les", "la", "un"), ("tion", "ing", "ver", "ent", "que"), ("schl", "blen"), ("wh", "zz")


@query(
    f"""WITH {_CANDIDATES} SELECT article_id, CASE WHEN {_hits('body', _STRONG)} = 0 THEN 0.0 ELSE round(least(1.0, {_hits('body', _STRONG)} * 0.24 + least(0.16, {_hits('body', _WEAK)} * 0.04)), 9) END AS finance,
 round(greatest(0.0, least(1.0, {_hits('body', _OVER)} / 4) - CASE WHEN {_hits('body', _SINGLE)} > 0 THEN 0.25 ELSE 0 END), 9) AS overview, CASE WHEN {_hits('body', _BY)} > 0 THEN 0.3 ELSE 0.0 END AS peripheral,
 round(v * 0.55 + 0.3 * regexp_matches(' ' || {FOLD.format('content')} || ' ', '[^\\pL\\pN_]the[^\\pL\\pN_]')::INT + 0.15 * regexp_matches(' ' || head || ' ', '[^\\pL\\pN_]the[^\\pL\\pN_]')::INT, 9) AS in_article FROM cand"""
)
def topical_scores(spark, sf_dir):
    """Finance words, market overviews, articles on one share, mentions by the way, and chunks within an article (X-60, X-61, X-64)."""
    from newsloom.functions import text as T
    from newsloom.operators import rerank as K

    body = T.folded(F.concat_ws(" ", "title", "text"))
    return candidates(spark, sf_dir).select(
        "article_id",
        F.round(K.finance_score("economy_finance_stock", body, _STRONG, _WEAK), 9).alias("finance"),
        F.round(K.overview_quality("stock_market_overview", body, _OVER, _SINGLE), 9).alias("overview"),
        K.peripheral_penalty("ask about bank", ("bank",), body, "bank", ("transfer",), _BY).alias("peripheral"),
        F.round(K.chunk_score("the", F.col("vector_score"), F.col("text"), F.col("title")), 9).alias("in_article"),
    )


_NAME = "(list_contains(list_transform(names, lambda x: lower(x)), 'open ai') OR list_contains(list_transform(names, lambda x: regexp_replace(lower(x), '[^a-z0-9]', '', 'g')), 'openai') OR len(list_filter(names, lambda x: contains(lower(x), 'open ai') OR contains(lower(x), 'openai') OR contains('open ai', lower(x)) OR contains('openai', lower(x)))) > 0 OR contains(body, 'open ai') OR contains(body, 'openai'))"
_RELAXED = f"({_NAME} OR contains(body, 'schaftl'))"


def _ladder(topic: str, strict: str, time: str, source: str = "true") -> str:
    return f"""s AS (SELECT *, count(*) FILTER (WHERE {strict}) OVER () >= 5 AS scoped FROM cand), i AS (SELECT *, NOT scoped OR {strict} AS inside FROM s),
 m AS (SELECT *, inside AND {strict} AND {_NAME} AND {time} AND {source} AS ma, inside AND {_RELAXED} AND {source} AS mb, inside AND {topic} AND {_RELAXED} AND {source} AS mc, {_RELAXED} AND {source} AS md FROM i),
 f AS (SELECT bool_or(ma) AS fa, bool_or(mb) AS fb, bool_or(mc) AS fc, bool_or(md) AS fd FROM m),
 l AS (SELECT m.*, CASE WHEN fa THEN 'all' WHEN fb THEN 'relaxed_entity_filter' WHEN fc THEN 'relaxed_time_filter' WHEN fd THEN 'entity_over_topic_fallback' ELSE 'pre_filter_topk_fallback' END AS step FROM m, f WHERE CASE WHEN fa THEN ma WHEN fb THEN mb WHEN fc THEN mc WHEN fd THEN md ELSE inside END)"""


_TOPIC = "(category = 'de' OR (article_id % 4 = 0 AND 'de' = 'en'))"
_STRICT = f"({_TOPIC} OR contains(head, 'schaft') OR contains(head, 'ering'))"


def _wanted(**more):
    from newsloom.operators import metadata, rerank

    q = rerank.Question(text="the", intent="topic_news", topic="de", explicit_topic=True, entities=("open ai",), days=5.0)
    return metadata.Wanted(**{"question": q, "lexical_terms": ("schaftl",), "signals": {"de": ("schaft", "ering")}, "least": 5} | more)


@query(f"WITH {_CANDIDATES}, {_ladder(_TOPIC, _STRICT, '''published_at >= TIMESTAMP '2024-01-06' ''')} SELECT article_id, scoped, step FROM l")
def metadata_filter(spark, sf_dir):
    """Candidates by topic, entity, time and source, with the fallbacks (F-05, F-06, F-07, F-08, F-09, F-10, F-15, F-16)."""
    from newsloom.operators import metadata

    return metadata.filtered(candidates(spark, sf_dir), _wanted(time_range="7d"), F.expr("timestamp_ntz '2024-01-13'")).select("article_id", "scoped", "step")


@query(f"WITH {_CANDIDATES}, {_ladder(_TOPIC, _STRICT, '''published_at > TIMESTAMP '2100-01-01' ''')} SELECT article_id, scoped, step FROM l")
def metadata_fallback(spark, sf_dir):
    """The same for a time that no candidate has (F-16)."""
    from newsloom.operators import metadata

    return metadata.filtered(candidates(spark, sf_dir), _wanted(time_range="24h"), F.expr("timestamp_ntz '2100-01-02'")).select("article_id", "scoped", "step")


@query()
def retrieved(spark, sf_dir):
    """From candidates to results: scope, filter, guard, rerank, diversify (R-05, F-17, O-10); tested against a sequential model."""
    from newsloom.operators import metadata

    text = F.lower("text")
    found = metadata.retrieve(candidates(spark, sf_dir), _wanted(time_range="7d"), F.expr("timestamp_ntz '2024-01-13'"), [F.desc("hybrid_score"), F.col("article_id")], 10, text.contains("worthless"), text.contains("ation"), F.col("vector_score") > 0.5)
    return found.select("article_id", "step", F.round("final_score", 6).alias("final_score"))
