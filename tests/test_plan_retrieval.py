"""Retrieval for a table of plans, against the same steps taken question by question."""

import datetime
import math
import re

from pyspark.sql import functions as F
from test_retrieval_pipeline import AS_OF, rows, words

from newsloom.operators import metadata, plan_retrieval, rerank, router
from newsloom.plans.routing import ALSO, ASKED, LEXICON

SCHEMA = "article_id int, title string, text string, source string, primary_topic string, secondary_topics array<string>, entity_names array<string>, published_at timestamp_ntz, has_images boolean, vector_score double, bm25_score double, hybrid_score double"
TOPICS = list(router.PRIORITY)


def order():
    return [F.desc("hybrid_score"), F.col("article_id")]


def guard():
    return F.col("text").contains("gossip"), F.col("text").contains("rise"), F.col("vector_score") > 0.5


def articles():
    """Articles whose topics, names and texts fit the questions that the router knows."""
    out = []
    for i, r in enumerate(rows()):
        text = r[2] + ("HPG rose, chứng khoán " if i % 4 == 0 else "") + ("Ukraine " if i % 5 == 1 else "")
        out.append((r[0], r[1], text, ("vnexpress", "cafef", "genk", "s3")[i % 4], TOPICS[i % len(TOPICS)], [TOPICS[(i + 2) % len(TOPICS)]] if i % 3 == 0 else [], (["Hòa Phát"], ["AI"], ["Ukraine"], [], None)[i % 5], *r[7:]))
    return out


def plain(text):
    return metadata.plain(text or "")


def same_name(wanted, name):
    own = metadata.compact(wanted)
    if not name:
        return False
    if wanted == name or own and own == metadata.compact(name):
        return True
    if wanted == "ai":
        return name in ("ai", "openai") or name.endswith(" ai")
    return len(wanted) >= 3 and wanted in name or len(name) >= 3 and name in wanted


def model(data, p):
    """One question after the other, one candidate after the other."""
    topic, sure = p["topic"] or "", p["explicit_topic"] or p["topic_confidence"] >= 0.75
    body = lambda r: plain(r[1] + " " + r[2])
    age = lambda r: AS_OF - r[7]

    def on(r, strict):
        return not topic or r[4] == topic or topic in r[5] or strict and any(s in plain(r[1]) for s in metadata.SIGNALS.get(topic, ()))

    def named(r, relaxed=False):
        if not p["wanted"] or any(same_name(w, plain(n)) for n in r[6] or () for w in p["wanted"]):
            return True
        return any(len(w) >= 2 and w in body(r) for w in p["wanted"]) or relaxed and any(len(t) >= 3 and t in body(r) for t in p["terms"])

    def timely(r):
        if p["date"]:
            return p["date"] in (r[7].date(), (r[7] + datetime.timedelta(hours=7)).date())
        if p["time_range"] == "today":
            return r[7].date() == AS_OF.date()
        days = {"24h": 1, "7d": 7}.get(p["time_range"])
        return days is None or age(r) <= datetime.timedelta(days=days)

    source = lambda r: not p["source"] or r[3] == p["source"]
    image = lambda r: not p["need_images"] or p["intent"] == "media_lookup" or r[8]
    scoped = [r for r in data if not (sure and topic) or on(r, sure)]
    inside = scoped if len(scoped) >= max(1, p["least"]) else data
    steps = [[r for r in inside if on(r, sure) and named(r) and timely(r) and source(r) and image(r)]]
    if not p["source"]:
        steps.append([r for r in inside if source(r) and image(r) and named(r, True)])
        steps.append([r for r in inside if source(r) and image(r) and on(r, False) and named(r, True)])
        steps.append([r for r in data if named(r, True)])
        steps.append(sorted(inside, key=lambda r: (-r[11], r[0]))[:8])
    at = next((i for i, s in enumerate(steps) if s), -1)
    kept = steps[at] if at >= 0 else []
    filtered = len(kept)
    guarded = [r for r in kept if "gossip" not in r[2] and (topic in ("", "general_news", r[4]) or r[9] > 0.5 or "rise" in r[2])]
    step = plan_retrieval.STEPS[at]
    counts = (len(data), len(inside), filtered, len(guarded))
    if guarded:
        kept = guarded
    elif at <= 0:
        kept, step = (inside, "scoped_fallback") if not p["source"] and not sure else ([], step)
    kept = sorted(kept, key=lambda r: (-r[11], r[0]))
    seen, scored, asked = {}, [], {w for w in re.findall(r"\w+", plain(p["question"])) if len(w) >= 3}
    bounded = lambda x: x if x <= 1 else x / (1 + x)
    w = rerank.WEIGHTS.get(p["intent"], rerank.WEIGHTS["default"])
    for r in kept:
        b = body(r)
        found = {x for x in re.findall(r"\w+", b) if len(x) >= 3}
        share = len(asked & found) / len(asked) if asked else 0.0
        if topic == "economy_finance_stock":
            strong = sum(x in b for x in rerank.STRONG_FINANCE)
            share = max(share, min(1.0, strong * 0.24 + min(0.16, 0.04 * sum(x in b for x in rerank.WEAK_FINANCE))) if strong else 0.0)
        mix = (0.35, 0.25, 0.35, 0.05) if p["requires_lexical"] else (0.35, 0.30, 0.25, 0.10)
        relevance = bounded(r[11]) * mix[0] + bounded(r[9]) * mix[1] + bounded(r[10]) * mix[2] + min(1, share) * mix[3]
        match = (1.0 if r[4] == topic else 0.5 if topic in r[5] else 0.0) if topic else 0.0
        entity = 0.0
        if p["entities"]:
            n = len(p["entities"])
            entity = max(len(set(p["entities"]) & {plain(x) for x in r[6] or ()}) / n, sum(e in b for e in p["entities"]) / n)
        loss = 0.0 if match or not topic else 0.9 if p["explicit_topic"] else 0.8 if p["topic_confidence"] >= 0.75 else 0.45 if p["topic_confidence"] >= 0.35 else 0.25
        loss = min(loss, 0.15) if entity >= 0.75 else loss
        quality = 0.0
        if p["intent"] == "stock_market_overview":
            quality = max(0.0, min(1.0, sum(x in b for x in rerank.OVERVIEW) / 4) - (0.25 if any(x in b for x in rerank.SINGLE_SHARE) else 0))
        again = min(0.2, 0.05 * seen.get(r[3], 0))
        seen[r[3]] = seen.get(r[3], 0) + 1
        recent = min(1.0, math.exp(-age(r).total_seconds() / 86400 / p["half_life"]))
        final = relevance * w[0] + recent * w[1] + entity * w[2] + match * w[3] + quality * w[4] + rerank.SOURCES.get(r[3], 0.7) * 0.05 + (0.05 if p["need_images"] and r[8] else 0) - again - loss
        scored.append((round(final, 9), r))
    scored.sort(key=lambda x: (-x[0], -x[1][11], x[1][0]))
    return [(r[0], step, counts, s) for s, r in scored[: p["top"]]]


def test_a_thousand_routed_questions_in_one_job(spark):
    asked = [(i, ASKED[i % len(ASKED)] + (" " + ALSO[i // len(ASKED) % len(ALSO)] if i % 7 < 4 else "")) for i in range(1000)]
    routed = router.route(spark.createDataFrame(asked, "qid int, question string"), "question", LEXICON, year=F.lit(2024))
    aliases = spark.createDataFrame([("HPG", "Hòa Phát"), ("hoaphat", "tập đoàn hòa phát"), ("nobody", "no one")], "name string, alias string")
    plans = plan_retrieval.from_routes(routed, "qid", "question", top=5, aliases=aliases)
    data = articles()
    base = {"question": "rise", "intent": "topic_news", "explicit_topic": False, "topic_confidence": 0.3, "entities": [], "wanted": [], "terms": [], "source": None, "time_range": "all", "date": None, "need_images": False, "requires_lexical": False, "half_life": 3.0, "least": 3, "top": 5}
    beside = [
        base | {"qid": 1000, "topic": TOPICS[0], "explicit_topic": True, "wanted": ["title 59"]},  # only outside of the sure topic
        base | {"qid": 1001, "topic": TOPICS[11 % len(TOPICS)], "wanted": ["title 11"]},  # only what the guard denies, topic unsure
        base | {"qid": 1002, "topic": TOPICS[11 % len(TOPICS)], "wanted": ["title 11"], "source": "s3"},  # the same for one source
        base | {"qid": 1003, "topic": "general_news", "terms": ["story 4"], "wanted": ["nowhere"]},
    ]
    plans = plans.unionByName(spark.createDataFrame([tuple(b[c] for c in plans.columns) for b in beside], plans.schema)).cache()
    every = spark.createDataFrame(data, SCHEMA)
    # as the index would give them: of each question's candidates some are missing
    candidates = every.crossJoin(spark.range(1004).select(F.col("id").cast("int").alias("qid"))).where("pmod(article_id * 7 + qid, 10) < 6 or qid >= 1000")
    found = plan_retrieval.retrieve(candidates, plans, "qid", F.lit(AS_OF).cast("timestamp_ntz"), order(), *guard())
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.qid, r["rank"])):
        got.setdefault(r.qid, []).append((r.article_id, r.step, tuple(r.counts), round(r.final_score, 9)))
    steps = set()
    for p in map(lambda r: r.asDict(), plans.collect()):
        want = model([r for r in data if (r[0] * 7 + p["qid"]) % 10 < 6 or p["qid"] >= 1000], p)
        mine = got.pop(p["qid"], [])
        assert [m[:3] for m in mine] == [w[:3] for w in want], p
        assert all(abs(m[3] - w[3]) < 1e-8 for m, w in zip(mine, want, strict=True)), p
        steps |= {w[1] for w in want}
    assert not got
    # the ladder's third step asks more than its second, so it never comes to it
    assert steps == set(plan_retrieval.STEPS) - {"relaxed_time_filter"}
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in text and "CartesianProduct" not in text


def test_equals_one_question_at_a_time(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    for topic in ("de", "en"):
        w = metadata.Wanted(question=rerank.Question(text="shares rise today", intent="topic_news", topic=topic, explicit_topic=True, entities=("open ai",), days=5.0), time_range="7d", signals={}, least=5)
        one = metadata.retrieve(df, w, as_of, order(), 6, *guard()).collect()
        plan = spark.createDataFrame([(1, "shares rise today", "topic_news", topic, True, ["open ai"], 5.0, "7d", 5, 6)], "q int, question string, intent string, topic string, explicit_topic boolean, entities array<string>, half_life double, time_range string, least int, top int")
        many = plan_retrieval.retrieve(df.withColumn("q", F.lit(1)), plan, "q", as_of, order(), *guard()).orderBy("rank").collect()
        assert [(r.article_id, r.step, round(r.final_score, 9)) for r in one] == [(r.article_id, r.step, round(r.final_score, 9)) for r in many]


def test_null_plans_and_empty_tables(spark):
    df = spark.createDataFrame(rows()[:8], SCHEMA).withColumns({"q": F.lit(1), "rank_": F.lit("x"), "question": F.lit("clash"), "top": F.lit("clash")})
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    plan = spark.createDataFrame([(1, None, None), (None, "x", "y"), (2, "no candidates", "")], "q int, question string, topic string")
    got = plan_retrieval.retrieve(df, plan, "q", as_of, order(), F.lit(None).cast("boolean"), F.lit(False), F.lit(False)).collect()
    assert len(got) == 8 and {r.step for r in got} == {"all"} and {r.top for r in got} == {"clash"}
    assert plan_retrieval.retrieve(df.limit(0), plan, "q", as_of, order(), *guard()).count() == 0
    assert plan_retrieval.retrieve(df, plan.limit(0), "q", as_of, order(), *guard()).count() == 0
    nulls = df.select(*(F.lit(None).cast(t).alias(c) if c not in ("q", "article_id", "hybrid_score") else F.col(c) for c, t in df.dtypes))
    assert plan_retrieval.retrieve(nulls, plan, "q", as_of, order(), *guard()).count() == 8
    assert words("a bc def") == {"def"}
