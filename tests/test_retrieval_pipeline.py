"""The whole way from candidates to results against a sequential model."""

import datetime
import math

from pyspark.sql import functions as F

from newsloom.operators import metadata, rerank

AS_OF = datetime.datetime(2024, 1, 13)


def rows():
    out = []
    for i in range(60):
        text = f"story {i} " + ("shares rise " if i % 3 == 0 else "") + ("gossip " if i % 11 == 0 else "") + ("Open-AI news " if i % 7 == 0 else "")
        out.append((i, f"title {i}", text, f"s{i % 4}", "en" if i % 2 else "de", ["en"] if i % 6 == 0 else [], ["Open AI"] if i % 5 == 0 else [], AS_OF - datetime.timedelta(hours=7 * i), i % 2 == 0, i % 9 / 9, float(i % 5), i % 8 / 8))
    return out


def words(text):
    return {w for w in text.lower().replace("-", " ").split() if len(w) >= 3}


def model(data, w, top):
    """Filter, guard, score and diversify one candidate after the other."""
    topic, age = w.question.topic, lambda r: AS_OF - r[7]
    fits_topic = lambda r: r[4] == topic or topic in r[5]
    named = lambda r: any(n.lower().replace(" ", "") == "openai" for n in r[6]) or "open ai" in (r[1] + " " + r[2]).lower() or "openai" in (r[1] + r[2]).lower()
    scoped = [r for r in data if fits_topic(r)]
    inside = scoped if len(scoped) >= w.least else data
    kept, step = [r for r in inside if fits_topic(r) and named(r) and age(r) <= datetime.timedelta(days=7)], "all"
    if not kept:
        kept, step = [r for r in inside if named(r)], "relaxed_entity_filter"
    guarded = [r for r in kept if "gossip" not in r[2] and (r[4] == topic or r[9] > 0.5 or "rise" in r[2])]
    kept = guarded or ([] if step == "all" else kept)
    kept.sort(key=lambda r: (-r[11], r[0]))
    seen, scored = {}, []
    asked = words(w.question.text)
    for r in kept:
        bounded = lambda x: x if x <= 1 else x / (1 + x)
        share = len(asked & words(r[1] + " " + r[2])) / len(asked)
        relevance = 0.35 * bounded(r[11]) + 0.30 * bounded(r[9]) + 0.25 * bounded(r[10]) + 0.10 * share
        match = 1.0 if r[4] == topic else 0.5 if topic in r[5] else 0.0
        entity = max(float("open ai" in [n.lower() for n in r[6]]), float("open ai" in (r[1] + " " + r[2]).lower()))
        loss = 0.0 if match else 0.9
        loss = min(loss, 0.15) if entity >= 0.75 else loss
        again = min(0.2, 0.05 * seen.get(r[3], 0))
        seen[r[3]] = seen.get(r[3], 0) + 1
        recent = math.exp(-age(r).total_seconds() / 86400 / w.question.days)
        scored.append((relevance * 0.40 + recent * 0.08 + entity * 0.08 + match * 0.44 + 0.7 * 0.05 - again - loss, r))
    scored.sort(key=lambda x: (-x[0], -x[1][11], x[1][0]))
    out, per_source = [], {}
    for score, r in scored:
        if per_source.get(r[3], 0) < max(2, top):
            per_source[r[3]] = per_source.get(r[3], 0) + 1
            out.append((r[0], step, round(score, 6)))
    return out[:top]


def test_retrieve(spark):
    schema = "article_id int, title string, text string, source string, primary_topic string, secondary_topics array<string>, entity_names array<string>, published_at timestamp_ntz, has_images boolean, vector_score double, bm25_score double, hybrid_score double"
    df = spark.createDataFrame(rows(), schema)
    for span, topic in (("7d", "de"), ("7d", "en"), ("today", "en")):
        w = metadata.Wanted(question=rerank.Question(text="shares rise today", intent="topic_news", topic=topic, explicit_topic=True, entities=("open ai",), days=5.0), time_range=span, signals={}, least=5)
        as_of = F.lit(AS_OF).cast("timestamp_ntz") if span != "today" else F.lit(AS_OF).cast("timestamp_ntz") + F.expr("interval 300 days")
        got = metadata.retrieve(df, w, as_of, [F.desc("hybrid_score"), F.col("article_id")], 6, F.col("text").contains("gossip"), F.col("text").contains("rise"), F.col("vector_score") > 0.5).collect()
        if span == "today":  # no candidate is that new: the ladder's next step
            assert {r.step for r in got} == {"relaxed_entity_filter"}
            continue
        assert [(r.article_id, r.step, round(r.final_score, 6)) for r in got] == model(rows(), w, 6)


def test_one_source_gets_no_other(spark):
    schema = "article_id int, title string, text string, source string, primary_topic string, secondary_topics array<string>, entity_names array<string>, published_at timestamp_ntz, has_images boolean, vector_score double, bm25_score double, hybrid_score double"
    df = spark.createDataFrame(rows(), schema)
    w = metadata.Wanted(source="nowhere")
    assert metadata.filtered(df, w, F.current_timestamp()).count() == 0


def test_names():
    assert metadata.expanded(("Hòa Phát",), {"hoaphat": ("hpg",)}) == ["hoa phat", "hoaphat", "hpg"]
