"""Lexicons as tables against regular expressions and against the expressions of the built-in lexicon; the JSON walk against a plain one."""

import json
import re

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import classify, lexicon
from newsloom.operators import records as R

TEXTS = ["Mỹ và Hoa Kỳ; USA usa, usa's Usa_ 2USA", "ha ha ha ha-ha", "TP.HCM TP HCM tphcm TPHCM.", "", None, "new york's new-york New  York\nnew york", "đồng Đồng dong²", "x" * 50000 + " nato"]
PHRASES = [("c", "Hoa Kỳ", "Mỹ"), ("c", "Hoa Kỳ", "Hoa Kỳ"), ("c", "Hoa Kỳ", "USA"), ("h", "Ha", "ha ha"), ("l", "HCM", "TP.HCM"), ("l", "HCM", "tp hcm"), ("n", "NY", "new york"), ("n", "NY", "new york's"), ("d", "Dong", "đồng"), ("o", "NATO", "NATO"), ("e", "Empty", ""), ("e", "Null", None)]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "id long, text string, n int").repartition(3)


@pytest.mark.parametrize("most", [1000, 3])
def test_mentions(spark, texts, most):
    phrases = spark.createDataFrame(PHRASES, "type string, name string, phrase string")
    got = sorted((r.id, r.type, r.phrase, r.n) for r in lexicon.mentions(texts.select("id", "text"), "id", T.normalized(F.col("text")), phrases, most=most).collect())
    folded = {r.id: r.t for r in texts.select("id", T.normalized(F.col("text")).alias("t")).collect()}
    want = []
    for i in folded:
        for kind, _, phrase in PHRASES:
            n = len(re.findall(rf"(?<!\w){re.escape(classify.plain(phrase))}(?!\w)", folded[i].replace("²", " "))) if phrase else 0
            want += [(i, kind, phrase, n)] * (n > 0)
    assert got == sorted(want)


def test_entities_equal_the_expressions(spark, texts):
    rows = [(kind, name, alias, confidence) for kind, name, aliases, confidence in classify.ENTITIES for alias in aliases]
    table = spark.createDataFrame(rows, "type string, name string, alias string, confidence double")
    got = sorted(tuple(r) for r in lexicon.entities(texts, "id", "text", table).select("id", "type", "name", "mentions", "confidence").collect())
    one = texts.select("id", F.explode(classify.entities(T.normalized(F.col("text")))).alias("e")).select("id", "e.*")
    # the expressions know each alias once; two spellings that fold alike count twice in both
    assert got == sorted(tuple(r) for r in one.collect())


def test_topics_equal_the_expressions(spark):
    titles = ["Chứng khoán, cổ phiếu AI", "AI-chip", "ai", "trai", "Quốc hội bàn chính sách đầu tư", "Tuyển sinh", "", None, "m&a CEO doanh nghiệp du an", "Nga, Mỹ: chiến tranh", "kinh te the thao"]
    rows = [(i, ["The thao", "kinh doanh", None, "real"][i % 4], t, titles[-i], (t or "") + " " + (titles[i - 3] or "")) for i, t in enumerate(titles)]
    df = spark.createDataFrame(rows, "id long, category string, title string, summary string, content string")
    keywords = spark.createDataFrame([(t, i, w) for i, (t, (_, words)) in enumerate(classify.TOPICS.items()) for w in words], "topic string, place int, keyword string")
    aliases, locks = [("kinh", "business_startup"), ("the thao", "world_geopolitics")], [("real", "real_estate")]
    table = lambda pairs: spark.createDataFrame([(a, i, t) for i, (a, t) in enumerate(pairs)], "alias string, place int, topic string")
    got = lexicon.topics(df, "category", "title", "summary", "content", keywords, table(aliases), table(locks))
    want = classify.topics(df, "category", "title", "summary", "content", aliases=aliases, locks=locks)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def walked(value):
    if isinstance(value, str):
        return [value] if value.strip() else []
    if isinstance(value, list):
        return [x for v in value for x in walked(v)]
    return [x for k in ("image", "imageUrl", "thumbnailUrl", "url", "contentUrl") if k in value for x in walked(value[k])] if isinstance(value, dict) else []


def test_images_in_json(spark):
    given = [
        '{"image": ["a", "b"]}', '[{"url": "a"}, {"url": "b"}, "c", 4, null, true]', '{"image": {"url": {"contentUrl": ["x", {"image": "y"}]}}, "imageUrl": "z", "other": {"image": "no"}}',
        '{"image": "first", "image": "last"}', '{"image": "http:\\/\\/a\\u00e9\\n"}', '"alone"', '"  "', "[[[[[\"deep\"]]]]]", "{broken", None, "", "12", '{"url": null, "thumbnailUrl": [], "contentUrl": {}}',
    ]
    df = spark.createDataFrame([(i, t, "v") for i, t in enumerate(given)], "id long, json string, v string").select("id", "json")
    got = {}
    for r in R.images_under(df, "id", "json").orderBy("id", "path").collect():
        got.setdefault(r.id, []).append(r.value)
    for i, t in enumerate(given):
        try:
            want = walked(json.loads(t))
        except (TypeError, ValueError):
            want = []
        assert got.get(i, []) == want, t
