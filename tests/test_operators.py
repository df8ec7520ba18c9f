"""Small cases of single operators, and sequential models of those that depend on order."""

import random

from pyspark.sql import functions as F

from newsloom.functions import dates, html, ids, text, urls
from newsloom.operators import assembly, chunking, classify, dedup, quality, retrieval, sync, tables
from newsloom.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_text(spark):
    assert one(spark, text.normalized(F.lit("  Hòa  Phát\tĐẠT ß "))) == "hoa phat dat ss"
    assert sorted(one(spark, text.tokens(F.lit("HPG tăng a trần")))) == ["HPG", "hpg", "tang", "tran"]
    assert one(spark, text.normalized(F.lit(None).cast("string"))) == ""
    assert one(spark, text.has_keyword(F.lit("said air"), "ai")) is False
    assert one(spark, text.has_keyword(F.lit("the ai age"), "ai")) is True
    assert one(spark, text.truthy(F.lit(" Yes "))) is True and one(spark, text.truthy(F.lit(None).cast("string"))) is False


def test_urls_and_ids(spark):
    import uuid

    cases = {"HTTP://Ex.com/a/?b=2&utm_source=x&a=1#f": "http://ex.com/a?a=1&b=2", "//ex.com/p": "https://ex.com/p", "https://ex.com/?q=&z=a%20b": "https://ex.com?z=a+b", "": ""}
    for given, wanted in cases.items():
        assert one(spark, urls.normalize_url(F.lit(given))) == wanted
    for name in ("a|b", "é|中", ""):
        assert one(spark, ids.uuid5(F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_dates(spark):
    cases = {"Thứ hai, 13/05/2024, 14:30 (GMT+7)": "2024-05-13 07:30:00", "05/13/2024": "2024-05-13 00:00:00", "1/2/2024 03:05 PM": "2024-02-01 15:05:00", "Tue, 02 Jan 2024 03:04:05 +0700": "2024-01-01 20:04:05", "2024-01-02T03:04:05": "2024-01-02 03:04:05", "nothing": None}
    for given, wanted in cases.items():
        got = one(spark, dates.parse_datetime(F.lit(given)))
        assert (str(got) if got else None) == wanted, given


def test_greedy_groups(spark):
    rng = random.Random(5)
    for _ in range(4):
        rows = [(i, rng.choice(["", "a", "b", "c", None]), rng.choice("xyzw")) for i in range(24)]
        by_url, by_hash, group, wanted = {}, {}, {}, {}
        for i, url, h in rows:
            parent = by_url.get(url) if url else None
            parent = parent if parent is not None else by_hash.get(h)
            group[i] = group[parent] if parent is not None else i
            wanted[i] = (parent is not None, group[i])
            if url:
                by_url.setdefault(url, i)
            by_hash.setdefault(h, i)
        got = dedup.greedy_groups(spark.createDataFrame(rows, "ord int, url string, h string"), "ord", "url", "h").collect()
        assert {r.ord: (r.is_duplicate, r.group_id) for r in got} == wanted


def test_upserts(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    source = spark.createDataFrame([(2, "x"), (2, "y"), (3, "z")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(target, source, ["k"], F.col("v")).collect()), key=str) == sorted([(1, "a"), (2, "y"), (3, "z"), (None, "n")], key=str)
    assert tables.upsert(target, source.limit(0), ["k"]).count() == 3


def test_streak(spark):
    rng = random.Random(2)
    for _ in range(3):
        rows = [(s, i, rng.random() < 0.6) for s in "ab" for i in range(15)]
        wanted = set()
        for s in "ab":
            run = 0
            for src, i, quiet in rows:
                if src == s:
                    wanted.add((s, i))
                    run = run + 1 if quiet else 0
                    if run >= 3:
                        break
        got = sync.until_streak(spark.createDataFrame(rows, "s string, i int, q boolean"), "s", [F.col("i")], F.col("q"), 3)
        assert {(r.s, r.i) for r in got.collect()} == wanted


def test_lengths_of_nothing(spark):
    row = quality.length_stats(spark.createDataFrame([], "text string"), "text", 1, 2).first()
    assert row.chunks is None and row.short == 0


def test_served_images(spark):
    lists = spark.createDataFrame([(1, [("a", "u"), ("a", "v"), ("b", "u"), ("b", "v"), ("c", "w")])], "request int, images array<struct<article: string, url: string>>")
    assert [r.image for r in assembly.served_images(lists, "request", 1, 3).collect()] == ["u", "v", "w"]


def test_hybrid_negative_share(spark):
    v = spark.createDataFrame([(1, 0.5), (2, 0.9)], "id int, score double")
    b = spark.createDataFrame([(2, 4.0), (3, 2.0)], "id int, bm25_score double")
    got = {r.id: r.hybrid_score for r in retrieval.hybrid(v, b, "id", (0.65, 0.35)).collect()}
    assert abs(got[1] - 0.35 * -1) < 1e-9 and abs(got[2] - 1.0) < 1e-9 and abs(got[3] - 0.65 * -1.25) < 1e-9


def test_html():
    root = html.parse('<title>A &amp; B</title><script>var t="</p>";</script><article><p>' + "word " * 50 + '</p><figure><img data-src="/i.jpg" width=300><figcaption>c</figcaption></figure><img src="/logo.png"></article><a href="/x#y">t</a>')
    assert html.title(root) == "A & B" and html.content(root).startswith("word") and "var" not in html.content(root)
    assert html.images(root, "http://e.com/") == [(0, "http://e.com/i.jpg", "", "c")]
    assert html.links(root, "http://e.com/") == [("http://e.com/x", "t")]


def test_chunking():
    assert chunking.sentences("Ông Mr. Nam nói. TP.HCM đông.") == ["Ông Mr. Nam nói.", "TP.HCM đông."]
    text = " ".join(f"Sentence number {i} is here." for i in range(80))
    parts = chunking.split(text)
    assert all(len(p) <= 700 + 300 for p in parts) and all(f"number {i} " in " ".join(parts) for i in range(80))
    assert chunking.split("") == [] and max(map(len, chunking.split("x" * 5000))) <= 1000


def test_topics(spark):
    df = spark.createDataFrame([("kinh te", "Chứng khoán tăng", None, "cổ phiếu ngân hàng"), ("", "", "", "")], "c string, t string, s string, x string")
    a, b = classify.topics(df, "c", "t", "s", "x").collect()
    assert a.primary_topic == "economy_finance_stock" and b.primary_topic == "general_news" and b.topic_confidence == 0.0


def test_stream_upsert(spark, tmp_path):
    schema = "k int, v string, at int"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema).write.parquet(str(tmp_path / "in"))
    for more in ([(2, "c", 2)], [(3, "d", 3)]):
        events.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "at")
        spark.createDataFrame(more, schema).write.mode("append").parquet(str(tmp_path / "in"))
    events.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), ["k"], "at")
    assert sorted(map(tuple, events.current(spark, str(tmp_path / "out")).collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 3)]
