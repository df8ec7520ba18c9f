"""Follow-ups of tables and streams against a sequential model."""

import itertools
import random

import pytest

from newsloom.operators import followups as f

SCHEMA = f"conv long, turn long, role string, text string, sources array<{f.SOURCE}>, intent string"
QUESTIONS = ["tóm tắt nguồn 2", "bài này nói gì", "[1] về vàng", "bài báo số 3 nói gì", "nguồn 9", "tin số 2 về dầu mỏ", "giải thích thêm", "rút gọn", "cho tôi xem ảnh bài này", "thời tiết", "", None, "source 1 gold", "ý trên là sao"]


def source(i, title):
    return (i, f"a{i}", f"u{i}", title, None, "src", None)


def rows():
    rng = random.Random(3)
    titles = ["Giá vàng tăng", "Dầu mỏ giảm", "gold price", "Bóng đá", ""]
    out = []
    for conv, n in itertools.chain(((c, rng.randint(1, 12)) for c in range(40)), [(None, 6), (99, 0)]):
        for turn in range(n):
            if rng.random() < 0.6:
                out.append((conv, turn, "user", rng.choice(QUESTIONS), None, "clash"))
            else:
                out.append((conv, turn, rng.choice(["assistant", None]), "answer", rng.choice([None, [], [source(i + 1, rng.choice(titles)) for i in range(rng.randint(1, 3))]]), None))
    return out


def model(given):
    """Turn by turn, with plain dictionaries."""
    import re
    import unicodedata

    def plain(t):
        return " ".join("".join(c for c in unicodedata.normalize("NFD", (t or "").casefold()) if unicodedata.category(c) != "Mn").replace("đ", "d").split())

    words = lambda t: {w for w in re.findall(r"\w+", plain(t)) if len(w) >= 3}
    state, out = {}, []
    for conv, turn, role, text, sources, _ in sorted(given, key=lambda r: (str(r[0]), r[1])):
        held = state.setdefault(conv, {"sources": [], "chosen": None})
        if role != "user":
            if sources:
                state[conv] = {"sources": sources, "chosen": None}
            continue
        q = plain(text)
        cited = next((int(m[1]) for p in f.CITATIONS if (m := re.search(p, q))), None)
        refers = any(p in q for p in f.REFERENCES)
        number = cited if cited is not None else held["chosen"]
        status, found = "none", None
        if held["sources"] and number is not None:
            match = [s for s in held["sources"] if s[0] == number]
            terms = {w for w in words(text) if w not in f.STOP_TERMS and not w.isdigit()}
            if not match:
                status, found = "clarify", number
            elif not terms or terms & words(match[0][3] + " src"):
                status, found = "source", number
        elif held["sources"] and refers:
            status, found = ("source", held["sources"][0][0]) if len(held["sources"]) == 1 else ("clarify", None)
        if status == "source":
            held["chosen"] = found
        mark = refers or cited is not None
        one = lambda phrases: any(p in q for p in phrases)  # noqa: E731, B023
        intent = "followup_simplify" if one(f.SIMPLER) else "followup_media_lookup" if one(f.IMAGES) and mark else "followup_article_summary" if one(f.SUMMARY) and mark else "followup_citation_question" if cited is not None else "followup_expand" if one(f.EXPAND) else None
        out.append((conv, turn, intent, status, found))
    return sorted(out, key=str)


def test_table(spark):
    given = rows()
    df = spark.createDataFrame(given, SCHEMA).repartition(4)
    got = [tuple(r) for r in f.resolve(df, "conv", "turn", "role", "text", "sources").collect()]
    want = model(given)
    assert sorted(got, key=str) == want and {w[3] for w in want} == {"source", "clarify", "none"}
    assert f.resolve(df.limit(0), "conv", "turn", "role", "text", "sources").count() == 0


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_table(spark, tmp_path, files):
    given = [r for r in rows() if r[0] is not None]
    for part in range(files):  # later turns come in later micro-batches
        own = [r for r in given if r[1] * files // 12 == part]
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = f.resolve_stream(stream, "conv", "turn", "role", "text", "sources")
    name = f"followups{files}"
    out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((tuple(r) for r in spark.table(name).collect()), key=str) == model(given)
