"""Topics and entities of articles by lexicons, as column expressions without any join or Python."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions import text as T

#: Topics in order of precedence, with their names and keywords.
TOPICS: dict[str, tuple[str, tuple[str, ...]]] = {
    "tech_ai_internet": ("Cong nghe - AI - Internet", ("ai", "tri tue nhan tao", "cong nghe", "internet", "chuyen doi so", "chip", "cloud", "an ninh mang", "phan mem", "robot", "startup cong nghe")),
    "economy_finance_stock": ("Kinh te - Tai chinh - Chung khoan", ("kinh te", "tai chinh", "chung khoan", "vn-index", "co phieu", "ngan hang", "lai suat", "ty gia", "trai phieu", "thanh khoan", "khoi ngoai", "tu doanh", "vi mo", "cpi", "gdp", "lam phat")),
    "politics_society": ("Thoi su - Chinh tri - Xa hoi", ("thoi su", "chinh tri", "xa hoi", "chinh sach", "quoc hoi", "chinh phu", "phap luat", "dan sinh", "giao thong", "viec lam", "an sinh")),
    "world_geopolitics": ("Quoc te - Dia chinh tri - The gioi", ("the gioi", "quoc te", "dia chinh tri", "my", "trung quoc", "nga", "ukraine", "israel", "trung dong", "chien tranh", "xung dot", "ngoai giao", "nato", "lien hop quoc")),
    "business_startup": ("Doanh nghiep - Khoi nghiep", ("doanh nghiep", "startup", "khoi nghiep", "ceo", "loi nhuan", "doanh thu", "m&a", "goi von", "dau tu", "ket qua kinh doanh", "chien luoc")),
    "real_estate": ("Bat dong san", ("bat dong san", "nha dat", "chung cu", "du an", "quy hoach", "dat nen", "khu do thi", "nha o", "mat bang", "van phong", "khu cong nghiep")),
    "lifestyle_education_health_entertainment": ("Doi song - Giao duc - Suc khoe - Giai tri", ("doi song", "giao duc", "suc khoe", "giai tri", "du lich", "the thao", "phim", "am nhac", "truong hoc", "tuyen sinh", "y te", "benh", "lifestyle", "am thuc")),
}
GENERAL = ("general_news", "Tin tong hop")
#: Weights of category, title, summary and content; of a category's alias; of a lock; the least score of a topic.
FIELD_WEIGHTS, ALIAS_WEIGHT, LOCK_WEIGHT, LEAST = (5.0, 3.0, 2.0, 1.0), 10.0, 100.0, 3.0


def alias_topic(category: Column, aliases: list[tuple[str, str]]) -> Column:
    """The topic of the first alias, in the order given, that the category holds; null if none."""
    out = None
    for alias, topic in aliases:
        hit = T.has_keyword(category, alias)
        out = F.when(hit, topic) if out is None else out.when(hit, topic)
    return out if out is not None else F.lit(None).cast("string")


def topics(df: DataFrame, category: str, title: str, summary: str, content: str, lexicon: dict | None = None, aliases: list | None = None, locks: list | None = None, extra: dict | None = None) -> DataFrame:
    """df with primary_topic, topic_confidence, secondary_topics.

    Every field counts the keywords that it holds, each once, by its weight. Ties go to the earlier topic. Below a score of 3
    the topic is general. aliases and locks are ordered (alias, topic) pairs on the category; extra: more secondary topics by alias.
    """
    lexicon = lexicon or TOPICS
    fields = [T.normalized(F.col(c)) for c in (category, title, summary, content)]
    # each folded field is made once: an explode of one element keeps the optimizer from repeating it
    wide = df.select("*", F.explode(F.array(F.struct(*(f.alias(f"f{i}") for i, f in enumerate(fields))))).alias("_f"))
    folded = [F.col(f"_f.f{i}") for i in range(4)]
    alias, lock = alias_topic(folded[0], aliases or []), alias_topic(folded[0], locks or [])

    def hits(text: Column, words: tuple[str, ...]) -> Column:
        return reduce(lambda a, w: a + F.when(T.has_keyword(text, w), 1.0).otherwise(0.0), words, F.lit(0.0))

    scores = []
    for order, (topic, (_, words)) in enumerate(lexicon.items()):
        score = reduce(lambda a, fw, words=words: a + hits(fw[0], words) * fw[1], zip(folded, FIELD_WEIGHTS, strict=True), F.lit(0.0))
        score = score + F.when(alias == topic, ALIAS_WEIGHT).otherwise(0.0) + F.when(lock == topic, LOCK_WEIGHT).otherwise(0.0)
        scores.append(F.struct((-score).alias("neg"), F.lit(order).alias("order"), F.lit(topic).alias("topic")))
    ranked = wide.withColumn("_s", F.array_sort(F.array(*scores)))
    more = F.array().cast("array<string>")
    for name, found in (extra or {}).items():
        more = F.when(T.has_keyword(folded[0], name) & (F.size(more) == 0), F.array(*(F.lit(t) for t in found))).otherwise(more)
    return decided(ranked, df.columns, len(lexicon), more)


def decided(ranked: DataFrame, columns: list[str], size: int, more: Column) -> DataFrame:
    """columns, primary_topic, topic_confidence, secondary_topics from _s: structs of neg (less the score), order and topic, sorted. more: further secondary topics."""
    best = -F.col("_s")[0]["neg"]
    total = F.aggregate("_s", F.lit(0.0), lambda a, s: a - s["neg"])
    general = best < LEAST
    second = F.slice(F.transform(F.filter(F.slice("_s", 2, size), lambda s: (s["neg"] < 0) & ((-s["neg"] >= LEAST) | (-s["neg"] >= best * 0.5))), lambda s: s["topic"]), 1, 3)
    second = F.array_distinct(F.concat(second, F.filter(more, lambda t: t != F.col("_s")[0]["topic"])))
    return ranked.select(
        *columns,
        F.when(general, GENERAL[0]).otherwise(F.col("_s")[0]["topic"]).alias("primary_topic"),
        F.when(general, 0.0).otherwise(F.round(F.least(F.lit(1.0), best / total), 4)).alias("topic_confidence"),
        F.when(general, F.array().cast("array<string>")).otherwise(second).alias("secondary_topics"),
    )


#: Entities as (type, name, names by which texts call it, confidence). More are given as a parameter.
ENTITIES: list[tuple[str, str, tuple[str, ...], float]] = [
    ("country", "Hoa Kỳ", ("Mỹ", "Hoa Kỳ", "USA", "United States"), 0.90),
    ("country", "Trung Quốc", ("Trung Quốc",), 0.90),
    ("country", "Nga", ("Nga",), 0.90),
    ("country", "Ukraine", ("Ukraine",), 0.90),
    ("organization", "NATO", ("NATO",), 0.90),
    ("organization", "World Bank", ("World Bank", "Ngân hàng Thế giới"), 0.90),
    ("location", "Hà Nội", ("Hà Nội",), 0.90),
    ("location", "TP.HCM", ("TP.HCM", "TP HCM", "TPHCM", "TP Hồ Chí Minh", "Thành phố Hồ Chí Minh"), 0.90),
]


def plain(name: str) -> str:
    """A name folded as texts are."""
    import unicodedata

    return " ".join("".join(c for c in unicodedata.normalize("NFD", name.casefold()) if unicodedata.category(c) != "Mn").replace("đ", "d").split())


def entities(text: Column, lexicon: list[tuple[str, str, tuple[str, ...], float]] | None = None) -> Column:
    """array of struct type, name, mentions, confidence of the entities that a folded text mentions, by type and name.

    Mentions of all names of an entity add up, so overlapping names count twice.
    """
    found = []
    for kind, name, names, confidence in lexicon or ENTITIES:
        n = reduce(lambda a, x: a + T.mentions(text, plain(x)), names, F.lit(0))
        found.append(F.when(n > 0, F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"), n.alias("mentions"), F.lit(confidence).alias("confidence"))))
    return F.array_sort(F.array_compact(F.array(*found)))
