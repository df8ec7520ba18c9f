"""BM25, lexical, vector and hybrid retrieval over chunk tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T

K1, B = 1.5, 0.75


def postings(chunks: DataFrame, key: str, text: str) -> DataFrame:
    """term, key, tf, length: an index of all terms, to be written once and read by many queries."""
    tokens = chunks.select(key, F.explode(F.array(T.tokens(F.col(text)))).alias("_tokens")).withColumn("length", F.size("_tokens"))
    return tokens.select(key, "length", F.explode("_tokens").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def query_terms(query: str) -> list[str]:
    """Different search tokens of a query, as T.tokens makes them."""
    import re
    import unicodedata

    found: dict[str, None] = {}
    for raw in re.findall(r"[A-Za-z0-9À-ỹĐđ-]+", query):
        plain = "".join(c for c in unicodedata.normalize("NFD", raw) if unicodedata.category(c) != "Mn").replace("đ", "d").replace("Đ", "D").lower()
        if len(plain) >= 2:
            found[plain] = None
        if raw.isupper() and 2 <= len(raw) <= 8:
            found[raw] = None
    return list(found)


def bm25(chunks: DataFrame, key: str, text: str, query: str, top: int | None, where: Column | None = None) -> DataFrame:
    """key, bm25_score, rank of the best chunks for a query; without top all that score, unranked. Statistics are those of all chunks; where filters only what is returned.

    One pass counts the query's terms in each chunk without exploding it; only chunks that hold one are kept.
    """
    terms = query_terms(query)

    def times(term: str) -> Column:
        return F.size(F.filter("_tokens", lambda x: x == F.lit(term)))

    # explode of a one-element array: the tokens are then made once a row, not once for each use
    tokens = chunks.select("*", F.explode(F.array(T.tokens(F.col(text)))).alias("_tokens"))
    counted = tokens.select(key, F.size("_tokens").alias("_length"), *(times(t).alias(f"_tf{i}") for i, t in enumerate(terms)), (where if where is not None else F.lit(True)).alias("_wanted"))
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_length").alias("_avg"), *(F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))))
    some = reduce(lambda a, b: a | b, (F.col(f"_tf{i}") > 0 for i in range(len(terms))), F.lit(False))
    joined = counted.where(some & F.col("_wanted")).join(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        tf, df = F.col(f"_tf{i}"), F.col(f"_df{i}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_length") / F.col("_avg")))

    score = reduce(lambda a, b: a + b, (part(i) for i in range(len(terms))), F.lit(0.0))
    scored = joined.select(key, score.alias("bm25_score")).where("bm25_score > 0")
    if top is None:
        return scored
    best = scored.orderBy(F.desc("bm25_score"), key).limit(max(1, top))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("bm25_score"), key)))


def lexical(chunks: DataFrame, key: str, title: str, text: str, terms: list[str], top: int) -> DataFrame:
    """key, lexical_score: 3 for each term in the title, 1 for each in the text."""
    head, body = F.lower(T.strip_accents(F.coalesce(title, F.lit("")))), F.lower(T.strip_accents(F.coalesce(text, F.lit(""))))
    score = reduce(lambda a, b: a + b, (F.when(head.contains(t), 3.0).otherwise(0.0) + F.when(body.contains(t), 1.0).otherwise(0.0) for t in terms), F.lit(0.0))
    return chunks.select(key, score.alias("lexical_score")).where("lexical_score > 0").orderBy(F.desc("lexical_score"), key).limit(max(1, top))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, key: str, column: str, query: list[float], top: int) -> DataFrame:
    """key, distance, score of the chunks nearest by cosine, exactly: one scan, the best of each partition, then of all."""
    q = F.array(*(F.lit(float(x)) for x in query))
    v = F.col(column)
    length = F.sqrt(dot(v, v)) * F.sqrt(dot(q, q))
    distance = 1 - F.when(length == 0, 0.0).otherwise(dot(v, q) / length)
    return vectors.select(key, distance.alias("distance")).withColumn("score", 1 / (1 + F.col("distance"))).orderBy("distance", key).limit(top)


def scaled(value: Column, low: Column, high: Column) -> Column:
    """value between low and high as 0..1; where both are equal 1 if above 0; an empty list (null bounds) gives 0."""
    return F.when(low.isNull(), 0.0).when(low == high, F.when(value > 0, 1.0).otherwise(0.0)).otherwise((value - low) / (high - low))


def hybrid(vector: DataFrame, lexical: DataFrame, key: str, weights: tuple[float, float], bonus: Column | float = 0.0) -> DataFrame:
    """key, vector_score, bm25_score, hybrid_score, score of the union of two result lists.

    Each side is scaled over its own list, and a missing score enters as 0, also below a list's least.
    vector: key, score. lexical: key, bm25_score, at most one row for each key.
    """
    both = vector.select(key, F.col("score").alias("_v")).join(lexical.select(key, F.col("bm25_score").alias("_b")), key, "full_outer")
    everything = Window.partitionBy()
    bounds = both.select("*", *(f("_v" if side == "v" else "_b").over(everything).alias(f"_{name}{side}") for side in "vb" for name, f in (("low", F.min), ("high", F.max))))
    v, b = F.coalesce("_v", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    mixed = weights[0] * scaled(v, F.col("_lowv"), F.col("_highv")) + weights[1] * scaled(b, F.col("_lowb"), F.col("_highb")) + bonus
    out = bounds.select(key, v.alias("vector_score"), b.alias("bm25_score"), mixed.alias("hybrid_score"))
    return out.withColumn("score", F.greatest("vector_score", "hybrid_score"))


def weights_for(query: str, requires_lexical: bool) -> tuple[float, float]:
    """Weights of vector and lexical scores: lexical leads where a query needs it or holds a ticker."""
    import re

    return (0.45, 0.55) if requires_lexical or re.search(r"\b[A-Z]{2,8}\b", query) else (0.65, 0.35)


def exact_bonus(query: str, text: Column, title: Column) -> Column:
    """Up to 0.15: the share of the query's tokens that a candidate's text or title holds."""
    terms = query_terms(query)
    body = F.lower(T.strip_accents(F.concat_ws(" ", F.coalesce(text, F.lit("")), F.coalesce(title, F.lit("")))))
    hits = reduce(lambda a, t: a + F.when(body.contains(t.lower()) | body.contains(t), 1).otherwise(0), terms, F.lit(0))
    return F.least(F.lit(0.15), hits / len(terms) * 0.15) if terms else F.lit(0.0)


def entity_bonus(terms: tuple[str, ...], title: Column, names: Column) -> Column:
    """Up to 0.15: the share of asked names (each as often as it is asked) in a candidate's title and entities."""
    body = F.lower(T.strip_accents(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.array_join(names, ","))))
    hits = reduce(lambda a, t: a + F.when(body.contains(F.lower(T.strip_accents(F.lit(t)))), 1).otherwise(0), terms, F.lit(0))
    return F.least(F.lit(0.15), hits / len(terms) * 0.15) if terms else F.lit(0.0)


def source_bonus(preferred: tuple[str, ...], source: Column) -> Column:
    """0.08 for a preferred source, in any case of letters."""
    return F.when(F.lower(source).isin(*(p.lower() for p in preferred)) & (source != ""), 0.08).otherwise(0.0) if preferred else F.lit(0.0)


def image_bonus(wanted: bool, has_images: Column) -> Column:
    """0.1 for a candidate with images where they are wanted."""
    return F.when(T.truthy(has_images), 0.1).otherwise(0.0) if wanted else F.lit(0.0)


def diversified(results: DataFrame, article: str, source: str, order: list[Column], top: int, per_article: int = 2, per_source: int = 3) -> DataFrame:
    """The best results with at most so many of an article and of a source; an article has one source. Results are few: a list for one question."""
    a = results.withColumn("_a", F.row_number().over(Window.partitionBy(article).orderBy(*order))).where(F.col("_a") <= per_article)
    s = a.withColumn("_s", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("_s") <= per_source)
    return s.drop("_a", "_s").orderBy(*order).limit(top)
