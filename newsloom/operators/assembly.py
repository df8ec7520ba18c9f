"""From ranked chunks to articles, citations and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T


def best_per_article(chunks: DataFrame, article: str, score: str, order: str, text: str) -> DataFrame:
    """article, score, best (the best chunk's order), text (its chunks' different texts in order): one row for each article."""
    best = F.max_by(F.col(order), F.struct(F.col(score), -F.col(order)))
    parts = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda c: c[text]))
    return chunks.groupBy(article).agg(F.max(score).alias(score), best.alias("best"), F.array_join(parts, " ").alias("text"))


def latest_articles(chunks: DataFrame, article: str, published: str, score: str, order: str, articles: int, each: int) -> DataFrame:
    """The best ``each`` chunks of the ``articles`` newest articles, by time and then score. Articles are ranked first, so only a few are joined."""
    newest = chunks.groupBy(article).agg(F.max(published).alias("_at"), F.max(score).alias("_best")).orderBy(F.desc("_at"), F.desc("_best"), article).limit(articles)
    few = chunks.join(F.broadcast(newest.select(article)), article, "left_semi")
    w = Window.partitionBy(article).orderBy(F.desc(score), order)
    return few.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= each).drop("_n")


def capped_articles(results: DataFrame, article: str, order: list[Column], each: int, articles: int) -> DataFrame:
    """At most ``each`` results of an article and ``articles`` articles, in order. Articles are ranked by their first results."""
    kept = results.withColumn("_n", F.row_number().over(Window.partitionBy(article).orderBy(*order))).where(F.col("_n") <= each)
    few = kept.where("_n = 1").orderBy(*order).limit(articles).select(F.col(article).alias("_a"))
    return kept.join(F.broadcast(few), F.col(article).eqNullSafe(F.col("_a")), "left_semi").drop("_n")


def cited(results: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """key, citation: numbers in the order in which keys first appear, by falling score and then order.

    Each key's first place comes before any ranking. Keys of one score are numbered together, after those of all higher scores.
    """
    first = results.groupBy(key).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(order)).alias("o"))).alias("_f")).select(key, F.col("_f.s").alias("_s"), (-F.col("_f.o")).alias("_o"))
    sizes = first.groupBy(F.col("_s").alias("_t")).agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy(F.desc("_t"))) - F.col("_size"))
    placed = first.withColumn("_n", F.row_number().over(Window.partitionBy("_s").orderBy("_o"))).join(before, F.col("_s").eqNullSafe(F.col("_t")))
    return placed.select(key, (F.col("_before") + F.col("_n")).cast("int").alias("citation"))


def with_parent(chunks: DataFrame, parents: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """chunks whose columns are the parent's where it has them filled."""
    joined = chunks.alias("c").join(parents.select(key, *(F.col(x).alias(f"_p_{x}") for x in columns)), key, "left")
    return joined.withColumns({x: T.first_filled(F.col(f"_p_{x}"), F.col(x)) for x in columns}).drop(*(f"_p_{x}" for x in columns))


def only_if_any(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among keys; all rows if none is."""
    marked = rows.join(keys.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    some = marked.agg(F.coalesce(F.bool_or("_hit"), F.lit(False)).alias("_some"))  # one row
    return marked.join(F.broadcast(some)).where(~F.col("_some") | F.col("_hit")).drop("_hit", "_some")


def best_sentences(articles: DataFrame, key: str, text: str, question: str, n: int) -> DataFrame:
    """key, answer: the n sentences that share the most of the question's words, in the order of the text, with their number as citation."""
    words = T.terms(F.lit(question))
    split = articles.select(key, F.posexplode(T.sentences(F.col(text))).alias("_at", "_sentence"))
    scored = split.withColumn("_score", T.overlap(words, T.terms(F.col("_sentence")))).where("_score > 0")
    top = scored.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_score"), "_at"))).where(F.col("_n") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("_at", "_sentence")))
    return top.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["_sentence"]), " ").alias("answer"))


def previous_turn(turns: DataFrame, conversation: str, order: str, column: str) -> DataFrame:
    """turns with what the turn before said."""
    return turns.withColumn("previous", F.lag(column).over(Window.partitionBy(conversation).orderBy(order)))


def served_images(images: DataFrame, request: str, per_article: int, total: int) -> DataFrame:
    """request, image: an url is served once, an article gives at most ``per_article``, a request has at most ``total``.

    images: request, images (array of struct article, url, in the order of serving). An url that was taken before costs
    its article nothing, and one that a full article could not give may come from another: each depends on what
    was served so far, so it is a fold over the request's list.
    """
    start = F.struct(F.array().cast("array<string>").alias("urls"), F.array().cast("array<string>").alias("given"))

    def step(state: Column, image: Column) -> Column:
        full = F.size(F.filter(state["given"], lambda a: a == image["article"])) >= per_article
        skip = (F.size(state["urls"]) >= total) | F.array_contains(state["urls"], image["url"]) | full
        return F.when(skip, state).otherwise(F.struct(F.array_append(state["urls"], image["url"]).alias("urls"), F.array_append(state["given"], image["article"]).alias("given")))

    served = F.aggregate("images", start, step, lambda s: s["urls"])
    return images.select(request, F.explode(served).alias("image"))
