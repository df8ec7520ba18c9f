"""Change detection between articles and an index's manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def classify(articles: DataFrame, state: DataFrame, key: str, content: str = "content_hash") -> DataFrame:
    """articles with change: new if state has no active row of the key, changed if its hash differs, else unchanged."""
    known = state.where("status = 'active'").select(key, F.col(content).alias("_known"), F.lit(True).alias("_there"))
    change = F.when(F.col("_there").isNull(), "new").when(~F.col("_known").eqNullSafe(F.col(content)), "changed").otherwise("unchanged")
    return articles.join(known, key, "left").withColumn("change", change).drop("_known", "_there")


def not_current(articles: DataFrame, state: DataFrame, key: str, versions: dict[str, str], content: str = "content_hash") -> DataFrame:
    """articles for which no active row of state has the same hash and the given versions."""
    current = state.where("status = 'active'")
    for column, value in versions.items():
        current = current.where(F.col(column) == value)
    return articles.join(current.select(key, content), [key, content], "left_anti")


def until_streak(rows: DataFrame, source: str, order: list[Column], quiet: Column, length: int) -> DataFrame:
    """Rows of each source in order up to the one that completes ``length`` quiet rows in a row; 0: all rows."""
    if length <= 0:
        return rows
    w = Window.partitionBy(source).orderBy(*order)
    loud = F.when(quiet, 0).otherwise(1)
    placed = rows.withColumn("_pos", F.row_number().over(w)).withColumn("_island", F.sum(loud).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = F.sum(1 - loud).over(Window.partitionBy(source, "_island").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0))
    stop = F.min(F.when(F.col("_run") >= length, F.col("_pos"))).over(Window.partitionBy(source))
    return placed.withColumn("_run", run).withColumn("_stop", stop).where("_stop is null or _pos <= _stop").drop("_pos", "_island", "_run", "_stop")


def streaks(rows: DataFrame, key: str, order: list[str], wanted: Column) -> DataFrame:
    """For each key, how many runs of wanted rows it has, and the longest."""
    w = Window.partitionBy(key).orderBy(*order)
    other = F.sum(F.when(wanted, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("_wanted", wanted).withColumn("_run", other).where("_wanted").groupBy(key, "_run").agg(F.count("*").alias("_n"))
    return runs.groupBy(key).agg(F.count("*").alias("streaks"), F.max("_n").alias("longest"))


def health(articles: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """One row: keys missing in the index, keys only there, and keys of both."""
    both = articles.distinct().withColumn("_a", F.lit(True)).join(index.distinct().withColumn("_b", F.lit(True)), key, "full_outer")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("missing"), F.count_if(F.col("_a").isNull()).alias("extra"), F.count_if(F.col("_a") & F.col("_b")).alias("both"))


def apply_changes(changed: DataFrame, chunks: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """index with the chunks of changed articles in place of their old ones: delete, then insert."""
    return index.join(changed.select(key).distinct(), key, "left_anti").select(index.columns).unionByName(chunks.join(changed.select(key).distinct(), key, "left_semi").select(index.columns))
