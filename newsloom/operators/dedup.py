"""Deduplication of records by keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def newest_by_key(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """One row for each key: the first by order. The order should be total, or ties are arbitrary."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_occurrence(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each combination of keys."""
    return newest_by_key(df, F.struct(*keys), *order)


def greedy_groups(df: DataFrame, order: str, url: str, content: str) -> DataFrame:
    """df with is_duplicate and group_id as by a pass in the given order.

    A row joins the group of the first earlier row of its url (not empty), else of its content; rows without either
    begin a group. order must be unique; group_id is the order of the group's first row. Parents are found by two
    windows, in which rows without a url or content are each by themselves, and roots by jumping over parents, which
    halves every chain in a round, until none moves.
    """

    def first(key: Column) -> Column:
        alone = F.when(key.isNull(), F.col(order))
        return F.when(key.isNotNull(), F.min(order).over(Window.partitionBy(key, alone)))

    by_url, by_content = first(F.nullif(F.col(url), F.lit(""))), first(F.col(content))
    parent = F.when(by_url < F.col(order), by_url).when(by_content < F.col(order), by_content)
    linked = df.withColumn("_parent", parent)
    roots, moved = settled(linked.select(F.col(order).alias("_id"), F.coalesce("_parent", F.col(order)).alias("_root"))), True
    while moved:
        step = roots.select(F.col("_id").alias("_root"), F.col("_root").alias("_next"))
        after = settled(roots.join(step, "_root").select("_id", F.col("_next").alias("_root"), (F.col("_next") != F.col("_root")).alias("_moved")))
        moved = not after.where("_moved").isEmpty()
        roots = after.select("_id", "_root")
    return linked.join(roots, linked[order] == roots["_id"]).select(*df.columns, F.col("_parent").isNotNull().alias("is_duplicate"), F.col("_root").alias("group_id"))


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; one of our own where none is set, in local tests."""
    import tempfile

    if not spark.sparkContext.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="newsloom-"))
    return spark.sparkContext.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder, without lineage and without the estimate of its size, which joins in a loop would multiply."""
    spark = df.sparkSession
    shared_folder(spark)
    made = df.checkpoint()._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(made.queryExecution().toRdd(), made.schema(), False), spark)
