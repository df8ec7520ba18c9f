"""Table maintenance without a transactional format: upserts, deletes, schema evolution, and swaps of whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """df with exactly the columns of schema: missing ones null, others left out, types cast."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def evolve(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with those of the columns that it lacks, null; only adds."""
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def last_of(df: DataFrame, keys: list[str], order: Column | None) -> DataFrame:
    """One row for each key: the last by order, or any."""
    if order is None:
        return df.dropDuplicates(keys)
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return df.withColumn("_last", F.row_number().over(w)).where("_last = 1").drop("_last")


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """target with source's rows in place of those of equal keys. Of several source rows for a key the last by order counts.

    Rows of target with a null key match nothing and stay.
    """
    newest = last_of(source, keys, order)
    return target.join(newest.select(*keys), keys, "left_anti").unionByName(newest.select(target.columns))


def upsert_either(target: DataFrame, source: DataFrame, scope: str, keys: tuple[str, str], order: Column | None = None) -> DataFrame:
    """Like upsert, where a row matches if scope is equal and either of two keys is: two hash joins in place of one on a disjunction."""
    newest = last_of(source, [scope, keys[0]], order)
    rest = target
    for key in keys:
        rest = rest.join(newest.select(scope, key).where(F.col(key).isNotNull()).distinct(), [scope, key], "left_anti").select(target.columns)
    return rest.unionByName(newest.select(target.columns))


def delete(target: DataFrame, keys: DataFrame) -> DataFrame:
    """target without the rows whose key is in keys."""
    return target.join(keys.distinct(), keys.columns, "left_anti").select(target.columns)


def deactivate(target: DataFrame, keys: DataFrame, column: str = "status", value: str = "inactive") -> DataFrame:
    """target with a column set where the key is in keys."""
    marked = target.join(keys.distinct().withColumn("_hit", F.lit(True)), keys.columns, "left")
    return marked.withColumn(column, F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(column))).select(target.columns)


def without_range(target: DataFrame, column: str, low, high) -> tuple[DataFrame, DataFrame]:
    """target without a range of a column, and one row that says how many rows that takes."""
    gone = F.col(column).between(low, high)
    return target.where(~F.coalesce(gone, F.lit(False))), target.agg(F.count_if(gone).alias("planned"), F.count("*").alias("rows"))


def swap(df: DataFrame, path: str) -> str:
    """Write df into a new folder below path, which readers then use; a table that is read to make df is never overwritten."""
    version = f"{path}/v-{uuid.uuid4().hex}"
    df.write.parquet(version)
    return version


def required(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows in which all columns are filled, and the others."""
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    return df.where(good), df.where(~good)
