"""Audits of tables: completeness, lengths, duplicates, validity, and overall status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filled(column: str) -> Column:
    """Neither null nor blank."""
    return F.col(column).isNotNull() & (F.trim(F.col(column).cast("string")) != "")


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, missing, missing_ratio for each column, from one pass."""
    counts = df.agg(F.count("*").alias("_n"), *(F.count_if(~filled(c)).alias(c) for c in columns))
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return counts.selectExpr("_n", f"stack({len(columns)}, {pairs}) as (field, missing)").select("field", "missing", F.when(F.col("_n") == 0, 0.0).otherwise(F.round(F.col("missing") / F.col("_n"), 4)).alias("missing_ratio"))


def nearest_rank(sorted_by: Column, percent: int) -> Column:
    """The value whose rank is percent/100 * (n - 1), rounded half to even. Aggregates by value first, so it holds one entry for each different value."""
    values = F.array_sort(F.collect_list(sorted_by))
    return F.element_at(values, (F.bround(F.lit(percent / 100.0) * (F.size(values) - 1), 0) + 1).cast("int"))


def length_stats(df: DataFrame, column: str, short: int, long: int) -> DataFrame:
    """One row: number, least, greatest, mean, median and 90th percentile of text lengths, and how many are short or long.

    Lengths are counted first: the percentiles are read from running totals over the different lengths, not from all rows.
    """
    sizes = df.select(F.length(F.coalesce(F.col(column), F.lit(""))).alias("length")).groupBy("length").agg(F.count("*").alias("rows"))
    upto = F.sum("rows").over(Window.orderBy("length"))
    placed = sizes.withColumn("upto", upto).withColumn("all", F.sum("rows").over(Window.partitionBy()))
    at = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("length")))
    n = F.col("all")
    return placed.agg(
        F.sum("rows").alias("chunks"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.round(F.sum(F.col("length") * F.col("rows")) / F.sum("rows"), 2).alias("avg_length"),
        ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2.0).alias("median_length"),
        at(F.bround((n - 1) * 0.9, 0)).alias("p90_length"),
        F.coalesce(F.sum(F.when(F.col("length") < short, F.col("rows"))), F.lit(0)).alias("short"),
        F.coalesce(F.sum(F.when(F.col("length") > long, F.col("rows"))), F.lit(0)).alias("long"),
    )


def json_validity(df: DataFrame, columns: list[str]) -> DataFrame:
    """field, valid, invalid, blank: whether each text column holds JSON."""
    parsed = lambda c: F.try_parse_json(F.col(c)).isNotNull()
    counts = df.agg(*(x for c in columns for x in (F.count_if(filled(c) & parsed(c)).alias(f"{c}_valid"), F.count_if(filled(c) & ~parsed(c)).alias(f"{c}_invalid"), F.count_if(~filled(c)).alias(f"{c}_blank"))))
    rows = ", ".join(f"'{c}', `{c}_valid`, `{c}_invalid`, `{c}_blank`" for c in columns)
    return counts.selectExpr(f"stack({len(columns)}, {rows}) as (field, valid, invalid, blank)")


def reasons(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that a row breaks, in order. A rule whose condition is null is not broken."""
    return F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules)))


def split_valid(df: DataFrame, column: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """Rows without and with reasons against them."""
    return df.where(F.size(column) == 0), df.where(F.size(column) > 0)


def duplicate_count(df: DataFrame, *keys: str) -> DataFrame:
    """One row: how many rows repeat an earlier one of equal keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def grouping_stats(df: DataFrame, key: str) -> DataFrame:
    """One row: how many rows groups have: least, greatest, mean, single ones, ones of ten or more."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("groups"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"), F.round(F.avg("n"), 2).alias("avg_rows"), F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") >= 10).alias("ten_or_more"))


def most_common(df: DataFrame, key: str, n: int, *tie: Column) -> DataFrame:
    """The n most frequent values with their counts; ties in the order given, by value if none."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *(tie or (F.col(key),))).limit(n)


def status(missing: Column, optional: Column, short: Column, long: Column, twice: Column) -> Column:
    """OK, WARN or FAIL from ratios: of missing critical fields (0.2), short (0.1), long (0.05), repeated (0.05), missing optional ones (0.5)."""
    return F.when(missing >= 0.2, "FAIL").when((short >= 0.1) | (long >= 0.05) | (twice >= 0.05) | (optional >= 0.5), "WARN").otherwise("OK")


def pivoted(df: DataFrame, entity: str, key: str, values: list[str], keys: list[str]) -> DataFrame:
    """Entity-attribute-value rows as one row for each entity; each value is the first filled of several typed columns."""
    value = F.coalesce(*(F.col(v).cast("string") for v in values))
    return df.withColumn("_value", value).groupBy(entity).pivot(key, keys).agg(F.first("_value", ignorenulls=True))


def differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """side, key of what only one of two tables holds."""
    return left.join(right, key, "left_anti").select(F.lit("left").alias("side"), key).distinct().unionByName(right.join(left, key, "left_anti").select(F.lit("right").alias("side"), key).distinct())
