"""Event streams: windows with watermarks, and upserts by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """event_type, window_start, n, value by the hour; works on streams (rows later than ``late`` are dropped there) and tables."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("event_type", F.col("w.start").alias("window_start"), "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session_start, session_end, n: runs of a user's events without a longer gap."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def ingest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: str) -> None:
    """Upsert all that a stream has into a table at path, batch by batch, and end.

    Each batch writes the table anew in a folder of its own batch number and names it in a pointer table; a repeated
    batch finds its own pointer and is skipped, so a restart changes nothing.
    """
    from newsloom.operators.tables import last_of, upsert

    spark = stream.sparkSession
    pointers = f"{path}/pointers"

    def pointed() -> tuple[int, str | None]:
        try:
            last = spark.read.json(pointers).orderBy(F.desc("batch")).first()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return -1, None
            raise
        return (last["batch"], last["version"]) if last else (-1, None)

    def batch(df: DataFrame, number: int) -> None:
        done, version = pointed()
        if number <= done:
            return
        merged = upsert(spark.read.parquet(version), df, keys, F.col(order)) if version else last_of(df, keys, F.col(order))
        new = f"{path}/batch-{number}"
        merged.write.mode("overwrite").parquet(new)
        spark.createDataFrame([(number, new)], "batch long, version string").coalesce(1).write.mode("append").json(pointers)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark, path: str) -> DataFrame:
    """The table that ingest last completed."""
    last = spark.read.json(f"{path}/pointers").orderBy(F.desc("batch")).first()
    return spark.read.parquet(last["version"])
