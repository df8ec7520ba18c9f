"""Session helpers shared by the tests, the bench and the command line."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the engine expects of any cluster: UTC, AQE, Arrow."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("newsloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
