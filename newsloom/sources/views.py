"""The driver's tables as the engine's own: articles, chunks, images, raw documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import ids, text

#: The same views for DuckDB. Text is cleaned by the engine's collapse; the tables hold no white space beyond ASCII.
ART = r"""art AS (SELECT doc_id AS article_id, source, lang AS category, text AS content, split_part(text, chr(10), 1) AS title,
 TIMESTAMP '2024-01-01' + to_hours(doc_id) AS published_at, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS content_hash FROM documents)"""
CHUNKS = r"""chunk AS (SELECT d.doc_id AS article_id, d.source, CAST(u.i - 1 AS INTEGER) AS chunk_index, trim(u.p) AS text, doc_id * 100000 + u.i - 1 AS ord
 FROM documents d, (SELECT doc_id AS k, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) u
 WHERE u.k = d.doc_id AND trim(u.p) <> '')"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as Gold articles; the time of publication follows from the id."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("article_id"),
        "source",
        F.col("lang").alias("category"),
        F.col("text").alias("content"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.expr("timestamp_ntz '2024-01-01' + make_dt_interval(0, cast(doc_id as int))").alias("published_at"),
        ids.content_hash(F.col("text")).alias("content_hash"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents as chunks, in order; ord numbers them over all documents."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "source", F.posexplode(F.split("text", "\n")).alias("chunk_index", "_line"))
    return lines.select("article_id", "source", "chunk_index", F.trim("_line").alias("text"), (F.col("article_id") * 100000 + F.col("chunk_index")).alias("ord")).where("text <> ''")


def plain(column) -> object:
    """A text folded as DuckDB can: lower case, accents stripped."""
    return text.folded(column)
