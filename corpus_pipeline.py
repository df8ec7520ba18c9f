"""From documents to packed training sequences: quality, near duplicates, repeated passages, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import compression_quality, ngram_jaccard, packing, queries, substring_dedup
from newsloom.llm.common import checkpoint_dir, dropped
from newsloom.llm.windows import row_hash


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier doesn't reject (score of 0.3 or more). Null and empty texts score alike.

    The classifier learns from the labelled rows of docs. Repeated rows stay as often as they come; an empty table stays empty.
    """
    model = compression_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = unused(docs, "_score")
    return compression_quality.score(docs, model, to=name).where(F.col(name) >= 0.3).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates; of repeated rows one. Documents without words stay.

    A row without an id goes if its group has a row with one; else it stays.
    """
    mine, other, ident = unused(docs, "_hash"), unused(docs, "_other"), unused(docs, "_id")
    found = ngram_jaccard.join(docs, 5)
    kept = found.where(F.col("component_id").isNull() | (F.col("component_id") == F.col("doc_id")))
    stays = kept.select(F.col("row_hash").alias(other), F.col("doc_id").alias(ident)).distinct()
    joined = docs.withColumn(mine, row_hash()).join(stays, (F.col(mine) == F.col(other)) & F.col("doc_id").cast("long").eqNullSafe(F.col(ident)))
    return joined.dropDuplicates([mine, "doc_id"]).select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that an earlier one has; n_chars follows. Texts that lose nothing stay as they are.

    Every row stays, also where no word is left.
    """
    mine, other, ident, kept = (unused(docs, x) for x in ("_hash", "_other", "_id", "_kept"))
    found = substring_dedup.deduplicate(docs, 13, with_text=True).where("n_removed > 0")
    changed = found.select(F.col("row_hash").alias(other), F.col("doc_id").alias(ident), F.col("text").alias(kept)).dropDuplicates([other, ident])
    joined = docs.withColumn(mine, row_hash()).join(changed, (F.col(mine) == F.col(other)) & F.col("doc_id").cast("long").eqNullSafe(F.col(ident)), "left")
    new = {"text": F.coalesce(kept, "text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(kept).isNotNull(), F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return joined.withColumns(new).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 2048 ids.

    A null or empty text is one piece of its end id; repeated rows are packed as often as they come; an empty table gives no rows.
    """
    return packing.pack(packing.pieces(docs, queries.tokenizer("word_bpe_49k.json"), 2048, end_id=1), docs.count(), 2048)


STAGES = [("quality classifier", quality), ("n-gram jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("packing", packed)]

#: SQL can express neither compressed sizes nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each returns is written to the shared checkpoint folder, read by the next, and removed when that one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if number:
            dropped(f"{folder}/{number - 1}")
    return docs
