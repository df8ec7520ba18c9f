"""A stored inverted index and BM25 answers to whole tables of questions.

The index lies in folders of term buckets. A row holds a term's postings in one block of texts (those of an Arrow
batch): their keys, counts and lengths, and the largest count and least length, from which follows the most that the term
can add to a score there. A search reads the questions' buckets only. It first bounds every question's scores in every
block, scores the most promising blocks, and with the score that a question's last answer then has leaves all blocks out
whose bound is below it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators.dedup import settled
from newsloom.operators.retrieval import K1, B

#: Texts of a block; blocks that a question scores first; rows of a questions' table that are broadcast; digits of a score; questions that a block scores at once; terms that
#: are named to the scan.
TEXTS, PROBED, SMALL, DIGITS, SLICE, FEW = 2048, 2, 200_000, 9, 1024, 500


def build(chunks: DataFrame, key: str, text: str, path: str, buckets: int = 64) -> None:
    """Write the index of all texts to a new folder: postings and terms by bucket, and the corpus' size.

    Null texts are empty; they have no postings but count as texts. Keys must be unique; rows without a key are left out.
    """
    chunks, tag = chunks.where(F.col(key).isNotNull()), uuid.uuid4().hex
    kind = chunks.schema[key].dataType.simpleString()
    tokens = chunks.select(F.col(key).alias("key"), T.tokens(F.col(text)).alias("tokens"))

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, partition = count(), TaskContext.get().partitionId()
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                part, block = batch.slice(low, TEXTS), next(blocks)
                lists = part.column(1)
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                words = lists.flatten().dictionary_encode()
                if not len(words):
                    continue
                code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                # by term, then text: each pair once, with its count
                pair, tf = np.unique(code * len(lengths) + np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
                term, row = pair // len(lengths), pair % len(lengths)
                first = np.flatnonzero(np.diff(term, prepend=-1))
                bounds = pa.array(np.append(first, len(pair)), pa.int32())
                lists_of = lambda values: pa.ListArray.from_arrays(bounds, values)  # noqa: B023, E731
                found = words.dictionary.take(pa.array(term[first]))
                yield pa.RecordBatch.from_arrays(
                    [
                        found,
                        pa.array([f"{tag}-{partition}-{block}"] * len(first), pa.string()),
                        pa.array(np.maximum.reduceat(tf, first), pa.int32()),
                        pa.array(np.minimum.reduceat(lengths[row], first), pa.int32()),
                        lists_of(part.column(0).take(pa.array(row))),
                        lists_of(pa.array(tf, pa.int32())),
                        lists_of(pa.array(lengths[row], pa.int32())),
                    ],
                    ["term", "block", "most", "least", "keys", "tfs", "lengths"],
                )

    schema = rows_of(kind)
    rows = tokens.mapInArrow(posted, schema).withColumn("bucket", bucket("term", buckets))
    rows.repartition("bucket", F.pmod(F.xxhash64("term"), F.lit(97))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{path}/postings")
    stored = chunks.sparkSession.read.schema(f"{schema}, bucket int").parquet(f"{path}/postings")
    terms = stored.groupBy("bucket", "term").agg(F.sum(F.size("keys").cast("long")).alias("documents"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, x: a + x)).alias("occurrences"))
    terms.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/terms")
    total = chunks.sparkSession.read.schema(TERMS).parquet(f"{path}/terms").agg(F.coalesce(F.sum("occurrences"), F.lit(0)).alias("tokens"))
    chunks.agg(F.count("*").alias("texts")).join(total).withColumns({"buckets": F.lit(buckets), "kind": F.lit(kind)}).coalesce(1).write.parquet(f"{path}/corpus")


#: Columns of the terms' table.
TERMS = "term string, documents long, occurrences long, bucket int"


def rows_of(kind: str) -> str:
    """Columns of postings, without the bucket, of keys of a type; an index without words has no file that could tell them."""
    return f"term string, block string, most int, least int, keys array<{kind}>, tfs array<int>, lengths array<int>"


def bucket(term: str, buckets: int):
    """The bucket of a term."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def hinted(df: DataFrame, rows: int) -> DataFrame:
    """df for a broadcast if it has few rows."""
    return F.broadcast(df) if rows <= SMALL else df


def search(spark: SparkSession, path: str, questions: DataFrame, top: int, qid: str = "qid", question: str = "question") -> DataFrame:
    """qid, key, bm25_score (to nine digits), rank of the ``top`` best texts for each question, ties to the smaller key.

    The same scores as retrieval.bm25 of one question. Questions without a known term have no rows; repeated rows of a question
    count once.
    """
    corpus = spark.read.parquet(f"{path}/corpus").first()
    average = corpus["tokens"] / max(1, corpus["texts"])
    asked = questions.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(T.tokens(F.col(question)))).alias("term")).distinct().withColumn("bucket", bucket("term", corpus["buckets"]))
    asked = settled(asked)
    rows = asked.count()
    wanted = hinted(asked.select("bucket", "term").distinct(), rows)
    # at most as many folders as there are buckets; in them files are in the order of terms
    own = F.col("bucket").isin([r["bucket"] for r in asked.select("bucket").distinct().collect()])
    if rows <= FEW:
        own &= F.col("term").isin([r["term"] for r in asked.select("term").distinct().collect()])
    postings = spark.read.schema(f"{rows_of(corpus['kind'])}, bucket int").parquet(f"{path}/postings").where(own).join(wanted, ["bucket", "term"])
    df = spark.read.schema(TERMS).parquet(f"{path}/terms").where(own).join(wanted, ["bucket", "term"])
    idf = F.log(1 + (corpus["texts"] - F.col("documents") + 0.5) / (F.col("documents") + 0.5))
    weighed = settled(asked.join(df.select("term", idf.alias("idf")), "term").select("qid", "term", "idf"))
    most = F.col("most") * (K1 + 1) / (F.col("most") + K1 * (1 - B + B * F.col("least") / average))
    bounds = postings.select("term", "block", most.alias("part")).join(hinted(weighed, rows), "term").groupBy("qid", "block").agg(F.sum(F.col("idf") * F.col("part")).alias("bound"))
    bounds = settled(bounds.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bound"), "block"))))
    best = scored(postings, weighed, bounds.where(F.col("place") <= PROBED), average, top)
    best = settled(best)
    floor = best.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bm25_score"), "key"))).where(F.col("n") == top).select("qid", F.col("bm25_score").alias("floor"))
    rest = bounds.where(F.col("place") > PROBED).join(floor, "qid", "left").where(F.col("floor").isNull() | (F.col("bound") + 1e-6 >= F.col("floor")))
    found = best.unionByName(scored(postings, weighed, rest, average, top))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("bm25_score"), "key")))
    return ranked.where(F.col("rank") <= top)


def scored(postings: DataFrame, weighed: DataFrame, pairs: DataFrame, average: float, top: int) -> DataFrame:
    """qid, key, bm25_score: for each pair of question and block the best texts of the block (ties to the smaller key)."""
    kind = postings.schema["keys"].dataType.elementType.simpleString()
    slices = max(1, -(-weighed.select("qid").distinct().count() // SLICE))
    needed = pairs.select("qid", "block").join(weighed, "qid").withColumn("slice", F.pmod(F.xxhash64("qid"), F.lit(slices)).cast("int"))
    lists = postings.select("term", "block", "keys", "tfs", "lengths").join(needed.select("term", "block", "slice").distinct(), ["term", "block"])

    def summed(posted: pa.Table, asked: pa.Table) -> pa.Table:
        out = ([], [], [])
        if posted.num_rows and asked.num_rows:
            posted, asked = posted.combine_chunks(), asked.sort_by([("qid", "ascending"), ("term", "ascending")])
            sizes = posted.column("keys").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
            flat = lambda name: posted.column(name).combine_chunks().flatten()
            every = flat("keys")
            code = every.dictionary_encode()
            index = code.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            keys = code.dictionary
            order = pa.compute.sort_indices(keys).to_numpy()
            place = np.empty(len(keys), np.int64)
            place[order] = np.arange(len(keys))
            index, keys = place[index], keys.take(pa.array(order))
            tf, length = (flat(n).to_numpy(zero_copy_only=False).astype(np.float64) for n in ("tfs", "lengths"))
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))
            edges = np.concatenate(([0], np.cumsum(sizes)))
            at = dict(zip(posted.column("term").to_pylist(), range(posted.num_rows), strict=True))
            scores, current = None, None

            def close() -> None:
                held = np.flatnonzero(scores)
                value = np.round(scores[held], DIGITS)
                few = held[np.lexsort((held, -value))[:top]]
                out[0].extend([current] * len(few))
                out[1].append(few)
                out[2].append(np.round(scores[few], DIGITS))

            for q, term, idf in zip(*(asked.column(c).to_pylist() for c in ("qid", "term", "idf")), strict=True):
                if q != current or scores is None:
                    if scores is not None:
                        close()
                    scores, current = np.zeros(len(keys)), q
                if term in at:
                    low, high = edges[at[term]], edges[at[term] + 1]
                    scores[index[low:high]] += idf * part[low:high]  # a term has each text once
            close()
            which = np.concatenate([np.zeros(0, np.int64), *out[1]]).astype(np.int64)
            return pa.table({"qid": pa.array(out[0], asked.schema.field("qid").type), "key": keys.take(pa.array(which)), "bm25_score": np.concatenate([np.zeros(0), *out[2]])})
        return pa.table({"qid": asked.column("qid").slice(0, 0), "key": posted.column("keys").combine_chunks().flatten().slice(0, 0), "bm25_score": pa.array([], pa.float64())})

    asked = needed.select("qid", "term", "idf", F.col("block").alias("_block"), F.col("slice").alias("_slice"))
    schema = f"qid {weighed.schema['qid'].dataType.simpleString()}, key {kind}, bm25_score double"
    return lists.groupBy("block", "slice").cogroup(asked.groupBy("_block", "_slice")).applyInArrow(summed, schema)
