"""The thin queries over the driver's tables, one per operator of this folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import audio, bpe, centroids, compression_quality, long_matches, ngram_jaccard, nn_descent, packing, product_codes, records, sharding, substring_dedup, suffix_tree
from newsloom.llm.common import fold


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of the whole documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link documents whose sets of 5-word shingles are alike by 0.8 or more."""
    return ngram_jaccard.join(documents(spark, sf_dir), 5).select("doc_id", "n_shingles", "component_id")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document by a suffix tree learned from six sevenths of them."""
    return suffix_tree.score(documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every document with two zstandard dictionaries."""
    docs = documents(spark, sf_dir)
    model = compression_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = compression_quality.score(docs, model)
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove passages of 13 words that occur in an earlier document."""
    return substring_dedup.deduplicate(documents(spark, sf_dir), 13)


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors of every hundredth, by graph search."""
    return nn_descent.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100, k=10)


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids as records in the order of doc_id and read them back."""
    return records.write_and_read(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=0)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 ids."""
    docs = documents(spark, sf_dir)
    return packing.pack(packing.pieces(docs, tokenizer("word_bpe_49k.json"), 2048, end_id=1), docs.count(), 2048)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every document's bytes as 8-bit audio and describe it."""
    return audio.digests(documents(spark, sf_dir))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document."""
    return bpe.round_trip(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deal all documents into 40 shards of near equal bytes."""
    found = sharding.shard(documents(spark, sf_dir), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of four parts of every vector."""
    return product_codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), parts=4, entries=256, rounds=4, scale=1024)


def op12_long_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove strings of 100 bytes that begin earlier in the corpus."""
    return long_matches.deduplicate(documents(spark, sf_dir), 100)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all vectors of 64 components."""
    return centroids.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3, dims=64, scale=64)


def queries() -> dict:
    """Queries by name."""
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: Words of a text: runs of bytes other than white space of ASCII.
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Links by counting common shingles of all pairs, groups by walking along links.
_OP1 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_SMALL)} AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM d, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS t(i) WHERE len(w) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
 r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
 SELECT doc_id, coalesce(n.n, 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1, 2"""

_OP4 = f"""WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
 x AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM d, unnest(generate_series(1, len(w) - 12)) AS t(i)), m AS (SELECT g, min(doc_id) AS least FROM x GROUP BY 1),
 gone AS (SELECT DISTINCT doc_id, i + k AS place FROM x JOIN m USING (g), range(13) AS t(k) WHERE least < doc_id),
 word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM d), kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text FROM word ANTI JOIN gone USING (doc_id, place) GROUP BY 1)
 SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


_FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_GAP = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"


def _nearest(rows: str, entries: str, group: str) -> str:
    """Every row of a group with the nearest entry of that group, ties to the smaller number."""
    return f"SELECT * EXCLUDE (c, r) FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, {group} ORDER BY d, j) AS r FROM (SELECT v.*, e.j, e.c, {_GAP} AS d FROM {rows} v JOIN {entries} e USING ({group}))) WHERE r = 1"


def _moved(assigned: str, entries: str, group: str) -> str:
    """Entries as the floors of their members' means; those without members stay."""
    return f"""SELECT e.{group}, e.j, coalesce(m.c, e.c) AS c FROM {entries} e LEFT JOIN (SELECT {group}, j, list(s ORDER BY k) AS c FROM (SELECT {group}, j, k, floor(sum(y) / count(*))::BIGINT AS s
 FROM (SELECT {group}, j, unnest(x) AS y, generate_subscripts(x, 1) AS k FROM {assigned}) GROUP BY ALL) GROUP BY 1, 2) m USING ({group}, j)"""


def _rounds(rows: str, group: str, rounds: int) -> str:
    """Entries e1, e2, ... and the rows' entries a0, a1, ... from e0."""
    steps = [f"a0 AS MATERIALIZED ({_nearest(rows, 'e0', group)})"]
    for i in range(rounds):
        steps += [f"e{i + 1} AS MATERIALIZED ({_moved(f'a{i}', f'e{i}', group)})", f"a{i + 1} AS MATERIALIZED ({_nearest(rows, f'e{i + 1}', group)})"]
    return ", ".join(steps)


_OP11 = f"""WITH w AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE {_FINITE}),
 v AS MATERIALIZED (SELECT vec_id, part, x[part * len(x) // 4 + 1 : (part + 1) * len(x) // 4] AS x FROM w, range(4) AS t(part)),
 e0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS j, x AS c FROM v QUALIFY j < 256), {_rounds("v", "part", 4)},
 s AS (SELECT vec_id, string_agg(printf('%02x', j), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY 1)
 SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, j, k)) FROM (SELECT part, j, unnest(c) AS y, generate_subscripts(c, 1) AS k FROM e4)) AS codebooks_sha256
 FROM s JOIN w USING (vec_id)"""

_OP13 = f"""WITH v AS MATERIALIZED (SELECT vec_id, 0 AS one, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND {_FINITE}),
 e0 AS MATERIALIZED (SELECT one, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j, x AS c FROM v QUALIFY j < 16), {_rounds("v", "one", 3)},
 h AS (SELECT j, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM e3)
 SELECT vec_id, j::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY j))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a3 JOIN h USING (j)"""


def oracle_sql() -> dict:
    """DuckDB SQL by name, for those that SQL can express."""
    return {"op1_ngram_jaccard": _OP1, "op4_substring_dedup": _OP4, "op11_product_codes": _OP11, "op13_centroids": _OP13}
