"""Deterministic identities as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.text import clean

#: Fixed value: the namespace of URLs of RFC 4122.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """The version-5 UUID of a name in the namespace of URLs."""
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substr(digest, F.lit(17), F.lit(1)), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda start, length: F.substr(digest, F.lit(start), F.lit(length))
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def content_hash(content: Column) -> Column:
    """sha256 of the cleaned text in lower case."""
    return F.sha2(F.encode(F.lower(clean(content)), "UTF-8"), 256)


def chunk_hash(text: Column, version: str) -> Column:
    """sha256 of the collapsed text and the chunking version."""
    return F.sha2(F.encode(F.concat(clean(text), F.lit("\n" + version)), "UTF-8"), 256)


def chunk_id(article_id: Column, block: Column, local: Column) -> Column:
    """{article}::b{block}::c{local}, with unsafe characters of the article's id as underscores."""
    safe = F.regexp_replace(article_id.cast("string"), "[^a-zA-Z0-9_.:-]+", "_")
    return F.concat(safe, F.lit("::b"), block.cast("string"), F.lit("::c"), local.cast("string"))
