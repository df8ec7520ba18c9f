"""Groups of duplicates kept up over batches: new rows join old groups by a stored index of keys, without reading old rows.

The rule is that of dedup.greedy_groups: a row joins the group of the first earlier row of its url, else of its content. So
only the first row of every url and content matters, and the index keeps these: for each key its first row's place
in the order, that row's other key, and the root of its group. A batch whose rows come after all others reads the buckets of its
own keys. A late row may be earlier than a key's first: then groups can merge or part, and roots are found anew
over the index, never over the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom.operators.bucketed import Table
from newsloom.operators.dedup import settled

SCHEMA = "kind string, key string, first long, url string, content string, root long"
URL, CONTENT = "url", "content"


def firsts(rows: DataFrame, order: str, url: str, content: str) -> DataFrame:
    """kind, key, first, url, content: the first row of each url and of each content. Pre-aggregated, so that a frequent key costs each task one row."""
    named = rows.where(F.col(order).isNotNull()).select(F.col(order).cast("long").alias("first"), F.nullif(F.col(url).cast("string"), F.lit("")).alias("url"), F.col(content).cast("string").alias("content"))
    both = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("key")) for kind in (URL, CONTENT))))
    keyed = named.select("*", both.alias("k")).select("k.kind", "k.key", "first", "url", "content").where("key IS NOT NULL")
    return keyed.groupBy("kind", "key").agg(F.min(F.struct("first", "url", "content")).alias("m")).select("kind", "key", "m.*")


def rooted(keys: DataFrame) -> DataFrame:
    """keys (kind, key, first, url, content, root) with the root of each; one that has a root keeps it.

    A url's first row may have a content that came earlier, a content's first row an earlier url: that key's root is its
    own. Chains of such steps fall in the order; each round halves them.
    """
    other = keys.select(F.col("kind").alias("_kind"), F.col("key").alias("_key"), F.col("first").alias("_first"))
    to = F.when(F.col("kind") == URL, F.col("content")).otherwise(F.col("url"))
    kind = F.when(F.col("kind") == URL, CONTENT).otherwise(URL)
    ahead = keys.withColumns({"_kind": kind, "_key": to}).join(other, ["_kind", "_key"], "left")
    onward = F.col("root").isNull() & F.coalesce(F.col("_first") < F.col("first"), F.lit(False))
    found = ahead.select(
        "kind", "key", "first", "url", "content", F.when(~onward, F.coalesce("root", "first")).alias("root"), F.when(onward, F.col("_kind")).alias("to_kind"), F.when(onward, F.col("_key")).alias("to_key")
    )
    found = settled(found)
    while not found.where("root IS NULL").isEmpty():
        step = found.select(F.col("kind").alias("to_kind"), F.col("key").alias("to_key"), F.col("root").alias("_root"), F.col("to_kind").alias("_kind"), F.col("to_key").alias("_key"))
        moved = found.join(step, ["to_kind", "to_key"], "left")
        found = settled(moved.select("kind", "key", "first", "url", "content", F.coalesce("root", "_root").alias("root"), F.when(F.coalesce("root", "_root").isNull(), F.col("_kind")).alias("to_kind"), F.when(F.coalesce("root", "_root").isNull(), F.col("_key")).alias("to_key")))
    return found.drop("to_kind", "to_key")


class Groups:
    """The index at a path. One writer at a time absorbs batches."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.table = Table(spark, path).create(StructType.fromDDL(SCHEMA), ["kind", "key"], buckets)

    def absorb(self, rows: DataFrame, order: str, url: str, content: str, batch: tuple[str, int] | None = None) -> int:
        """Take a batch's rows into the index; the index' new version.

        order: a row's place among all rows, unique and a whole number; batches may come in any order of it. batch: name of a stream
        and number of its batch; one that was absorbed before changes nothing. Rows without a url and content are groups of
        their own and leave no trace, as do rows without an order. An empty batch changes nothing.
        """
        table, state = self.table, self.table.snapshot()
        if batch and state["done"].get(batch[0], -1) >= batch[1]:
            return state["version"]
        fresh = settled(firsts(rows, order, url, content))
        touched = [r["b"] for r in fresh.select(table.bucket(state).alias("b")).distinct().collect()]  # at most as many as there are buckets
        old = table.read(state["version"], touched).withColumnsRenamed({c: f"_{c}" for c in ("first", "url", "content", "root")})
        both = settled(fresh.join(old, ["kind", "key"], "left"))
        earlier = F.col("_first").isNull() | (F.col("first") < F.col("_first"))
        pick = lambda c: F.when(earlier, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
        now = both.select("kind", "key", pick("first"), pick("url"), pick("content"), F.when(~earlier, F.col("_root")).alias("root"), earlier.alias("_new"))
        if both.where("first < _first").isEmpty():
            # all that is new lies behind what was there: no old root moves, and chains end at old keys of the batch
            made = rooted(now.drop("_new")).join(now.where("_new").select("kind", "key"), ["kind", "key"], "left_semi")
        else:
            whole = table.read(state["version"])
            changed = now.where("_new").drop("_new", "root")
            after = whole.drop("root").join(changed, ["kind", "key"], "left_anti").unionByName(changed)
            every = rooted(after.withColumn("root", F.lit(None).cast("long")))
            before = whole.select("kind", "key", F.col("root").alias("_root"), F.col("first").alias("_first"))
            made = every.join(before, ["kind", "key"], "left").where(~(F.col("root").eqNullSafe(F.col("_root")) & F.col("first").eqNullSafe(F.col("_first")))).drop("_root", "_first")
        return table.upsert(settled(made), batch=batch)

    def of(self, rows: DataFrame, order: str, url: str, content: str) -> DataFrame:
        """rows with is_duplicate and group_id as the index knows them; rows of any batch that was absorbed.

        A row without an order has none of both. Of rows with a frequent key the join may be uneven; adaptive execution splits it.
        """
        keys = self.table.read()
        part = lambda kind, c: keys.where(F.col("kind") == kind).select(F.col("key").alias(f"_{c}"), F.col("first").alias(f"_{c}first"), F.col("root").alias(f"_{c}root"))
        named = rows.withColumns({"_u": F.nullif(F.col(url).cast("string"), F.lit("")), "_c": F.col(content).cast("string")})
        joined = named.join(part(URL, "u"), "_u", "left").join(part(CONTENT, "c"), "_c", "left")
        at = F.col(order)
        group = F.when(F.col("_ufirst") < at, F.col("_uroot")).when(F.col("_cfirst") < at, F.col("_croot"))
        return joined.select(*rows.columns, F.when(at.isNotNull(), group.isNotNull()).alias("is_duplicate"), F.when(at.isNotNull(), F.coalesce(group, at.cast("long"))).alias("group_id"))
