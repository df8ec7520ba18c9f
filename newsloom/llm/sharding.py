"""Sharding of a corpus by sampled splitters into shards of near equal bytes.

Records are put in the order of (key hash, row hash). Size-weighted key samples give quantile boundaries of many
small ranges. A key that takes several quantiles is a range of its own, divided evenly by row hash; ranges that turn
out overfull are divided again by samples of their own. The exact bytes of each range then place every record on a line of
all bytes, which the shards cut into equal parts. Records of one key stay together unless their key alone is a
large part of a shard. All of it is DataFrame code.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import cut

#: The least key hash.
LOWEST = -(1 << 63)
#: Ranges as (first key, parts): keys from this one up to the next range's, dealt over so many parts by row hash.
Ranges = list[tuple[int, int]]


def splitters(df: DataFrame, wanted: int, total: int, oversample: int) -> Ranges:
    """About ``wanted`` ranges: quantiles of a sample in which a record's chance follows its size.

    At most about wanted * oversample keys come to the driver. The sample is drawn by a hash of the record, so it is
    the same in any run.
    """
    if wanted < 2 or total <= 0:
        return []
    share = wanted * oversample / total
    chance = (F.xxhash64("_row", F.lit("splitters")) / F.lit(2.0**64)) + 0.5
    keys = sorted(r._key for r in df.where(chance < F.col("_size") * share).select("_key").collect())
    found: dict[int, int] = {}
    for key, times in Counter(keys[len(keys) * i // wanted] for i in range(1, wanted) if keys).items():
        found[key] = times + 1 if times > 1 else 1
        if times > 1 and key < -LOWEST - 1:
            found.setdefault(key + 1, 1)  # what follows a divided key
    return sorted(found.items())


def united(first: Ranges, second: Ranges) -> Ranges:
    """The boundaries of both; where both divide a key, the finer division."""
    found = dict(first)
    for key, parts in second:
        found[key] = max(parts, found.get(key, 1))
    return sorted(found.items())


def ranged(df: DataFrame, ranges: Ranges) -> DataFrame:
    """df with _range, the number of the part in which a record lies, and _whole, whether that is a range of one part.

    Ranges are looked up in two steps: the upper bits of a key name the few ranges that begin there, which are
    broadcast (two rows for each range at most), and of these the last that begins at or below the key.
    """
    every = [(LOWEST, 1), *(r for r in ranges if r[0] != LOWEST)] if not ranges or ranges[0][0] != LOWEST else ranges
    bits = min(30, max(1, (len(every) - 1).bit_length()))
    numbered, at = [], 0
    for key, parts in every:
        numbered.append((key, at, parts))
        at += parts
    slots: dict[int, list] = {}
    for r in numbered:
        slots.setdefault(r[0] >> (64 - bits), []).append(r)
    rows, last = [], numbered[0]
    for slot in range(-(1 << bits - 1), 1 << bits - 1):
        own = slots.get(slot, [])
        rows.append((slot, [last, *own]))  # the range that reaches into the slot, and those that begin there
        last = own[-1] if own else last
    table = df.sparkSession.createDataFrame(rows, "_slot long, _ranges array<struct<key: long, first: int, parts: int>>")
    found = F.element_at(F.filter("_ranges", lambda r: r["key"] <= F.col("_key")), -1)
    placed = df.withColumn("_slot", F.shiftright("_key", 64 - bits)).join(F.broadcast(table), "_slot").withColumn("_found", found)
    part = F.least(F.floor((F.col("_row") / F.lit(2.0**64) + 0.5) * F.col("_found.parts")), F.col("_found.parts") - 1)
    return placed.withColumns({"_range": (F.col("_found.first") + part).cast("int"), "_whole": F.col("_found.parts") == 1}).select(*df.columns, "_range", "_whole")


def shard(docs: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None, oversample: int = 20, together: float = 0.05, range_bytes: int = 64 << 20) -> DataFrame:
    """Return doc_id, size, text_crc32, shard, slot for every row of docs; sizes of shards are near equal.

    A record weighs its text's UTF-8 bytes plus 16 (null text: 0 bytes). ``ranges`` bounds the work of one task to a share of
    the data; unless given, there are four for each shard, or more so that none weighs over about ``range_bytes``. Copies of a
    text share a shard unless together they weigh more than ``together`` of a shard. Rows are kept whatever they hold: null
    ids and texts, repeated rows. Rows alike in both id and text are interchangeable. An empty table gives no rows. Other
    columns of docs are left out.
    """
    line = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("_size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("_crc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_key"),
        # rows alike or without an id may be many: their place in the input parts them (fixed from the checkpoint on)
        F.xxhash64(F.col(doc_id).cast("string"), F.monotonically_increasing_id()).alias("_row"),
    )
    line = cut(line)  # 40 bytes a record, read several times from here on
    total = int(line.agg(F.sum("_size").alias("bytes")).first()["bytes"] or 0)
    wanted = ranges or max(4 * shards, -(-total // range_bytes))
    bounds = splitters(line, wanted, total, oversample)

    def weighed(bounds: Ranges) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
        df = ranged(line, bounds)
        return df, {r._range: (r.b, r.n) for r in df.groupBy("_range").agg(F.sum("_size").alias("b"), F.count("*").alias("n")).collect()}

    placed, counted = weighed(bounds)
    most = 2 * total / wanted
    over = sorted(k for k, (b, n) in counted.items() if b > most and n > 1)
    if over:  # divide overfull ranges by samples of their own
        inside = sum(counted[k][0] for k in over)
        more = splitters(placed.where(F.col("_range").isin(over)), min(4 * len(over), wanted) + 1, inside, oversample * 4)
        placed, counted = weighed(united(bounds, more))
    before, at = [], 0
    for k in sorted(counted):
        before.append((k, at))
        at += counted[k][0]
    spark = docs.sparkSession
    starts = F.broadcast(spark.createDataFrame(before, "_range int, _start long"))  # a row for each range

    within = Window.partitionBy("_range").orderBy("_key", "_row", "doc_id")
    group = Window.partitionBy("_range", "_key")
    placed = (
        placed.join(starts, "_range", "left")
        .withColumn("_end", F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_start"))
        .withColumn("_first", F.min(F.col("_end") - F.col("_size")).over(group))
        .withColumn("_last", F.max("_end").over(group))
        .withColumn("_n", F.row_number().over(within))
    )
    one = total / shards if total else 1.0
    middle = F.when(F.col("_whole") & ((F.col("_last") - F.col("_first")) <= one * together), (F.col("_first") + F.col("_last")) / 2).otherwise(F.col("_end") - F.col("_size") / 2)
    placed = placed.withColumn("shard", F.least(F.floor(middle / one), F.lit(shards - 1)).cast("int"))
    placed = cut(placed.select("doc_id", "_size", "_crc", "_range", "_n", "shard"))
    pieces = placed.groupBy("shard", "_range").agg(F.min("_n").alias("_low"), F.count("*").alias("_rows")).collect()  # about ranges + shards rows
    offsets, filled = [], dict.fromkeys(range(shards), 0)
    for p in sorted(pieces, key=lambda p: (p["_range"], p["_low"])):
        offsets.append((p["shard"], p["_range"], filled[p["shard"]] - p["_low"]))
        filled[p["shard"]] += p["_rows"]
    moves = F.broadcast(spark.createDataFrame(offsets, "shard int, _range int, _move long"))
    return placed.join(moves, ["shard", "_range"]).select(
        "doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "shard", (F.col("_n") + F.col("_move")).cast("long").alias("slot")
    )
