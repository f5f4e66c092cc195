"""Sharding by rendezvous hashing of record keys over weighted shards, with DataFrame functions alone.

Each shard bids for a key: with a uniform u from the hash of key and shard, the bid is weight / -ln(u), and the highest
bid wins. So a key leaves its shard only for a new one that outbids it: one more shard takes rows only into itself.
Law `key`: id and shard list alone decide. Null ids are one key. Repeated ids go to one shard, as the law has it; their
slots are numbered in parts by id and content, so that rows without id aren't numbered by one task. Ties go to the
smaller shard number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from treescan.llm.common import shuffle_partitions

#: Slots are numbered in this many parts of each shard at least, so that no task numbers a whole shard.
PARTS = 256


def winner(key: Column, weights: list[float]) -> Column:
    """The shard (0, 1, ...) of highest bid for a key."""

    def bid(shard: int) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(2**53)
        return F.struct((weights[shard] / -F.ln(u)).alias("bid"), F.lit(-shard).alias("shard"))

    return (-F.greatest(*map(bid, range(len(weights))))["shard"] if len(weights) > 1 else F.lit(0)).cast("int")


def shard_rows(docs: DataFrame, weights: list[float], grown: list[float] | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot (gapless from 0 in each shard), grown_shard (by the weights ``grown``)."""
    if not weights or min([*weights, *(grown or [])]) <= 0:
        raise ValueError("weights must be positive")
    key = F.col(id_col)
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    part = F.pmod(F.xxhash64(key, crc, size), F.lit(max(PARTS, shuffle_partitions(docs.sparkSession)))).cast("int").alias("part")
    placed = docs.select(
        key.alias(id_col),
        size.alias("size"),
        crc.alias("text_crc32"),
        F.lit("key").alias("law"),
        winner(key, weights).alias("shard"),
        (winner(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
        part,
    )
    # shards x parts rows: small enough to broadcast at any size of docs
    counts = docs.select(winner(key, weights).alias("shard"), part).groupBy("shard", "part").count()
    before = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("before"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy(id_col, "size", "text_crc32")) - 1
    return placed.withColumn("own", own).join(F.broadcast(before), ["shard", "part"]).select(id_col, "size", "text_crc32", "law", "shard", (F.col("own") + F.col("before")).cast("long").alias("slot"), "grown_shard")


def move_share(sharded: DataFrame) -> Column:
    """Share of rows that the grown shard list moves."""
    return reduce(lambda a, b: a / b, [F.sum((F.col("shard") != F.col("grown_shard")).cast("long")), F.count("*")])
