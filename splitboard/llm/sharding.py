"""Sharding by weighted rendezvous hashing.

Each record key draws a hash for every shard and goes to the shard with the best
score, -weight / ln(u). The key, the shard and its weight alone decide, so one more
shard takes rows only into itself, and a changed weight moves rows only to or from
that shard. Slots number the rows of a shard without gaps: rows are numbered
inside (shard, hash bucket) and the buckets' counts give the offsets, so no shard is
gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets that a shard is numbered in.
BUCKETS = 4096


def rendezvous(key: Column, weights: Sequence[float], salt: str = "shard") -> Column:
    """The shard (from 0) that wins the key; shards of weight 0 never do."""
    races = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{salt}:{shard}")), 12)
            u = (bits.cast("double") + 0.5) / float(1 << 52)
            races.append(F.struct((-F.log(u) / float(weight)).alias("cost"), F.lit(shard).alias("shard")))
    if not races:
        raise ValueError("no shard has a weight above 0")
    return F.array_min(F.array(*races)).getField("shard")


def shard_records(
    docs: DataFrame,
    weights: Sequence[float] = (1.0,) * 8,
    grown: Sequence[float] | None = None,
    id_col: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per record: id, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    ``grown`` are the weights after a change (default: one more shard of the last
    weight). A null text has no bytes; a null key is a key like any other. Repeated
    rows share a shard and have slots of their own, in order of key, size and
    checksum. Texts are measured whole, whatever their length. An empty table gives no
    rows; other columns, whatever their names, are not read.
    """
    grown = grown if grown is not None else [*weights, weights[-1]]
    key = F.col(id_col)
    bucket = F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(BUCKETS)).cast("int")
    placed = docs.select(
        key.alias("id"),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, grown).alias("grown_shard"),
        bucket.alias("bucket"),
    )
    # Shard and bucket come from the key alone, so this pass reads no text.
    counts = docs.select(rendezvous(key, weights).alias("shard"), bucket.alias("bucket")).groupBy("shard", "bucket").count()
    running = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("count").over(running), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy(F.asc_nulls_last("id"), "size", "text_crc32")
    return (
        placed.withColumn("place", F.row_number().over(inside))
        .join(offsets, ["shard", "bucket"])
        .select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("key").alias("law"),
            "shard",
            (F.col("start") + F.col("place") - 1).alias("slot"),
            "grown_shard",
        )
    )
