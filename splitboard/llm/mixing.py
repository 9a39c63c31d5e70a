"""Mixing sources to target weights by hash thresholds.

Every document has a fixed hash. A source's budget becomes a threshold: documents
whose hash lies below it are taken once more than the rest. The threshold is found
by histograms: sizes are summed by source and leading hash bits, the bucket that
the budget ends in is refined by its next bits, and so on until one hash value is
left. Documents are never sorted, and a source that holds a third of all rows is
pre-aggregated like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, words

#: Bits of the hash, and how many each histogram resolves.
BITS, STEP = 48, 12
#: Parts that each row of a per-source table is copied into if the table is too large to broadcast.
SALTS = 64


def mix_hash(key: Column) -> Column:
    """48 hash bits of the key as a long; a null key has a hash too."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """Add ``target`` to (source, source_size).

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes; a target stops at ``cap`` times its source's size and
    what is over goes to the others by weight. Sorted by cap per weight, the sources
    that stop are the first ones, so one running sum finds the level of the rest.
    The windows here are over sources, one row each.
    """
    ordered = Window.orderBy(F.asc_nulls_last("source"))
    place = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place.cast("int") + 1).cast("long"))
    ranked = ranked.withColumn("stop", F.lit(cap) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("stop") / F.col("weight"), F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("source_size").over(everything)
    level = ranked.select(
        "*",
        (
            (total * F.lit(share) - F.coalesce(F.sum("stop").over(before), F.lit(0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        ).alias("level"),
    )
    return level.select(
        "source",
        "source_size",
        F.least(
            F.col("stop").cast("double"), F.col("weight") * F.max("level").over(everything)
        ).alias("target"),
    )


def _with_source(rows: DataFrame, dim: DataFrame, small: bool, extra: Column | None = None) -> DataFrame:
    """Join per-source facts to rows, null sources included, without gathering a source."""
    dim = dim.withColumnRenamed("source", "its_source")
    on = rows.source.eqNullSafe(dim.its_source)
    if small:
        joined = rows.join(F.broadcast(dim), on)
    else:
        dim = dim.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("part", F.pmod(F.col("h"), F.lit(SALTS)).cast("int"))
        joined = rows.join(dim, rows.source.eqNullSafe(dim.its_source) & (rows.part == dim.salt)).drop("salt", "part")
    return joined.drop("its_source")


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    share: float = 1.0,
    cap: int = 3,
) -> DataFrame:
    """One row per document: id, ``source``, ``size`` (words; null text: 0), ``source_size``, ``target``, ``copies``, ``taken``.

    ``copies`` is how often the mix takes the document and ``taken`` the words that
    makes. Every document of a source is taken floor(target / source_size) times,
    and those with the smallest hashes once more; the one that the budget ends in
    is taken if at least half of it fits. Rows with one identifier share a hash and
    so a decision. Null sources form a source of their own. Texts are counted whole,
    whatever their length, and other columns, whatever their names, are not looked at.
    An empty table gives no rows; a source without words has target 0.
    """
    sized = cut(
        docs.select(
            F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"), mix_hash(F.col(id_col)).alias("h")
        )
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, weights, share, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goals = goals.withColumn("base", F.floor(rate)).withColumn(
        "budget", F.col("target") - F.col("base") * F.col("source_size")
    )
    goals = cut(goals)
    small = goals.count() <= BROADCAST_ROWS

    # bound: the bucket that holds the end of the budget, as its leading bits, and the sizes before it.
    bound = goals.select("source", "budget", F.lit(0).cast("long").alias("bits"), F.lit(0).cast("long").alias("spent"))
    for left in range(BITS - STEP, -1, -STEP):
        inside = _with_source(sized, bound, small).where(F.shiftright("h", left + STEP) == F.col("bits"))
        hist = inside.groupBy("source", "budget", "spent", F.shiftright("h", left).alias("bucket")).agg(F.sum("size").alias("held"))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("after", F.col("spent") + F.sum("held").over(run))
        bound = hist.where((F.col("after") > F.col("budget")) & (F.col("after") - F.col("held") <= F.col("budget"))).select(
            "source", "budget", F.col("bucket").alias("bits"), (F.col("after") - F.col("held")).alias("spent"), "held"
        )
        if left:
            bound = cut(bound.drop("held"))
    # Of the last hash value, take it if half of it fits. Without a bound all is taken.
    fits = 2 * F.col("spent") + F.col("held") <= 2 * F.col("budget")
    ends = bound.select(F.col("source").alias("end_source"), (F.col("bits") + F.when(fits, 1).otherwise(0)).alias("threshold"))
    goals = goals.join(ends, goals.source.eqNullSafe(ends.end_source), "left").select(
        "source", "source_size", "target", "base", F.coalesce("threshold", F.lit(1 << BITS)).alias("threshold")
    )
    copies = F.col("base") + (F.col("h") < F.col("threshold")).cast("long")
    return _with_source(sized, goals, small).select(
        F.col("id").alias(id_col),
        "source",
        "size",
        "source_size",
        "target",
        # A whole rate leaves no budget, and a document without words is never worth a copy beyond the cap.
        F.least(copies, F.lit(cap)).alias("copies"),
        (F.col("size") * F.least(copies, F.lit(cap))).alias("taken"),
    )
