"""Numbers, neighbours and carried values over sorted rows, with no group in one task.

Rows are dealt by ranges of (group, order) and written once, so that ranges stay what
they are when tasks run again. A range does its own part; what it must know of the
ranges before or after it is one row of each range and group: a count, the first and
last value, the last header. These few rows are joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def ranged(rows: DataFrame, by: Sequence[str], order: Sequence[str], parts: int | None = None) -> DataFrame:
    """The rows with ``_part`` (their range of ``by`` and ``order``) and ``_tie``, which orders equal rows. Without ``parts`` the ranges' number follows their size."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*by, *order, "_tie"]
    dealt = tied.repartitionByRange(parts, *keys) if parts else tied.repartitionByRange(*keys)
    return written(dealt.withColumn("_part", F.spark_partition_id()))


def _local(by: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy("_part", *by).orderBy(*order, "_tie")


def _with_bounds(rows: DataFrame, by: Sequence[str], bounds: DataFrame) -> DataFrame:
    """Join facts of each group and range, null groups included."""
    names = ["_part", *by]
    facts = bounds.select(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(names)), *(c for c in bounds.columns if c not in names))
    joined = rows.join(facts, [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(names)])
    return joined.drop(*(f"_b{i}" for i in range(len(names))))


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add the row's number in its group, from 1. The groups are those that the rows were ranged by, or parts of them."""
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_count"))
    counts = counts.withColumn("_ahead", F.coalesce(F.sum("_count").over(ahead), F.lit(0))).drop("_count")
    own = F.row_number().over(_local(by, order)).cast("long")
    return _with_bounds(rows.withColumn(out, own), by, counts).withColumn(out, F.col(out) + F.col("_ahead")).drop("_ahead")


def neighbours(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str | Column, before: str, after: str) -> DataFrame:
    """Add the value of the row before and after in the group, null where there is none."""
    valued = rows.withColumn("_value", F.struct((F.col(value) if isinstance(value, str) else value).alias("v")))
    at = F.struct(*order, "_tie")
    ends = valued.groupBy("_part", *by).agg(F.min_by("_value", at).alias("_first"), F.max_by("_value", at).alias("_last"))
    across = Window.partitionBy(*by).orderBy("_part")
    ends = ends.select("_part", *by, F.lag("_last").over(across).alias("_earlier"), F.lead("_first").over(across).alias("_later"))
    w = _local(by, order)
    local = valued.withColumns({"_prev": F.lag("_value").over(w), "_next": F.lead("_value").over(w)})
    joined = _with_bounds(local, by, ends).withColumns({before: F.coalesce("_prev", "_earlier")["v"], after: F.coalesce("_next", "_later")["v"]})
    return joined.drop("_value", "_prev", "_next", "_earlier", "_later")


def carried(rows: DataFrame, by: Sequence[str], order: Sequence[str], header: Column, out: str, seed: Column | None = None) -> DataFrame:
    """Add the last header that isn't null at or before the row in its group, else the seed."""
    marked = rows.withColumn("_header", header)
    at = F.when(F.col("_header").isNotNull(), F.struct(*order, "_tie"))
    last = marked.groupBy("_part", *by).agg(F.max_by("_header", at).alias("_last"))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("_part", *by, F.last("_last", ignorenulls=True).over(ahead).alias("_ahead"))
    own = F.last("_header", ignorenulls=True).over(_local(by, order).rowsBetween(Window.unboundedPreceding, 0))
    held = F.coalesce("_own", "_ahead")
    joined = _with_bounds(marked.withColumn("_own", own), by, last)
    return joined.withColumn(out, held if seed is None else F.coalesce(held, seed)).drop("_header", "_own", "_ahead")


def counted(rows: DataFrame, by: Sequence[str], order: Sequence[str], starts: Column, out: str) -> DataFrame:
    """Add how many rows at or before this one in its group begin something."""
    marked = rows.withColumn("_start", F.when(starts, 1).otherwise(0).cast("long"))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = marked.groupBy("_part", *by).agg(F.sum("_start").alias("_total"))
    total = total.select("_part", *by, F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_ahead"))
    own = F.sum("_start").over(_local(by, order).rowsBetween(Window.unboundedPreceding, 0))
    return _with_bounds(marked.withColumn(out, own), by, total).withColumn(out, F.col(out) + F.col("_ahead")).drop("_start", "_ahead")


def plain(rows: DataFrame) -> DataFrame:
    """The rows without the ranges' columns."""
    return rows.drop("_part", "_tie")
