"""From marks to points, best points, winners and sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def threshold_points(time: Column, limits: Sequence[tuple[int, int]]) -> Column:
    """Most points whose limit the time keeps, else 0. Integers, so a time exactly at a limit keeps it."""
    steps = F.array(*(F.struct(F.lit(p).cast("long").alias("p"), F.lit(t).cast("long").alias("t")) for p, t in limits))
    kept = F.transform(F.filter(steps, lambda s: time <= s["t"]), lambda s: s["p"])
    return F.coalesce(F.array_max(kept), F.lit(0).cast("long"))


def threshold_join(marks: DataFrame, thresholds: DataFrame, on: Sequence[str], time: str) -> DataFrame:
    """Add ``points`` by a threshold table (on..., points, limit): one row for each key is joined, so no range join is planned."""
    rows = thresholds.groupBy(*on).agg(F.collect_list(F.struct("limit", "points")).alias("_steps"))
    kept = F.transform(F.filter("_steps", lambda s: F.col(time) <= s["limit"]), lambda s: s["points"])
    return marks.join(rows, list(on), "left").withColumn("points", F.coalesce(F.array_max(kept), F.lit(0)).cast("long")).drop("_steps")


def best_marks(scored: DataFrame, keys: Sequence[str], points: str, time: str, order: str) -> DataFrame:
    """The row with most points for each key, then least time (null first), then first arrival."""
    w = Window.partitionBy(*keys).orderBy(F.desc(points), F.asc_nulls_first(time), F.asc(order))
    return scored.where(F.col(points).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def winners(marks: DataFrame, keys: Sequence[str], name: str, time: str, order: str) -> DataFrame:
    """(keys, winner, best): least positive time, the first to arrive on ties. A partial aggregate, so no group is gathered."""
    timed = marks.where(F.col(time) > 0)
    return timed.groupBy(*keys).agg(F.min_by(name, F.struct(time, order)).alias("winner"), F.min(time).alias("best"))


def leg_scores(scored: DataFrame, keys: Sequence[str], leg: str, legs: Sequence[str], points: str) -> DataFrame:
    """Most points in each leg and over all; rows without points count nowhere."""
    paid = scored.where(F.col(points) > 0)
    each = [F.max(F.when(F.col(leg) == v, F.col(points))).alias(f"leg_{v.lower()}") for v in legs]
    return paid.groupBy(*keys).agg(*each, F.max(points).alias("combined"))


def merge_maps(a: Column, b: Column) -> Column:
    """Union of two score maps, the larger value on both."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(x, y))


def sequences(best: DataFrame, keys: Sequence[str], points: str, restricted: Column) -> DataFrame:
    """(keys, seq): all free events' points and the best restricted one's (0 without any), descending."""
    grouped = best.groupBy(*keys).agg(
        F.collect_list(F.when(~restricted, F.col(points))).alias("_free"), F.max(F.when(restricted, F.col(points))).alias("_one")
    )
    seq = F.sort_array(F.array_append("_free", F.coalesce("_one", F.lit(0).cast("long"))), asc=False)
    return grouped.select(*keys, seq.alias("seq"))


def top_sum(seq: Column, n: int) -> Column:
    return F.aggregate(F.slice(seq, 1, n), F.lit(0).cast("long"), lambda a, x: a + x)


def cumulative_keys(seqs: DataFrame) -> DataFrame:
    """Add k3..k6, sums of the first three to six: each breaks ties of the one before."""
    return seqs.withColumns({f"k{n}": top_sum(F.col("seq"), n) for n in (3, 4, 5, 6)})


def sequence_display(seq: Column) -> Column:
    """First three joined by +, then a bar and the fourth to sixth; 0 if empty."""
    words = lambda start, n: F.transform(F.slice(seq, start, n), lambda x: x.cast("string"))
    rest = F.when(F.size(seq) > 3, F.concat(F.lit(" | "), F.array_join(words(4, 3), " "))).otherwise("")
    return F.when(F.size(seq) == 0, "0").otherwise(F.concat(F.array_join(words(1, 3), "+"), rest))


def in_top(best: DataFrame, keys: Sequence[str], event: str, points: str, restricted: Column, n: int = 3) -> DataFrame:
    """Add ``in_top``: whether the event is one of the n that count; of restricted ones only the best, free ones first on ties."""
    flagged = best.withColumn("_r", restricted)
    only = Window.partitionBy(*keys, "_r").orderBy(F.desc(points), F.asc(event))
    usable = flagged.withColumn("_u", ~F.col("_r") | (F.row_number().over(only) == 1))
    place = Window.partitionBy(*keys).orderBy(F.desc("_u"), F.desc(points), F.asc("_r"), F.asc(event))
    return usable.withColumn("in_top", F.col("_u") & (F.row_number().over(place) <= n)).drop("_r", "_u")


def event_sequence(best: DataFrame, keys: Sequence[str], event: str, points: str, restricted: Column) -> DataFrame:
    """(keys, events): the events whose points make up the sequence, in its order, without the filling 0.

    Among equal points free events come before the restricted one, greater events before
    smaller ones; of restricted events the greatest of the most points counts.
    """
    one = F.struct(F.col(points), F.lit(False).alias("free"), F.col(event).alias("event"))
    free = F.struct(F.col(points), F.lit(True).alias("free"), F.col(event).alias("event"))
    paid = best.where(F.col(points) > 0).groupBy(*keys).agg(
        F.collect_list(F.when(~restricted, free)).alias("_free"), F.max(F.when(restricted, one)).alias("_one")
    )
    merged = F.sort_array(F.array_compact(F.array_append("_free", F.col("_one"))), asc=False)
    return paid.select(*keys, F.transform(merged, lambda x: x["event"]).alias("events"))
