"""Reports: tallies, roll-ups, pivots and data-quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan


def tally_sets(rows: DataFrame, value: str, group: str, flags: dict[str, Column]) -> DataFrame:
    """Counts of each flag by value and by (group, value) in one pass; a blank value is called by name."""
    named = rows.withColumn(value, F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit("Ferdi/Bilinmiyor")))
    counts = [F.count_if(c).alias(k) for k, c in flags.items()]
    sets = named.groupingSets([[value], [group, value]], group, value)
    return sets.agg(F.grouping(group).cast("long").alias("overall"), *counts, F.count(F.lit(1)).alias("total"))


def rollup_totals(rows: DataFrame, keys: Sequence[str], flags: dict[str, Column]) -> DataFrame:
    """Counts by the keys with sub- and grand totals; ``level`` tells them apart."""
    counts = [F.count_if(c).alias(k) for k, c in flags.items()]
    return rows.rollup(*keys).agg(F.grouping_id().cast("long").alias("level"), *counts, F.count(F.lit(1)).alias("total"))


def pivot_min(rows: DataFrame, keys: Sequence[str], event: str, events: Sequence[str], time: str) -> DataFrame:
    """One column for each event with the least time. The events are given, so no pass looks for them."""
    return rows.groupBy(*keys).agg(*(F.min(F.when(F.col(event) == e, F.col(time))).alias(f"t_{i}") for i, e in enumerate(events, 1)))


def unpivot(rows: DataFrame, keys: Sequence[str], columns: dict[str, str], event: str, value: str) -> DataFrame:
    """Back to one row for each event that has a value."""
    pairs = ", ".join(f"'{name}', {column}" for column, name in columns.items())
    return rows.selectExpr(*keys, f"stack({len(columns)}, {pairs}) as ({event}, {value})").where(F.col(value).isNotNull())


def neighbour_anomalies(rows: DataFrame, by: Sequence[str], time: str, order: Sequence[str], ratio: float = 1.45, low: float = 0.6, high: float = 3.0) -> DataFrame:
    """Times far from the mean of both neighbours or from the group's median; groups of three at least. A group is spread over ranges of ``order``."""
    timed = scan.neighbours(scan.ranged(rows.where(F.col(time) > 0), by, order), by, order, time, "_before", "_after")
    near = (F.col("_before") + F.col("_after")) / 2
    t = F.col(time)
    # One row for each group; a percentile's partial states hold distinct times, not rows.
    whole = timed.groupBy(*(F.col(c).alias(f"_b{i}") for i, c in enumerate(by))).agg(F.median(time).alias("_median"), F.count(F.lit(1)).alias("_n"))
    same = [F.col(c).eqNullSafe(F.col(f"_b{i}")) for i, c in enumerate(by)]
    seen = timed.withColumn("_near", near).join(whole.where("_n >= 3"), same)
    odd = F.coalesce((t < F.col("_near") / ratio) | (t > F.col("_near") * ratio), F.lit(False))
    far = (t < low * F.col("_median")) | (t > high * F.col("_median"))
    return seen.where(odd | far).select(*rows.columns)


def outliers(rows: DataFrame, event: str, time: str, limits: DataFrame, default: tuple[int, int]) -> DataFrame:
    """Least and greatest time of each event, and whether they lie outside its limits (event, lo, hi)."""
    ends = rows.groupBy(event).agg(F.min(time).alias("least"), F.max(time).alias("greatest"))
    joined = ends.join(limits, event, "left")
    lo, hi = F.coalesce("lo", F.lit(default[0])), F.coalesce("hi", F.lit(default[1]))
    return joined.select(event, "least", "greatest", (F.col("least") < lo).alias("too_low"), (F.col("greatest") > hi).alias("too_high"))


def duplicate_names(rows: DataFrame, norm: Column, identity: Sequence[Column], id_col: str) -> DataFrame:
    """Normalised names with more than one identity, and their identifiers in order."""
    grouped = rows.withColumn("norm", norm).groupBy("norm").agg(
        F.count_distinct(F.struct(*identity)).alias("identities"), F.array_join(F.transform(F.array_sort(F.collect_set(id_col)), lambda x: x.cast("string")), ",").alias("ids")
    )
    return grouped.where("identities > 1")


def stats(rows: DataFrame, person: Sequence[str], leg: str) -> DataFrame:
    """Distinct persons, rows and the legs seen."""
    legs = F.array_join(F.array_sort(F.collect_set(leg)), ",")
    return rows.agg(F.count_distinct(*person).alias("persons"), F.count(F.lit(1)).alias("n_rows"), legs.alias("legs"))


def top_of_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= n)


def _spread(rows: DataFrame, by: Sequence[str], order: Sequence[str], spread: str) -> DataFrame:
    """The rows with the part of their group that a task takes.

    "ranges": by size, whatever the groups are, at the price of a written table.
    "pages": by the values of the first column of ``order``. A third way, "whole", is
    for groups that are known to be small, as a document's lines are.
    """
    if spread == "ranges":
        return scan.ranged(rows, by, order)
    return rows.withColumns({"_part": F.col(order[0]), "_tie": F.lit(0)})


def carry_forward(rows: DataFrame, by: Sequence[str], order: Sequence[str], header: Column, out: str, seed: Column | None = None, spread: str = "ranges") -> DataFrame:
    """Add the last header at or before each row, else the seed. ``spread`` says how a group is dealt to tasks."""
    if spread != "whole":
        return scan.plain(scan.carried(_spread(rows, by, order, spread), by, order, header, out, seed))
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(header, ignorenulls=True).over(w)
    return rows.withColumn(out, last if seed is None else F.coalesce(last, seed))


def blocks(rows: DataFrame, by: Sequence[str], order: Sequence[str], starts: Column, out: str = "block", spread: str = "ranges") -> DataFrame:
    """Number the blocks that begin at each start row; rows before the first are block 0. ``spread`` as in ``carry_forward``."""
    if spread != "whole":
        return scan.plain(scan.counted(_spread(rows, by, order, spread), by, order, starts, out))
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.sum(F.when(starts, 1).otherwise(0)).over(w).cast("long"))


def before_first_gap(rows: DataFrame, by: Sequence[str], number: str, most: int, start: int = 0) -> DataFrame:
    """Rows of each group up to its first gap of ``most`` missing numbers, counted from ``start``; numbers of any range, spread over tasks."""
    dealt = scan.ranged(rows.select(*by, number).where(F.col(number) > start).distinct(), by, [number])
    seen = scan.neighbours(dealt, by, [number], number, "_before", "_after")
    at = F.when(F.col(number) - F.coalesce("_before", F.lit(start)) > most, F.coalesce("_before", F.lit(start))).when(F.col("_after") - F.col(number) > most, F.col(number))
    stops = seen.groupBy(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by))).agg(F.min(at).alias("_stop"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)]
    return rows.join(stops, same).where((F.col(number) > start) & (F.col("_stop").isNull() | (F.col(number) <= F.col("_stop")))).select(*rows.columns)


def event_map(rows: DataFrame, keys: Sequence[str], event: Sequence[str], points: str, meta: Sequence[str]) -> DataFrame:
    """(keys, meta..., scores): a map from event to its most points, above 0; meta of the row with the least event."""
    at = F.struct(*event)
    best = rows.where(F.col(points) > 0).groupBy(*keys, *event).agg(F.max(points).alias(points), F.min(F.struct(*meta)).alias("_m"))
    grouped = best.groupBy(*keys).agg(F.min_by("_m", at).alias("_m"), F.map_from_entries(F.collect_list(F.struct(at, F.col(points)))).alias("scores"))
    return grouped.select(*keys, "_m.*", "scores")


def leg_map(rows: DataFrame, keys: Sequence[str], event: Sequence[str], leg: str, legs: Sequence[str], points: str, order: str, first: Sequence[str], last: Sequence[str]) -> DataFrame:
    """Most points by keys and event in each leg and over all, above 0; ``first`` columns of the person's first row, ``last`` ones of its last row that has them."""
    paid = rows.where(F.col(points) > 0)
    each = [F.max(F.when(F.col(leg) == v, F.col(points))).alias(f"leg_{v.lower()}") for v in legs]
    scores = paid.groupBy(*keys, *event).agg(*each, F.max(points).alias("combined"))
    has = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")).isNotNull()
    newest = [F.max_by(F.when(has(c), F.col(c)), F.when(has(c), F.col(order))).alias(c) for c in last]
    meta = paid.groupBy(*keys).agg(F.min_by(F.struct(*first), order).alias("_m"), *newest)
    return scores.join(meta.select(*keys, "_m.*", *last), list(keys))


def keys_by(rows: DataFrame, key: str, by: str) -> DataFrame:
    """Distinct keys by group, in order."""
    return rows.groupBy(by).agg(F.count_distinct(key).alias("n_keys")).orderBy(by)


def names_by(rows: DataFrame, name: str, by: Sequence[str]) -> DataFrame:
    """The set of names (trimmed, small letters) of each group, in order. For lists of bounded size."""
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(F.trim(F.lower(name)))).alias("names"))


def athlete_sheet(rows: DataFrame, keys: Sequence[Column], info: Sequence[str], place: Sequence[str], events: dict[str, Column], time: str, shown: str, order: str) -> DataFrame:
    """One row a person, a column an event with the text of its least time, as sheets have it.

    ``info`` and ``place`` are of the person's first row; a person whose first row has
    no ``place`` (city first) takes all of them from the first that has one. ``events``
    maps column to condition. One aggregate, no pass to look for events.
    """
    blank = F.nullif(F.trim(F.col(place[0]).cast("string")), F.lit(""))
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    with_place = F.when(blank.isNotNull(), F.col(order))
    best = [F.min_by(F.when(c, F.col(shown)), F.when(c & F.col(time).isNotNull(), F.struct(time, order))).alias(e) for e, c in events.items()]
    grouped = rows.groupBy(*named).agg(
        F.min_by(F.struct(*info, *place), order).alias("_i"), F.min_by(F.struct(*place), with_place).alias("_p"), *best
    )
    kept = {c: F.when(F.nullif(F.trim(F.col(f"_i.{place[0]}").cast("string")), F.lit("")).isNull() & F.col("_p").isNotNull(), F.col(f"_p.{c}")).otherwise(F.col(f"_i.{c}")) for c in place}
    return grouped.select(*(F.col(f"_i.{c}").alias(c) for c in info), *(v.alias(c) for c, v in kept.items()), *events)


def quality_report(rows: DataFrame, checks: dict[str, tuple[str, Column]], norm, order: str) -> DataFrame:
    """(``check``, ``value``): values that a check (column, condition) flags, once for each lookup form, its first spelling to arrive."""
    each = None
    for check, (column, flag) in checks.items():
        found = rows.where(flag).groupBy(norm(F.col(column)).alias("_k")).agg(F.min_by(column, order).alias("value")).select(F.lit(check).alias("check"), "value")
        each = found if each is None else each.unionByName(found)
    return each.orderBy("check", F.lower("value"), "value")
