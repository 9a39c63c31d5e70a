"""Tables that change: upserts, histories, replacements, as functions from old and new rows to the new table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .score import threshold_join


def upsert_min(old: DataFrame, new: DataFrame, key: Sequence[str], time: str, order: str) -> DataFrame:
    """The row with the least time for each key; null loses, an equal time keeps the older row. No retraction."""
    both = old.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.asc_nulls_last(time), F.asc(order))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_by(rows: DataFrame, key: Sequence[str], *order: str) -> DataFrame:
    """The newest row for each key."""
    w = Window.partitionBy(*key).orderBy(*(F.desc_nulls_last(o) for o in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def replace_partition(old: DataFrame, new: DataFrame, part: str) -> DataFrame:
    """New rows replace all old rows of the parts that they belong to; without new rows nothing changes."""
    return old.join(new.select(part).distinct(), part, "left_anti").unionByName(new)


def history(rows: DataFrame, key: str, value: str, seen: str) -> DataFrame:
    """One row for each key and value with when it was first and last seen, and how often."""
    return rows.groupBy(key, value).agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"), F.count(F.lit(1)).alias("n"))


def conflict_status(events: DataFrame, key: str, status: str, at: str, pending: str = "pending") -> DataFrame:
    """Newest status of each conflict; those still pending by time of creation."""
    newest = events.groupBy(key).agg(F.max_by(status, at).alias("status"), F.min(at).alias("created"))
    return newest.where(F.col("status") == pending).orderBy("created", key)


def join_update(rows: DataFrame, fixes: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns replaced where a fix has a value."""
    named = fixes.select(*key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = rows.join(named, list(key), "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def pending(starts: DataFrame, results: DataFrame, event: Sequence[str], gender: str, person: Sequence[str], seq: str) -> DataFrame:
    """Start rows whose event is not over.

    An event's place is the least ``seq`` of its results; it is over if a later one
    has been seen or places are unknown. In the last one, a start row is dropped if
    that person has a result of the last place. A start row without gender counts as
    any gender.
    """
    total = results.agg(F.max(seq).alias("_max"))
    events = results.groupBy(*event, gender).agg(F.min(seq).alias("_seq")).crossJoin(total)  # one row
    over = events.where("_seq IS NULL OR _max IS NULL OR _seq < _max")
    named = starts.where(F.col(gender).isNotNull() & (F.col(gender) != ""))
    blank = starts.where(F.col(gender).isNull() | (F.col(gender) == ""))
    left = named.join(over.select(*event, gender).distinct(), [*event, gender], "left_anti").unionByName(
        blank.join(over.select(*event).distinct(), list(event), "left_anti")
    )
    active = events.where("_seq = _max").select(*event).distinct().withColumn("_active", F.lit(True))
    done = results.crossJoin(total).where(F.col(seq) == F.col("_max")).select(*person, *event).distinct().withColumn("_done", F.lit(True))
    joined = left.join(active, list(event), "left").join(done, [*person, *event], "left")
    return joined.where(~(F.coalesce("_active", F.lit(False)) & F.coalesce("_done", F.lit(False)))).drop("_active", "_done")


def with_entry_points(starts: DataFrame, thresholds: DataFrame, event: Sequence[str], gender: str, time: str) -> DataFrame:
    """Add ``entry_points``: what the entry time of a start would earn; 0 without one. A start without gender is scored as M.

    ``thresholds`` has the event's columns, the gender, points and limit.
    """
    known = F.when(F.coalesce(gender, F.lit("")) == "", "M").otherwise(F.col(gender))
    on = [*event, "_gender"]
    scored = threshold_join(starts.withColumn("_gender", known), thresholds.withColumnRenamed(gender, "_gender"), on, time)
    return scored.withColumn("entry_points", F.when(F.col(time) > 0, F.col("points")).otherwise(0)).drop("_gender", "points")


DECISIONS = ("same_person", "different_person")


def resolve_conflicts(events: DataFrame, decisions: DataFrame, key: str, status: str, at: str, pending: str = "pending") -> DataFrame:
    """The events and one for each decision on a conflict that is pending; others (unknown word, unknown or settled conflict) go.

    ``decisions`` has the events' columns; of several on one conflict the first by ``at`` counts.
    """
    known = decisions.where(F.col(status).isin(*DECISIONS))
    first = known.groupBy(key).agg(F.min_by(F.struct(*[c for c in known.columns if c != key]), at).alias("_d")).select(key, "_d.*")
    valid = first.join(conflict_status(events, key, status, at, pending).select(key), key, "left_semi")
    return events.unionByName(valid, allowMissingColumns=True)


def find(rows: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the values; a null value finds nulls."""
    for column, value in values.items():
        rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
    return rows


def create(table: DataFrame, rows: DataFrame, id_col: str) -> DataFrame:
    """The table and the rows, each with an identifier above all others; unique, with gaps, so nothing is sorted."""
    top = table.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long").alias("_top"))
    new = rows.withColumn("_n", F.monotonically_increasing_id()).crossJoin(top)  # one row
    return table.unionByName(new.withColumn(id_col, F.col("_top") + F.col("_n") + 1).drop("_top", "_n"), allowMissingColumns=True)


def update(table: DataFrame, id_col: str, value, **columns) -> DataFrame:
    """The table with columns of one row set."""
    return table.withColumns({c: F.when(F.col(id_col) == value, F.lit(v)).otherwise(F.col(c)) for c, v in columns.items()})


def upsert_unmatched(old: DataFrame, new: DataFrame, key: Sequence[str], time: str, order: str) -> DataFrame:
    """As ``upsert_min``, but a row with a null in its key equals no other, so all of those stay."""
    both = old.unionByName(new, allowMissingColumns=True)
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(c).isNotNull()
    return upsert_min(old.where(whole), new.where(whole), key, time, order).unionByName(both.where(~whole))


def add_override(overrides: DataFrame, new: DataFrame, key: Sequence[str], id_col: str) -> DataFrame:
    """Overrides with new ones in place of those of their key; null keys are one key, so open ones don't pile up."""
    both = overrides.unionByName(new, allowMissingColumns=True)
    return latest_by(both, key, id_col)
