"""Ranks, quotas with boundary ties, nested selection and its validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan

KEYS = ("k3", "k4", "k5", "k6")


def _by_cells(rows: DataFrame, cell: Sequence[str], decide) -> DataFrame:
    """Add what ``decide`` adds to the cells of the rows: one row for each value of the ``cell`` columns, with their number ``_size``.

    Ranks and quotas depend on the keys alone, so they are found over the few distinct
    keys, not by sorting rows.
    """
    cells = decide(rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_size")))
    named = cells.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(cell)), *(c for c in cells.columns if c not in (*cell, "_size")))
    return rows.join(named, [F.col(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(cell)]).drop(*(f"_c{i}" for i in range(len(cell))))


def _first(by: Sequence[str]) -> Column:
    """A cell's rank: one more than the rows of better keys."""
    w = Window.partitionBy(*by).orderBy(*(F.desc(k) for k in KEYS))
    # Equal keys (of other regions, say) are peers: all of them are counted, then taken off.
    return F.sum("_size").over(w) - _peers(by) + 1


def _peers(by: Sequence[str]) -> Column:
    return F.sum("_size").over(Window.partitionBy(*by, *KEYS))


def ranked(rows: DataFrame, by: Sequence[str], name: str, out: str = "place") -> DataFrame:
    """Add the place in each group by the cumulative keys, then name. Equal keys are numbered over ranges of names, so no task has all of them."""
    placed = _by_cells(rows, [*by, *KEYS], lambda cells: cells.withColumn("_rank", _first(by)))
    peers = [*by, *KEYS]
    counted = scan.numbered(scan.ranged(placed, peers, [name]), peers, [name], "_number")
    return scan.plain(counted.withColumn(out, F.col("_rank") + F.col("_number") - 1)).drop("_rank", "_number")


def quota_with_ties(rows: DataFrame, by: Sequence[str], quota: Column, name: str, eligible: Column | None = None) -> DataFrame:
    """Add ``chosen``, ``tied`` and ``slot`` among eligible rows.

    The first ``quota`` rows are chosen and with them all that equal the last of
    them; those are tied if some equal lies outside the quota. The quota is one of the
    group.
    """
    usable = rows.withColumns({"_e": F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False)), "_quota": quota})
    group = [*by, "_e"]

    def decide(cells: DataFrame) -> DataFrame:
        placed = cells.withColumns({"_rank": _first(group), "_n": _peers(group)})
        chosen = F.col("_e") & (F.col("_rank") <= F.col("_quota"))
        return placed.withColumns({"chosen": F.coalesce(chosen, F.lit(False)), "tied": F.coalesce(chosen & (F.col("_rank") + F.col("_n") - 1 > F.col("_quota")), F.lit(False))}).drop("_n")

    peers = [*group, *KEYS]
    out = scan.ranged(_by_cells(usable, [*by, "_e", "_quota", *KEYS], decide), peers, [name])
    out = scan.plain(scan.numbered(out, peers, [name], "_number"))
    slot = F.when(F.col("chosen"), (F.col("_rank") + F.col("_number") - 1).cast("long"))
    return out.withColumn("slot", slot).drop("_e", "_quota", "_rank", "_number")


def select_group(
    athletes: DataFrame, by: Sequence[str], region: str, name: str, national: int | Column, first_region: int | Column, other_region: int | Column,
    least: int | Column, excluded: Column,
) -> DataFrame:
    """Nested selection: excluded rows (place 0), national quota, then regional quotas among the qualified rest.

    Adds ``place``, ``selected`` (MULTINATIONS, TR, BÖLGE, BARAJ_YOK or -), ``tied``,
    ``slot`` and ``region_place``. The national quota asks for points above 0, the
    regional ones for ``least``; region 1 has its own quota, a null or 0 region none.
    Quotas are numbers, or columns of the group as ``with_quotas`` adds them. All is
    decided over distinct keys; rows are only numbered among their equals, over ranges of
    names (one range serves both numbers, as equals in a region are equals in the group).
    """
    r = F.col(region)
    marked = athletes.withColumn("_x", F.coalesce(excluded, F.lit(False))).withColumn(region, F.coalesce(region, F.lit(0)))
    marked = marked.withColumns({
        "_national": F.lit(national), "_least": F.lit(least), "_regional": F.when(r == 1, F.lit(first_region)).when(r > 1, F.lit(other_region)).otherwise(F.lit(0)),
    })
    whole, local = [*by, "_x"], [*by, region, "_rest"]

    def decide(cells: DataFrame) -> DataFrame:
        cells = cells.withColumns({"_rank": _first(whole), "_n": _peers(whole)})
        cells = cells.withColumn("_tr", ~F.col("_x") & (F.col("k3") > 0) & (F.col("_rank") <= F.col("_national")))
        cells = cells.withColumn("_rest", ~F.col("_x") & ~F.col("_tr") & (F.col("k3") >= F.col("_least")))
        cells = cells.withColumns({"_place": _first(local), "_m": _peers(local)})
        taken = F.col("_rest") & (F.col("_place") <= F.col("_regional"))
        status = F.when(F.col("_x"), "MULTINATIONS").when(F.col("_tr"), "TR").when(taken, "BÖLGE").when(~F.col("_rest"), "BARAJ_YOK").otherwise("-")
        beyond = lambda first, n, quota: F.col(first) + F.col(n) - 1 > F.col(quota)
        tied = (F.col("_tr") & beyond("_rank", "_n", "_national")) | (taken & beyond("_place", "_m", "_regional"))
        return cells.withColumns({"selected": status, "tied": tied}).drop("_n", "_m")

    out = scan.ranged(_by_cells(marked, [*by, region, "_x", "_national", "_least", "_regional", *KEYS], decide), [*whole, *KEYS], [name])
    out = scan.numbered(out, [*whole, *KEYS], [name], "_number")
    out = scan.plain(scan.numbered(out, [*local, *KEYS], [name], "_local"))
    out = out.withColumns({
        "place": F.when(F.col("_x"), F.lit(0).cast("long")).otherwise((F.col("_rank") + F.col("_number") - 1).cast("long")),
        "region_place": F.when(F.col("_rest"), (F.col("_place") + F.col("_local") - 1).cast("long")),
    })
    slot = F.when(F.col("selected") == "TR", F.col("place")).when(F.col("selected") == "BÖLGE", F.col("region_place"))
    return out.withColumn("slot", slot).drop("_x", "_national", "_least", "_regional", "_rank", "_tr", "_rest", "_place", "_number", "_local")


def with_quotas(rows: DataFrame, quotas: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add each group's quotas (``tr``, ``region_1``, ``region_other``, ``min_points``); a group without any selects nobody."""
    names = ("tr", "region_1", "region_other", "min_points")
    joined = rows.join(quotas.select(*on, *names), list(on), "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in names[:3]}).withColumn("min_points", F.coalesce("min_points", F.lit(2**31 - 1)))


def violations(rows: DataFrame, by: Sequence[str], place: str = "place") -> DataFrame:
    """Rows whose keys rise against the row before them in rank."""
    own = F.struct(*KEYS)
    placed = scan.ranged(rows.where(F.col(place) > 0), by, [place])
    seen = scan.plain(scan.neighbours(placed, by, [place], own, "_before", "_after"))
    return seen.where(own > F.col("_before")).drop("_before", "_after")


def passed_over(rows: DataFrame, by: Sequence[str], region: str, least: int) -> DataFrame:
    """Regions with a qualified, unselected row that is better than a regionally selected one."""
    key = F.struct(*KEYS)
    grouped = rows.groupBy(*by, region).agg(
        F.max(F.when((F.col("selected") == "-") & (F.col("k3") >= least), key)).alias("best_left"),
        F.min(F.when(F.col("selected") == "BÖLGE", key)).alias("worst_taken"),
    )
    return grouped.where("best_left > worst_taken")


def validate(
    rows: DataFrame, by: Sequence[str], region: str, name: str, least: int, sequences: DataFrame, keys: Sequence[str], restricted, place: str = "place"
) -> DataFrame:
    """Faults of a ranking: (by..., ``fault``, ``name``, ``place``), one row for each row and kind of fault.

    ``order``: the keys rise against the row one place before. ``total``: k3 rises
    against the row before it. ``restricted``: of the first six events in ``sequences``
    (keys, events) more than one is restricted. ``limit``: selected below ``least``
    points. ``passed``: selected by region though a qualified, unselected row of that
    region is better. Rows without a place (0) are listed, not ranked: only the last
    three kinds look at them.
    """
    own = F.struct(*KEYS)
    placed = scan.ranged(rows.where(F.col(place) > 0), by, [place])
    seen = scan.plain(scan.neighbours(placed, by, [place], F.struct(F.col(place).alias("place"), own.alias("keys")), "_before", "_after"))
    seen = seen.withColumns({
        "order": (F.col("_before.place") == F.col(place) - 1) & (own > F.col("_before.keys")),
        "total": F.col("k3") > F.col("_before.keys.k3"),
    }).drop("_before", "_after")
    seen = seen.unionByName(rows.where(F.col(place) == 0), allowMissingColumns=True)
    taken = F.col("selected").isin("TR", "BÖLGE")
    left = rows.where((F.col("selected") == "-") & (F.col("k3") >= least)).groupBy(*by, F.coalesce(region, F.lit(0)).alias("_region")).agg(F.max(own).alias("_left"))
    seen = seen.withColumn("_region", F.coalesce(region, F.lit(0))).join(left, [*by, "_region"], "left").join(sequences, list(keys), "left")
    checks = {
        "order": F.col("order"), "total": F.col("total"), "restricted": F.size(F.filter(F.slice("events", 1, 6), restricted)) > 1,
        "limit": taken & (F.col("k3") < least), "passed": (F.col("selected") == "BÖLGE") & (F.col("_left") > own),
    }
    faults = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in checks.items())))
    return seen.select(*by, F.explode(faults).alias("fault"), F.col(name).alias("name"), place)


def _counts(events: Column):
    return lambda e: F.struct(e["event"].alias("event"), e["points"].alias("points"), e["restricted"].alias("restricted"), F.array_contains(events, e["event"]).alias("in_top3"))


def shown_events(scores: DataFrame, keys: Sequence[str], event: str, lists: dict[str, str], restricted: Column) -> DataFrame:
    """(keys, a list of events for each of ``lists``, ``_top_<list>``): events by falling points, each with whether it is restricted and whether it counts among the first three; and the sum of those.

    ``lists`` names a points column of ``scores`` (keys, event, points...) for each; an
    event without points is in no list. One aggregate makes all lists: a person has few events.
    """
    is_r = F.coalesce(restricted, F.lit(False))

    def collected(points: str) -> Column:
        entry = F.struct((-F.col(points)).alias("o"), is_r.alias("restricted"), F.col(event).alias("event"), F.col(points).alias("points"))
        return F.array_sort(F.collect_list(F.when(F.col(points).isNotNull(), entry)))

    each = scores.groupBy(*keys).agg(*(collected(points).alias(name) for name, points in lists.items()))
    shown = {}
    for name in lists:
        # The first restricted one is the best of them; free ones come first among equals.
        one = F.slice(F.filter(name, lambda e: e["restricted"]), 1, 1)
        top = F.slice(F.array_sort(F.concat(F.filter(name, lambda e: ~e["restricted"]), one)), 1, 3)
        ordered = F.array_sort(F.transform(name, lambda e: F.struct(e["o"], e["event"], e["points"], e["restricted"])))
        counted = F.transform(top, lambda e: e["event"])
        shown[f"_top_{name}"] = F.aggregate(top, F.lit(0).cast("long"), lambda n, e: n + e["points"])
        shown[f"_shown_{name}"] = F.transform(ordered, _counts(counted))
    out = each.withColumns(shown)
    return out.select(*keys, *(F.col(f"_shown_{n}").alias(n) for n in lists), *(f"_top_{n}" for n in lists))


def output_rows(
    ranked: DataFrame, scores: DataFrame, legs: Sequence[str], winners: DataFrame, pending: DataFrame, keys: Sequence[str], gender: str, name: str,
    event: str, restricted: Column, labels: dict[str, str], least: int | Column,
) -> DataFrame:
    """One published row for each ranked person.

    ``ranked`` comes from ``select_group`` with ``seq``; ``scores`` has the most points
    by keys and event, over all (``combined``) and in each of ``legs`` (``leg_<leg>``),
    as ``leg_scores`` gives them; ``winners`` (leg, gender, event, winner) and
    ``pending`` (keys, event, entry) what was won and what is still to come. Adds
    ``top3``, ``seq_display``, ``selected_label`` (itself if unknown), ``qualifies``,
    ``first_place``, ``events``, ``events_<leg>``, ``top3_<leg>`` and ``pending_events``;
    who has none gets empty arrays and 0.
    """
    from .score import sequence_display

    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    out = ranked.withColumns({
        "top3": F.col("k3"), "seq_display": sequence_display(F.col("seq")), "selected_label": F.coalesce(table[F.col("selected")], F.col("selected")),
        "qualifies": (F.col("k3") >= least) | (F.col("selected") == "MULTINATIONS"),
    })
    columns = {"events": "combined"} | {f"events_{leg}": f"leg_{leg}" for leg in legs}
    lists = shown_events(scores, keys, event, columns, restricted)
    out = out.join(lists, list(keys), "left").withColumns({c: F.coalesce(c, F.array().cast(lists.schema[c].dataType)) for c in columns})
    out = out.withColumns({f"top3_{leg}": F.coalesce(f"_top_events_{leg}", F.lit(0).cast("long")) for leg in legs}).drop(*(f"_top_{c}" for c in columns))
    won = winners.groupBy(F.col(gender), F.col("winner").alias(name)).agg(F.array_sort(F.collect_list(F.struct("leg", event))).alias("first_place"))
    open_ = pending.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(event, "entry"))).alias("pending_events"))
    return _with_list(_with_list(out, won, [gender, name], "first_place"), open_, keys, "pending_events")


def _with_list(rows: DataFrame, lists: DataFrame, on: Sequence[str], column: str) -> DataFrame:
    empty = F.array().cast(lists.schema[column].dataType)
    return rows.join(lists, list(on), "left").withColumn(column, F.coalesce(column, empty))
