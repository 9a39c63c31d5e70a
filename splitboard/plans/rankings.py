"""Queries over scores, ranks, selection and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rank, report, score
from . import binding as b

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {b.MARKS_SQL} {sql}" if "marks" in sql or any(t in sql for t in ("scored", "best", "placed", "keyed")) else sql
        return f

    return add


NATIONAL, FIRST_REGION, OTHER_REGION, LEAST, LISTED = 20, 6, 3, 7, 97


@query(f"""
, athl AS (SELECT *, athlete % {LISTED} = 0 AS x FROM keyed),
p AS (SELECT *, CASE WHEN x THEN 0 ELSE row_number() OVER (PARTITION BY grp, x ORDER BY k3 DESC, k4 DESC, k5 DESC, k6 DESC, athlete) END AS place FROM athl),
n AS (SELECT *, NOT x AND k3 > 0 AS e FROM p),
n2 AS (SELECT *, rank() OVER w AS r, count(*) OVER (PARTITION BY grp, e, k3, k4, k5, k6) AS c,
       row_number() OVER (PARTITION BY grp, e ORDER BY k3 DESC, k4 DESC, k5 DESC, k6 DESC, athlete) AS s
       FROM n WINDOW w AS (PARTITION BY grp, e ORDER BY k3 DESC, k4 DESC, k5 DESC, k6 DESC)),
n3 AS (SELECT *, e AND r <= {NATIONAL} AS tr, e AND r <= {NATIONAL} AND r + c - 1 > {NATIONAL} AS tr_tied FROM n2),
g AS (SELECT *, NOT x AND NOT tr AND k3 >= {LEAST} AS q FROM n3),
g2 AS (SELECT *, rank() OVER w AS gr, count(*) OVER (PARTITION BY grp, region, q, k3, k4, k5, k6) AS gc,
       row_number() OVER (PARTITION BY grp, region, q ORDER BY k3 DESC, k4 DESC, k5 DESC, k6 DESC, athlete) AS gs,
       CASE WHEN region = 1 THEN {FIRST_REGION} WHEN region > 1 THEN {OTHER_REGION} ELSE 0 END AS quota
       FROM g WINDOW w AS (PARTITION BY grp, region, q ORDER BY k3 DESC, k4 DESC, k5 DESC, k6 DESC))
SELECT athlete, grp, region, k3, k4, k5, k6, place,
       CASE WHEN x THEN 'MULTINATIONS' WHEN tr THEN 'TR' WHEN q AND gr <= quota THEN 'BÖLGE' WHEN NOT q THEN 'BARAJ_YOK' ELSE '-' END AS selected,
       tr_tied OR (q AND gr <= quota AND gr + gc - 1 > quota) AS tied,
       CASE WHEN tr THEN s WHEN q AND gr <= quota THEN gs END AS slot, CASE WHEN q THEN gs END AS region_place
FROM g2""")
def flagship_selection(spark, sf_dir):
    chosen = rank.select_group(
        b.keyed(spark, sf_dir), ["grp"], "region", "athlete", NATIONAL, FIRST_REGION, OTHER_REGION, LEAST, F.col("athlete") % LISTED == 0
    )
    return chosen.select("athlete", "grp", "region", "k3", "k4", "k5", "k6", "place", "selected", "tied", "slot", "region_place")


@query("SELECT athlete, event, seq, cents, points FROM scored")
def threshold_score(spark, sf_dir):
    return b.scored(spark, sf_dir).select("athlete", "event", "seq", "cents", "points")


@query("SELECT athlete, event, seq, points FROM scored")
def threshold_join(spark, sf_dir):
    steps = [(e, p, t) for e in b.EVENTS for p, t in b.LIMITS]
    table = spark.createDataFrame(steps, "event string, points int, limit long")
    return score.threshold_join(b.marks(spark, sf_dir), table, ["event"], "cents").select("athlete", "event", "seq", "points")


@query("SELECT athlete, event, points, cents, seq, leg FROM best")
def best_per_event(spark, sf_dir):
    return b.best(spark, sf_dir).select("athlete", "event", "points", "cents", "seq", "leg")


@query("SELECT leg, grp, event, arg_min(athlete, cents * 1000000000 + seq) AS winner, min(cents) AS best FROM marks WHERE cents > 0 GROUP BY ALL")
def event_winners(spark, sf_dir):
    return score.winners(b.marks(spark, sf_dir), ["leg", "grp", "event"], "athlete", "cents", "seq")


@query("""SELECT athlete, max(points) FILTER (leg = 'F') AS leg_f, max(points) FILTER (leg = 'O') AS leg_o, max(points) FILTER (leg = 'P') AS leg_p,
       max(points) AS combined FROM scored WHERE points > 0 GROUP BY athlete""")
def leg_scores(spark, sf_dir):
    return score.leg_scores(b.scored(spark, sf_dir), ["athlete"], "leg", b.LEGS, "points")


@query("SELECT athlete, event, max(points) AS points FROM scored WHERE points > 0 AND leg IN ('F', 'O') GROUP BY ALL")
def merge_scores(spark, sf_dir):
    each = b.scored(spark, sf_dir).where("points > 0").groupBy("athlete", "leg", "event").agg(F.max("points").alias("points"))
    maps = each.groupBy("athlete", "leg").agg(F.map_from_entries(F.collect_list(F.struct("event", "points"))).alias("m"))
    left = maps.where("leg = 'F'").select("athlete", F.col("m").alias("a"))
    right = maps.where("leg = 'O'").select("athlete", F.col("m").alias("b"))
    none = F.create_map().cast("map<string,bigint>")
    both = left.join(right, "athlete", "full_outer").withColumn("m", score.merge_maps(F.coalesce("a", none), F.coalesce("b", none)))
    return both.select("athlete", F.explode("m").alias("event", "points"))


@query("SELECT athlete, grp, region, k3, k4, k5, k6 FROM keyed")
def cumulative_keys(spark, sf_dir):
    return b.keyed(spark, sf_dir).drop("seq")


@query("""SELECT athlete, array_to_string(list_reverse(list_sort(list_concat(list(points) FILTER (event <> '1-URGENT'), [coalesce(max(points) FILTER (event = '1-URGENT'), 0)]))), ',') AS seq
FROM best GROUP BY athlete""")
def constrained_sequence(spark, sf_dir):
    return b.keyed(spark, sf_dir).select("athlete", F.array_join(F.transform("seq", lambda x: x.cast("string")), ",").alias("seq"))


@query("""SELECT athlete, array_to_string(s[1:3], '+') || CASE WHEN len(s) > 3 THEN ' | ' || array_to_string(s[4:6], ' ') ELSE '' END AS shown
FROM (SELECT athlete, list_reverse(list_sort(list_concat(list(points) FILTER (event <> '1-URGENT'), [coalesce(max(points) FILTER (event = '1-URGENT'), 0)]))) AS s
FROM best GROUP BY athlete)""")
def seq_display(spark, sf_dir):
    return b.keyed(spark, sf_dir).select("athlete", score.sequence_display(F.col("seq")).alias("shown"))


@query("""SELECT b.athlete, b.event, coalesce(p.rp <= 3, false) AS in_top
FROM best b LEFT JOIN (SELECT athlete, event, row_number() OVER (PARTITION BY athlete ORDER BY points DESC, event = '1-URGENT', event) AS rp FROM placed) p
ON b.athlete = p.athlete AND b.event = p.event""")
def in_top3(spark, sf_dir):
    return score.in_top(b.best(spark, sf_dir), ["athlete"], "event", "points", b.restricted()).select("athlete", "event", "in_top")


@query("""SELECT athlete, grp, r <= 20 AS chosen, r <= 20 AND r + c - 1 > 20 AS tied, CASE WHEN r <= 20 THEN s END AS slot FROM (
SELECT *, rank() OVER (PARTITION BY grp ORDER BY k3 DESC, k4 DESC, k5 DESC, k6 DESC) AS r, count(*) OVER (PARTITION BY grp, k3, k4, k5, k6) AS c,
row_number() OVER (PARTITION BY grp ORDER BY k3 DESC, k4 DESC, k5 DESC, k6 DESC, athlete) AS s FROM keyed)""")
def quota_with_ties(spark, sf_dir):
    out = rank.quota_with_ties(b.keyed(spark, sf_dir), ["grp"], F.lit(NATIONAL), "athlete")
    return out.select("athlete", "grp", "chosen", "tied", "slot")


@query("SELECT athlete, grp, region, row_number() OVER (PARTITION BY grp, region ORDER BY k3 DESC, k4 DESC, k5 DESC, k6 DESC, athlete) AS place FROM keyed WHERE k3 >= 7")
def region_rank(spark, sf_dir):
    return rank.ranked(b.keyed(spark, sf_dir).where("k3 >= 7"), ["grp", "region"], "athlete").select("athlete", "grp", "region", "place")


def _rising(order: str) -> str:
    keys = "row(k3, k4, k5, k6)"
    return f"SELECT grp, {keys} > lag({keys}) OVER (PARTITION BY grp ORDER BY {order}) AS bad FROM keyed"


@query(f"""SELECT grp, ranked, CAST(count(*) FILTER (bad) AS BIGINT) AS n FROM (
SELECT *, 'keys' AS ranked FROM ({_rising("k3 DESC, k4 DESC, k5 DESC, k6 DESC, athlete")}) UNION ALL SELECT *, 'athlete' FROM ({_rising("athlete")})) GROUP BY ALL HAVING n > 0""")
def monotonic_check(spark, sf_dir):
    """Violations of the ranking by keys (none) and of one by athlete (many)."""
    keyed = b.keyed(spark, sf_dir)
    by_athlete = keyed.withColumn("place", F.row_number().over(Window.partitionBy("grp").orderBy("athlete")))
    found = [rank.violations(rows, ["grp"]).select("grp", F.lit(name).alias("ranked")) for name, rows in (("keys", rank.ranked(keyed, ["grp"], "athlete")), ("athlete", by_athlete))]
    return found[0].unionAll(found[1]).groupBy("grp", "ranked").agg(F.count(F.lit(1)).alias("n"))


@query(f""", s AS (SELECT *, row(k3, k4, k5, k6) AS key FROM keyed),
g AS (SELECT grp, region, max(key) FILTER (athlete % 3 = 1 AND k3 >= {LEAST}) AS l, min(key) FILTER (athlete % 3 = 0) AS t FROM s GROUP BY 1, 2)
SELECT grp, region, l[1] AS left_k3, l[2] AS left_k4, t[1] AS taken_k3, t[2] AS taken_k4 FROM g WHERE l > t""")
def passed_over(spark, sf_dir):
    """Of a selection by identifier, which passes better athletes over."""
    by_id = F.col("athlete") % 3
    rows = b.keyed(spark, sf_dir).withColumn("selected", F.when(by_id == 0, "BÖLGE").when(by_id == 1, "-").otherwise("TÜRKİYE"))
    found = rank.passed_over(rows, ["grp"], "region", LEAST)
    sides = (("left", "best_left"), ("taken", "worst_taken"))
    return found.select("grp", "region", *(F.col(f"{c}.{k}").alias(f"{n}_{k}") for n, c in sides for k in ("k3", "k4")))


@query("""SELECT CASE WHEN grouping(grp) = 1 THEN NULL ELSE grp END AS grp, leg, CAST(grouping(grp) AS BIGINT) AS overall,
count(*) FILTER (points >= 7) AS strong, count(*) FILTER (points = 0) AS none, count(*) AS total FROM scored GROUP BY GROUPING SETS ((leg), (grp, leg))""")
def club_tally_sets(spark, sf_dir):
    flags = {"strong": F.col("points") >= 7, "none": F.col("points") == 0}
    return report.tally_sets(b.scored(spark, sf_dir), "leg", "grp", flags)


@query("""SELECT grp, region, CAST(grouping(grp, region) AS BIGINT) AS level, count(*) FILTER (points > 0) AS paid, count(*) AS total
FROM scored GROUP BY ROLLUP (grp, region)""")
def summary_rollup(spark, sf_dir):
    return report.rollup_totals(b.scored(spark, sf_dir), ["grp", "region"], {"paid": F.col("points") > 0})


@query("SELECT grp, count(*) FILTER (k3 >= 7) AS qualified, count(*) FILTER (k3 >= 15) AS strong, count(*) AS total FROM keyed GROUP BY grp")
def selection_counts(spark, sf_dir):
    return b.keyed(spark, sf_dir).groupBy("grp").agg(F.count_if(F.col("k3") >= 7).alias("qualified"), F.count_if(F.col("k3") >= 15).alias("strong"), F.count(F.lit(1)).alias("total"))


@query("SELECT count(DISTINCT athlete) AS persons, count(*) AS n_rows, string_agg(DISTINCT leg, ',' ORDER BY leg) AS legs FROM marks")
def stats_row(spark, sf_dir):
    return report.stats(b.marks(spark, sf_dir), ["athlete"], "leg")


@query("SELECT leg, count(*) AS n_rows, count(DISTINCT athlete) AS persons, round(100.0 * count(*) FILTER (region > 0) / count(*), 2) AS with_region FROM marks GROUP BY leg")
def source_stats(spark, sf_dir):
    rows = b.marks(spark, sf_dir).groupBy("leg")
    share = F.round(100.0 * F.count_if(F.col("region") > 0) / F.count(F.lit(1)), 2)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("athlete").alias("persons"), share.alias("with_region"))


_PIVOT = ", ".join(f"min(cents) FILTER (event = '{e}') AS t_{i}" for i, e in enumerate(b.EVENTS, 1))


@query(f"SELECT athlete, {_PIVOT} FROM marks GROUP BY athlete")
def pivot_min(spark, sf_dir):
    return report.pivot_min(b.marks(spark, sf_dir), ["athlete"], "event", b.EVENTS, "cents")


@query("SELECT athlete, event, min(cents) AS cents FROM marks GROUP BY athlete, event")
def unpivot_events(spark, sf_dir):
    return report.unpivot(pivot_min(spark, sf_dir), ["athlete"], {f"t_{i}": e for i, e in enumerate(b.EVENTS, 1)}, "event", "cents")


@query("""SELECT event, athlete, seq, cents FROM (SELECT *, (lag(cents) OVER w + lead(cents) OVER w) / 2 AS near, median(cents) OVER (PARTITION BY grp, region, event) AS med,
count(*) OVER (PARTITION BY grp, region, event) AS n FROM marks WHERE cents > 0 WINDOW w AS (PARTITION BY grp, region, event ORDER BY seq)) WHERE n >= 3 AND
(coalesce(cents < near / 1.45 OR cents > near * 1.45, false) OR cents < 0.6 * med OR cents > 3.0 * med)""")
def neighbor_anomaly(spark, sf_dir):
    rows = report.neighbour_anomalies(b.marks(spark, sf_dir), ["grp", "region", "event"], "cents", ["seq"])
    return rows.select("event", "athlete", "seq", "cents")


@query("""SELECT event, min(cents) AS least, max(cents) AS greatest, min(cents) < CASE event WHEN '5-LOW' THEN 9000000000 ELSE 1 END AS too_low,
max(cents) > CASE event WHEN '5-LOW' THEN 9900000000 ELSE 99999 END AS too_high FROM marks GROUP BY event""")
def event_outliers(spark, sf_dir):
    limits = spark.createDataFrame([("5-LOW", 9_000_000_000, 9_900_000_000)], "event string, lo long, hi long")
    return report.outliers(b.marks(spark, sf_dir), "event", "cents", limits, (1, 99_999))


@query("SELECT event, median(cents) AS middle FROM marks GROUP BY event")
def event_median(spark, sf_dir):
    return b.marks(spark, sf_dir).groupBy("event").agg(F.median("cents").alias("middle"))


@query("SELECT athlete, grp, place FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY k3 DESC, athlete) AS place FROM keyed) WHERE place <= 5")
def top5_per_group(spark, sf_dir):
    return report.top_of_group(b.keyed(spark, sf_dir), ["grp"], [F.desc("k3"), F.asc("athlete")], 5).select("athlete", "grp", "place")


@query("SELECT leg, event, min(seq) AS first_seq, max(seq) AS last_seq FROM marks GROUP BY leg, event")
def event_sequence(spark, sf_dir):
    return b.marks(spark, sf_dir).groupBy("leg", "event").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("""SELECT w.leg, w.grp, w.event, w.winner, k.k3 FROM (SELECT leg, grp, event, arg_min(athlete, cents * 1000000000 + seq) AS winner FROM marks WHERE cents > 0 GROUP BY ALL) w
LEFT JOIN keyed k ON w.winner = k.athlete""")
def winners_join(spark, sf_dir):
    won = event_winners(spark, sf_dir).drop("best")
    people = b.keyed(spark, sf_dir).select(F.col("athlete").alias("winner"), "k3")
    return won.join(people, "winner", "left")


@query(""", p AS (SELECT grp, region, athlete, list({'event': event, 'points': points} ORDER BY points DESC, event) AS events FROM best JOIN (SELECT DISTINCT athlete AS a FROM keyed) ON a = athlete GROUP BY 1, 2, 3)
SELECT grp, region, CAST(to_json(list({'athlete': athlete, 'events': events} ORDER BY athlete)) AS VARCHAR) AS athletes FROM p GROUP BY 1, 2""")
def nested_json(spark, sf_dir):
    from ..sinks.files import nested

    return nested(b.best(spark, sf_dir), ["grp", "region"], ["athlete"], ["event", "points"], -F.col("points"))


@query("""SELECT athlete, string_agg(event, ',' ORDER BY points DESC, event = '1-URGENT', event DESC) AS events FROM placed GROUP BY athlete""")
def counted_events(spark, sf_dir):
    out = score.event_sequence(b.best(spark, sf_dir), ["athlete"], "event", "points", b.restricted())
    return out.select("athlete", F.array_join("events", ",").alias("events"))


_QUOTAS = (("AUTOMOBILE", 5, 2, 1, 7), ("BUILDING", 10, 4, 2, 7), ("FURNITURE", 20, 6, 3, 9), ("HOUSEHOLD", 0, 6, 3, 12))


@query(f"""
, q AS (SELECT * FROM (VALUES {", ".join(map(str, _QUOTAS))}) t(grp, tr, region_1, region_other, min_points)),
r AS (SELECT k.*, coalesce(tr, 0) AS tr, coalesce(region_1, 0) AS region_1, coalesce(region_other, 0) AS region_other, coalesce(min_points, 2147483647) AS least,
  rank() OVER (PARTITION BY grp, k3 > 0 ORDER BY k3 DESC, k4 DESC, k5 DESC, k6 DESC) AS n FROM keyed k LEFT JOIN q USING (grp)),
c AS (SELECT *, k3 > 0 AND n <= tr AS top FROM r), d AS (SELECT *, NOT top AND k3 >= least AS ok FROM c),
e AS (SELECT *, CASE WHEN region = 1 THEN region_1 WHEN region > 1 THEN region_other ELSE 0 END AS quota,
  rank() OVER (PARTITION BY grp, region, ok ORDER BY k3 DESC, k4 DESC, k5 DESC, k6 DESC) AS m FROM d)
SELECT athlete, grp, CASE WHEN top THEN 'TR' WHEN ok AND m <= quota THEN 'BÖLGE' WHEN NOT ok THEN 'BARAJ_YOK' ELSE '-' END AS selected FROM e""")
def selection_by_quota(spark, sf_dir):
    """Quotas from a table; a group that it lacks selects nobody."""
    quotas = spark.createDataFrame(list(_QUOTAS), "grp string, tr int, region_1 int, region_other int, min_points int")
    rows = rank.with_quotas(b.keyed(spark, sf_dir), quotas, ["grp"])
    limits = (F.col(c) for c in ("tr", "region_1", "region_other", "min_points"))
    return rank.select_group(rows, ["grp"], "region", "athlete", *limits, F.lit(False)).select("athlete", "grp", "selected")


# A ranking by identifier with selections by parity, so that there is every kind of fault; two events count as restricted.
@query(f"""
, r AS (SELECT *, row(k3, k4, k5, k6) AS own, row_number() OVER (PARTITION BY grp ORDER BY athlete) AS place,
  CASE WHEN region = 0 THEN 'TR' WHEN athlete % 2 = 0 THEN 'BÖLGE' ELSE '-' END AS selected FROM keyed),
s AS (SELECT athlete, list(event ORDER BY points DESC, event = '1-URGENT', event DESC)[1:6] AS events FROM placed GROUP BY athlete),
l AS (SELECT grp, region, max(own) AS best_left FROM r WHERE selected = '-' AND k3 >= {LEAST} GROUP BY 1, 2),
x AS (SELECT *, lag(own) OVER w AS before FROM r WINDOW w AS (PARTITION BY grp ORDER BY place)),
y AS (SELECT x.*, events, best_left FROM x LEFT JOIN s USING (athlete) LEFT JOIN l ON l.grp = x.grp AND l.region = x.region)
SELECT grp, 'order' AS fault, athlete AS name, place FROM y WHERE own > before
UNION ALL SELECT grp, 'total', athlete, place FROM y WHERE k3 > before[1]
UNION ALL SELECT grp, 'restricted', athlete, place FROM y WHERE len(list_filter(events, lambda e: e IN ('1-URGENT', '2-HIGH'))) > 1
UNION ALL SELECT grp, 'limit', athlete, place FROM y WHERE selected <> '-' AND k3 < {LEAST}
UNION ALL SELECT grp, 'passed', athlete, place FROM y WHERE selected = 'BÖLGE' AND best_left > own""")
def ranking_faults(spark, sf_dir):
    w = Window.partitionBy("grp").orderBy("athlete")
    chosen = F.when(F.col("region") == 0, "TR").when(F.col("athlete") % 2 == 0, "BÖLGE").otherwise("-")
    rows = b.keyed(spark, sf_dir).withColumns({"place": F.row_number().over(w).cast("long"), "selected": chosen})
    events = score.event_sequence(b.best(spark, sf_dir), ["athlete"], "event", "points", b.restricted())
    return rank.validate(rows, ["grp"], "region", "athlete", LEAST, events, ["athlete"], lambda e: e.isin("1-URGENT", "2-HIGH"))


def _list_sql(leg: str | None) -> str:
    rows = f"SELECT athlete, event, max(points) AS points FROM scored WHERE points > 0 {f"AND leg = '{leg}'" if leg else ''} GROUP BY 1, 2"
    return f"""(SELECT athlete, string_agg(event || ':' || points || ':' || (event = '1-URGENT') || ':' || (u AND rp <= 3), ',' ORDER BY points DESC, event) AS events,
  sum(CASE WHEN u AND rp <= 3 THEN points ELSE 0 END) AS top3 FROM (SELECT *, true AS u, row_number() OVER (PARTITION BY athlete ORDER BY points DESC, event = '1-URGENT', event) AS rp FROM ({rows})) GROUP BY 1)"""


@query(f"""
SELECT f.athlete, f.grp, f.place, f.selected, coalesce(CASE f.selected WHEN 'TR' THEN 'TR Kadro' WHEN 'BÖLGE' THEN 'Bölge' END, f.selected) AS selected_label, f.k3 AS top3, f.k3 >= {LEAST} OR f.selected = 'MULTINATIONS' AS qualifies,
  f.tied, e.events, coalesce(lf.events, '') AS events_f, coalesce(lo.events, '') AS events_o, CAST(coalesce(lf.top3, 0) AS BIGINT) AS top3_f, CAST(coalesce(lo.top3, 0) AS BIGINT) AS top3_o, coalesce(w.won, '') AS first_place, coalesce(p.open, '') AS pending_events
FROM ({ORACLES["flagship_selection"]}) f LEFT JOIN {_list_sql(None)} e USING (athlete) LEFT JOIN {_list_sql("F")} lf USING (athlete) LEFT JOIN {_list_sql("O")} lo USING (athlete)
LEFT JOIN (SELECT winner AS athlete, grp, string_agg(leg || ':' || event, ',' ORDER BY leg, event) AS won FROM ({ORACLES["event_winners"]}) GROUP BY 1, 2) w ON w.athlete = f.athlete AND w.grp = f.grp
LEFT JOIN (SELECT athlete, string_agg(event || ':' || cents, ',' ORDER BY event, cents) AS open FROM marks WHERE leg = 'P' GROUP BY 1) p ON p.athlete = f.athlete""")
def output_rows(spark, sf_dir):
    """The published rows, their lists shown as text."""
    ranked = rank.select_group(b.keyed(spark, sf_dir), ["grp"], "region", "athlete", NATIONAL, FIRST_REGION, OTHER_REGION, LEAST, F.col("athlete") % LISTED == 0)
    scores = score.leg_scores(b.scored(spark, sf_dir), ["athlete", "event"], "leg", ("F", "O"), "points")
    pending = b.marks(spark, sf_dir).where("leg = 'P'").select("athlete", "event", F.col("cents").alias("entry"))
    out = rank.output_rows(
        ranked, scores, ("f", "o"), event_winners(spark, sf_dir), pending, ["athlete"], "grp", "athlete", "event", b.restricted(), {"TR": "TR Kadro", "BÖLGE": "Bölge"}, LEAST
    )
    shown = lambda c, *parts: F.array_join(F.transform(c, lambda e: F.concat_ws(":", *(e[p].cast("string") for p in parts))), ",").alias(c)
    lists = [shown(c, "event", "points", "restricted", "in_top3") for c in ("events", "events_f", "events_o")]
    return out.select(
        "athlete", "grp", "place", "selected", "selected_label", "top3", "qualifies", "tied", *lists, "top3_f", "top3_o", shown("first_place", "leg", "event"), shown("pending_events", "event", "entry")
    )


@query("""SELECT athlete, event, max(points) FILTER (leg = 'F') AS leg_f, max(points) FILTER (leg = 'O') AS leg_o, max(points) FILTER (leg = 'P') AS leg_p, max(points) AS combined,
any_value(g) AS grp, any_value(l) AS leg FROM scored JOIN (SELECT athlete AS a, arg_min(grp, seq) AS g, arg_max(leg, seq) AS l FROM scored WHERE points > 0 GROUP BY 1) ON a = athlete WHERE points > 0 GROUP BY athlete, event""")
def leg_map(spark, sf_dir):
    return report.leg_map(b.scored(spark, sf_dir), ["athlete"], ["event"], "leg", b.LEGS, "points", "seq", ["grp"], ["leg"])


@query("""SELECT athlete, grp, string_agg(event || ':' || points, ',' ORDER BY event) AS scores FROM (SELECT athlete, grp, event, max(points) AS points FROM scored WHERE points > 0 GROUP BY ALL) GROUP BY ALL""")
def event_map(spark, sf_dir):
    out = report.event_map(b.scored(spark, sf_dir), ["athlete"], ["event"], "points", ["grp"])
    entries = F.array_sort(F.transform(F.map_entries("scores"), lambda e: F.concat_ws(":", e["key"]["event"], e["value"].cast("string"))))
    return out.select("athlete", "grp", F.array_join(entries, ",").alias("scores"))


@query("SELECT region, count(DISTINCT name) AS n_keys FROM marks GROUP BY 1")
def keys_by_region(spark, sf_dir):
    return report.keys_by(b.marks(spark, sf_dir), "name", "region")


@query("SELECT n_regionkey, string_agg(DISTINCT lower(n_name), ',' ORDER BY lower(n_name)) AS names FROM nation GROUP BY 1")
def exclusion_names(spark, sf_dir):
    from ..session import table

    return report.names_by(table(spark, sf_dir, "nation"), "n_name", ["n_regionkey"]).select("n_regionkey", F.array_join("names", ",").alias("names"))


@query("""SELECT grp, CAST(sum(k) AS BIGINT) AS qualified, CAST(count(*) AS BIGINT) AS total FROM (SELECT grp, CAST(k3 >= 7 AS INT) AS k FROM keyed) GROUP BY 1
UNION ALL SELECT 'TOPLAM', CAST(sum(CAST(k3 >= 7 AS INT)) AS BIGINT), count(*) FROM keyed""")
def summary_total(spark, sf_dir):
    from ..sinks.layouts import summary_sheet

    return summary_sheet(selection_counts(spark, sf_dir), "grp", ["qualified", "total"])
