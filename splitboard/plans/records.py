"""Queries over resolution, state, text, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import fuzzy, report, resolve, state
from ..session import table
from ..sources import html as pages_html
from . import binding as b

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, marks: bool = False):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {b.MARKS_SQL} {sql}" if marks else sql
        return f

    return add


@query("""WITH k AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN p_brand || ' x' WHEN 2 THEN p_type ELSE 'none' END AS key FROM part),
d1 AS (SELECT p_brand AS k1, arg_min(p_partkey, p_partkey) AS hit FROM part GROUP BY 1), d2 AS (SELECT p_brand || ' x' AS k2, max(p_partkey) AS hit FROM part GROUP BY 1),
d3 AS (SELECT p_type AS k3, min(p_partkey) AS hit FROM part GROUP BY 1)
SELECT p_partkey, key, CAST(CASE WHEN d1.hit IS NOT NULL THEN 1 WHEN d2.hit IS NOT NULL THEN 2 WHEN d3.hit IS NOT NULL THEN 3 END AS BIGINT) AS stage, coalesce(d1.hit, d2.hit, d3.hit) AS hit
FROM k LEFT JOIN d1 ON key = k1 LEFT JOIN d2 ON key = k2 LEFT JOIN d3 ON key = k3""")
def fallback_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    n = F.pmod("p_partkey", F.lit(4))
    rows = part.select("p_partkey", F.when(n == 0, F.col("p_brand")).when(n == 1, F.concat("p_brand", F.lit(" x"))).when(n == 2, F.col("p_type")).otherwise("none").alias("key"))
    first = resolve.one_per_key(part.select("p_brand", F.col("p_partkey").alias("hit")), "p_brand", "hit")
    last = resolve.one_per_key(part.select(F.concat("p_brand", F.lit(" x")).alias("k"), F.col("p_partkey").alias("hit")), "k", "hit", last=True)
    kind = resolve.one_per_key(part.select("p_type", F.col("p_partkey").alias("hit")), "p_type", "hit")
    return resolve.fallback_lookup(rows, [("key", first, "p_brand"), ("key", last, "k"), ("key", kind, "p_type")])


@query(f"SELECT DISTINCT key FROM ({ORACLES['fallback_lookup']}) WHERE stage IS NULL")
def missing_keys(spark, sf_dir):
    return resolve.misses(fallback_lookup(spark, sf_dir), "key")


@query("""WITH o AS (SELECT p_brand AS name, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_size END AS year, p_partkey AS id, p_type AS value FROM part WHERE p_partkey % 7 = 0),
e AS (SELECT name, year, arg_max(value, id) AS v FROM o WHERE year IS NOT NULL GROUP BY 1, 2), a AS (SELECT name, arg_max(value, id) AS v FROM o WHERE year IS NULL GROUP BY 1)
SELECT p_partkey, coalesce(e.v, a.v) AS value FROM part LEFT JOIN e ON p_brand = e.name AND p_size = e.year LEFT JOIN a ON p_brand = a.name""")
def wildcard_override(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.col("p_brand").alias("name"), F.col("p_size").alias("year"))
    overrides = part.where("p_partkey % 7 = 0").select(F.col("p_brand").alias("name"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("year"), F.col("p_partkey").alias("id"), F.col("p_type").alias("value"))
    return resolve.wildcard_override(rows, overrides, "name", "year", "id", ["value"]).select("p_partkey", "value")


@query("SELECT p_partkey, first_value(p_name) OVER (PARTITION BY lower(p_type), p_size ORDER BY p_partkey) AS canonical FROM part")
def canonical_first(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return resolve.canonical_first(part, "p_name", F.lower("p_type"), ["p_size"], "p_partkey").select("p_partkey", "canonical")


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 9 = 0)")
def exclusion_semi(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").where("s_suppkey % 9 = 0").select(F.col("s_nationkey").alias("c_nationkey"))
    return resolve.excluded(table(spark, sf_dir, "customer"), names, ["c_nationkey"], True).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 9 = 0)")
def exclusion_anti(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").where("s_suppkey % 9 = 0").select(F.col("s_nationkey").alias("c_nationkey"))
    return resolve.excluded(table(spark, sf_dir, "customer"), names, ["c_nationkey"], False).select("c_custkey")


@query("""SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)""")
def add_absent(spark, sf_dir):
    have = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return resolve.add_absent(have, new, ["id"])


@query("""SELECT coalesce(a.k, b.k) AS k, a.v AS value_a, b.v AS value_b, CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'both' ELSE 'differs' END AS status
FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS v FROM customer WHERE c_custkey % 4 <> 0) b ON a.k = b.k""")
def roster_full_outer(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    moved = rows.where("k % 4 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return resolve.roster_compare(rows.where("k % 3 <> 0"), moved, ["k"], "v")


@query("""SELECT a.p_type, a.p_partkey AS a, b.p_partkey AS b, CAST(levenshtein(a.p_name, b.p_name) AS BIGINT) AS edits FROM part a JOIN part b
ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey WHERE levenshtein(a.p_name, b.p_name) <= 3""")
def fuzzy_pairs(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("block", F.concat_ws("|", "p_type", "p_size"))
    pairs = resolve.fuzzy_pairs(part, "block", "p_name", "p_partkey", 3)
    return pairs.select(F.split_part("block", F.lit("|"), F.lit(1)).alias("p_type"), "a", "b", "edits")


_SPELLED = r"trim(regexp_replace(regexp_replace(lower(p_name), '[,;:()/_#!?-]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH k AS (SELECT p_partkey AS pos, p_name AS name, p_type, p_brand, {_SPELLED} AS norm, replace({_SPELLED}, ' ', '') AS ns, split_part({_SPELLED}, ' ', -1) AS sn FROM part),
n AS (SELECT sn, ns, min(pos) AS pos, arg_min(name, pos) AS n1, arg_min(p_brand, pos) AS b1, arg_max(name, pos) AS n3, arg_max(p_brand, pos) AS b3 FROM k WHERE sn <> '' GROUP BY sn, ns),
m AS (SELECT *, min(pos) OVER (PARTITION BY sn) AS seen FROM n),
near AS (
  SELECT row(1, a.seen, b.seen, a.pos, b.pos) AS rank, a.ns AS ns1, b.ns AS ns2, a.n1 AS name1, b.n1 AS name2, a.b1 AS p_brand1, b.b1 AS p_brand2
  FROM m a JOIN m b ON a.sn = b.sn AND a.pos < b.pos
  UNION ALL SELECT row(3, a.seen, b.seen, a.pos, b.pos), a.ns, b.ns, a.n3, b.n3, a.b3, b.b3
  FROM m a JOIN m b ON a.seen < b.seen AND levenshtein(a.sn, b.sn) <= 2 AND a.ns <> b.ns
), best AS (
  SELECT *, levenshtein(ns1, ns2) AS edits FROM near WHERE levenshtein(ns1, ns2) <= 3
  QUALIFY row_number() OVER (PARTITION BY least(ns1, ns2), greatest(ns1, ns2) ORDER BY rank) = 1
), e AS (SELECT ns, list(DISTINCT p_type) AS t FROM k GROUP BY ns), s AS (
  SELECT *, row_number() OVER (PARTITION BY ns ORDER BY pos) AS i FROM (SELECT ns, norm, min(pos) AS pos, arg_min(name, pos) AS name, arg_min(p_brand, pos) AS b FROM k GROUP BY ns, norm)
)
SELECT name1, name2, CAST(edits AS BIGINT) AS edits, array_to_string(list_sort(list_intersect(x.t, y.t)), ',') AS shared_events, len(list_intersect(x.t, y.t)) = 0 AS likely_same, p_brand1, p_brand2
FROM best JOIN e x ON x.ns = ns1 JOIN e y ON y.ns = ns2
UNION ALL SELECT a.name, b.name, 0, '', true, a.b, b.b FROM s a JOIN s b ON a.ns = b.ns AND a.i = 1 AND b.i = 2""")
def similar_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    found = resolve.similar_names(part, "p_name", text.normalize_for_lookup(F.col("p_name")), "p_partkey", ["p_type"], ["p_brand"])
    return found.withColumn("shared_events", F.array_join(F.transform("shared_events", lambda e: e["p_type"]), ","))


@query(r"""WITH r AS (SELECT p_partkey AS pos, p_brand, p_size, CASE WHEN p_partkey % 5 = 0 THEN p_name[1] || '. ' || split_part(p_name, ' ', -1) ELSE p_name END AS seen FROM part),
k AS (SELECT *, regexp_matches(seen, '^[A-Za-z]{1,2}\. ') AS short, lower(split_part(seen, ' ', -1)) AS sn, lower(CASE WHEN regexp_matches(seen, '^[A-Za-z]{1,2}\. ') THEN split_part(seen, '.', 1) ELSE seen[1] END) AS initial FROM r WHERE contains(seen, ' ')),
o AS (SELECT short, sn, initial, seen, min(pos) AS pos, arg_min(p_brand, pos) AS club, arg_min(p_size, pos) AS year FROM k GROUP BY ALL)
SELECT a.seen AS abbrev_name, b.seen AS full_name, a.club AS abbrev_club, b.club AS full_club, a.year IS NOT DISTINCT FROM b.year AS year_match
FROM o a JOIN o b ON a.short AND NOT b.short AND a.sn = b.sn AND a.initial = b.initial""")
def abbreviation_report(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    seen = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.substring("p_name", 1, 1), F.lit(". "), F.split_part("p_name", F.lit(" "), F.lit(-1)))).otherwise(F.col("p_name"))
    return resolve.abbreviation_report(part.withColumn("seen", seen), "seen", "seen", text.normalize_for_lookup, "p_brand", "p_size", "p_partkey")


@query(r"""WITH r AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 5 = 0 THEN p_name[1] || '.' ELSE split_part(p_name, ' ', 1) END AS first, p_brand AS last FROM part),
f AS (SELECT last, p_size, arg_max(first, p_partkey) AS full_first, max(p_partkey) AS full_id FROM r WHERE NOT regexp_matches(first, '^[a-z]\.?$') GROUP BY 1, 2)
SELECT p_partkey, p_size, first, last, full_first, full_id FROM r JOIN f USING (last, p_size) WHERE regexp_matches(first, '^[a-z]\.?$') AND upper(full_first[1]) = upper(first[1])""")
def abbreviation_pairs(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first"), F.col("p_brand").alias("last"))
    rows = part.withColumn("first", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.substring("first", 1, 1), F.lit("."))).otherwise(F.col("first")))
    return resolve.abbreviation_pairs(rows, "last", "first", ["p_size"], "p_partkey")


@query()
def best_fuzzy(spark, sf_dir):
    """Every part with the most similar other name of its brand and size."""
    part = table(spark, sf_dir, "part")
    rows = part.select("p_partkey", "p_brand", "p_size", F.col("p_name").alias("seen"))
    names = part.select("p_brand", "p_size", F.col("p_name").alias("known")).distinct()
    return fuzzy.best_indel(rows, names, ["p_brand", "p_size"], "seen", "known", 82.0, F.col("seen") != F.col("known"))


@query("""SELECT o_custkey, o_orderpriority, cents, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY cents, o_orderkey) AS n
FROM (SELECT *, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)) WHERE n = 1""")
def upsert_min(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), "o_orderkey")
    old = state.upsert_min(rows.limit(0), rows.where("o_orderkey % 2 = 0"), ["o_custkey", "o_orderpriority"], "cents", "o_orderkey")
    return state.upsert_min(old, rows.where("o_orderkey % 2 <> 0"), ["o_custkey", "o_orderpriority"], "cents", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_by(spark, sf_dir):
    return state.latest_by(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_seen, max(o_orderkey) AS last_seen, count(*) AS n FROM orders GROUP BY 1, 2")
def scd_club_history(spark, sf_dir):
    return state.history(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0")
def replace_partition(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return state.replace_partition(rows.where("o_orderkey % 3 = 0"), rows.where("o_orderstatus = 'F' AND o_orderkey % 2 = 0"), "o_orderstatus")


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, -o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def replace_on_storage(spark, sf_dir):
    """All orders in a table by status; those of one status are replaced in it."""
    import uuid

    from ..session import files, shared_dir
    from ..sinks import tables

    path = f"{shared_dir(spark)}/orders-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    tables.write_table(rows, path, ["o_orderstatus"])
    files(spark, path, lambda fs, at: fs.deleteOnExit(at))
    tables.replace_partitions(rows.where("o_orderstatus = 'F'").withColumn("o_custkey", -F.col("o_custkey")), path, ["o_orderstatus"])
    return spark.read.schema(rows.schema).parquet(path)


# Starts without gender count as M; the thresholds are those of the marks, by group.
@query(""", v AS (SELECT *, seq // 500 AS ev FROM marks), r AS (SELECT * FROM v WHERE leg = 'F' AND ev % 2 = 0), s AS (SELECT athlete, ev, grp, seq, cents, points FROM (SELECT *, seq // 500 AS ev FROM scored) WHERE leg = 'O'),
m AS (SELECT max(ev) AS mx FROM r), e AS (SELECT ev, grp, min(ev) AS sq FROM r GROUP BY 1, 2),
o AS (SELECT ev, grp FROM e, m WHERE sq < mx), act AS (SELECT DISTINCT ev FROM e, m WHERE sq = mx), done AS (SELECT DISTINCT athlete, ev FROM r, m WHERE ev = mx)
SELECT athlete, ev, grp, seq, CASE WHEN seq % 3 = 0 THEN 0 ELSE points END AS entry_points FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.ev = s.ev AND o.grp = s.grp)
AND NOT (EXISTS (SELECT 1 FROM act WHERE act.ev = s.ev) AND EXISTS (SELECT 1 FROM done WHERE done.athlete = s.athlete AND done.ev = s.ev))""", marks=True)
def pending_points(spark, sf_dir):
    """What is pending, with what its entry time would earn; every third has none."""
    rows = b.marks(spark, sf_dir).withColumn("ev", F.floor(F.col("seq") / 500))
    results = rows.where("leg = 'F' AND ev % 2 = 0").withColumn("pdf_seq", F.col("ev"))
    starts = rows.where("leg = 'O'").select("athlete", "ev", "grp", "seq", F.when(F.col("seq") % 3 != 0, F.col("cents")).alias("entry"))
    steps = rows.select("ev", "grp").distinct().withColumn("_s", F.explode(F.array(*(F.struct(F.lit(p).alias("points"), F.lit(t).cast("long").alias("limit")) for p, t in b.LIMITS)))).select("ev", "grp", "_s.*")
    left = state.pending(starts, results, ["ev"], "grp", ["athlete"], "pdf_seq")
    return state.with_entry_points(left, steps, ["ev"], "grp", "entry").select("athlete", "ev", "grp", "seq", "entry_points")


@query("""SELECT user_id, status, created FROM (SELECT user_id, arg_max(event_type, event_id) AS status, min(event_id) AS created FROM events GROUP BY user_id)
WHERE status = (SELECT min(event_type) FROM events)""")
def pending_conflicts(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    kind = rows.agg(F.min("event_type")).first()[0]
    return state.conflict_status(rows, "user_id", "event_type", "event_id", kind)


@query("SELECT c_custkey, c_mktsegment, coalesce(s_nationkey, c_nationkey) AS c_nationkey FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def repair_update(spark, sf_dir):
    fixes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"))
    return state.join_update(table(spark, sf_dir, "customer"), fixes, ["c_custkey"], ["c_nationkey"]).select("c_custkey", "c_mktsegment", "c_nationkey")


# Events are runs of 500 orders; only every second one has results, so the others and the last one's open starts are pending.
@query(""", v AS (SELECT *, seq // 500 AS ev FROM marks), r AS (SELECT * FROM v WHERE leg = 'F' AND ev % 2 = 0), s AS (SELECT athlete, ev, grp, seq FROM v WHERE leg = 'O'),
m AS (SELECT max(ev) AS mx FROM r), e AS (SELECT ev, grp, min(ev) AS sq FROM r GROUP BY 1, 2),
o AS (SELECT ev, grp FROM e, m WHERE sq < mx), act AS (SELECT DISTINCT ev FROM e, m WHERE sq = mx), done AS (SELECT DISTINCT athlete, ev FROM r, m WHERE ev = mx)
SELECT athlete, ev, grp, seq FROM s WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.ev = s.ev AND o.grp = s.grp)
AND NOT (EXISTS (SELECT 1 FROM act WHERE act.ev = s.ev) AND EXISTS (SELECT 1 FROM done WHERE done.athlete = s.athlete AND done.ev = s.ev))""", marks=True)
def pending_antijoin(spark, sf_dir):
    rows = b.marks(spark, sf_dir).withColumn("ev", F.floor(F.col("seq") / 500))
    results = rows.where("leg = 'F' AND ev % 2 = 0").withColumn("pdf_seq", F.col("ev"))
    starts = rows.where("leg = 'O'").select("athlete", "ev", "grp", "seq")
    return state.pending(starts, results, ["ev"], "grp", ["athlete"], "pdf_seq").select("athlete", "ev", "grp", "seq")


@query("SELECT c_mktsegment AS norm, count(DISTINCT c_nationkey) AS identities FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1")
def dup_names(spark, sf_dir):
    out = report.duplicate_names(table(spark, sf_dir, "customer"), F.col("c_mktsegment"), [F.col("c_nationkey")], "c_nationkey")
    return out.select("norm", "identities")


@query("""WITH r AS (SELECT *, replace(p_name, ' ', '') AS key, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '') ELSE p_name END AS shown FROM part),
g AS (SELECT *, contains(shown, ' ') OR length(shown) < 8 AS good, row_number() OVER (PARTITION BY key, p_size ORDER BY p_retailprice NULLS LAST, p_partkey) AS n FROM r),
l AS (SELECT key, p_size, arg_min(shown, p_partkey) FILTER (good) AS ls, arg_min(p_brand, p_partkey) FILTER (good) AS lb FROM g GROUP BY 1, 2),
w AS (SELECT key, shown AS ws, p_brand AS wb FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY len(string_split(shown, ' ')) DESC, p_partkey) AS m FROM g) WHERE m = 1)
SELECT p_partkey, key, p_size, CASE WHEN good THEN shown ELSE coalesce(ls, ws) END AS shown, CASE WHEN good THEN p_brand WHEN ls IS NOT NULL THEN lb ELSE wb END AS p_brand
FROM g JOIN l USING (key, p_size) JOIN w USING (key) WHERE n = 1""")
def name_donor(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("shown", F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit(""))).otherwise(F.col("p_name")))
    rows = part.withColumn("key", F.replace("p_name", F.lit(" "), F.lit("")))
    return resolve.donor_names(rows, ["key"], ["p_size"], "shown", "p_retailprice", "p_partkey", ["p_brand"]).select("p_partkey", "key", "p_size", "shown", "p_brand")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'X' ELSE p_brand END AS club, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS city,
CASE WHEN p_partkey % 3 = 0 THEN 'X' END AS o_club, CAST(NULL AS VARCHAR) AS o_city, p_partkey % 3 = 0 OR p_brand IS NOT NULL OR p_type IS NOT NULL AS found FROM part""")
def enrich(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.col("p_brand").alias("club"), F.col("p_type").alias("city"), F.when(F.col("p_partkey") % 3 == 0, "X").alias("o_club"), F.lit(None).cast("string").alias("o_city"))
    return resolve.enrich(rows, ["o_club", "o_city"], ["club", "city"])


# Text and times. Java's and RE2's patterns differ, so SQL states the rules in its own way.
@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[,;:()/_#!?-]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm FROM part""")
def normalize_lookup(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_for_lookup(F.col("p_name")).alias("norm"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS shown FROM part")
def normalize_display(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.normalize_display(F.col("p_name")).alias("shown"))


@query("SELECT doc_id, NOT contains(w, ' ') AND length(w) >= 8 AS fused, regexp_matches(w, '[0-9]') AS digit FROM (SELECT doc_id, coalesce(text, '') AS w FROM documents)")
def dq_flags(spark, sf_dir):
    body = F.coalesce(F.col("text"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", text.is_fused_name(body).alias("fused"), text.has_digit(body).alias("digit"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'small' THEN 'Ufak' WHEN 'bolt' THEN 'Cıvata' ELSE w END), ' ') AS shown,
upper(p_brand[1]) || lower(substr(p_brand, 2)) AS club FROM part""")
def dict_restore(spark, sf_dir):
    words = {"small": "Ufak", "bolt": "Cıvata"}
    return table(spark, sf_dir, "part").select("p_partkey", text.restore_display(F.col("p_name"), words).alias("shown"), text.restore_club(F.col("p_brand"), words).alias("club"))


_SHOWN = "o_orderkey % 59 || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0')"


@query(f"SELECT o_orderkey, {_SHOWN} AS word, (o_orderkey % 59) * 6000 + (o_orderkey % 60) * 100 + o_orderkey % 100 AS cents FROM orders")
def time_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    two = lambda n: F.lpad((k % n).cast("string"), 2, "0")
    word = F.concat((k % 59).cast("string"), F.lit(":"), two(60), F.lit("."), two(100))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", word.alias("word"))
    return rows.withColumn("cents", times.parse_time(F.col("word")))


@query("""SELECT o_orderkey, CASE WHEN c >= 6000 THEN (c // 6000) || ':' || lpad(CAST((c % 6000) // 100 AS VARCHAR), 2, '0') ELSE CAST(c // 100 AS VARCHAR) END || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS shown
FROM (SELECT o_orderkey, o_orderkey % 100000 AS c FROM orders)""")
def time_display(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", times.display_time(F.col("o_orderkey") % 100_000).alias("shown"))


@query("""SELECT o_orderkey, CASE WHEN y <= 26 THEN 2000 + y ELSE 1900 + y END AS year, 2026 - CASE WHEN y <= 26 THEN 2000 + y ELSE 1900 + y END AS age
FROM (SELECT o_orderkey, CAST(o_orderkey % 100 AS INTEGER) AS y FROM orders)""")
def birth_year(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", times.birth_year((F.col("o_orderkey") % 100)).alias("year"))
    return rows.withColumn("age", times.age(F.col("year")))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y.%m.%d') AS day FROM orders")
def race_date(spark, sf_dir):
    d = F.col("o_orderdate")
    iso, free = F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "dd / MM / yyyy")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, iso).otherwise(free).alias("word"))
    return rows.select("o_orderkey", times.race_date(F.col("word")).alias("day"))


# Lines, pages, properties.
@query("""SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS header FROM conversations""")
def header_carry_forward(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    out = report.carry_forward(rows, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.col("turn")), "header")
    return out.select("conv_id", "turn", "header")


@query("SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS block FROM conversations")
def line_blocks(spark, sf_dir):
    return report.blocks(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user").select("conv_id", "turn", "block")


@query("SELECT page_id, href, count(*) * 0 + 1 AS once FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY page_id, href")
def html_links(spark, sf_dir):
    found = pages_html.links(table(spark, sf_dir, "pages"), "page_id", "html")
    return found.select("page_id", "href", F.lit(1).cast("long").alias("once"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?i)<html[^>]*\\blang=\"([^\"]*)\"', 1) AS language FROM pages")
def page_meta(spark, sf_dir):
    return pages_html.page_meta(table(spark, sf_dir, "pages"), "page_id", "html")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""WITH h AS (SELECT user_id, 1 + date_diff('hour', TIMESTAMP '2024-01-01', ts) AS n, count(*) AS files FROM events GROUP BY ALL),
l AS (SELECT *, n - coalesce(lag(n) OVER w, 0) > 12 AS late, lag(n) OVER w AS before FROM h WINDOW w AS (PARTITION BY user_id ORDER BY n)), s AS (SELECT user_id, min(n) FILTER (late) AS stop FROM l GROUP BY user_id)
SELECT user_id, n, files FROM h JOIN s USING (user_id) WHERE stop IS NULL OR n < stop""")
def numbered_probe(spark, sf_dir):
    """A user's hours stand for numbered files: they are looked for up to the first twelve that are missing."""
    hour = (F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - 1_704_067_200) / 3600) + 1).alias("n")
    rows = table(spark, sf_dir, "events").groupBy("user_id", hour).agg(F.count(F.lit(1)).alias("files"))
    return report.before_first_gap(rows, ["user_id"], "n", 12)


@query("""SELECT 'digit' AS "check", min(value) AS value FROM (SELECT p_name AS value FROM part WHERE regexp_matches(p_name, '[0-9]')) GROUP BY lower(value)
UNION ALL SELECT 'brand', arg_min(p_brand, p_partkey) FROM part WHERE regexp_matches(p_brand, '[0-9]') GROUP BY lower(p_brand)
UNION ALL SELECT 'fused', arg_min(p_brand, p_partkey) FROM part WHERE NOT contains(p_brand, ' ') AND length(p_brand) >= 8 GROUP BY lower(p_brand)""")
def quality_report(spark, sf_dir):
    checks = {"digit": ("p_name", text.has_digit(F.col("p_name"))), "brand": ("p_brand", text.has_digit(F.col("p_brand"))), "fused": ("p_brand", text.is_fused_name(F.col("p_brand")))}
    return report.quality_report(table(spark, sf_dir, "part"), checks, text.normalize_for_lookup, "p_partkey")


@query("""SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1 HAVING NOT (arg_max(event_type, event_id) = (SELECT min(event_type) FROM events))
UNION ALL SELECT user_id, 'same_person' FROM (SELECT user_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1) WHERE status = (SELECT min(event_type) FROM events)""")
def resolved_conflicts(spark, sf_dir):
    """Everyone is decided on; only pending conflicts take the decision."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    kind = rows.agg(F.min("event_type")).first()[0]
    told = rows.groupBy("user_id").agg(F.max("event_id").alias("event_id")).select("user_id", F.lit("same_person").alias("event_type"), (F.col("event_id") + 1_000_000_000).alias("event_id"))
    done = state.resolve_conflicts(rows, told, "user_id", "event_type", "event_id", kind)
    return done.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"))


@query("SELECT page_id, '' AS title, '' AS location, '' AS date FROM pages")
def meet_meta(spark, sf_dir):
    """These pages have no table, so no meta; pages with one are tested by hand."""
    return pages_html.meet_meta(table(spark, sf_dir, "pages"), "page_id", "html")


# Set operations and streams.
@query("SELECT s_nationkey AS n FROM supplier UNION ALL SELECT c_nationkey FROM customer")
def union_all(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n")))


@query("SELECT s_nationkey AS n FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_custkey % 50 = 0")
def intersect_keys(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n")).intersect(table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").select("c_nationkey"))


@query("SELECT n_nationkey AS n FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0")
def except_keys(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("n")).exceptAll(table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select("s_nationkey").distinct())


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    from ..streaming import live

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))
    out = live.run_to_table(live.tumbling_counts(stream, "ts", "1 day", "0 seconds", ["event_type"], "value"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, event_type, cents, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY cents, event_id) AS n FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events)) WHERE n = 1")
def stream_upsert(spark, sf_dir):
    import uuid

    from ..session import shared_dir
    from ..streaming import live

    root = shared_dir(spark)
    target = f"{root}/live-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select("user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), "event_id")
    live.upsert_stream(rows, f"{target}/table", ["user_id", "event_type"], "cents", "event_id", f"{target}/progress").awaitTermination()
    return live.newest_version(spark, f"{target}/table").select("user_id", "event_type", "cents", "event_id")
